"""Scores turned into money. Amounts are DECIMAL, so sums do not depend on task order."""

from __future__ import annotations

from decimal import Decimal
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.constants import (
    DEFAULT_MODE_COST, DEFAULT_PENALTY, DEFAULT_REGION_MULTIPLIER, DEFAULT_UNIT_COST,
    MODE_BASE_COST, REGION_MULTIPLIER,
)
from parcelwise.functions.scalars import lookup, risk_bucket

MONEY = "decimal(18,4)"


def dec(value) -> Column:
    return F.lit(Decimal(str(value)))


def mode_cost(mode: Column) -> Column:
    return lookup(MODE_BASE_COST, mode, DEFAULT_MODE_COST)


def region_multiplier(region: Column) -> Column:
    return lookup(REGION_MULTIPLIER, region, DEFAULT_REGION_MULTIPLIER)


def upgrade_cost(mode: Column, region: Column, ratio=1) -> Column:
    """Base cost of the mode x region multiplier x ratio, in cents."""
    return F.round(mode_cost(mode) * region_multiplier(region) * dec(ratio), 2).cast("decimal(12,2)")


def expected_penalty(p_late: Column, penalty=DEFAULT_PENALTY) -> Column:
    return (p_late * dec(penalty)).cast(MONEY)


def with_prediction_money(df: DataFrame, penalty=DEFAULT_PENALTY, ratio=1) -> DataFrame:
    """Bucket, expected penalty and upgrade cost next to each score."""
    return df.withColumns(
        {
            "risk_bucket": risk_bucket(F.col("p_late")),
            "expected_penalty": F.round(expected_penalty(F.col("p_late"), penalty), 2).cast("decimal(12,2)"),
            "upgrade_cost": upgrade_cost(F.col("shipping_mode"), F.col("order_region"), ratio),
        }
    )


def join_rate_card(df: DataFrame, modes: DataFrame, regions: DataFrame, ratio=1) -> DataFrame:
    """Upgrade cost from rate-card tables ``(shipping_mode, base_cost)`` and ``(order_region, multiplier)``.

    Left joins on trimmed keys, first tariff row per key. Whether a side is
    broadcast is decided by its measured size, not by a hint.
    """
    mode_side = modes.groupBy(F.trim("shipping_mode").alias("_mode")).agg(F.min("base_cost").alias("_base"))
    region_side = regions.groupBy(F.trim("order_region").alias("_region")).agg(F.min("multiplier").alias("_mult"))
    base = F.coalesce(F.col("_base"), F.lit(DEFAULT_MODE_COST))
    multiplier = F.coalesce(F.col("_mult"), F.lit(DEFAULT_REGION_MULTIPLIER))
    return (
        df.join(mode_side, F.trim(df["shipping_mode"]) == F.col("_mode"), "left")
        .join(region_side, F.trim(df["order_region"]) == F.col("_region"), "left")
        .withColumn("upgrade_cost", F.round(base * multiplier * dec(ratio), 2).cast("decimal(12,2)"))
        .drop("_mode", "_base", "_region", "_mult")
    )


def upload_profit(sales: Column, margin: Column) -> Column:
    """Book profit of an uploaded row in cents, NULL unless both parts are numbers."""
    return F.round(sales.try_cast("decimal(18,4)") * margin.try_cast("decimal(9,6)"), 2).cast("decimal(18,2)")


@dataclass(frozen=True)
class Scope:
    """Which profit and which delay cost a report rests on."""

    name: str = "historical_validation"
    profit_column: str = "profit_actual"
    labelled: bool = True

    @property
    def false_positive_available(self) -> bool:
        return self.labelled

    @property
    def delay_cost_basis(self) -> str:
        return "actual_late_label" if self.labelled else "expected_probability"

    @property
    def profit_basis(self) -> str:
        return "actual_profit" if self.profit_column == "profit_actual" else "predicted_profit"

    def delay_cost(self, penalty) -> Column:
        exposure = F.col("true_label" if self.labelled else "p_late").cast("decimal(8,4)")
        return (F.coalesce(exposure, dec(0)) * dec(penalty)).cast(MONEY)

    def profit(self) -> Column:
        return F.coalesce(F.col(self.profit_column).cast(MONEY), dec(0).cast(MONEY))

    def net(self, penalty) -> Column:
        return (self.profit() - self.delay_cost(max(Decimal(0), Decimal(str(penalty))))).cast(MONEY)


HISTORY = Scope()


def session_scope(labelled: bool) -> Scope:
    return Scope("session_upload", "profit_pred", labelled)


def with_value_risk(
    df: DataFrame, value_axis: str = "net_of_service", risk_axis: str = "p_late",
    penalty=DEFAULT_PENALTY, scope: Scope = HISTORY,
) -> DataFrame:
    """Value and risk axes of the portfolio view, without touching other columns."""
    net = scope.net(penalty)
    use_label = risk_axis == "true_label" and scope.labelled
    risk = F.col("true_label" if use_label else "p_late").cast("decimal(8,4)")
    flag = ((scope.profit() > 0) & (net < 0)).cast("int") if scope.false_positive_available else F.lit(0)
    return df.withColumns(
        {
            "net_of_service": net,
            "value": net if value_axis == "net_of_service" else scope.profit(),
            "risk": F.coalesce(risk, dec(0)),
            "is_false_positive_value": flag,
        }
    )


def with_decision_columns(df: DataFrame, penalty=DEFAULT_PENALTY) -> DataFrame:
    """Money columns of the order mart."""
    net = HISTORY.net(penalty)
    return df.withColumns(
        {
            "expected_penalty": expected_penalty(F.col("p_late"), penalty),
            "net_of_service": net,
            "epar": F.round(F.col("profit_actual") * F.col("p_late"), 4).cast(MONEY),
            "profit_resid": (F.col("profit_actual") - F.col("profit_pred")).cast(MONEY),
            "is_false_positive_value": ((F.col("profit_actual") > 0) & (net < 0)).cast("int"),
            "risk_bucket": risk_bucket(F.col("p_late")),
        }
    )


def with_net_benefit(df: DataFrame) -> DataFrame:
    net = (F.col("expected_penalty") - F.col("upgrade_cost")).cast(MONEY)
    return df.withColumns(
        {
            "net_benefit": net,
            "roi": F.try_divide(net.cast("double"), F.col("upgrade_cost").cast("double")),
        }
    )


def complete_fields(
    df: DataFrame, penalty=DEFAULT_PENALTY, unit_cost=DEFAULT_UNIT_COST, cost_basis: str = "auto"
) -> DataFrame:
    """Bucket, unrounded penalty and upgrade cost for the selection.

    ``cost_basis``: ``given`` scales the costs in the table, ``rate_card`` ignores
    them, ``auto`` looks at the whole table: any cost missing or other than the
    placeholder 80 means the table brings its own costs.
    """
    scale = Decimal(str(unit_cost)) / DEFAULT_UNIT_COST if unit_cost else Decimal(1)
    card = upgrade_cost(F.col("shipping_mode"), F.col("order_region"), scale)
    if cost_basis == "rate_card" or "upgrade_cost" not in df.columns:
        cost = card
    else:
        given = F.round(F.col("upgrade_cost") * dec(scale), 2).cast("decimal(12,2)")
        if cost_basis == "given":
            cost = given
        else:
            own = F.col("upgrade_cost").isNull() | (F.col("upgrade_cost") != dec(80))
            brings_own = df.agg(F.coalesce(F.bool_or(own), F.lit(False)).alias("own")).scalar()
            cost = F.when(brings_own, given).otherwise(card)
    return df.withColumns(
        {
            "risk_bucket": risk_bucket(F.col("p_late")),
            "expected_penalty": expected_penalty(F.col("p_late"), penalty),
            "upgrade_cost": cost,
        }
    )
