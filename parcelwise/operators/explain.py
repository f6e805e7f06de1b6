"""Per-order factors and texts, from given feature importances."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.constants import HIGH_RISK
from parcelwise.functions.scalars import display_id
from parcelwise.operators.money import MONEY

# fixed values: how many factors are shown and when a region counts as risky
TOP_GLOBAL = 3
MAX_FACTORS = 4
RISKY_REGION_MEAN = 0.55


def region_scores(pred: DataFrame) -> DataFrame:
    """Summed score and row count per trimmed region."""
    return pred.groupBy(F.trim("order_region").alias("region_key")).agg(
        F.sum(F.col("p_late").cast("decimal(8,4)")).alias("total"), F.count("p_late").alias("n")
    )


def with_region_mean(orders: DataFrame, pred: DataFrame) -> DataFrame:
    """Region mean of each order, the overall mean where the region is unknown.

    Both come from one roll-up per region, a few dozen rows, which becomes one map: the scores are read once.
    """
    mean = F.round(F.col("total") / F.col("n"), 4).cast("double")
    known = F.collect_list(F.when(F.col("region_key").isNotNull(), F.struct("region_key", mean.alias("m"))))
    overall = F.round(F.sum("total") / F.sum("n"), 4).cast("double")
    means = region_scores(pred).agg(F.struct(F.map_from_entries(known).alias("by_region"), overall.alias("overall")).alias("s")).scalar()
    return orders.withColumn("_means", means).withColumn(
        "region_mean", F.coalesce(F.try_element_at("_means.by_region", F.trim("order_region")), F.col("_means.overall"))
    ).drop("_means")


def recommended_action(bucket: Column, net: Column) -> Column:
    return (
        F.when((bucket == "High") & (net > 0), "upgrade and dispatch first")
        .when((bucket == "Medium") & (net > 0), "keep as upgrade candidate")
        .otherwise("keep current shipping and monitor")
    )


def _factor(feature, label, impact, evidence, weight, specific: bool) -> Column:
    def as_col(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        as_col(feature).alias("feature"), as_col(label).alias("label"), as_col(impact).alias("impact"),
        as_col(evidence).alias("evidence"), F.lit(round(float(weight), 4)).alias("weight"),
        F.lit(int(specific)).alias("order_specific"),
    )


def _region_evidence(region: Column) -> Column:
    return F.concat(region, F.lit(" mean late probability "), F.round(F.col("region_mean") * 100, 0).cast("int").cast("string"), F.lit("%"))


def factors(importances: Mapping[str, float]) -> Column:
    """Array of at most four factors per order.

    The importance list is short and fixed, so the rules unfold into one
    expression: the three strongest features that apply to the order, then the
    order's own mode and region if those are not among them.
    """
    mode = F.coalesce(F.col("shipping_mode"), F.lit("Unknown"))
    region = F.trim(F.coalesce(F.col("order_region"), F.lit("Unknown")))
    risky_region = F.when(F.col("region_mean") >= RISKY_REGION_MEAN, "raises risk").otherwise("neutral")
    slow = F.when(mode == "Standard Class", "raises risk").otherwise("context")
    used = F.concat(F.lit("ships by "), mode)

    entries = []
    for feature, weight in sorted(importances.items(), key=lambda kv: -kv[1]):
        if feature.startswith("Shipping Mode_"):
            entry = _factor(feature, "shipping mode", slow, used, weight, True)
            entry = F.when(mode == feature.split("_", 1)[1], entry)
        elif feature == "Days for shipment (scheduled)":
            tight = F.when(F.col("p_late") >= F.lit(HIGH_RISK), "raises risk").otherwise("context")
            entry = _factor(feature, "promised days", tight, "tight promises run late more often", weight, False)
        elif feature.startswith("Type_"):
            entry = _factor(feature, "order type", "context", feature.replace("_", " "), weight, False)
        elif "Region" in feature or "Country" in feature:
            entry = _factor(feature, "destination region", risky_region, _region_evidence(region), weight, True)
        else:
            entry = _factor(feature, feature.replace("_", " "), "context", "important for the model overall", weight, False)
        entries.append(entry)

    strongest = F.slice(F.filter(F.array(*entries), lambda x: x.isNotNull()), 1, TOP_GLOBAL)
    own_mode = F.when(
        (mode != "Unknown") & ~F.exists(strongest, lambda x: x["label"] == "shipping mode"),
        F.array(_mode_factor(importances, mode, slow, used)),
    ).otherwise(F.array().cast(_FACTOR_ARRAY))
    own_region = F.when(
        ~F.exists(strongest, lambda x: F.lower(x["feature"]).contains("region")),
        F.array(_factor("order_region", "destination region", risky_region, _region_evidence(region), 0.0, True)),
    ).otherwise(F.array().cast(_FACTOR_ARRAY))
    return F.slice(F.concat(strongest.cast(_FACTOR_ARRAY), own_mode.cast(_FACTOR_ARRAY), own_region.cast(_FACTOR_ARRAY)), 1, MAX_FACTORS)


_FACTOR_ARRAY = (
    "array<struct<feature:string,label:string,impact:string,evidence:string,weight:double,order_specific:int>>"
)


def _mode_factor(importances: Mapping[str, float], mode: Column, impact: Column, evidence: Column) -> Column:
    weight = F.lit(0.0)
    for feature, value in importances.items():
        if feature.startswith("Shipping Mode_"):
            weight = F.when(mode == feature.split("_", 1)[1], F.lit(round(float(value), 4))).otherwise(weight)
    return F.struct(
        F.concat(F.lit("Shipping Mode_"), mode).alias("feature"), F.lit("shipping mode").alias("label"),
        impact.alias("impact"), evidence.alias("evidence"), weight.alias("weight"), F.lit(1).alias("order_specific"),
    )


def explain_orders(orders: DataFrame, pred: DataFrame, importances: Mapping[str, float]) -> DataFrame:
    """Net benefit, action, factors and a summary sentence per order."""
    net = (F.col("expected_penalty") - F.col("upgrade_cost")).cast(MONEY)
    out = with_region_mean(orders, pred).withColumn("net_benefit", net)
    out = out.withColumns(
        {"recommended_action": recommended_action(F.col("risk_bucket"), F.col("net_benefit")), "factors": factors(importances)}
    )
    return out.withColumn("manager_summary", narrative())


def narrative() -> Column:
    def whole(name: str) -> Column:
        return F.round(F.col(name), 0).cast("decimal(18,0)").cast("string")

    percent = F.round(F.col("p_late") * 100, 1).cast("decimal(5,1)").cast("string")
    return F.concat(
        F.lit("Risk "), F.upper("risk_bucket"), F.lit(" (p_late="), percent, F.lit("%), ships by "), F.col("shipping_mode"),
        F.lit(" to "), F.trim("order_region"), F.lit(". Penalty at stake USD "), whole("expected_penalty"),
        F.lit(", upgrade USD "), whole("upgrade_cost"), F.lit(", net USD "), whole("net_benefit"),
        F.lit(". Factors: "), F.array_join(F.transform("factors", lambda x: x["label"]), ", "),
        F.lit(". Advice: "), F.col("recommended_action"), F.lit("."),
    )


def factor_rows(explained: DataFrame, key: str) -> DataFrame:
    """One row per order and factor with its position."""
    return explained.select(key, F.posexplode("factors").alias("position", "f")).select(key, "position", "f.*")


def order_list(explained: DataFrame, key: str) -> DataFrame:
    """Order list row: ids, dimensions, score, first factor, action."""
    first = F.try_element_at("factors", F.lit(1))
    return explained.select(
        key, display_id(F.col(key)).alias("display_order_id"), "shipping_mode", "order_region", "p_late", "risk_bucket",
        "upgrade_cost", "expected_penalty",
        F.concat(first["label"], F.lit(": "), first["evidence"]).alias("top_factor"), "recommended_action",
    )


def named_orders(pred: DataFrame, question: str, id_col: str = "order_id_hash") -> DataFrame:
    """Orders whose display id or first eight id characters occur in a text.

    The tokens are taken from the text once, so the table is filtered by
    equality instead of searching the text for every row.
    """
    import re

    tokens = set()
    for word in re.findall(r"[A-Z0-9]+", question.upper()):
        tokens.update(word[i : i + 8] for i in range(len(word) - 7))
    compact = F.substring(F.regexp_replace(F.upper(F.col(id_col)), "[^A-Z0-9]", ""), 1, 8)
    return pred.where(compact.isin(sorted(tokens)) if tokens else F.lit(False))
