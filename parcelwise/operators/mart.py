"""Order items rolled up to orders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.constants import DELAY_SALT, DEFAULT_PENALTY, SESSION_DEFAULTS
from parcelwise.functions.scalars import clip_unit, hash_id, risk_bucket, to_number
from parcelwise.operators.codes import POSITION, Codes
from parcelwise.operators.money import MONEY, Scope, expected_penalty, session_scope, with_decision_columns


def first_value(name: str, order_by: Sequence[str]) -> Column:
    """First non-null value in file order; merges map-side, unlike a window."""
    position = F.struct(*order_by)
    return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), position)).alias(name)


def first_values(
    rows: DataFrame, names: Sequence[str], order_by: Sequence[str], codes: Codes | None
) -> tuple[DataFrame, list[Column], Callable[[DataFrame], DataFrame]]:
    """The rows to group, the first value of each column, and what is done to the roll-up.

    With ``codes`` position and texts are numbers, so the roll-up is a hash aggregate; without them texts make
    each task sort its rows.
    """
    if codes is None:
        return rows, [first_value(c, order_by) for c in names], lambda out: out
    coded = codes.encode(rows.withColumn(POSITION, codes.position(rows, order_by)), names)
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(POSITION))).alias(c) for c in names]
    return coded, first, codes.decode


def mean_exact(name: str, places: int = 4) -> Column:
    """Mean of a decimal column rounded half up."""
    total = F.sum(F.col(name).cast("decimal(8,4)"))
    return F.round(total / F.count(name), places).cast("decimal(8,4)").alias(name)


def money_sum(name: str) -> Column:
    return F.sum(F.col(name).cast(MONEY)).cast(MONEY).alias(name)


def delay_rollup(pred: DataFrame, key: str, order_by: Sequence[str], codes: Codes | None = None) -> DataFrame:
    """Mean score, any late item, highest cost, first descriptive values."""
    rows, first, finish = first_values(pred.where(F.col(key).isNotNull()), ("shipping_mode", "order_region", "order_ts"), order_by, codes)
    return finish(rows.groupBy(key).agg(
        mean_exact("p_late"),
        F.max("true_label").alias("true_label"),
        F.max("upgrade_cost").alias("upgrade_cost"),
        *first,
    ))


def profit_rollup(items: DataFrame, key: str, order_by: Sequence[str], salt: str = DELAY_SALT, codes: Codes | None = None) -> DataFrame:
    """Summed actual and predicted profit with the order's dimensions."""
    rows, (segment, category, customer), finish = first_values(
        items.where(F.col(key).isNotNull()), ("customer_segment", "category_name", "customer_id"), order_by, codes
    )
    rolled = rows.groupBy(key).agg(
        money_sum("profit_actual"), money_sum("profit_pred"), segment, category, mean_exact("discount_rate"), customer
    )
    return finish(rolled).withColumn("customer_id_hash", hash_id(F.col("customer_id"), salt))


def decision_mart(
    pred: DataFrame, items: DataFrame, key: str, order_by: Sequence[str], penalty=DEFAULT_PENALTY, codes: Codes | None = None
) -> DataFrame:
    """Delay side and profit side joined per order.

    Both sides are grouped on the join key, so the join adds no shuffle. Items
    of orders without a prediction fall out in the join itself.
    """
    joined = delay_rollup(pred, key, order_by, codes).join(profit_rollup(items, key, order_by, codes=codes), key, "inner")
    return with_decision_columns(joined, penalty)


def decision_mart_single(
    items: DataFrame, key: str, order_by: Sequence[str], penalty=DEFAULT_PENALTY, dims: Sequence[str] = (
        "customer_segment", "order_region", "category_name", "shipping_mode", "order_ts", "customer_id",
    ), codes: Codes | None = None,
) -> DataFrame:
    """The same mart from one frame carrying scores and profits: one scan, one shuffle.

    Only the dimensions asked for are carried through the shuffle.
    """
    rows, first, finish = first_values(items.where(F.col(key).isNotNull()), dims, order_by, codes)
    rolled = rows.groupBy(key).agg(
        mean_exact("p_late"),
        F.max("true_label").alias("true_label"),
        F.max("upgrade_cost").alias("upgrade_cost"),
        money_sum("profit_actual"),
        money_sum("profit_pred"),
        mean_exact("discount_rate"),
        *first,
    )
    return with_decision_columns(finish(rolled), penalty)


def order_state(items: DataFrame, key: str, order_by: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """What a batch of items adds to its orders: sums, counts, maxima, and each dimension's first value with its position.

    States of the same order are merged by :func:`merged_state`, in any grouping and any order of batches.
    """
    def first(name: str) -> Column:
        value = F.struct(*[F.col(c).alias(f"at{i}") for i, c in enumerate(order_by)], F.col(name).alias("value"))
        return F.min(F.when(F.col(name).isNotNull(), value)).alias(f"first_{name}")

    def total(name: str) -> list[Column]:
        return [F.sum(F.col(name).cast("decimal(8,4)")).cast("decimal(28,4)").alias(f"{name}_sum"), F.count(name).alias(f"{name}_n")]

    return items.where(F.col(key).isNotNull()).groupBy(key).agg(
        *total("p_late"), *total("discount_rate"), F.max("true_label").alias("true_label"), F.max("upgrade_cost").alias("upgrade_cost"),
        money_sum("profit_actual"), money_sum("profit_pred"), *[first(c) for c in dims],
    )


def merged_state(states: DataFrame, key: str, dims: Sequence[str]) -> DataFrame:
    """One state per order from several."""
    sums = [F.sum(f"{c}_sum").cast("decimal(28,4)").alias(f"{c}_sum") for c in ("p_late", "discount_rate")]
    counts = [F.sum(f"{c}_n").alias(f"{c}_n") for c in ("p_late", "discount_rate")]
    best = [F.max(c).alias(c) for c in ("true_label", "upgrade_cost")]
    return states.groupBy(key).agg(*sums, *counts, *best, money_sum("profit_actual"), money_sum("profit_pred"), *[F.min(f"first_{c}").alias(f"first_{c}") for c in dims])


def mart_of_states(state: DataFrame, key: str, dims: Sequence[str], penalty=DEFAULT_PENALTY) -> DataFrame:
    """The decision mart that :func:`decision_mart_single` gives for all items behind the states."""
    def mean(name: str) -> Column:
        return F.round(F.try_divide(F.col(f"{name}_sum"), F.col(f"{name}_n")), 4).cast("decimal(8,4)").alias(name)

    rolled = state.select(
        key, mean("p_late"), "true_label", "upgrade_cost", "profit_actual", "profit_pred", mean("discount_rate"), *[F.col(f"first_{c}.value").alias(c) for c in dims]
    )
    return with_decision_columns(rolled, penalty)


def items_of_orders(items: DataFrame, orders: DataFrame, key: str) -> DataFrame:
    """Semi join; the key side is made distinct before it is shuffled."""
    return items.join(orders.select(key).distinct(), key, "left_semi")


def orders_missing(pred: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Predicted orders that have no item: one row per order."""
    return pred.select(key).distinct().join(items.select(key).distinct(), key, "left_anti")


def join_rows(left: DataFrame, right: DataFrame, row_key: Sequence[str]) -> DataFrame:
    """Columns of two tables put side by side by the row key given at ingest.

    Row positions mean nothing in a distributed table, so the key travels with
    the rows.
    """
    return left.join(right.select(*row_key, *[c for c in right.columns if c not in left.columns]), list(row_key))


def hydrate(orders: DataFrame, pred: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """Missing order fields taken from the first prediction row of the order.

    Only predictions of the wanted orders are grouped; a key that the orders lack is not looked up.
    """
    extra = [c for c in pred.columns if c not in orders.columns]
    wanted = pred.join(orders.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
    first = wanted.groupBy(key).agg(
        F.min_by(F.struct(*extra), F.struct(*order_by)).alias("first")
    )
    return orders.join(first, key, "left").select(orders["*"], "first.*")


def session_rows(pred: DataFrame, row_id: str) -> DataFrame:
    """Uploaded prediction rows with defaults, clipped scores and generated ids."""
    out = pred
    texts = ("shipping_mode", "order_region", "customer_segment", "category_name", "market")
    numbers = ("days_for_shipment", "product_price", "order_item_quantity", "discount_rate", "upgrade_cost")
    cols: dict[str, Column] = {}
    for c in texts:
        value = F.col(c) if c in out.columns else F.lit(None).cast("string")
        cols[c] = F.coalesce(value, F.lit(SESSION_DEFAULTS[c]))
    for c in numbers:
        value = to_number(F.col(c)) if c in out.columns else F.lit(None).cast("double")
        cols[c] = F.coalesce(value, F.lit(float(SESSION_DEFAULTS[c])))
    cols["p_late"] = clip_unit(F.coalesce(to_number(F.col("p_late")), F.lit(0.0))).cast("decimal(8,4)")
    cols["sales"] = to_number(F.col("sales")) if "sales" in out.columns else F.lit(None).cast("double")
    if "order_date" not in out.columns:
        cols["order_date"] = F.lit(None).cast("string")
    given = F.col("order_id_hash").cast("string") if "order_id_hash" in out.columns else F.lit(None).cast("string")
    made_up = hash_id(F.concat(F.lit("session_order_"), F.col(row_id).cast("string")), length=32)
    cols["order_id_hash"] = F.when(F.trim(F.coalesce(given, F.lit(""))) == "", made_up).otherwise(given)
    out = out.withColumns(cols)
    if "customer_id_hash" not in out.columns:
        made_up = hash_id(F.concat(F.lit("session_customer_"), F.col("order_id_hash")), length=32)
        out = out.withColumn("customer_id_hash", made_up)
    return out


def session_mart(
    scored: DataFrame, order_by: Sequence[str], labelled: bool, penalty=DEFAULT_PENALTY
) -> tuple[DataFrame, Scope]:
    """Order table of an upload whose items carry ``profit_pred``.

    ``labelled`` is a parameter, see :func:`fully_labelled`; without labels the
    delay cost is the expected one and no order is called a false positive.
    """
    scope = session_scope(labelled)
    label = F.max(F.col("true_label").cast("int")) if labelled else F.lit(None).cast("int")
    rolled = scored.groupBy("order_id_hash").agg(
        *[
            first_value(c, order_by)
            for c in ("customer_id_hash", "order_date", "customer_segment", "order_region", "category_name", "shipping_mode")
        ],
        mean_exact("discount_rate"),
        mean_exact("p_late"),
        money_sum("profit_pred"),
        F.max("upgrade_cost").cast("decimal(12,2)").alias("upgrade_cost"),
        label.alias("true_label"),
    )
    return (
        rolled.withColumns(
            {
                "risk_bucket": risk_bucket(F.col("p_late")),
                "profit_actual": F.col("profit_pred"),
                "profit_resid": F.lit(0).cast(MONEY),
                "expected_penalty": expected_penalty(F.col("p_late"), penalty),
                "net_of_service": scope.net(penalty),
                "epar": F.round(F.col("profit_pred") * F.col("p_late"), 4).cast(MONEY),
                "is_false_positive_value": F.lit(0),
            }
        ),
        scope,
    )


def fully_labelled(pred: DataFrame) -> bool:
    """True only if every row carries a known outcome."""
    if "true_label" not in pred.columns:
        return False
    label = to_number(F.col("true_label"))
    row = pred.agg(F.count("*").alias("n"), F.count(label).alias("known")).first()
    return row["n"] > 0 and row["n"] == row["known"]
