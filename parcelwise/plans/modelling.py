"""Splits, features, audits and the two models."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.constants import ID_COLUMNS, MARGIN_ALLOWED, PROFIT_LEAKAGE
from parcelwise.functions.scalars import to_number
from parcelwise.operators import audits, evaluation, features, models
from parcelwise.operators.money import with_prediction_money
from parcelwise.plans.registry import query
from parcelwise.plans.sql import over_items, ratio4
from parcelwise.session import scratch_path, shared_dir, written
from parcelwise.sources import store
from parcelwise.sources.tables import ITEM_KEYS, RAW_NAMES, order_items, raw_orders, table

TIES = ITEM_KEYS
_ORDER = "order_ts, order_id, line_no, product_id, supplier_id, price_cents"
_SPLIT = f"""split_items AS (SELECT *, CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_train + n_val THEN 'val' ELSE 'test' END AS split FROM
      (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rn, round_even(COUNT(*) OVER () * 0.70::DOUBLE, 0) AS n_train,
        round_even(COUNT(*) OVER () * 0.15::DOUBLE, 0) AS n_val FROM items))"""


def _time_split(spark, sf_dir, columns=(), numbers=()):
    """Items with their side; they are written once, since the borders and what follows read them several times.

    ``numbers`` are further columns that are only read as the doubles they become here.
    """
    items = order_items(spark, sf_dir, [*ITEM_KEYS, "order_ts", *columns, *numbers])
    items = written(items.withColumns({c: to_number(F.col(c)) for c in numbers}), "items")
    return features.time_split(items, "order_ts", TIES)


# --- splits -----------------------------------------------------------------------------


@query(
    "ML-06",
    """SELECT o_orderkey AS order_id, CASE WHEN p < 7000 THEN 'train' WHEN p < 8500 THEN 'val' ELSE 'test' END AS split FROM
      (SELECT o_orderkey, ('0x' || substr(sha256('42:' || o_orderkey), 1, 8))::BIGINT % 10000 AS p FROM orders)""",
)
def group_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    return features.group_split(orders, "order_id")


@query(
    "ML-06 AGG-36",
    over_items("""SELECT COUNT(*) FILTER (sides > 1) AS orders_on_two_sides, COUNT(*) AS orders FROM
      (SELECT order_id, 1 AS sides FROM items GROUP BY 1)"""),
)
def split_exclusivity(spark, sf_dir):
    """No order may have items on two sides."""
    items = features.group_split(order_items(spark, sf_dir, ["order_id", "line_no"]), "order_id")
    sides = items.groupBy("order_id").agg((F.min("split") != F.max("split")).cast("int").alias("two"))
    return sides.agg(F.coalesce(F.sum("two"), F.lit(0)).alias("orders_on_two_sides"), F.count("*").alias("orders"))


@query(
    "ML-06",
    """SELECT label, split, COUNT(*) AS n FROM (SELECT l, label, CASE WHEN p < 7000 THEN 'train' WHEN p < 8500 THEN 'val' ELSE 'test' END AS split FROM
      (SELECT doc_id AS l, quality AS label, ('0x' || substr(sha256('42:' || quality || '|' || doc_id), 1, 8))::BIGINT % 10000 AS p FROM labels)) GROUP BY 1, 2""",
)
def stratified_split(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return features.stratified_split(rows, "doc_id", "label").groupBy("label", "split").agg(F.count("*").alias("n"))


@query(
    "ML-07 WIN-07 SNK-01",
    over_items(f", {_SPLIT} SELECT order_id, line_no, product_id, supplier_id, price_cents, split FROM split_items"),
)
def time_split(spark, sf_dir):
    return _time_split(spark, sf_dir).select(*ITEM_KEYS, "split")


@query(
    "AGG-36 SNK-01",
    over_items(f""", {_SPLIT}, parts AS (SELECT split AS part, COUNT(*) AS n, strftime(MIN(order_ts), '%Y-%m-%d') AS first_day,
      strftime(MAX(order_ts), '%Y-%m-%d') AS last_day FROM split_items GROUP BY 1) SELECT *, 1 AS in_order FROM parts"""),
)
def split_integrity(spark, sf_dir):
    """The split written as partitions, read back and checked."""
    path = scratch_path(spark, "splits")
    store.write_splits(_time_split(spark, sf_dir), path)
    checked = audits.split_integrity(spark.read.parquet(path), "order_ts")
    return checked.select(
        "part", "n", F.date_format("first_ts", "yyyy-MM-dd").alias("first_day"),
        F.date_format("last_ts", "yyyy-MM-dd").alias("last_day"), "in_order",
    )


_PROFILE = f"""profile AS (SELECT part, COUNT(*) AS n, ROUND(SUM(y)::DOUBLE/COUNT(*), 4) AS profit_mean, ROUND(median(y::DOUBLE), 4) AS profit_median,
      ROUND(stddev_samp(y::DOUBLE), 4) AS profit_std, {ratio4('COUNT(*) FILTER (y < 0)', 'COUNT(*)')} AS neg_pct,
      {ratio4('COUNT(*) FILTER (y = 0)', 'COUNT(*)')} AS zero_pct, ROUND(skewness(y::DOUBLE), 4) AS skew,
      strftime(MIN(ts), '%Y-%m-%d') AS date_min, strftime(MAX(ts), '%Y-%m-%d') AS date_max FROM
      (SELECT split AS part, profit_actual AS y, order_ts AS ts FROM split_items UNION ALL SELECT 'overall', profit_actual, order_ts FROM split_items) GROUP BY 1)"""


@query("AGG-21", over_items(f", {_SPLIT}, {_PROFILE} SELECT * FROM profile"))
def split_profile(spark, sf_dir):
    return audits.split_profile(_time_split(spark, sf_dir, ["profit_actual"]), "profit_actual", "order_ts")


@query(
    "AGG-22",
    over_items(f""", {_SPLIT}, {_PROFILE} SELECT p.part, CASE WHEN abs(p.neg_pct - o.neg_pct) > 0.07 THEN 1 ELSE 0 END AS loss_share_off,
      CASE WHEN abs(p.profit_mean - o.profit_mean) / abs(o.profit_mean) > 0.5 THEN 1 ELSE 0 END AS mean_off
      FROM profile p, profile o WHERE o.part = 'overall' AND p.part <> 'overall'"""),
)
def balance_warnings(spark, sf_dir):
    profile = audits.split_profile(_time_split(spark, sf_dir, ["profit_actual"]), "profit_actual", "order_ts")
    return audits.balance_warnings(profile)


# --- statistics and codes -----------------------------------------------------------------


@query(
    "AGG-24 PRJ-23",
    over_items("""SELECT shipping_mode, COUNT(*) AS n, SUM(CASE WHEN profit_actual::DOUBLE < lo OR profit_actual::DOUBLE > hi THEN 1 ELSE 0 END)::BIGINT AS outliers,
      ROUND(MIN(lo), 4) AS lower, ROUND(MIN(hi), 4) AS upper FROM items, (SELECT quantile_cont(profit_actual::DOUBLE, 0.01) AS lo,
      quantile_cont(profit_actual::DOUBLE, 0.99) AS hi FROM items) GROUP BY 1"""),
)
def outliers_by_mode(spark, sf_dir):
    items = order_items(spark, sf_dir, ["shipping_mode", "profit_actual"])
    q = features.numeric_quantiles(order_items(spark, sf_dir, ["profit_actual"]), ["profit_actual"], [0.01, 0.99])
    low, high = q[("profit_actual", 0.01)], q[("profit_actual", 0.99)]
    return items.groupBy("shipping_mode").agg(
        F.count("*").alias("n"), F.sum(features.outlier_flag(F.col("profit_actual"), low, high)).alias("outliers"),
        F.round(F.lit(low), 4).alias("lower"), F.round(F.lit(high), 4).alias("upper"),
    )


_NUMERIC = ["product_price", "quantity", "discount_rate", "profit_ratio", "profit_actual", "sales"]


@query(
    "AGG-25 SNK-05",
    over_items(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", ROUND(median({c}::DOUBLE), 4) AS median FROM items" for c in _NUMERIC)),
)
def column_medians(spark, sf_dir):
    found = features.medians(order_items(spark, sf_dir, _NUMERIC), _NUMERIC)
    rows = spark.createDataFrame([(c, float(v)) for c, v in found.items()], "column string, m double")
    return rows.select("column", F.round("m", 4).alias("median"))


@query(
    "AGG-26",
    over_items("""SELECT COUNT(*) FILTER (true_label = 0) AS neg, COUNT(*) FILTER (true_label = 1) AS pos,
      ROUND((COUNT(*) FILTER (true_label = 0))::DOUBLE / COUNT(*) FILTER (true_label = 1), 2) AS weight FROM items"""),
)
def class_ratio(spark, sf_dir):
    items = order_items(spark, sf_dir, ["true_label"])
    counted = items.agg(F.count_if(F.col("true_label") == 0).alias("neg"), F.count_if(F.col("true_label") == 1).alias("pos"))
    return counted.withColumn("weight", F.lit(models.class_weight(items, "true_label")))


_CODED = ["order_region", "category_name", "order_country", "department_name"]
_CODES = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS category, (dense_rank() OVER (ORDER BY {c}) - 1)::INTEGER AS code FROM (SELECT DISTINCT {c} FROM items)" for c in _CODED
)


@query("AGG-28 ML-02 SNK-05", over_items(_CODES))
def category_codes(spark, sf_dir):
    return features.category_codes(order_items(spark, sf_dir, _CODED), _CODED)


@query(
    "ML-03 ML-05",
    over_items(f""", {_SPLIT}, codes AS (SELECT category_name AS c, dense_rank() OVER (ORDER BY category_name) AS code FROM
      (SELECT DISTINCT category_name FROM split_items WHERE split = 'train' AND category_name <> 'PROMO'))
      SELECT split, COALESCE(code, 0)::INTEGER AS code, COUNT(*) AS n FROM split_items LEFT JOIN codes ON c = category_name GROUP BY 1, 2"""),
)
def train_only_codes(spark, sf_dir):
    """Codes fitted on the training split; a category withheld from it gets the unknown code."""
    items = _time_split(spark, sf_dir, ["category_name"])
    codes = features.category_codes(items.where("split = 'train' and category_name <> 'PROMO'"), ["category_name"], 1)
    coded = features.encode(items, ["category_name"], codes, 0, "_code")
    return coded.groupBy("split", F.col("category_name_code").alias("code")).agg(F.count("*").alias("n"))


# --- feature tables ----------------------------------------------------------------------------

_DATE = "isodow(order_ts) - 1"


@query(
    "ML-04 ML-01 ML-02 SCL-01",
    over_items(f""", codes AS (SELECT order_region AS c, dense_rank() OVER (ORDER BY order_region) - 1 AS code FROM (SELECT DISTINCT order_region FROM items))
      SELECT ({_DATE})::DOUBLE AS order_dayofweek, month(order_ts)::DOUBLE AS order_month, COUNT(*) AS n, SUM(code)::DOUBLE AS region_codes,
      COUNT(*) FILTER (shipping_mode = 'Same Day') ::DOUBLE AS same_day, COUNT(*) FILTER (order_type = 'R')::DOUBLE AS returned,
      SUM(quantity)::DOUBLE AS quantity FROM items JOIN codes ON c = order_region GROUP BY 1, 2"""),
)
def delay_features(spark, sf_dir):
    """Feature table of the late model, summed up per weekday and month."""
    items = order_items(spark, sf_dir, ["order_id", "order_ts", "shipping_mode", "order_type", "order_region", "quantity"])
    spec, codes = features.fit_features(items, ["quantity"], ["order_region"], ["shipping_mode", "order_type"])
    made = features.transform_features(items, spec, codes, "order_ts")
    return made.groupBy("order_dayofweek", "order_month").agg(
        F.count("*").alias("n"), F.sum("order_region_encoded").alias("region_codes"), F.sum("`shipping_mode_Same Day`").alias("same_day"),
        F.sum("order_type_R").alias("returned"), F.sum("quantity").alias("quantity"),
    )


@query(
    "ML-05 SCL-02 PRJ-12",
    over_items(f""", {_SPLIT}, m AS (SELECT median(quantity::DOUBLE) AS q FROM split_items WHERE split = 'train' AND line_no <> 1),
      codes AS (SELECT department_name AS c, dense_rank() OVER (ORDER BY department_name) AS code FROM (SELECT DISTINCT department_name FROM split_items WHERE split = 'train'))
      SELECT split, year(order_ts)::DOUBLE AS order_year, COUNT(*) AS n, SUM(CASE WHEN line_no = 1 THEN q ELSE quantity END)::DOUBLE AS quantity,
      SUM(COALESCE(code, 0))::DOUBLE AS codes, SUM(day(order_ts))::DOUBLE AS days FROM split_items CROSS JOIN m LEFT JOIN codes ON c = department_name GROUP BY 1, 2"""),
)
def profit_features(spark, sf_dir):
    """Feature table of the profit model: medians and codes from the training rows only."""
    items = _time_split(spark, sf_dir, ["quantity", "department_name"]).withColumn(
        "quantity", F.when(F.col("line_no") != 1, F.col("quantity"))
    )
    train = items.where("split = 'train'")
    spec, codes = features.fit_features(
        train, ["quantity"], ["department_name"], (), code_start=1, date_missing=0, calendar=True, code_suffix=""
    )
    made = features.transform_features(items, spec, codes, "order_ts", keep=["split"])
    return made.groupBy(F.col("key_split").alias("split"), "order_year").agg(
        F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.sum("department_name").alias("codes"), F.sum("order_day").alias("days")
    )


@query(
    "PRJ-24",
    over_items("""SELECT quantity::DOUBLE AS quantity, 0.0::DOUBLE AS "Market_X", COUNT(*) AS n, SUM(discount_rate::DECIMAL(9,4))::DOUBLE AS discount_rate
      FROM items GROUP BY 1"""),
)
def aligned_features(spark, sf_dir):
    """Columns in contract order; one the table lacks is filled with 0."""
    items = order_items(spark, sf_dir, ["quantity", "discount_rate"])
    aligned = features.align(items, ["discount_rate", "Market_X", "quantity"])
    return aligned.groupBy("quantity", "Market_X").agg(
        F.count("*").alias("n"), F.sum(F.col("discount_rate").cast("decimal(8,4)")).alias("discount_rate")
    )


@query(
    "SRC-04 SRC-03",
    over_items("""SELECT COUNT(*) AS n, 2 AS columns_left, SUM(profit_actual)::DOUBLE AS profit FROM items"""),
)
def ready_table(spark, sf_dir):
    """Forbidden columns are dropped on demand; what is left must be numeric."""
    items = order_items(spark, sf_dir, ["quantity", "profit_actual", "true_label"])
    dirty = items.withColumnsRenamed({"true_label": "Late_delivery_risk"}).withColumn("Order Zipcode", F.lit("00000"))
    ready = models.load_ready(dirty, "profit_actual", "drop")
    return ready.agg(F.count("*").alias("n"), F.lit(len(ready.columns)).alias("columns_left"), F.sum("profit_actual").alias("profit"))


@query(
    "PRJ-25 ML-12",
    over_items("""SELECT market, COUNT(*) AS n, 7 AS columns_left, SUM(quantity)::DOUBLE AS quantity, 'Market_F,Market_O,quantity' AS some_left FROM items GROUP BY 1"""),
)
def features_without_groups(spark, sf_dir):
    """Two feature groups taken out of a one-hot table by their names."""
    items = order_items(spark, sf_dir, ["shipping_mode", "order_type", "market", "quantity"])
    named = items.withColumnsRenamed({"shipping_mode": "Shipping Mode", "order_type": "Type", "market": "Market"})
    hot = features.one_hot(features.one_hot_values(named, ["Shipping Mode", "Type", "Market"]))
    wide = named.select("Market", "quantity", *[c.alias(n) for n, c in hot.items()])
    dropped = models.resolve_features(["Type"], wide.columns)
    kept = wide.drop(*dropped)
    left = ",".join(sorted(c for c in kept.columns if c.startswith("Market_") or c == "quantity"))
    return kept.groupBy(F.col("Market").alias("market")).agg(
        F.count("*").alias("n"), F.lit(len(hot) + 1 - len(dropped)).alias("columns_left"),
        F.sum("quantity").cast("double").alias("quantity"), F.lit(left).alias("some_left"),
    )


# --- audits --------------------------------------------------------------------------------------


_RAW_NUMBERS = {"Sales": "sales", "Product Price": "product_price", "Order Item Quantity": "quantity", "Order Item Discount Rate": "discount_rate"}


def _guard(x: str, name: str) -> str:
    y = "profit_actual::DOUBLE"
    return f"""SELECT '{name}' AS candidate, ROUND(abs(corr({x}, {y})), 4) AS abs_corr, CASE WHEN abs(corr({x}, {y})) > 0.98 THEN 1 ELSE 0 END AS leaks FROM items"""


_GUARDS = [_guard(f"{c}::DOUBLE", n) for n, c in _RAW_NUMBERS.items()] + [
    _guard(f"{a}::DOUBLE * {b}::DOUBLE", f"{n} x {m}")
    for i, (n, a) in enumerate(_RAW_NUMBERS.items()) for m, b in list(_RAW_NUMBERS.items())[i + 1:]
]


@query("AGG-23", over_items(" UNION ALL ".join(_GUARDS)))
def identity_leakage(spark, sf_dir):
    """Columns and products that reproduce the profit; the margin is allowed."""
    items = order_items(spark, sf_dir, [*_RAW_NUMBERS.values(), "profit_ratio", "profit_actual"])
    raw = items.withColumnsRenamed({**{v: k for k, v in _RAW_NUMBERS.items()}, "profit_ratio": "Order Item Profit Ratio"})
    return audits.identity_leakage(raw, [*_RAW_NUMBERS, "Order Item Profit Ratio"], "profit_actual", MARGIN_ALLOWED)


@query(
    "ML-15 AGG-23 SET-03",
    over_items("SELECT 5 AS feature_count, 0 AS blocked_features, 1::BIGINT AS identity_leaks, 'FAIL' AS gate_status FROM items LIMIT 1"),
)
def leakage_gate(spark, sf_dir):
    """Sales times margin is the profit: without the allowance the gate must fail."""
    items = order_items(spark, sf_dir, ["sales", "quantity", "product_price", "discount_rate", "profit_ratio", "profit_actual"])
    numbers = ["sales", "quantity", "product_price", "discount_rate", "profit_ratio"]
    return audits.leakage_gate(items, numbers, ["sales", "quantity", "profit_ratio"], "profit_actual", [])


_GATE_NUMBERS = ["sales", "quantity", "profit_ratio"]


def _gate_sql(case: str, names: list[str]) -> str:
    pairs = [(f"{a}::DOUBLE", a) for a in names] + [(f"{a}::DOUBLE * {b}::DOUBLE", f"{a} x {b}") for i, a in enumerate(names) for b in names[i + 1:]]
    checks = " UNION ALL ".join(_guard(x, name) for x, name in pairs)
    return f"SELECT '{case}' AS \"case\", 3 AS feature_count, SUM(leaks)::BIGINT AS identity_leaks, CASE WHEN SUM(leaks) > 0 THEN 'FAIL' ELSE 'PASS' END AS gate_status FROM ({checks})"


@query(
    "ML-15 AGG-23",
    over_items(" UNION ALL ".join([_gate_sql("margin not allowed", _GATE_NUMBERS), _gate_sql("margin allowed", _GATE_NUMBERS[:2])])),
)
def leakage_gates(spark, sf_dir):
    """The gate with and without the allowance for the margin: the correlations decide, not a list."""
    items = order_items(spark, sf_dir, [*_GATE_NUMBERS, "profit_actual"])
    strict = audits.leakage_gate(items, _GATE_NUMBERS, _GATE_NUMBERS, "profit_actual", []).withColumn("case", F.lit("margin not allowed"))
    mild = audits.leakage_gate(items, _GATE_NUMBERS, _GATE_NUMBERS, "profit_actual", ["profit_ratio"]).withColumn("case", F.lit("margin allowed"))
    return strict.unionByName(mild).select("case", "feature_count", "identity_leaks", "gate_status")


@query(
    "AGG-35",
    over_items("""SELECT 'order_region' AS "column", COUNT(*) FILTER (order_region IS NULL) AS nulls, 0 AS is_numeric, COUNT(*) - COUNT(DISTINCT order_id) AS duplicate_keys FROM items
      UNION ALL SELECT 'quantity', COUNT(*) FILTER (quantity > 45), 1, COUNT(*) - COUNT(DISTINCT order_id) FROM items
      UNION ALL SELECT 'p_late', 0, 1, COUNT(*) - COUNT(DISTINCT order_id) FROM items"""),
)
def table_audit(spark, sf_dir):
    items = order_items(spark, sf_dir, ["order_id", "order_region", "quantity", "p_late"]).withColumn(
        "quantity", F.when(F.col("quantity") <= 45, F.col("quantity"))
    )
    return audits.table_audit(items, "order_id", ["order_region", "quantity", "p_late"])


@query(
    "SET-03 ML-15",
    """SELECT 'manifest' AS source, 3 AS feature_count, '' AS missing, '' AS extra, '' AS blocked, 'PASS' AS status, COUNT(*) AS n FROM lineitem
      UNION ALL SELECT 'artifacts', 3, 'Sales', 'Order Id', 'Order Id', 'FAIL', COUNT(*) FROM lineitem""",
)
def feature_contract(spark, sf_dir):
    """Feature names stored with two tables compared; the second swaps one for an id."""
    raw = raw_orders(spark, sf_dir, [c for c in RAW_NAMES])
    good = ["Sales", "Product Price", "Order Item Quantity"]
    swapped = ["Order Id", *good[1:]]
    audit = audits.contract_audit(
        spark, {"manifest": raw.select(*good).columns, "artifacts": raw.select(*swapped).columns}, ID_COLUMNS + PROFIT_LEAKAGE
    )
    size = raw.agg(F.count("*").alias("n")).scalar()
    texts = [F.array_join(c, ",").alias(c) for c in ("missing", "extra", "blocked")]
    return audit.select("source", "feature_count", *texts, "status", size.alias("n"))


@query(
    "AGG-27",
    over_items("""SELECT 'mode' AS what, shipping_mode AS value, COUNT(*) AS count FROM items GROUP BY ALL
      UNION ALL SELECT * FROM (SELECT 'region', order_region, COUNT(*) AS c FROM items GROUP BY ALL ORDER BY c DESC, order_region LIMIT 5)
      UNION ALL SELECT 'late', 'yes', COUNT(*) FILTER (true_label = 1) FROM items"""),
)
def eda_counts(spark, sf_dir):
    items = order_items(spark, sf_dir, ["shipping_mode", "order_region", "true_label"])
    modes = audits.value_counts(items, "shipping_mode").withColumn("what", F.lit("mode"))
    regions = audits.value_counts(items, "order_region", 5).withColumn("what", F.lit("region"))
    late = items.agg(F.count_if(F.col("true_label") == 1).alias("count")).select(
        F.lit("yes").alias("value"), "count", F.lit("late").alias("what")
    )
    return modes.unionByName(regions).unionByName(late)


@query(
    "AGG-27",
    over_items("""SELECT COUNT(x) AS count, ROUND(SUM(x)::DOUBLE/COUNT(*), 4) AS mean, ROUND(stddev_samp(x::DOUBLE), 4) AS std, MIN(x)::DOUBLE AS min, MAX(x)::DOUBLE AS max,
      ROUND(quantile_cont(x::DOUBLE, 0.25), 4) AS p25, ROUND(quantile_cont(x::DOUBLE, 0.5), 4) AS p50, ROUND(quantile_cont(x::DOUBLE, 0.75), 4) AS p75
      FROM (SELECT product_price AS x FROM items)"""),
)
def price_description(spark, sf_dir):
    return audits.describe_number(order_items(spark, sf_dir, ["product_price"]), "product_price")


# --- models ----------------------------------------------------------------------------------------

_NUMBERS = ["scheduled_days", "product_price", "quantity", "discount_rate", "profit_ratio"]
_HOT = ["shipping_mode", "customer_segment", "order_type", "market"]
_MODEL_COLUMNS = [*ITEM_KEYS, *_NUMBERS, *_HOT, "order_region", "category_name", "order_ts", "true_label", "profit_actual"]


def late_table(spark, sf_dir):
    """Feature table of the late model with its split, and what was fitted.

    Items and features are written, since fitting, training and scoring read them many times.
    """
    items = features.group_split(written(order_items(spark, sf_dir, _MODEL_COLUMNS), "items"), "order_id")
    spec, codes = features.fit_features(items.where("split = 'train'"), _NUMBERS, ["order_region", "category_name"], _HOT)
    keep = ["split", "true_label", "order_id", "shipping_mode", "order_region"]
    made = features.transform_features(items, spec, codes, "order_ts", keep=keep)
    return written(made.withColumnsRenamed({f"key_{k}": k for k in keep}), "features"), spec


@query("ML-08 ML-10 SRC-03 AGG-19 SNK-10")
def late_model_report(spark, sf_dir):
    """Trained on the order split, scored and evaluated on the test side, model saved and loaded."""
    shared_dir(spark)
    data, spec = late_table(spark, sf_dir)
    path = scratch_path(spark, "late_model")
    models.save_model(models.train_late(data, spec.columns, "true_label", max_iter=10, max_depth=4, step=0.2), path)
    scored = models.score_late(models.load_late(path), data.where("split = 'test'"), spec.columns)
    return evaluation.classifier_report(scored)


@query("ML-10 SNK-02 OPT-09")
def late_model_scores(spark, sf_dir):
    """Scored test rows with bucket and costs, per mode."""
    data, spec = late_table(spark, sf_dir)
    model = models.train_late(data, spec.columns, "true_label", max_iter=5, max_depth=4, step=0.3)
    scored = with_prediction_money(models.score_late(model, data.where("split = 'test'"), spec.columns))
    return scored.groupBy("shipping_mode", "risk_bucket").agg(
        F.count("*").alias("n"), F.avg("p_late").cast("double").alias("mean_p_late"), F.sum("expected_penalty").alias("penalty")
    )


@query("ML-09 ML-11 AGG-20 SNK-10")
def profit_model_report(spark, sf_dir):
    """Trained on the time split; error of the newest rows."""
    items = _time_split(spark, sf_dir, ["profit_actual", "order_region", "category_name"], numbers=[*_NUMBERS, "sales"])
    spec, codes = features.fit_features(
        items.where("split = 'train'"), [*_NUMBERS, "sales"], ["order_region", "category_name"], (), 1, 0, True, ""
    )
    data = features.transform_features(items, spec, codes, "order_ts", keep=["split", "profit_actual"]).withColumnsRenamed(
        {"key_split": "split", "key_profit_actual": "profit_actual"}
    )
    data = written(data, "features")
    model = models.train_profit(data, spec.columns, "profit_actual", max_iter=10, max_depth=5, step=0.3)
    scored = models.score_profit(model, data.where("split = 'test'"), spec.columns)
    scored = written(scored.select("profit_actual", "profit_pred"), "scored")
    path = scratch_path(spark, "profit_model")
    report = evaluation.regression_report(scored, "profit_actual", "profit_pred")
    rows = scored.select(F.col("profit_actual").alias("actual_profit"), F.col("profit_pred").alias("predicted_profit"))
    store.write_model_outputs(report, spec.columns, rows, path)
    return report


@query("TOP-05")
def late_model_importances(spark, sf_dir):
    data, spec = late_table(spark, sf_dir)
    model = models.train_late(data, spec.columns, "true_label", max_iter=5, max_depth=4, step=0.3)
    return models.importance_table(model, spec.columns, spark).limit(10)


@query("ML-12 PRJ-25 AGG-37 SET-01")
def retrained_late_model(spark, sf_dir):
    """Two halves united, one feature group left out, metrics before and after."""
    data, spec = late_table(spark, sf_dir)
    both = store.combined_training(data.where("market_F = 1"), data.where("market_O = 1"))
    names = ["auc", "f1", "precision", "recall"]
    full = models.train_late(both, spec.columns, "true_label", max_iter=5, max_depth=4, step=0.3)
    less, kept = models.retrain_late(both, spec.columns, "true_label", ["order_type"], max_iter=5, max_depth=4, step=0.3)
    test = both.where("split = 'test'")
    old = evaluation.as_metric_rows(evaluation.classifier_report(models.score_late(full, test, spec.columns)), names)
    new = evaluation.as_metric_rows(evaluation.classifier_report(models.score_late(less, test, kept)), names)
    return evaluation.compare_metrics(old, new)

