"""What is written and read back, and what the trained models achieve against values computed in SQL."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from parcelwise.constants import ID_COLUMNS, PROFIT_LEAKAGE
from parcelwise.functions.scalars import display_id, hash_id, parse_order_ts, search_token
from parcelwise.operators import audits, decisions, evaluation, features, mart, models, reports, sessions
from parcelwise.plans import choices, modelling, scores
from parcelwise.plans.orders import history_of, mart_of
from parcelwise.plans.registry import QUERIES, query
from parcelwise.plans.sql import over_items, over_mart, over_pred
from parcelwise.session import scratch_path, shared_dir, written
from parcelwise.sources import readers, search, store, versions
from parcelwise.sources.tables import ITEM_KEYS, RAW_NAMES, order_items, predictions, raw_orders, table

# --- written and read back ---------------------------------------------------------------------------


@query("SNK-07 TOP-10", QUERIES["best_thresholds"].sql)
def stored_thresholds(spark, sf_dir):
    """Threshold table and best rows written; the best rows follow from the stored table and equal the stored ones."""
    path = scratch_path(spark, "thresholds")
    sweep = evaluation.threshold_sweep(order_items(spark, sf_dir, ["p_late", "true_label"]))
    store.write_thresholds(sweep, evaluation.best_thresholds(sweep), path)
    best, again = spark.read.parquet(f"{path}/best"), evaluation.best_thresholds(spark.read.parquet(f"{path}/sweep"))
    return best.intersect(again.select(*best.columns))


@query("SNK-06 AGG-40", QUERIES["trust_map"].sql)
def stored_trust_map(spark, sf_dir):
    """The whole trust map stored next to mart and summary, read back."""
    path = scratch_path(spark, "mart_with_trust")
    dims = ["customer_segment", "order_region"]
    rows = order_items(spark, sf_dir, [*dims, "profit_actual", "profit_pred"])
    full = mart_of(spark, sf_dir)
    store.write_mart(full, reports.roi_totals(full), evaluation.trust_map(history_of(spark, sf_dir, dims), rows, dims), path)
    return spark.read.parquet(f"{path}/trust_map")


@query("SNK-06 AGG-14", QUERIES["roi_totals"].sql)
def stored_summary(spark, sf_dir):
    path = scratch_path(spark, "mart_with_summary")
    full = mart_of(spark, sf_dir)
    store.write_mart(full, reports.roi_totals(full), evaluation.delay_calibration(full, ["customer_segment"]), path)
    return spark.read.parquet(f"{path}/summary")


@query(
    "SNK-03 PRJ-35",
    over_pred(choices._RISKIEST.format(t=3000) + """ SELECT risk_bucket, COUNT(*) AS n, SUM(upgrade_cost)::DOUBLE AS cost,
      (SELECT COUNT(*) FROM cand) AS selected_count FROM cand GROUP BY 1"""),
)
def stored_choice(spark, sf_dir):
    """A selection's report rows as CSV, its totals as JSON, both read back."""
    path = scratch_path(spark, "choice")
    chosen = decisions.choose(choices._candidates(spark, sf_dir), "order_id", [choices.EVERYTHING])
    store.write_selection(decisions.selection_report(chosen, "order_id"), decisions.selection_totals(chosen, [choices.EVERYTHING]), path)
    rows = spark.read.option("header", True).csv(f"{path}/orders")
    total = spark.read.schema("selected_count long").json(f"{path}/summary").select("selected_count").scalar()
    return rows.groupBy("risk_bucket").agg(
        F.count("*").alias("n"), F.sum(F.col("upgrade_cost").cast("decimal(12,2)")).cast("double").alias("cost")
    ).withColumn("selected_count", total)


_SEARCHED = "SELECT o_orderkey AS order_id, sha256('EXAMPLE_DELAY_SALT:' || o_orderkey) AS order_id_hash FROM orders"


@query(
    "FLT-03 SCL-05 FLT-08 SNK-02",
    f"""SELECT token, order_id, order_id_hash FROM ({_SEARCHED}) JOIN (
        SELECT unnest(['a1b', '7c0de', lower(substr(max_by(order_id_hash, order_id), 1, 8))]) AS token FROM ({_SEARCHED})
      ) ON contains(order_id_hash, token)""",
)
def stored_search(spark, sf_dir):
    """Orders stored with an index of the pieces of their ids: typed parts of an id, and the id as a list shows it."""
    path = scratch_path(spark, f"searchable-{uuid.uuid4().hex}")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    hashed = orders.withColumn("order_id_hash", hash_id(F.col("order_id"), "EXAMPLE_DELAY_SALT"))
    search.write_searchable(hashed, path, "order_id_hash", folders=64, gram=5)
    shown = hashed.agg(display_id(F.max_by("order_id_hash", "order_id"))).first()[0]
    typed = [" ORD-A1b ", "7c0-de", shown or ""]
    found = [(search_token(t), search.search_ids(spark, path, "order_id_hash", t, gram=5)) for t in typed]
    hits = [(rows if rows is not None else hashed.limit(0)).withColumn("token", F.lit(token)) for token, rows in found]
    return functools.reduce(lambda a, b: a.unionByName(b), hits)


_FLAGS = """SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS kind, o_orderkey AS flagged_at, o_orderstatus FROM orders"""


@query(
    "SNK-08",
    f"""SELECT month, arg_max(kind, flagged_at) AS kind, MAX(flagged_at) AS flagged_at, 3::BIGINT AS versions,
      (SELECT COUNT(DISTINCT month) FROM ({_FLAGS}) WHERE o_orderstatus = 'O') AS months_of_first FROM ({_FLAGS}) GROUP BY 1""",
)
def stored_event_flags(spark, sf_dir):
    """Flags written, updated by two more batches, one of them sent twice, and read back; the first version is still there."""
    path = scratch_path(spark, f"event_flags-{uuid.uuid4().hex}")
    orders = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("flagged_at"), "o_orderstatus"
    )
    for status in ("O", "P", "O", "F"):
        rows = orders.where(F.col("o_orderstatus") == status)
        store.store_flags(rows.groupBy("month").agg(F.max_by("kind", "flagged_at").alias("kind"), F.max("flagged_at").alias("flagged_at")), path, f"status {status}")
    first = versions.read(spark, path, 1).agg(F.count("*")).scalar()
    return versions.read(spark, path).select("month", "kind", "flagged_at", versions.history(spark, path).agg(F.count("*")).scalar().alias("versions"), first.alias("months_of_first"))


@query(
    "SNK-04 SET-01",
    over_items("""SELECT market AS "Market", COUNT(*) AS n, SUM(profit_actual)::DOUBLE AS profit, COUNT(*) FILTER (market = 'F') AS with_carrier,
      (SELECT COUNT(*) FROM items WHERE market = 'O' AND order_type <> 'A') AS first_version FROM items WHERE order_type <> 'A' GROUP BY 1"""),
)
def known_results_in_versions(spark, sf_dir):
    """Batches of known results, each sent twice, the second with a further column: every batch is stored once."""
    path = scratch_path(spark, f"result_versions-{uuid.uuid4().hex}")
    raw = raw_orders(spark, sf_dir).where("Type <> 'A'")
    for market in ("O", "O", "F", "F", "O"):
        rows = raw.where(F.col("Market") == market)
        store.append_batch(rows.withColumn("Carrier", F.col("Type")) if market == "F" else rows, path, f"market {market}")
    before = versions.read(spark, path, 1).agg(F.count("*")).scalar()
    return versions.read(spark, path).groupBy("Market").agg(
        F.count("*").alias("n"), F.sum("Order Profit Per Order").alias("profit"), F.count("Carrier").alias("with_carrier"), before.alias("first_version")
    )


@query(
    "SNK-01 SNK-02 JON-02 JON-03 JON-05",
    over_pred(f""", chosen AS (SELECT DISTINCT order_id FROM pred WHERE true_label = 1 AND profit_actual < 0), open_scores AS (SELECT * FROM pred WHERE market = 'O')
      SELECT shipping_mode, COUNT(*) AS items, COUNT(*) FILTER (order_id IN (SELECT order_id FROM chosen)) AS items_of_losing_orders,
        COUNT(*) FILTER (order_id NOT IN (SELECT order_id FROM open_scores)) AS items_without_score,
        COUNT(*) FILTER (market = 'O') AS side_by_side, SUM(upgrade_cost) FILTER (market = 'O')::DOUBLE AS cost FROM pred GROUP BY 1"""),
)
def joins_of_bucketed_tables(spark, sf_dir):
    """Items and scores stored in buckets by order; semi, anti and side-by-side joins of the stored tables."""
    run = uuid.uuid4().hex
    root = scratch_path(spark, f"bucketed-{run}")
    every = predictions(spark, sf_dir, [*ITEM_KEYS, "market", "true_label", "profit_actual"])
    items = store.write_bucketed(every.select(*ITEM_KEYS, "shipping_mode", "true_label", "profit_actual"), f"{root}/items", f"items_{run}", "order_id", 8)
    scored = store.write_bucketed(every.where("market = 'O'").select(*ITEM_KEYS, "upgrade_cost"), f"{root}/scores", f"scores_{run}", "order_id", 8)
    return bucketed_joins(items, scored)


def bucketed_joins(items, scored):
    chosen = mart.items_of_orders(items, items.where("true_label = 1 and profit_actual < 0"), "order_id")
    missing = items.join(mart.orders_missing(items, scored, "order_id"), "order_id", "left_semi")
    beside = mart.join_rows(items, scored, ITEM_KEYS)
    zero = F.lit(0).cast("decimal(12,2)")
    counted = [
        df.select("shipping_mode", F.lit(kind).alias("kind"), (F.col("upgrade_cost") if kind == "beside" else zero).alias("cost"))
        for kind, df in (("all", items), ("chosen", chosen), ("missing", missing), ("beside", beside))
    ]
    rows = functools.reduce(lambda a, b: a.unionByName(b), counted)
    return rows.groupBy("shipping_mode").agg(
        F.count_if(F.col("kind") == "all").alias("items"), F.count_if(F.col("kind") == "chosen").alias("items_of_losing_orders"),
        F.count_if(F.col("kind") == "missing").alias("items_without_score"), F.count_if(F.col("kind") == "beside").alias("side_by_side"),
        F.sum(F.when(F.col("kind") == "beside", F.col("cost"))).cast("double").alias("cost"),
    )


_DIMS = ("customer_segment", "order_region", "category_name", "shipping_mode")


@query(
    "SNK-06 SRC-08 AGG-01 AGG-02",
    over_mart("""SELECT order_id, p_late::DOUBLE AS p_late, true_label, upgrade_cost::DOUBLE AS upgrade_cost, profit_actual::DOUBLE AS profit_actual, profit_pred::DOUBLE AS profit_pred,
      discount_rate::DOUBLE AS discount_rate, customer_segment, order_region, category_name, shipping_mode, net_of_service::DOUBLE AS net_of_service, risk_bucket FROM mart"""),
)
def mart_in_batches(spark, sf_dir):
    """The mart kept up to date by three batches that share their orders, one of them sent twice."""
    path = scratch_path(spark, f"mart_batches-{uuid.uuid4().hex}")
    items = predictions(spark, sf_dir, [*ITEM_KEYS, "discount_rate", "true_label", "profit_actual", "profit_pred", *_DIMS])
    for batch in (1, 0, 1, 2):
        store.update_mart(items.where(F.col("line_no") % 3 == batch), path, f"lines {batch}", "order_id", ITEM_KEYS[1:], _DIMS, parts=16)
    full = store.read_updated_mart(spark, path, "order_id", _DIMS)
    return full.select(
        "order_id", "p_late", "true_label", "upgrade_cost", "profit_actual", "profit_pred", "discount_rate", *_DIMS, "net_of_service", "risk_bucket"
    )


_RUNS = """named AS (SELECT DISTINCT 'Type_' || order_type AS feature, market, shipping_mode FROM items UNION ALL SELECT DISTINCT 'Category_' || category_name, market, shipping_mode FROM items WHERE quantity = 50 AND order_region = 'Oceania'),
      lists AS (SELECT DISTINCT 'late' AS run, 'manifest' AS part, feature FROM named UNION ALL SELECT DISTINCT 'late', 'artifacts', feature FROM named
        UNION ALL SELECT DISTINCT 'fast', 'manifest', feature FROM named UNION ALL SELECT DISTINCT 'fast', 'model', feature FROM named WHERE shipping_mode = 'Same Day'
        UNION ALL SELECT DISTINCT 'open', 'manifest', feature FROM named WHERE market = 'O' UNION ALL SELECT DISTINCT 'open', 'model', feature FROM named UNION ALL SELECT 'open', 'model', 'Order Id')"""


@query(
    "SET-03 ML-15 SNK-10",
    over_items(f""", {_RUNS}, own AS (SELECT run, part, list(feature ORDER BY feature) AS own FROM lists GROUP BY ALL),
      pairs AS (SELECT o.run, o.part, o.own, w.own AS wanted FROM own o JOIN own w ON o.run = w.run AND w.part = 'manifest')
      SELECT run, part, len(own)::INTEGER AS feature_count, array_to_string(list_filter(wanted, lambda x: NOT list_contains(own, x)), ',') AS missing,
        array_to_string(list_filter(own, lambda x: NOT list_contains(wanted, x)), ',') AS extra, array_to_string(list_filter(own, lambda x: x = 'Order Id'), ',') AS blocked,
        0 AS reordered, CASE WHEN own = wanted THEN 'PASS' ELSE 'FAIL' END AS status FROM pairs"""),
)
def stored_contracts(spark, sf_dir):
    """Feature lists of three training runs, stored as JSON by part and audited after reading them back."""
    path = scratch_path(spark, f"contracts-{uuid.uuid4().hex}")
    items = order_items(spark, sf_dir, ["order_type", "market", "shipping_mode", "category_name", "order_region", "quantity"])
    kinds = items.select(F.concat(F.lit("Type_"), "order_type").alias("feature"), "market", "shipping_mode").distinct()
    some = items.where((F.col("quantity") == 50) & (F.col("order_region") == "Oceania"))
    named = kinds.unionByName(some.select(F.concat(F.lit("Category_"), "category_name").alias("feature"), "market", "shipping_mode").distinct())
    named = spark.createDataFrame(named.collect(), named.schema)  # the names of a model's features, a few hundred
    extra = spark.createDataFrame([("Order Id", "", "")], named.schema)
    parts = {
        ("late", "manifest"): named, ("late", "artifacts"): named, ("fast", "manifest"): named, ("fast", "model"): named.where("shipping_mode = 'Same Day'"),
        ("open", "manifest"): named.where("market = 'O'"), ("open", "model"): named.unionByName(extra),
    }
    for (run, part), rows in parts.items():
        numbered = rows.select("feature").distinct().withColumn("position", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("feature")) - 1).cast("int"))
        store.write_contract(numbered, path, run, part)
    audit = audits.stored_contract_audit(store.read_contracts(spark, path), ID_COLUMNS + PROFIT_LEAKAGE)
    return audit.select("run", "part", "feature_count", *[F.array_join(c, ",").alias(c) for c in ("missing", "extra", "blocked")], "reordered", "status")


_FITTED = ["quantity", "product_price", "discount_rate"]


@query(
    "SRC-09 SNK-05 AGG-25 AGG-28",
    over_items(
        " UNION ALL ".join(f"SELECT 'median' AS what, '{c}' AS \"column\", '' AS category, ROUND(median({c}::DOUBLE), 4) AS value FROM items" for c in _FITTED)
        + " UNION ALL SELECT 'class', 'department_name', department_name, (dense_rank() OVER (ORDER BY department_name) - 1)::DOUBLE FROM (SELECT DISTINCT department_name FROM items)"
    ),
)
def stored_artifacts(spark, sf_dir):
    """Fitted medians and class lists as JSON, read back."""
    path = scratch_path(spark, "json_artifacts")
    items = order_items(spark, sf_dir, [*_FITTED, "department_name"])
    store.write_json_artifacts(spark, features.medians(items, _FITTED), features.category_codes(items, ["department_name"]), path)
    medians = readers.read_artifacts(spark, path).select(F.lit("median").alias("what"), "column", F.lit("").alias("category"), F.round("value", 4).alias("value"))
    classes = readers.read_label_classes(spark, path)
    return medians.unionByName(classes.select(F.lit("class").alias("what"), "column", "category", F.col("code").cast("double").alias("value")))


# --- models ------------------------------------------------------------------------------------------

_SIDE = """sided AS (SELECT *, CASE WHEN p < 7000 THEN 'train' WHEN p < 8500 THEN 'val' ELSE 'test' END AS side FROM
      (SELECT *, ('0x' || substr(sha256('42:' || order_id), 1, 8))::BIGINT % 10000 AS p FROM items))"""
_BY_MODE = f""", {_SIDE}, rates AS (SELECT shipping_mode AS rate_mode, ((20000*SUM(true_label)+COUNT(*))//(2*COUNT(*)))::BIGINT AS rate FROM sided WHERE side = 'train' GROUP BY 1),
      rated AS (SELECT s.*, rate FROM sided s JOIN rates ON rate_mode = shipping_mode WHERE side = 'test')"""


@query(
    "ML-08 ML-10 AGG-19 TOP-05",
    over_items(_BY_MODE + f""", {scores.auc_sql('rated', '1', 'rate')} SELECT n, late_rate, auc AS auc_by_mode, 1 AS model_is_better, 1 AS importances_add_up FROM area"""),
)
def late_model_evidence(spark, sf_dir):
    """The late model on unseen orders: it must rank them better than the late rate of their shipping mode does."""
    shared_dir(spark)
    data, spec = modelling.late_table(spark, sf_dir)
    model = models.train_late(data, spec.columns, "true_label", max_iter=10, max_depth=4, step=0.2)
    test = data.where("split = 'test'")
    rates = data.where("split = 'train'").groupBy("shipping_mode").agg(reports.mean4(F.col("true_label")).cast("decimal(8,4)").alias("p_late"))
    simple = evaluation.auc_by(test.join(rates, "shipping_mode"))
    better = evaluation.auc_by(models.score_late(model, test, spec.columns)).select("auc").scalar()
    weights = models.importance_table(model, spec.columns, spark).agg(F.sum("importance")).scalar()
    return simple.select(
        "n", "late_rate", F.col("auc").alias("auc_by_mode"), (better > F.col("auc")).cast("int").alias("model_is_better"),
        (F.abs(weights - 1) < 1e-3).cast("int").alias("importances_add_up"),
    )


@query(
    "ML-09 ML-11 AGG-20 SNK-10",
    over_items(f""", {modelling._SPLIT}, test AS (SELECT profit_actual::DOUBLE AS y FROM split_items WHERE split = 'test')
      SELECT COUNT(*) AS n, COUNT(*) AS stored_rows, 1 AS better_than_mean, 1 AS manifest_equal FROM test"""),
)
def profit_model_evidence(spark, sf_dir):
    """The profit model on the newest rows beats their mean; metrics, manifest and predictions are stored and read back."""
    items = modelling._time_split(spark, sf_dir, ["profit_actual", "order_region"], numbers=[*modelling._NUMBERS, "sales"])
    spec, codes = features.fit_features(items.where("split = 'train'"), [*modelling._NUMBERS, "sales"], ["order_region"], (), 1, 0, True, "")
    keep = ["split", "profit_actual"]
    data = features.transform_features(items, spec, codes, "order_ts", keep=keep).withColumnsRenamed({f"key_{k}": k for k in keep})
    data = written(data, "features")
    model = models.train_profit(data, spec.columns, "profit_actual", max_iter=10, max_depth=5, step=0.3)
    scored = models.score_profit(model, data.where("split = 'test'"), spec.columns)
    scored = written(scored.select("profit_actual", "profit_pred"), "scored")
    path = scratch_path(spark, "profit_evidence")
    rows = scored.select(F.col("profit_actual").alias("actual_profit"), F.col("profit_pred").alias("predicted_profit"))
    store.write_model_outputs(evaluation.regression_report(scored, "profit_actual", "profit_pred"), spec.columns, rows, path)
    manifest = [r["feature"] for r in spark.read.json(f"{path}/manifest").orderBy("position").collect()]
    stored = spark.read.parquet(f"{path}/predictions").where("residual = actual_profit - predicted_profit").agg(F.count("*")).scalar()
    return spark.read.schema("n long, r2 double").json(f"{path}/metrics").select(
        "n", stored.alias("stored_rows"), (F.col("r2") > 0.5).cast("int").alias("better_than_mean"), F.lit(int(manifest == spec.columns)).alias("manifest_equal")
    )


@query(
    "ML-12 PRJ-25 SET-01 AGG-37 SNK-04",
    over_items(f""", {_SIDE} SELECT side, COUNT(*) AS n, COUNT(*) FILTER (order_type = 'R') AS from_store, 1 AS group_left_out, 4 AS metrics_compared FROM sided GROUP BY 1"""),
)
def retrained_on_store(spark, sf_dir):
    """Raw rows and the stored known results train a model without one feature group; old and new meet on the same test rows."""
    path = scratch_path(spark, "retraining_store")
    raw = raw_orders(spark, sf_dir)
    late = F.col("Late_delivery_risk") == 1
    for batch in (late, ~late):
        store.append_known_results(raw.where("Type = 'R'").where(batch), path)
    known = store.read_known_results(spark, path).withColumn("origin", F.lit("store"))
    rows = store.combined_training(raw.where("Type <> 'R'").withColumn("origin", F.lit("raw")), known)
    rows = features.group_split(rows.withColumn("ts", parse_order_ts(F.col("`order date (DateOrders)`"))), "Order Id")
    rows = written(rows.select(*RAW_NUMBERS, *RAW_HOT, "Order Region", "ts", "split", "Late_delivery_risk", "origin"), "items")
    spec, codes = features.fit_features(rows.where("split = 'train'"), RAW_NUMBERS, ["Order Region"], RAW_HOT)
    keep = ["split", "Late_delivery_risk", "origin"]
    data = features.transform_features(rows, spec, codes, "ts", keep=keep).withColumnsRenamed({"key_split": "split", "key_Late_delivery_risk": "true_label", "key_origin": "origin"})
    data = written(data, "features")
    options = {"max_iter": 4, "max_depth": 3, "step": 0.3}
    full = models.train_late(data, spec.columns, "true_label", **options)
    less, kept = models.retrain_late(data, spec.columns, "true_label", ["type"], **options)
    test, names = data.where("split = 'test'"), ["auc", "f1", "precision", "recall"]
    old, new = (
        evaluation.as_metric_rows(evaluation.classifier_report(models.score_late(m, test, c)), names) for m, c in ((full, spec.columns), (less, kept))
    )
    compared = evaluation.compare_metrics(old, new).agg(F.count("*")).scalar()
    gone = set(spec.columns) - set(kept)
    return data.groupBy(F.col("split").alias("side")).agg(
        F.count("*").alias("n"), F.count_if(F.col("origin") == "store").alias("from_store"),
        F.lit(int(bool(gone) and all(c.startswith("Type_") for c in gone))).alias("group_left_out"),
    ).withColumn("metrics_compared", compared.cast("int"))


# --- an upload scored by a trained model ----------------------------------------------------------------

RAW_NUMBERS = ["Days for shipment (scheduled)", "Product Price", "Order Item Quantity", "Order Item Discount Rate", "Order Item Profit Ratio"]
RAW_HOT = ["Shipping Mode", "Customer Segment", "Type", "Market"]
RAW_DATE = "order date (DateOrders)"


@query(
    "ML-10 OPT-09 SRC-05 SRC-06 SNK-02",
    over_pred(f""", {_SIDE.replace('FROM items', 'FROM pred')} SELECT shipping_mode, COUNT(*) AS n, SUM(true_label)::BIGINT AS late, SUM(upgrade_cost)::DOUBLE AS cost, 0 AS scored_differently
      FROM sided WHERE side = 'test' GROUP BY 1"""),
)
def upload_scored_by_model(spark, sf_dir):
    """A model fitted on known orders scores uploaded files with odd headers as it scores the same rows directly."""
    root = scratch_path(spark, "model_upload")
    rows = features.group_split(raw_orders(spark, sf_dir), "Order Id").withColumn("ts", parse_order_ts(F.col(f"`{RAW_DATE}`")))
    rows = written(rows.select(*RAW_NAMES.values(), "split", "ts"), "items")
    spec, codes = features.fit_features(rows.where("split = 'train'"), RAW_NUMBERS, ["Order Region"], RAW_HOT)
    keep = ["split", "Late_delivery_risk"]
    data = features.transform_features(rows, spec, codes, "ts", keep=keep).withColumnsRenamed({"key_split": "split", "key_Late_delivery_risk": "true_label"})
    data = written(data, "features")
    model = models.train_late(data, spec.columns, "true_label", max_iter=5, max_depth=4, step=0.3)
    upload = rows.where("split = 'test'").select(*RAW_NAMES.values()).withColumn("Late_delivery_risk", F.format_string("%d.0", "Late_delivery_risk"))
    upload = upload.withColumnsRenamed({"Product Price": "PRODUCT PRICE", "Type": "type", "Shipping Mode": "shipping mode"})
    upload.withColumn("Note, free", F.lit('a, "b"')).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/in/orders")
    scorer = sessions.late_scorer(model, spec, codes, RAW_DATE)
    needed = [*RAW_NUMBERS, *RAW_HOT, "Order Region", RAW_DATE]
    sessions.score_uploads(spark, f"{root}/in", scorer, f"{root}/predictions", "model-1", features=needed)
    stored = readers.read_session(spark, f"{root}/predictions", "model-1")
    direct = models.score_late(model, data.where("split = 'test'"), spec.columns)
    counts = lambda df: df.groupBy("p_late", "true_label").agg(F.count("*").alias("n"))
    differ = counts(stored).exceptAll(counts(direct)).agg(F.count("*")).scalar()
    return stored.groupBy("shipping_mode").agg(
        F.count("*").alias("n"), F.sum("true_label").alias("late"), F.sum("upgrade_cost").alias("cost")
    ).withColumn("scored_differently", differ.cast("int"))
