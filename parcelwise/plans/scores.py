"""Reports on scored order items and checks of the scores."""

from __future__ import annotations


from decimal import Decimal

from pyspark.sql import functions as F

from parcelwise.functions.scalars import display_id, hash_id, risk_bucket, safe_divide, search_token
from parcelwise.operators import evaluation, reports
from parcelwise.plans.orders import history_of, mart_of
from parcelwise.plans.registry import query
from parcelwise.plans.sql import avg4, bucket_sql, over_items, over_mart, over_pred, ratio4
from parcelwise.sources.tables import ITEM_KEYS, order_items, predictions, table

_MONTH = "strftime(order_ts, '%Y-%m')"


# --- breakdowns -------------------------------------------------------------------------


def _summary(dimension: str) -> str:
    return over_pred(f"SELECT {dimension} AS label, COUNT(*) AS count, {avg4('bp')} AS avg_p_late FROM pred GROUP BY 1")


@query("AGG-04", _summary("shipping_mode"))
def summary_by_mode(spark, sf_dir):
    return reports.summary_by(order_items(spark, sf_dir, ["shipping_mode", "p_late"]), "shipping_mode")


@query("AGG-04", _summary("order_region"))
def summary_by_region(spark, sf_dir):
    return reports.summary_by(order_items(spark, sf_dir, ["order_region", "p_late"]), "order_region")


@query("AGG-04 PRJ-15", _summary("risk_bucket"))
def summary_by_bucket(spark, sf_dir):
    items = order_items(spark, sf_dir, ["p_late"]).withColumn("risk_bucket", risk_bucket(F.col("p_late")))
    return reports.summary_by(items, "risk_bucket")


@query(
    "AGG-05 PRJ-29",
    over_items(f"""SELECT order_region, {avg4('bp')} AS p_late, COUNT(*) AS count,
      CASE WHEN {avg4('bp')} >= 0.56 THEN 'severe' WHEN {avg4('bp')} >= 0.52 THEN 'high' WHEN {avg4('bp')} >= 0.48 THEN 'elevated'
      ELSE 'calm' END AS heat FROM items GROUP BY 1"""),
)
def region_heat(spark, sf_dir):
    ranking = reports.region_ranking(order_items(spark, sf_dir, ["order_region", "p_late"]))
    return ranking.withColumn("heat", reports.heat_band(F.col("p_late")))


@query(
    "AGG-30",
    over_items(f"""SELECT {avg4('bp')} AS p_late, COUNT(*) AS count FROM items
      WHERE order_region LIKE '%USA%' OR order_region LIKE '%US Center%'"""),
)
def united_states_combined(spark, sf_dir):
    return reports.combined_regions(order_items(spark, sf_dir, ["order_region", "p_late"]), "USA|US Center")


@query(
    "PRJ-30",
    """SELECT c_custkey, COALESCE(r.r_name, s.r_name) AS resolved_region FROM customer
      LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0) r
        ON r.n_name = 'NATION_' || c_nationkey
      LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 <> 0) s
        ON s.n_nationkey = c_nationkey""",
)
def customers_by_region(spark, sf_dir):
    """Name lookup first, code lookup second; some countries are in neither list."""
    named = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    names = named.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    codes = named.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").cast("string").alias("code"), F.col("r_name").alias("region"))
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("country"),
        F.col("c_nationkey").cast("string").alias("code"),
    )
    return reports.resolve_region(customers, names, codes).select("c_custkey", "resolved_region")


# --- months --------------------------------------------------------------------------------


@query(
    "AGG-06 FLT-09",
    over_items(f"""SELECT {_MONTH} AS month, {avg4('bp')} AS avg_p_late, {ratio4('SUM(true_label)', 'COUNT(*)')} AS actual_late_rate,
      COUNT(*) AS total_orders FROM items GROUP BY 1"""),
)
def monthly_rates(spark, sf_dir):
    return reports.monthly_rates(order_items(spark, sf_dir, ["order_ts", "p_late", "true_label"]))


@query(
    "AGG-11 PRJ-19",
    over_items(f"""SELECT {_MONTH} AS month, SUM(true_label)::BIGINT AS actual_late,
      SUM(CASE WHEN bp >= 5000 THEN 1 ELSE 0 END)::BIGINT AS predicted_late, COUNT(*) AS total FROM items GROUP BY 1"""),
)
def monthly_late_counts(spark, sf_dir):
    return reports.monthly_counts(order_items(spark, sf_dir, ["order_ts", "p_late", "true_label"]), "0.5")


_GAP = "ABS(SUM(bp) - 10000*SUM(true_label))"
_DIAGNOSIS = f"""{avg4('bp')} AS avg_p_late, {ratio4('SUM(true_label)', 'COUNT(*)')} AS actual_late_rate,
      ((2*{_GAP}+COUNT(*))//(2*COUNT(*)))::DOUBLE/10000 AS error,
      CASE WHEN {_GAP} > 500*COUNT(*) THEN 1 ELSE 0 END AS error_exceeds_threshold, COUNT(*) AS total_orders,
      COUNT(*) FILTER ((bp >= 5000) <> (true_label = 1)) AS error_orders_count"""


@query("AGG-07", over_items(f"SELECT {_MONTH} AS month, {_DIAGNOSIS} FROM items GROUP BY 1"))
def monthly_diagnosis(spark, sf_dir):
    return reports.monthly_diagnosis(order_items(spark, sf_dir, ["order_ts", "p_late", "true_label"]))


@query(
    "WIN-02 AGG-07",
    over_items(f"""SELECT batch AS month, {_DIAGNOSIS} FROM (SELECT *, CAST(((row_number() OVER
      (ORDER BY order_id, line_no, product_id, supplier_id, price_cents) - 1) // ((COUNT(*) OVER () + 11)//12)) + 1 AS INTEGER) AS batch
      FROM items) GROUP BY 1"""),
)
def batch_diagnosis(spark, sf_dir):
    """Twelve equal runs of rows stand in for months when there are no dates."""
    items = order_items(spark, sf_dir, [*ITEM_KEYS, "p_late", "true_label"])
    return reports.monthly_diagnosis(reports.with_batches(items, ITEM_KEYS), period="batch")


@query(
    "JON-14 SNK-08",
    over_items(f""", monthly AS (SELECT {_MONTH} AS month, {_DIAGNOSIS} FROM items GROUP BY 1),
      flags AS (SELECT strftime(ts, '%Y-%m') AS month, arg_max(event_type, (ts, event_id)) AS event_type FROM
        (SELECT ts - INTERVAL 25 YEAR AS ts, event_id, event_type FROM events) GROUP BY 1)
      SELECT month, error, flags.event_type FROM monthly LEFT JOIN flags USING (month)"""),
)
def months_with_events(spark, sf_dir):
    """Latest event of a month, as its flag, next to the diagnosis of that month."""
    monthly = reports.monthly_diagnosis(order_items(spark, sf_dir, ["order_ts", "p_late", "true_label"]))
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts") - F.expr("INTERVAL '25' YEAR"))
    flags = events.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type")
    )
    return reports.with_event_flags(monthly, flags).select("month", "error", "event_type")


# --- KPI rows and lists -------------------------------------------------------------------------


@query(
    "AGG-12 FLT-05",
    over_pred(f"""SELECT COUNT(*) AS total_orders, COUNT(*) FILTER (bp >= 7000) AS at_risk_orders,
      {ratio4('COUNT(*) FILTER (bp >= 7000)', 'COUNT(*)')} AS at_risk_rate,
      {ratio4('COUNT(*) - COUNT(*) FILTER (bp >= 7000)', 'COUNT(*)')} AS estimated_service_level,
      ROUND(SUM(expected_penalty) FILTER (bp >= 7000), 2)::DOUBLE AS expected_penalty_exposure FROM pred"""),
)
def executive_kpis(spark, sf_dir):
    return reports.executive_kpis(predictions(spark, sf_dir, ["p_late"]).drop("upgrade_cost"), "0.7")


@query(
    "AGG-13",
    over_pred(f"""SELECT order_region AS label, COUNT(*) AS count, {avg4('bp')} AS avg_p_late FROM pred WHERE bp >= 7000
      GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 5"""),
)
def top_risk_regions(spark, sf_dir):
    return reports.top_breakdown(order_items(spark, sf_dir, ["order_region", "p_late"]), "order_region", "0.7")


@query(
    "AGG-13",
    over_pred(f"""SELECT shipping_mode AS label, COUNT(*) AS count, {avg4('bp')} AS avg_p_late FROM pred WHERE bp >= 5000
      GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 5"""),
)
def top_risk_modes(spark, sf_dir):
    return reports.top_breakdown(order_items(spark, sf_dir, ["shipping_mode", "p_late"]), "shipping_mode", "0.5")


@query(
    "FLT-07 PRJ-19",
    over_items("""SELECT shipping_mode, true_label AS actual_late, CASE WHEN bp >= 6000 THEN 1 ELSE 0 END AS predicted_late, COUNT(*) AS n
      FROM items WHERE (bp >= 6000) <> (true_label = 1) GROUP BY ALL"""),
)
def wrong_predictions(spark, sf_dir):
    wrong = reports.error_rows(order_items(spark, sf_dir, ["shipping_mode", "p_late", "true_label"]), "0.6")
    return wrong.groupBy("shipping_mode", "actual_late", "predicted_late").agg(F.count("*").alias("n"))


_HASH = "sha256('EXAMPLE_DELAY_SALT:' || order_id)"


@query(
    "FLT-02 TOP-01 WIN-06",
    over_pred(f"""SELECT order_id, line_no, product_id, p_late::DOUBLE AS p_late, risk_bucket,
      row_number() OVER (ORDER BY bp DESC, order_id, line_no, product_id, supplier_id, price_cents) AS row_number
      FROM pred WHERE {_MONTH} = '1997-03' AND risk_bucket = 'High' AND shipping_mode = 'Standard Class' AND bp >= 6000
      QUALIFY row_number BETWEEN 21 AND 40"""),
)
def order_page(spark, sf_dir):
    pred = predictions(spark, sf_dir, [*ITEM_KEYS, "order_ts", "true_label"])
    chosen = reports.filter_orders(
        pred, month="1997-03", risk="High", shipping="Standard Class", threshold="0.6", id_col="order_id"
    )
    return reports.page(chosen, ["-p_late", *ITEM_KEYS], 2, 20).select("order_id", "line_no", "product_id", "p_late", "risk_bucket", "row_number")


@query(
    "TOP-01 WIN-06 FLT-02",
    over_pred("""SELECT order_id, line_no, product_id, p_late::DOUBLE AS p_late, row_number FROM (SELECT *, row_number() OVER (ORDER BY bp DESC, order_id, line_no, product_id, supplier_id, price_cents) AS row_number FROM pred)
      WHERE row_number > 40000 AND row_number <= 40100"""),
)
def far_order_page(spark, sf_dir):
    """A page deep in the list of all items: its key range is found first, then only that range is sorted."""
    pred = predictions(spark, sf_dir, ITEM_KEYS)
    return reports.page(pred, ["-p_late", *ITEM_KEYS], 401, 100).select("order_id", "line_no", "product_id", "p_late", "row_number")


@query(
    "FLT-02 FLT-07",
    over_pred("""SELECT order_region, COUNT(*) AS n, SUM(upgrade_cost)::DOUBLE AS cost FROM pred
      WHERE order_region = 'West of USA ' AND (bp >= 5000) <> (true_label = 1) GROUP BY 1"""),
)
def wrong_in_region(spark, sf_dir):
    pred = predictions(spark, sf_dir, ["order_id", "order_ts", "true_label"])
    chosen = reports.filter_orders(pred, region="West of USA ", error_only=True, id_col="order_id")
    return chosen.groupBy("order_region").agg(F.count("*").alias("n"), F.sum("upgrade_cost").alias("cost"))


@query(
    "FLT-03 SCL-05 FLT-08",
    f"""SELECT order_id, {_HASH} AS order_id_hash FROM (SELECT o_orderkey AS order_id FROM orders)
      WHERE contains({_HASH}, '{search_token('ORD-A1b')}')""",
)
def search_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    hashed = orders.withColumn("order_id_hash", hash_id(F.col("order_id"), "EXAMPLE_DELAY_SALT"))
    return hashed.where(F.lower("order_id_hash").contains(search_token(" ord-A1b ")))


@query(
    "FLT-10 TOP-04 WIN-06 PRJ-13",
    over_items("""SELECT order_id, line_no, ROUND(profit_actual,4)::DOUBLE AS actual_profit, ROUND(profit_pred,4)::DOUBLE AS predicted_profit,
      (profit_actual - profit_pred)::DOUBLE AS residual, row_number() OVER (ORDER BY abs(profit_actual - profit_pred) DESC,
        order_id, line_no, product_id, supplier_id, price_cents) AS row_number,
      'profit_test_' || lpad((row_number() OVER (ORDER BY abs(profit_actual - profit_pred) DESC, order_id, line_no, product_id,
        supplier_id, price_cents))::VARCHAR, 5, '0') AS row_id FROM items QUALIFY row_number BETWEEN 26 AND 50"""),
)
def largest_residuals(spark, sf_dir):
    rows = _profit_predictions(spark, sf_dir)
    page = reports.residual_list(rows, ITEM_KEYS, "abs_residual", 2, 25)
    return page.select("order_id", "line_no", "actual_profit", "predicted_profit", "residual", "row_number", "row_id")


@query(
    "TOP-04",
    over_items("""SELECT order_id, line_no, profit_actual::DOUBLE AS actual_profit FROM items
      ORDER BY profit_actual DESC, order_id, line_no, product_id, supplier_id, price_cents LIMIT 25"""),
)
def most_profitable_items(spark, sf_dir):
    rows = _profit_predictions(spark, sf_dir)
    return reports.residual_list(rows, ITEM_KEYS, "actual_profit").select("order_id", "line_no", "actual_profit")


def _profit_predictions(spark, sf_dir):
    items = order_items(spark, sf_dir, [*ITEM_KEYS, "profit_actual", "profit_pred"])
    return items.select(
        *ITEM_KEYS, F.col("profit_actual").alias("actual_profit"), F.col("profit_pred").alias("predicted_profit"),
        (F.col("profit_actual") - F.col("profit_pred")).alias("residual"),
    )


# --- thresholds -----------------------------------------------------------------------------------


def _confusion(t: str) -> str:
    return f"""COUNT(*) FILTER (bp >= {t} AND true_label = 1) AS tp, COUNT(*) FILTER (bp >= {t} AND true_label = 0) AS fp,
      COUNT(*) FILTER (bp < {t} AND true_label = 1) AS fn, COUNT(*) FILTER (bp < {t} AND true_label = 0) AS tn"""


_QUALITY = f"""{ratio4('tp', 'tp+fp')} AS "precision", {ratio4('tp', 'tp+fn')} AS recall, {ratio4('2*tp', '2*tp+fp+fn')} AS f1,
      tp + fp AS selected_count, ((tp+fp)*80)::DOUBLE AS upgrade_spend, (fn*250)::DOUBLE AS missed_delay_cost,
      (fp*80)::DOUBLE AS false_alarm_cost, (fp*80 + fn*250)::DOUBLE AS expected_cost"""


@query(
    "AGG-08 SCL-07",
    over_items(f""", c AS (SELECT {_confusion('5000')} FROM items)
      SELECT 0.5::DOUBLE AS threshold, tp, fp, fn, tn, {_QUALITY} FROM c"""),
)
def metrics_at_half(spark, sf_dir):
    return evaluation.threshold_metrics(order_items(spark, sf_dir, ["p_late", "true_label"]), "0.5")


_SWEEP = f""", t AS (SELECT UNNEST(generate_series(1000, 9000, 500)) AS t),
      c AS (SELECT t, {_confusion('t')} FROM items CROSS JOIN t GROUP BY t),
      sweep AS (SELECT t::DOUBLE/10000 AS threshold, tp, fp, fn, tn, {_QUALITY} FROM c)"""


@query("AGG-09 JON-10 SNK-07", (over_items(_SWEEP + " SELECT * FROM sweep")))
def threshold_sweep(spark, sf_dir):
    return evaluation.threshold_sweep(order_items(spark, sf_dir, ["p_late", "true_label"]))


@query(
    "TOP-10 SNK-07",
    over_items(
        _SWEEP
        + """ SELECT 'best_f1' AS criterion, threshold, "precision", recall, f1, tp, fp, fn, tn, expected_cost FROM
      (SELECT * FROM sweep ORDER BY f1 DESC, recall DESC, "precision" DESC, threshold LIMIT 1)
      UNION ALL SELECT 'best_expected_cost', threshold, "precision", recall, f1, tp, fp, fn, tn, expected_cost FROM
      (SELECT * FROM sweep ORDER BY expected_cost, fn, fp, threshold LIMIT 1)"""
    ),
)
def best_thresholds(spark, sf_dir):
    return evaluation.best_thresholds(evaluation.threshold_sweep(order_items(spark, sf_dir, ["p_late", "true_label"])))


@query(
    "AGG-10",
    over_pred(f"""SELECT COUNT(*) AS total_orders, COUNT(*) FILTER (bp >= 5000) AS high_risk_orders,
      {ratio4('COUNT(*) FILTER (bp >= 5000)', 'COUNT(*)')} AS predicted_late_rate, {ratio4('SUM(true_label)', 'COUNT(*)')} AS actual_late_rate,
      ROUND(SUM(expected_penalty) FILTER (bp >= 5000), 2)::DOUBLE AS expected_penalty_sum, {_confusion('5000')},
      {ratio4('COUNT(*) FILTER (bp >= 5000 AND true_label = 1)', 'COUNT(*) FILTER (bp >= 5000)')} AS "precision",
      {ratio4('COUNT(*) FILTER (bp >= 5000 AND true_label = 1)', 'COUNT(*) FILTER (true_label = 1)')} AS recall,
      {ratio4('2*COUNT(*) FILTER (bp >= 5000 AND true_label = 1)', 'COUNT(*) FILTER (bp >= 5000) + COUNT(*) FILTER (true_label = 1)')} AS f1
      FROM pred"""),
)
def metrics_row(spark, sf_dir):
    return evaluation.metrics_row(predictions(spark, sf_dir, ["p_late", "true_label"]), "0.5")


# --- calibration --------------------------------------------------------------------------------------


def auc_sql(source: str, group: str, p: str) -> str:
    return f"""hist AS (SELECT {group} AS g, {p} AS s, COUNT(*) FILTER (true_label = 1) AS pos, COUNT(*) FILTER (true_label = 0) AS neg
        FROM {source} GROUP BY 1, 2),
      cum AS (SELECT *, SUM(neg) OVER (PARTITION BY g ORDER BY s) AS upto FROM hist),
      area AS (SELECT g, SUM(pos+neg)::BIGINT AS n, CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN ROUND(SUM(pos*(2*upto-neg))::DOUBLE /
        (2.0::DOUBLE*SUM(pos)::DOUBLE*SUM(neg)::DOUBLE), 4) END AS auc, {ratio4('SUM(pos)', 'SUM(pos+neg)')} AS late_rate,
        ((2*SUM(s*(pos+neg))+SUM(pos+neg))//(2*SUM(pos+neg)))::DOUBLE/10000 AS mean_p_late FROM cum GROUP BY 1)"""


@query(
    "AGG-19",
    over_items(f""", {auc_sql('items', '1', 'bp')}, c AS (SELECT {_confusion('5000')}, COUNT(*) FILTER (bp >= 7000) AS high_risk_orders FROM items)
      SELECT n, auc, late_rate AS actual_late_rate, tp, fp, fn, tn, {ratio4('tp', 'tp+fp')} AS "precision", {ratio4('tp', 'tp+fn')} AS recall,
      {ratio4('2*tp', '2*tp+fp+fn')} AS f1, high_risk_orders FROM area CROSS JOIN c"""),
)
def classifier_report(spark, sf_dir):
    return evaluation.classifier_report(order_items(spark, sf_dir, ["p_late", "true_label"]))


@query(
    "AGG-17 AGG-19",
    over_items(f", {auc_sql('items', 'shipping_mode', 'bp')} SELECT g AS shipping_mode, n, auc, late_rate, mean_p_late FROM area"),
)
def auc_by_mode(spark, sf_dir):
    return evaluation.auc_by(order_items(spark, sf_dir, ["shipping_mode", "p_late", "true_label"]), ["shipping_mode"])


def _dims(source: str, keep: str) -> str:
    return f"""long AS (SELECT 'customer_segment' AS dimension, customer_segment AS grp, {keep} FROM {source}
        UNION ALL SELECT 'order_region', order_region, {keep} FROM {source})"""


_DELAY = f"{_dims('mart', 'p_bp, true_label')}, {auc_sql('long', '(dimension, grp)', 'p_bp')}"


@query(
    "AGG-17 FLT-06",
    over_mart(f""", {_DELAY} SELECT g[1] AS dimension, g[2] AS "group", n, auc, late_rate, mean_p_late FROM area WHERE n >= 30"""),
)
def delay_calibration(spark, sf_dir):
    return evaluation.delay_calibration(
        history_of(spark, sf_dir, ("customer_segment", "order_region")), ["customer_segment", "order_region"]
    )


_ERRORS = """COUNT(*) AS n, ROUND(SUM(ABS(a-p))::DOUBLE/COUNT(*), 2) AS mae, ROUND(SQRT(SUM((a-p)*(a-p))::DOUBLE/COUNT(*)), 2) AS rmse,
      ROUND(1 - SUM((a-p)*(a-p))::DOUBLE/(SUM(a*a)::DOUBLE - SUM(a)::DOUBLE*SUM(a)::DOUBLE/COUNT(*)), 4) AS r2,
      ROUND(SUM(a-p)::DOUBLE/COUNT(*), 2) + 0.0 AS resid_mean"""


@query(
    "AGG-18 FLT-06",
    over_items(f""", {_dims('items', 'profit_actual AS a, profit_pred AS p')}
      SELECT dimension, grp AS "group", {_ERRORS} FROM long GROUP BY 1, 2 HAVING COUNT(*) >= 30"""),
)
def profit_calibration(spark, sf_dir):
    cols = ["customer_segment", "order_region", "profit_actual", "profit_pred"]
    return evaluation.profit_calibration(order_items(spark, sf_dir, cols), ["customer_segment", "order_region"])


@query(
    "AGG-40 SNK-06",
    over_mart(f""", {_DELAY}, long2 AS (SELECT 'customer_segment' AS dimension, customer_segment AS grp, profit_actual AS a, profit_pred AS p FROM items
        UNION ALL SELECT 'order_region', order_region, profit_actual, profit_pred FROM items)
      SELECT 'delay' AS kind, g[1] AS dimension, g[2] AS "group", n, auc, late_rate, mean_p_late, NULL::DOUBLE AS mae, NULL::DOUBLE AS rmse,
        NULL::DOUBLE AS r2, NULL::DOUBLE AS resid_mean FROM area WHERE n >= 30
      UNION ALL SELECT 'profit', dimension, grp, n, NULL, NULL, NULL, mae, rmse, r2, resid_mean FROM
        (SELECT dimension, grp, {_ERRORS} FROM long2 GROUP BY 1, 2 HAVING COUNT(*) >= 30)"""),
)
def trust_map(spark, sf_dir):
    dims = ["customer_segment", "order_region"]
    rows = order_items(spark, sf_dir, [*dims, "profit_actual", "profit_pred"])
    return evaluation.trust_map(history_of(spark, sf_dir, dims), rows, dims)


@query(
    "AGG-20",
    over_items(f"""SELECT {_ERRORS}, ROUND(quantile_cont(ABS(a-p)::DOUBLE, 0.95), 4) AS residual_p95_abs FROM
      (SELECT profit_actual AS a, profit_pred AS p FROM items)"""),
)
def regression_report(spark, sf_dir):
    return evaluation.regression_report(order_items(spark, sf_dir, ["profit_actual", "profit_pred"]), "profit_actual", "profit_pred")


@query(
    "AGG-37",
    over_items(f""", {auc_sql('items', "market", 'bp')} SELECT m.metric, ROUND(o.v, 4) AS old_value, ROUND(n.v, 4) AS new_value,
      ROUND(n.v - o.v, 4) AS difference FROM (VALUES ('auc'), ('late_rate'), ('mean_p_late')) m(metric),
      LATERAL (SELECT CASE m.metric WHEN 'auc' THEN auc WHEN 'late_rate' THEN late_rate ELSE mean_p_late END AS v FROM area WHERE g = 'F') o,
      LATERAL (SELECT CASE m.metric WHEN 'auc' THEN auc WHEN 'late_rate' THEN late_rate ELSE mean_p_late END AS v FROM area WHERE g = 'O') n"""),
)
def compare_models(spark, sf_dir):
    """Metrics of the scores on two halves of the table, compared as old and new."""
    by_half = evaluation.auc_by(order_items(spark, sf_dir, ["market", "p_late", "true_label"]), ["market"])
    names = ["auc", "late_rate", "mean_p_late"]
    old = evaluation.as_metric_rows(by_half.where("market = 'F'"), names)
    new = evaluation.as_metric_rows(by_half.where("market = 'O'"), names)
    return evaluation.compare_metrics(old, new)


_SCORES = """rescored AS (SELECT true_label, bp AS old, (bp * 3 + 2000 * true_label + order_id * 13 % 4000) // 4 AS new FROM items),
      long AS (SELECT 'old' AS model, true_label, old AS s FROM rescored UNION ALL SELECT 'new', true_label, new FROM rescored)"""
_VALUES = f"""SELECT g, n, auc, {ratio4('tp', 'tp+fp')} AS p, {ratio4('tp', 'tp+fn')} AS r, {ratio4('2*tp', '2*tp+fp+fn')} AS f1 FROM area JOIN
      (SELECT model, COUNT(*) FILTER (s >= 5000 AND true_label = 1) AS tp, COUNT(*) FILTER (s >= 5000 AND true_label = 0) AS fp, COUNT(*) FILTER (s < 5000 AND true_label = 1) AS fn FROM long GROUP BY 1) ON model = g"""


@query(
    "AGG-37",
    over_items(f""", {_SCORES}, {auc_sql('long', 'model', 's')}, v AS ({_VALUES}),
      named AS (SELECT g, unnest(['auc', 'f1', 'precision', 'recall']) AS metric, unnest([auc, f1, p, r]) AS value FROM v)
      SELECT o.metric, o.value AS old_value, n.value AS new_value, ROUND(n.value - o.value, 4) AS difference FROM named o JOIN named n ON o.metric = n.metric AND o.g = 'old' AND n.g = 'new'"""),
)
def compare_two_models(spark, sf_dir):
    """Two models' scores of the same rows: every metric of the old and of the new one, and what changed."""
    items = order_items(spark, sf_dir, ["order_id", "p_late", "true_label"])
    points = F.round(F.col("p_late") * 10_000).cast("long")
    newer = F.floor((points * 3 + 2000 * F.col("true_label") + F.col("order_id") * 13 % 4000) / 4)
    rescored = items.withColumn("p_late", (newer.cast("decimal(8,0)") * F.lit(Decimal("0.0001"))).cast("decimal(8,4)"))
    names = ["auc", "f1", "precision", "recall"]
    old, new = (evaluation.as_metric_rows(evaluation.classifier_report(df), names) for df in (items, rescored))
    return evaluation.compare_metrics(old, new)


@query(
    "SRC-08 PRJ-15",
    over_mart(f"SELECT {bucket_sql('p_late')} AS risk_bucket, COUNT(*) AS orders, SUM(upgrade_cost)::DOUBLE AS cost FROM mart GROUP BY 1"),
)
def orders_by_bucket(spark, sf_dir):
    return mart_of(spark, sf_dir, ()).groupBy("risk_bucket").agg(
        F.count("*").alias("orders"), F.sum("upgrade_cost").alias("cost")
    )


@query(
    "SCL-07",
    """SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN 0.0::DOUBLE ELSE c_acctbal / (c_nationkey % 5) END AS share FROM customer""",
)
def safe_shares(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", safe_divide(F.col("c_acctbal"), F.col("c_nationkey") % 5).alias("share")
    )


@query(
    "PRJ-14",
    f"SELECT order_id, 'ORD-' || upper(substr({_HASH}, 1, 8)) AS display_order_id FROM (SELECT o_orderkey AS order_id FROM orders)",
)
def display_ids(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    return orders.select("order_id", display_id(hash_id(F.col("order_id"), "EXAMPLE_DELAY_SALT")).alias("display_order_id"))


