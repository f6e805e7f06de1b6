"""Order roll-ups, the order mart and reports on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.constants import REGIONS
from parcelwise.functions.scalars import display_id, hash_id, month_key
from parcelwise.operators import decisions, mart, money, reports
from parcelwise.operators.codes import Codes, measured
from parcelwise.operators.money import HISTORY
from parcelwise.plans.registry import query
from parcelwise.plans.sql import over_items, over_mart, over_pred, ratio4
from parcelwise.sources.tables import ITEM_KEYS, SCHEDULED_DAYS, order_items, predictions, table

TIES = ITEM_KEYS[1:]
MART_COLUMNS = [
    *ITEM_KEYS, "customer_id", "customer_segment", "order_region", "category_name", "shipping_mode", "order_ts",
    "discount_rate", "p_late", "true_label", "profit_actual", "profit_pred",
]


# widest values of the item view's position columns: a table beyond them is an error, never a wrong order
ITEM_SPANS = {"line_no": (0, 998), "product_id": (0, 10**11 - 2), "supplier_id": (0, 10**10 - 2), "price_cents": (0, 10**9 - 2)}


def item_codes(spark, sf_dir, dims=(), scores=False) -> Codes | None:
    """Spans of the items' positions and dictionaries of the texts among ``dims``, from the dimension tables."""
    sources = {
        "customer_segment": lambda: table(spark, sf_dir, "customer").select("c_mktsegment"),
        "category_name": lambda: table(spark, sf_dir, "part").select("p_type"),
        "shipping_mode": lambda: list(SCHEDULED_DAYS),
        "order_region": lambda: REGIONS,
        "risk_bucket": lambda: ["High", "Medium", "Low"],
    }
    texts = {c: sources[c]() for c in dims if c in sources}
    order = ["p_late", *TIES] if scores else TIES
    return measured(order_items(spark, sf_dir, TIES), order, texts, known={**ITEM_SPANS, "p_late": (0, 10_000)})


def mart_of(spark, sf_dir, dims=("customer_segment",), penalty=250):
    """Order mart over the test tables with just the wanted dimensions."""
    base = [*ITEM_KEYS, "discount_rate", "p_late", "true_label", "profit_actual", "profit_pred", "shipping_mode", "order_region"]
    pred = predictions(spark, sf_dir, [*base, *dims])
    codes = item_codes(spark, sf_dir, dims) if dims else None
    return mart.decision_mart_single(pred, "order_id", TIES, penalty, dims, codes)


def history_of(spark, sf_dir, dims=("customer_segment",), penalty=250):
    """The mart without upgrade cost, for reports that need no rate card."""
    items = order_items(spark, sf_dir, [*ITEM_KEYS, "discount_rate", "p_late", "true_label", "profit_actual", "profit_pred", *dims])
    codes = item_codes(spark, sf_dir, dims) if dims else None
    return mart.decision_mart_single(items.withColumn("upgrade_cost", F.lit(None).cast("decimal(12,2)")), "order_id", TIES, penalty, dims, codes)


@query(
    "AGG-15 PRJ-21 AGG-01 AGG-02",
    over_mart("""SELECT customer_segment AS segment, COUNT(*) AS orders, ROUND(SUM(profit_actual),2)::DOUBLE AS book_profit,
      ROUND(SUM(net_of_service),2)::DOUBLE AS net_of_service, ROUND(SUM(epar),2)::DOUBLE AS epar,
      SUM(is_false_positive_value)::BIGINT AS false_positive_value_orders,
      COUNT(*) FILTER (profit_actual > 0) AS profit_positive_orders
      FROM mart GROUP BY 1"""),
)
def roi_by_segment(spark, sf_dir):
    return reports.roi_by(history_of(spark, sf_dir))


@query(
    "AGG-14",
    over_mart(f"""SELECT COUNT(*) AS rows_orders, ROUND(SUM(profit_actual),2)::DOUBLE AS book_profit_total,
      ROUND(SUM(net_of_service),2)::DOUBLE AS net_of_service_total,
      ROUND(SUM(profit_actual)-SUM(net_of_service),2)::DOUBLE AS service_erosion_total,
      SUM(is_false_positive_value)::BIGINT AS false_positive_value_orders,
      COUNT(*) FILTER (profit_actual > 0) AS profit_positive_orders,
      {ratio4('SUM(is_false_positive_value)', 'COUNT(*) FILTER (profit_actual > 0)')} AS false_positive_value_pct,
      ROUND(SUM(epar),2)::DOUBLE AS epar_total FROM mart"""),
)
def roi_totals(spark, sf_dir):
    return reports.roi_totals(history_of(spark, sf_dir, ()))


@query(
    "AGG-14",
    over_mart("""SELECT COUNT(*) AS rows_orders, ROUND(SUM(profit_actual),2)::DOUBLE AS book_profit_total,
      ROUND(SUM(profit_actual),2)::DOUBLE AS net_of_service_total, 0.0::DOUBLE AS service_erosion_total,
      0::BIGINT AS false_positive_value_orders, COUNT(*) FILTER (profit_actual > 0) AS profit_positive_orders,
      0.0::DOUBLE AS false_positive_value_pct, ROUND(SUM(epar),2)::DOUBLE AS epar_total FROM mart"""),
)
def roi_totals_without_penalty(spark, sf_dir):
    return reports.roi_totals(history_of(spark, sf_dir, ()), penalty=0)


@query(
    "AGG-16 SNK-06",
    over_mart(f"""SELECT COUNT(*) AS rows_orders, ROUND(SUM(profit_actual),2)::DOUBLE AS book_profit_total,
      ROUND(SUM(net_of_service),2)::DOUBLE AS net_of_service_total,
      ROUND(SUM(profit_actual)-SUM(net_of_service),2)::DOUBLE AS service_erosion_total,
      SUM(is_false_positive_value)::BIGINT AS false_positive_value_orders,
      COUNT(*) FILTER (profit_actual > 0) AS profit_positive_orders,
      {ratio4('SUM(is_false_positive_value)', 'COUNT(*) FILTER (profit_actual > 0)')} AS false_positive_value_pct,
      ROUND(SUM(epar),2)::DOUBLE AS epar_total,
      ROUND(1 - SUM(profit_resid*profit_resid)::DOUBLE / (SUM(profit_actual*profit_actual)::DOUBLE
        - SUM(profit_actual)::DOUBLE*SUM(profit_actual)::DOUBLE/COUNT(*)), 4) AS profit_r2 FROM mart"""),
)
def decision_summary(spark, sf_dir):
    return reports.decision_summary(history_of(spark, sf_dir, ()))


@query(
    "AGG-01",
    over_mart("""SELECT order_id, p_late::DOUBLE AS p_late, true_label, upgrade_cost::DOUBLE AS upgrade_cost, shipping_mode,
      order_region, strftime(order_ts, '%Y-%m-%d') AS order_date FROM mart"""),
)
def order_rollup_delay(spark, sf_dir):
    pred = predictions(spark, sf_dir, [*ITEM_KEYS, "order_region", "order_ts", "true_label"])
    rolled = mart.delay_rollup(pred, "order_id", TIES, item_codes(spark, sf_dir, ("shipping_mode", "order_region")))
    return rolled.withColumn("order_date", F.date_format("order_ts", "yyyy-MM-dd")).drop("order_ts")


@query(
    "AGG-02 PRJ-02",
    over_mart("""SELECT order_id, profit_actual::DOUBLE AS profit_actual, profit_pred::DOUBLE AS profit_pred, customer_segment,
      category_name, discount_rate::DOUBLE AS discount_rate, customer_id,
      sha256('EXAMPLE_DELAY_SALT:' || customer_id) AS customer_id_hash FROM mart"""),
)
def order_rollup_profit(spark, sf_dir):
    cols = [*ITEM_KEYS, "customer_id", "customer_segment", "category_name", "discount_rate", "profit_actual", "profit_pred"]
    codes = item_codes(spark, sf_dir, ("customer_segment", "category_name"))
    return mart.profit_rollup(order_items(spark, sf_dir, cols), "order_id", TIES, codes=codes)


@query(
    "JON-01 PRJ-21 SNK-06",
    over_mart("""SELECT order_id, p_late::DOUBLE AS p_late, true_label, risk_bucket, profit_actual::DOUBLE AS profit_actual,
      profit_pred::DOUBLE AS profit_pred, net_of_service::DOUBLE AS net_of_service, epar::DOUBLE AS epar,
      profit_resid::DOUBLE AS profit_resid, is_false_positive_value, upgrade_cost::DOUBLE AS upgrade_cost,
      expected_penalty::DOUBLE AS expected_penalty, customer_segment, category_name, shipping_mode
      FROM mart WHERE order_id IN (SELECT order_id FROM pred WHERE market = 'O')"""
             .replace("FROM mart WHERE", "FROM (SELECT * REPLACE ((p_bp::DECIMAL(9,0)*0.0001)::DECIMAL(9,4) AS p_late) FROM mart) WHERE")),
)
def decision_mart_joined(spark, sf_dir):
    """Orders with an open line: delay and profit sides rolled up apart and joined."""
    items = order_items(spark, sf_dir, [*MART_COLUMNS, "market"])
    chosen = items.where("market = 'O'").select("order_id").distinct()
    pred = money.with_prediction_money(mart.items_of_orders(items, chosen, "order_id"))
    codes = item_codes(spark, sf_dir, ("customer_segment", "category_name", "shipping_mode", "order_region"))
    full = mart.decision_mart(pred, items, "order_id", TIES, codes=codes)
    return full.select(
        "order_id", "p_late", "true_label", "risk_bucket", "profit_actual", "profit_pred", "net_of_service", "epar",
        "profit_resid", "is_false_positive_value", "upgrade_cost", "expected_penalty", "customer_segment", "category_name",
        "shipping_mode",
    )


@query(
    "JON-02 SET-02",
    over_items("""SELECT shipping_mode, COUNT(*) AS items, COUNT(DISTINCT order_id) AS orders, SUM(profit_actual)::DOUBLE AS profit
      FROM items WHERE order_id IN (SELECT order_id FROM items WHERE true_label = 1 AND profit_actual < 0) GROUP BY 1"""),
)
def items_of_late_losing_orders(spark, sf_dir):
    items = order_items(spark, sf_dir, ["order_id", "shipping_mode", "true_label", "profit_actual"])
    chosen = items.where("true_label = 1 and profit_actual < 0").select("order_id").distinct()
    per_order = mart.items_of_orders(items, chosen, "order_id").groupBy("shipping_mode", "order_id").agg(
        F.count("*").alias("n"), F.sum("profit_actual").alias("p")
    )
    return per_order.groupBy("shipping_mode").agg(
        F.sum("n").alias("items"), F.count("*").alias("orders"), F.sum("p").alias("profit")
    )


@query(
    "JON-03",
    """SELECT o_orderkey AS order_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def orders_without_items(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"))
    return mart.orders_missing(orders, items, "order_id")


@query(
    "JON-04 PRJ-03",
    over_items("""SELECT substr(sha256('EXAMPLE_PROFIT_SALT' || order_id), 1, 16) AS order_key, customer_segment, order_region,
      profit_actual::DOUBLE AS actual_profit, profit_pred::DOUBLE AS predicted_profit FROM items"""),
)
def profit_rows_with_dimensions(spark, sf_dir):
    """Profit predictions keyed by the short hash, joined with their order's dimensions."""
    key = hash_id(F.col("order_id"), "EXAMPLE_PROFIT_SALT", "", 16).alias("order_key")
    items = order_items(spark, sf_dir, [*ITEM_KEYS, "customer_segment", "order_region", "profit_actual", "profit_pred"])
    predicted = items.select(
        key, F.col("profit_actual").alias("actual_profit"), F.col("profit_pred").alias("predicted_profit")
    )
    # hash once per order, after the roll-up
    texts = ("customer_segment", "order_region")
    rows, first, finish = mart.first_values(items, texts, TIES, item_codes(spark, sf_dir, texts))
    dims = finish(rows.groupBy("order_id").agg(*first)).select(key, *texts)
    return predicted.join(dims, "order_key", "left").dropna(subset=["customer_segment", "order_region"])


@query(
    "JON-12",
    over_pred("""SELECT o.order_id, o.wanted, f.shipping_mode, f.p_late::DOUBLE AS p_late, f.risk_bucket FROM
      (SELECT o_orderkey AS order_id, o_totalprice AS wanted FROM orders WHERE o_orderstatus = 'P') o
      LEFT JOIN (SELECT order_id, arg_min(shipping_mode, k) AS shipping_mode, arg_min(p_late, k) AS p_late, arg_min(risk_bucket, k) AS risk_bucket
        FROM (SELECT *, (line_no, product_id, supplier_id, price_cents) AS k FROM pred) GROUP BY order_id) f USING (order_id)"""),
)
def hydrated_orders(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("wanted")
    )
    pred = predictions(spark, sf_dir, ITEM_KEYS).select(*ITEM_KEYS, "shipping_mode", "p_late", "risk_bucket")
    full = mart.hydrate(wanted, pred, "order_id", TIES)
    return full.select("order_id", "wanted", "shipping_mode", "p_late", "risk_bucket")


# --- axes, facets, portfolio ------------------------------------------------------------


@query(
    "PRJ-20 PRJ-28",
    over_mart("""SELECT customer_segment, CASE WHEN net_of_service >= 0 AND p_late >= 0.5 THEN 'high_profit_high_risk'
      WHEN net_of_service < 0 AND p_late >= 0.5 THEN 'low_profit_high_risk'
      WHEN net_of_service >= 0 THEN 'high_profit_low_risk' ELSE 'low_profit_low_risk' END AS quadrant,
      COUNT(*) AS orders, SUM(net_of_service)::DOUBLE AS value FROM mart GROUP BY 1, 2"""),
)
def portfolio_quadrants(spark, sf_dir):
    view = money.with_value_risk(history_of(spark, sf_dir))
    return view.groupBy("customer_segment", reports.quadrant(F.col("value"), F.col("risk")).alias("quadrant")).agg(
        F.count("*").alias("orders"), F.sum("value").alias("value")
    )


@query(
    "PRJ-20",
    over_mart("""SELECT true_label::DOUBLE AS risk, COUNT(*) AS orders, SUM(profit_actual)::DOUBLE AS value,
      SUM(CASE WHEN profit_actual > 0 AND profit_actual - true_label*100 < 0 THEN 1 ELSE 0 END)::BIGINT AS false_positives
      FROM mart GROUP BY 1"""),
)
def value_by_actual_risk(spark, sf_dir):
    view = money.with_value_risk(history_of(spark, sf_dir, ()), "book_profit", "true_label", 100)
    return view.groupBy("risk").agg(
        F.count("*").alias("orders"), F.sum("value").alias("value"), F.sum("is_false_positive_value").alias("false_positives")
    )


@query(
    "FLT-04",
    over_mart("""SELECT CASE WHEN discount_rate < 0.10 THEN 'low' WHEN discount_rate < 0.25 THEN 'mid' ELSE 'high' END AS band,
      COUNT(*) AS orders, ROUND(SUM(net_of_service),2)::DOUBLE AS net FROM mart
      WHERE customer_segment = 'BUILDING' AND shipping_mode = 'First Class' GROUP BY 1"""),
)
def discount_bands_of_segment(spark, sf_dir):
    full = history_of(spark, sf_dir, ("customer_segment", "shipping_mode"))
    chosen = reports.filter_decision(full, segment="BUILDING", shipping="First Class")
    return chosen.groupBy(reports.discount_band(F.col("discount_rate")).alias("band")).agg(
        F.count("*").alias("orders"), reports.money2(F.sum("net_of_service")).alias("net")
    )


@query(
    "FLT-04",
    over_mart("""SELECT order_region, category_name, COUNT(*) AS orders, SUM(profit_actual)::DOUBLE AS profit FROM mart
      WHERE category_name = 'PROMO' AND discount_rate < 0.10 GROUP BY 1, 2"""),
)
def low_discount_category(spark, sf_dir):
    full = history_of(spark, sf_dir, ("order_region", "category_name"))
    chosen = reports.filter_decision(full, category="PROMO", discount_band="low")
    return chosen.groupBy("order_region", "category_name").agg(
        F.count("*").alias("orders"), F.sum("profit_actual").alias("profit")
    )


@query(
    "OPT-07 TOP-03 PRJ-14",
    over_mart("""SELECT row_number() OVER (ORDER BY epar DESC, order_id) AS row_number,
      'ORD-' || substr(order_id::VARCHAR, 1, 8) AS id, ROUND(epar,2)::DOUBLE AS epar, ROUND(profit_actual,2)::DOUBLE AS profit_actual,
      p_late::DOUBLE AS p_late, ROUND(net_of_service,2)::DOUBLE AS net_of_service, customer_segment AS segment,
      order_region AS region, risk_bucket FROM mart WHERE customer_segment = 'FURNITURE' QUALIFY row_number BETWEEN 51 AND 100"""),
)
def at_risk_list(spark, sf_dir):
    full = mart_of(spark, sf_dir, ("customer_segment", "order_region"))
    return reports.at_risk_list(reports.filter_decision(full, segment="FURNITURE"), "order_id", 2, 50)


@query(
    "OPT-07 TOP-03",
    over_mart("""SELECT order_id, epar::DOUBLE AS epar, row_number() OVER (ORDER BY epar DESC, order_id) AS row_number FROM mart
      WHERE shipping_mode = 'Same Day'
      QUALIFY row_number > ((COUNT(*) OVER () + 199)//200 - 1)*200"""),
)
def last_page_of_list(spark, sf_dir):
    """A page far past the end falls back to the last one."""
    full = history_of(spark, sf_dir, ("shipping_mode",)).where("shipping_mode = 'Same Day'")
    return reports.clamped_page(full, ["-epar", "order_id"], 10**6, 200).select("order_id", "epar", "row_number")


@query(
    "TOP-08 OPT-07",
    over_mart("""SELECT 'ORD-' || substr(order_id::VARCHAR, 1, 8) AS id, ROUND(net_of_service,2)::DOUBLE AS value, p_late::DOUBLE AS risk,
      ROUND(epar,2)::DOUBLE AS epar, customer_segment AS segment, is_false_positive_value AS fp FROM mart
      ORDER BY sha256('42:' || order_id) LIMIT 1500"""),
)
def scatter_sample(spark, sf_dir):
    view = money.with_value_risk(history_of(spark, sf_dir))
    return reports.scatter_sample(view, "order_id").select(
        display_id(F.col("order_id")).alias("id"), reports.money2(F.col("value")).alias("value"), F.col("risk"),
        reports.money2(F.col("epar")).alias("epar"), F.col("customer_segment").alias("segment"),
        F.col("is_false_positive_value").alias("fp"),
    )


@query(
    "AGG-33",
    over_items("""SELECT 'customer_segment' AS facet, customer_segment AS value FROM items GROUP BY ALL
      UNION ALL SELECT 'order_region', order_region FROM items GROUP BY ALL
      UNION ALL SELECT 'shipping_mode', shipping_mode FROM items GROUP BY ALL"""),
)
def facet_values(spark, sf_dir):
    cols = ["customer_segment", "order_region", "shipping_mode"]
    return reports.facets(order_items(spark, sf_dir, cols), cols)


@query("AGG-33", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def available_months(spark, sf_dir):
    return reports.available_months(table(spark, sf_dir, "orders"), "o_orderdate")


@query(
    "OPT-08",
    over_mart("""SELECT 'historical_validation' AS scope, COUNT(*) AS rows_orders, 'actual_profit' AS profit_basis,
      'profit_actual' AS profit_column, 'actual_late_label' AS delay_cost_basis, 1 AS has_ground_truth,
      1 AS false_positive_available FROM mart"""),
)
def data_scope(spark, sf_dir):
    return decisions.scope_record(history_of(spark, sf_dir, ()), HISTORY)


# --- trends -----------------------------------------------------------------------------


@query(
    "AGG-32 WIN-04",
    over_mart(f"""SELECT customer_segment AS "group", strftime(order_ts, '%Y-%m') AS month, SUM(net_of_service)::DOUBLE AS net_of_service,
      {ratio4('SUM(true_label)', 'COUNT(*)')} AS late_rate, COUNT(*) AS orders,
      (row_number() OVER (PARTITION BY customer_segment ORDER BY strftime(order_ts, '%Y-%m')) - 1)::INTEGER AS month_index
      FROM mart GROUP BY 1, 2"""),
)
def deterioration_series(spark, sf_dir):
    return reports.deterioration_series(history_of(spark, sf_dir, ("customer_segment", "order_ts")), "customer_segment")


_TREND = """, series AS (SELECT {dim} AS grp, strftime(order_ts, '%Y-%m') AS month, SUM(net_of_service) AS net,
      row_number() OVER (PARTITION BY {dim} ORDER BY strftime(order_ts, '%Y-%m')) - 1 AS x FROM mart GROUP BY 1, 2)
      SELECT grp AS "group", COUNT(*) AS months, ROUND(regr_slope(net::DOUBLE, x::DOUBLE), 2) AS trend_slope,
      ROUND(arg_max(net, month), 2)::DOUBLE AS last_net_of_service,
      ROUND(regr_intercept(net::DOUBLE, x::DOUBLE) + regr_slope(net::DOUBLE, x::DOUBLE) * COUNT(*), 2) AS forecast_next
      FROM series GROUP BY 1 HAVING COUNT(*) >= 3"""


@query("AGG-32 WIN-05 FLT-06", over_mart(_TREND.format(dim="customer_segment")))
def deterioration_by_segment(spark, sf_dir):
    series = reports.deterioration_series(history_of(spark, sf_dir, ("customer_segment", "order_ts")), "customer_segment")
    return reports.deterioration_trend(series)


@query("AGG-32 WIN-05", over_mart(_TREND.format(dim="order_region")))
def deterioration_by_region(spark, sf_dir):
    series = reports.deterioration_series(history_of(spark, sf_dir, ("order_region", "order_ts")), "order_region")
    return reports.deterioration_trend(series)


@query(
    "SET-04",
    over_mart("""SELECT g.category_name AS "group", m.month, SUM(net_of_service)::DOUBLE AS net_of_service FROM
      (SELECT DISTINCT category_name FROM mart WHERE profit_actual < -150) g
      CROSS JOIN (SELECT DISTINCT strftime(order_ts, '%Y-%m') AS month FROM mart WHERE profit_actual < -150) m
      LEFT JOIN (SELECT * FROM mart WHERE profit_actual < -150) x
        ON x.category_name = g.category_name AND strftime(x.order_ts, '%Y-%m') = m.month GROUP BY 1, 2"""),
)
def dense_monthly_series(spark, sf_dir):
    """Heavy losses per category, with empty months shown."""
    losses = history_of(spark, sf_dir, ("category_name", "order_ts")).where("profit_actual < -150")
    return reports.dense_series(reports.deterioration_series(losses, "category_name"))


@query("SCL-03", """SELECT strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS orders, ROUND(SUM(o_totalprice::DECIMAL(18,2)),2)::DOUBLE AS total
      FROM orders GROUP BY 1""")
def orders_per_month(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(month_key(F.col("o_orderdate")).alias("month")).agg(
        F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total")
    )
