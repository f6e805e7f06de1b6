"""Reading, cleaning, de-identifying and storing order files."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.constants import LABEL
from parcelwise.functions.scalars import (
    clip_unit, date_parts, hash_id, mask_name, number_or, one_hot_decode, parse_order_ts, to_number, upload_id,
)
from parcelwise.operators import evaluation, explain, features, mart, money, privacy, reports, sessions
from parcelwise.plans.orders import mart_of
from parcelwise.plans.registry import query
from parcelwise.plans.sql import bucket_sql, over_items, over_mart, over_pred
from parcelwise.session import scratch_path, shuffles_removed
from parcelwise.sources import readers, store
from parcelwise.sources.tables import ITEM_KEYS, RAW_NAMES, order_items, predictions, raw_orders, table


# --- personal data --------------------------------------------------------------------


@query(
    "PRJ-01 PRJ-07",
    over_items("""SELECT shipping_mode AS mode, COUNT(*) AS n, SUM(true_label)::BIGINT AS late, 17 AS columns_left FROM items GROUP BY 1"""),
)
def cleaned_orders(spark, sf_dir):
    """Personal and leakage columns dropped, label kept; the column count is part of the answer."""
    raw = raw_orders(spark, sf_dir, [*RAW_NAMES][:19])
    clean = privacy.drop_leakage(privacy.drop_pii(raw)).drop("Order Id", "Customer Id")
    return clean.groupBy(F.col("Shipping Mode").alias("mode")).agg(
        F.count("*").alias("n"), F.sum(LABEL).alias("late"), F.lit(len(clean.columns)).alias("columns_left")
    )


@query(
    "PRJ-06 PRJ-02 SCL-04 PRJ-08",
    over_items("""SELECT sha256('EXAMPLE_DELAY_SALT:' || order_id) AS order_id_hash, shipping_mode, order_region,
      strftime(order_ts, '%-m/%-d/%Y %-H:%M') AS order_date, COUNT(*) AS n FROM items GROUP BY ALL"""),
)
def de_identified_metadata(spark, sf_dir):
    safe = privacy.metadata(privacy.de_identify(raw_orders(spark, sf_dir)))
    return safe.groupBy("order_id_hash", "shipping_mode", "order_region", "order_date").agg(F.count("*").alias("n"))


@query(
    "PRJ-02 PRJ-03 PRJ-04",
    """SELECT o_orderkey, sha256('S:' || o_orderkey) AS salted, substr(sha256('S' || o_orderkey), 1, 16) AS join_key,
      CASE WHEN o_orderkey % 3 = 0 THEN sha256('S:' || o_orderkey) ELSE substr(sha256(o_orderkey::VARCHAR), 1, 32) END AS upload_key
      FROM orders""",
)
def order_keys(spark, sf_dir):
    key = F.col("o_orderkey")
    given = F.when(key % 3 == 0, hash_id(key, "S")).otherwise(key.cast("string"))
    return table(spark, sf_dir, "orders").select(
        key, hash_id(key, "S").alias("salted"), hash_id(key, "S", "", 16).alias("join_key"), upload_id(given).alias("upload_key")
    )


def _mask(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL OR length(trim({c})) = 0 THEN '***' WHEN length(trim({c})) = 1 THEN trim({c})
      WHEN length(trim({c})) = 2 THEN left(trim({c}), 1) || '*'
      ELSE left(trim({c}), 1) || repeat('*', length(trim({c}))-2) || right(trim({c}), 1) END"""


@query(
    "PRJ-05",
    f"""SELECT source, {_mask('name')} AS masked, COUNT(*) AS n FROM (
      SELECT 'customer' AS source, c_name AS name FROM customer UNION ALL SELECT 'status', o_orderstatus FROM orders
      UNION ALL SELECT 'lang', CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN '  ' ELSE lang END FROM documents
      UNION ALL SELECT 'part', p_name FROM part) GROUP BY 1, 2""",
)
def masked_names(spark, sf_dir):
    lang = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 1, F.lit("  ")).otherwise(F.col("lang"))
    parts = [("customer", "customer", F.col("c_name")), ("status", "orders", F.col("o_orderstatus")),
             ("lang", "documents", lang), ("part", "part", F.col("p_name"))]
    named = None
    for source, name, c in parts:
        one = table(spark, sf_dir, name).select(F.lit(source).alias("source"), mask_name(c).alias("masked"))
        named = one if named is None else named.unionByName(one)
    return named.groupBy("source", "masked").agg(F.count("*").alias("n"))


@query(
    "PRJ-31",
    over_pred("""SELECT sha256('EXAMPLE_DELAY_SALT:' || order_id) AS order_id_hash, risk_bucket, p_late::DOUBLE AS p_late,
      expected_penalty::DOUBLE AS expected_penalty, upgrade_cost::DOUBLE AS upgrade_cost,
      'ORD-' || upper(substr(sha256('EXAMPLE_DELAY_SALT:' || order_id), 1, 8)) AS display_order_id FROM pred"""),
)
def egress_view(spark, sf_dir):
    pred = predictions(spark, sf_dir, ["order_id", "customer_id"])
    hashed = pred.withColumn("order_id_hash", hash_id(F.col("order_id"), "EXAMPLE_DELAY_SALT"))
    return privacy.egress_view(hashed)


# --- money columns ------------------------------------------------------------------------


@query(
    "PRJ-16 PRJ-17 SCL-06 SNK-02 JON-08",
    over_pred("""SELECT shipping_mode, order_region, upgrade_cost::DOUBLE AS upgrade_cost, COUNT(*) AS n,
      SUM(expected_penalty)::DOUBLE AS expected_penalty FROM pred GROUP BY 1, 2, 3"""),
)
def rate_card_costs(spark, sf_dir):
    return predictions(spark, sf_dir, []).groupBy("shipping_mode", "order_region", "upgrade_cost").agg(
        F.count("*").alias("n"), F.sum("expected_penalty").alias("expected_penalty")
    )


@query(
    "JON-08 PRJ-16",
    over_items("""SELECT order_region, COUNT(*) AS n, SUM(ROUND(COALESCE(b.base, 80.00)::DECIMAL(9,2) * COALESCE(m.mult, 1.00)::DECIMAL(4,2) * 1.5, 2))::DOUBLE AS cost
      FROM items LEFT JOIN (SELECT shipping_mode AS mode, (MIN(scheduled_days) + 10)::DECIMAL(9,2) AS base FROM items WHERE scheduled_days > 0 GROUP BY 1) b
        ON b.mode = shipping_mode
      LEFT JOIN (SELECT trim(order_region) AS reg, (COUNT(DISTINCT customer_id) % 7)::DECIMAL(4,2) AS mult FROM items
        WHERE order_region LIKE '%a%' GROUP BY 1) m ON m.reg = trim(order_region) GROUP BY 1"""),
)
def tariff_join(spark, sf_dir):
    """Costs from a tariff held in tables; modes and regions without a tariff get the defaults."""
    items = order_items(spark, sf_dir, ["shipping_mode", "scheduled_days", "order_region", "customer_id"])
    modes = items.where("scheduled_days > 0").groupBy("shipping_mode").agg(
        (F.min("scheduled_days") + 10).cast("decimal(9,2)").alias("base_cost")
    )
    regions = items.where(F.col("order_region").contains("a")).select("order_region", "customer_id").distinct().groupBy("order_region").agg(
        (F.count("*") % 7).cast("decimal(4,2)").alias("multiplier")
    )
    costed = money.join_rate_card(items, modes, regions, "1.5")
    return costed.groupBy("order_region").agg(F.count("*").alias("n"), F.sum("upgrade_cost").alias("cost"))


@query(
    "PRJ-18 PRJ-13",
    """SELECT l_orderkey, COUNT(*) AS n, SUM(ROUND(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(9,6)), 2))::DOUBLE AS profit
      FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1""",
)
def upload_profits(spark, sf_dir):
    """Sales times margin from text columns; rows whose sales are no number give none."""
    sales = F.when(F.col("l_linenumber") == 3, F.lit("n/a")).otherwise(F.col("l_extendedprice").cast("string"))
    profit = money.upload_profit(sales, F.col("l_discount").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", profit.cast("decimal(18,2)").alias("profit"))
    return rows.where("profit is not null").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("profit").alias("profit"))


@query(
    "PRJ-22 PRJ-26 PRJ-27",
    over_pred("""SELECT risk_bucket, CASE WHEN risk_bucket = 'High' AND expected_penalty > upgrade_cost THEN 'upgrade and dispatch first'
      WHEN risk_bucket = 'Medium' AND expected_penalty > upgrade_cost THEN 'keep as upgrade candidate'
      ELSE 'keep current shipping and monitor' END AS action, COUNT(*) AS n, SUM(expected_penalty - upgrade_cost)::DOUBLE AS net,
      MAX(((expected_penalty - upgrade_cost)::DOUBLE / upgrade_cost::DOUBLE)) AS best_roi FROM pred GROUP BY 1, 2"""),
)
def actions_by_bucket(spark, sf_dir):
    pred = money.with_net_benefit(predictions(spark, sf_dir, []))
    action = explain.recommended_action(F.col("risk_bucket"), F.col("net_benefit")).alias("action")
    return pred.groupBy("risk_bucket", action).agg(
        F.count("*").alias("n"), F.sum("net_benefit").alias("net"), F.max("roi").alias("best_roi")
    )


# --- dates and numbers -----------------------------------------------------------------------


@query(
    "SCL-01 FLT-09",
    """SELECT (isodow(ts) - 1)::INTEGER AS order_dayofweek, month(ts)::INTEGER AS order_month, hour(ts)::INTEGER AS order_hour,
      CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS order_is_weekend, COUNT(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY ALL
      UNION ALL SELECT -1, -1, -1, 0, COUNT(*) FROM events WHERE event_id % 10 = 0""",
)
def event_date_parts(spark, sf_dir):
    """Dates given as text in two formats; every tenth is no date and becomes -1."""
    text = (
        F.when(F.col("event_id") % 10 == 0, F.lit("not a date"))
        .when(F.col("event_id") % 2 == 0, F.date_format("ts", "M/d/yyyy H:mm"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    parts = date_parts(F.col("parsed"), -1)
    rows = table(spark, sf_dir, "events").withColumn("parsed", parse_order_ts(text)).select(*[c.alias(n) for n, c in parts.items()])
    return rows.groupBy(*parts).agg(F.count("*").alias("n"))


@query(
    "SCL-02",
    """SELECT year(ts)::INTEGER AS order_year, month(ts)::INTEGER AS order_month, day(ts)::INTEGER AS order_day, COUNT(*) AS n,
      SUM(hour(ts))::BIGINT AS hours FROM events WHERE event_id % 10 <> 0 GROUP BY ALL
      UNION ALL SELECT 0, 0, 0, COUNT(*), 0 FROM events WHERE event_id % 10 = 0""",
)
def event_calendar_parts(spark, sf_dir):
    text = F.when(F.col("event_id") % 10 == 0, F.lit("??")).otherwise(F.date_format("ts", "M/d/yyyy H:mm"))
    parts = date_parts(F.col("parsed"), 0, calendar=True)
    rows = table(spark, sf_dir, "events").withColumn("parsed", parse_order_ts(text)).select(*[c.alias(n) for n, c in parts.items()])
    return rows.groupBy("order_year", "order_month", "order_day").agg(F.count("*").alias("n"), F.sum("order_hour").alias("hours"))


@query(
    "SCL-09 SCL-11 PRJ-11 PRJ-13",
    """SELECT user_id, COUNT(*) AS n, SUM(CASE WHEN event_id % 5 = 0 THEN 0.25::DECIMAL(9,4) ELSE
      LEAST(1, GREATEST(0, (value / 50)))::DECIMAL(9,4) END)::DOUBLE AS clipped FROM events GROUP BY 1""",
)
def clipped_values(spark, sf_dir):
    """Numbers from text with a default for bad ones, clipped to 0..1."""
    text = F.when(F.col("event_id") % 5 == 0, F.element_at(F.array(F.lit("NaN"), F.lit("x")), (F.col("event_id") % 2 + 1).cast("int"))).otherwise(
        (F.col("value") / 50).cast("string")
    )
    rows = table(spark, sf_dir, "events").select("user_id", clip_unit(number_or(text, 0.25)).cast("decimal(8,4)").alias("v"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("v").alias("clipped"))


@query(
    "SCL-08",
    """SELECT l_returnflag, SUM(CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)))::DOUBLE AS discounts
      FROM lineitem GROUP BY 1""",
)
def rounded_discounts(spark, sf_dir):
    amount = F.round(F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)"), 2)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(amount).alias("discounts"))


@query(
    "SCL-10 ML-01 SRC-10",
    over_items("SELECT shipping_mode, COUNT(*) AS n, SUM(quantity)::BIGINT AS quantity FROM items GROUP BY 1"),
)
def one_hot_round_trip(spark, sf_dir):
    """Modes to 0/1 columns and back."""
    items = order_items(spark, sf_dir, ["shipping_mode", "quantity"])
    values = features.one_hot_values(items, ["shipping_mode"])
    hot = features.one_hot(values)
    wide = items.select("quantity", *[c.alias(n) for n, c in hot.items()])
    decoded = wide.select("quantity", one_hot_decode(list(hot), "shipping_mode_").alias("shipping_mode"))
    return decoded.groupBy("shipping_mode").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query(
    "PRJ-12",
    """SELECT l_returnflag, COUNT(*) AS n, SUM(CASE WHEN l_linenumber = 1 THEN q ELSE p END)::DOUBLE AS sales,
      SUM(CASE WHEN l_linenumber = 2 THEN (CASE WHEN l_linenumber = 1 THEN q ELSE p END) ELSE q END)::DOUBLE AS totals FROM
      (SELECT *, l_extendedprice::DECIMAL(18,2) AS p, l_quantity::DECIMAL(18,2) AS q FROM lineitem) GROUP BY 1""",
)
def synonyms_filled(spark, sf_dir):
    """Gaps in Sales are filled from its synonyms and the other way round."""
    price, quantity = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity").cast("decimal(18,2)")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        F.when(F.col("l_linenumber") != 1, price).alias("Sales"),
        F.when(F.col("l_linenumber") != 2, quantity).alias("Order Item Total"),
    )
    filled = features.fill_synonyms(rows)
    return filled.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("Sales").alias("sales"), F.sum("`Order Item Total`").alias("totals")
    )


@query(
    "FLT-10 PRJ-13",
    """SELECT l_returnflag, COUNT(*) AS n, SUM(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM lineitem
      WHERE l_linenumber NOT IN (2, 4) GROUP BY 1""",
)
def complete_numeric_rows(spark, sf_dir):
    """Rows with a text or NaN in a required number are left out."""
    text = F.when(F.col("l_linenumber") == 2, F.lit("bad")).when(F.col("l_linenumber") == 4, F.lit("NaN")).otherwise(
        F.col("l_extendedprice").cast("string")
    )
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", to_number(text).alias("price")).dropna(subset=["price"])
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("price").cast("decimal(18,2)")).alias("total"))


# --- files -----------------------------------------------------------------------------------------

#: lines that are joined and written to files at a time, and rows of a file: a packed file is read by one task
SLICE_ROWS, CSV_ROWS = 20_000_000, 500_000


@query(
    "SRC-01 SRC-02 PRJ-13",
    over_items("""SELECT shipping_mode AS mode, order_region AS region, COUNT(*) AS n, SUM(quantity)::BIGINT AS quantity,
      SUM(profit_actual)::DOUBLE AS profit, MIN(strftime(order_ts, '%Y-%m-%d')) AS first_date FROM items GROUP BY 1, 2"""),
)
def orders_from_csv(spark, sf_dir):
    """Raw order file written as CSV and read back with explicit types.

    The files are packed, and short enough for one task each. A long table is written in slices by order, so that
    the shuffle files of all its rows never lie on disk together.
    """
    path = scratch_path(spark, "orders_csv")
    raw = raw_orders(spark, sf_dir)
    slices = max(1, -(-table(spark, sf_dir, "lineitem").count() // SLICE_ROWS))
    for i in range(slices):
        with shuffles_removed(spark):
            part = raw.where(F.pmod(F.hash("Order Id"), F.lit(slices)) == i) if slices > 1 else raw.select("*")
            part.write.mode("append" if i else "overwrite").option("header", True).option("encoding", "ISO-8859-1").option(
                "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option(
                "compression", "gzip").option("maxRecordsPerFile", CSV_ROWS).csv(path)
    back = readers.read_raw_orders(spark, path, columns=raw.columns)
    checked = readers.require_columns(back, ["Order Id", "Shipping Mode", "Order Region", LABEL])
    return checked.groupBy(F.col("Shipping Mode").alias("mode"), F.col("Order Region").alias("region")).agg(
        F.count("*").alias("n"), F.sum("Order Item Quantity").alias("quantity"),
        F.sum(F.col("Order Profit Per Order").cast("decimal(18,4)")).alias("profit"),
        F.date_format(F.min(parse_order_ts(F.col("`order date (DateOrders)`"))), "yyyy-MM-dd").alias("first_date"),
    )


@query(
    "SRC-06 SRC-05",
    """SELECT 'orders' AS upload, 1 AS accepted, 5 AS matched_known_columns, 0 AS duplicated_columns, COUNT(*) AS n FROM orders
      UNION ALL SELECT 'repeated', 0, 4, 1, 0 FROM region WHERE r_regionkey = 0
      UNION ALL SELECT 'events', 0, 0, 0, 0 FROM region WHERE r_regionkey = 0""",
)
def upload_gate(spark, sf_dir):
    """Three uploads: order rows, order rows with a repeated header, something else."""
    root = scratch_path(spark, "uploads")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("Order Id"), F.col("o_orderdate").cast("string").alias("Order Date"),
        F.col("o_orderpriority").alias("Shipping Mode"), F.col("o_totalprice").alias("Product Price"),
        F.col("o_orderstatus").alias("Type"),
    )
    orders.write.mode("overwrite").option("header", True).csv(f"{root}/orders")
    orders.toDF("Order Id", "Order Date", "Shipping Mode", "Type ", "type").write.mode("overwrite").option(
        "header", True).csv(f"{root}/repeated")
    table(spark, sf_dir, "events").select("event_id", "user_id", "value").write.mode("overwrite").option("header", True).csv(f"{root}/events")
    gated = readers.gate_uploads(readers.upload_headers(spark, root))
    name = F.element_at(F.split("path", "/"), -2)
    rows = spark.read.option("recursiveFileLookup", True).text(root).select(F.col("_metadata.file_path").alias("path"))
    accepted = rows.groupBy("path").agg((F.count("*") - 1).alias("rows"))
    sizes = accepted.groupBy(F.element_at(F.split("path", "/"), -2).alias("upload")).agg(F.sum("rows").alias("rows"))
    per_upload = gated.groupBy(name.alias("upload")).agg(
        F.min("accepted").alias("accepted"), F.max("matched_known_columns").cast("int").alias("matched_known_columns"),
        F.max("duplicated_columns").cast("int").alias("duplicated_columns"),
    )
    return per_upload.join(sizes, "upload").select(
        "upload", "accepted", "matched_known_columns", "duplicated_columns",
        F.when(F.col("accepted") == 1, F.col("rows")).otherwise(0).alias("n"),
    )


@query(
    "SRC-05 PRJ-09 PRJ-10 PRJ-04",
    over_items("""SELECT shipping_mode, 'Unknown' AS customer_segment, market, COUNT(*) AS n, COUNT(DISTINCT order_id) AS orders,
      SUM(ROUND(sales * profit_ratio, 2))::DOUBLE AS profit,
      SUM(true_label)::BIGINT AS late FROM items GROUP BY shipping_mode, market"""),
)
def standardized_upload(spark, sf_dir):
    """Headers in odd letter case, two sales columns of which the last wins, no segment."""
    items = order_items(spark, sf_dir, ["order_id", "line_no", "shipping_mode", "market", "sales", "profit_ratio", "true_label", "product_price"])
    upload = items.select(
        F.col("order_id").alias("ORDER ID"), F.col("shipping_mode").alias("shipping mode"), F.col("market").alias("MARKET"),
        F.col("product_price").cast("string").alias("Sales"), F.col("sales").cast("double").cast("string").alias("order item total"),
        F.col("profit_ratio").cast("double").cast("string").alias("Order Item Profit Ratio"), F.col("true_label").alias("late_delivery_RISK"), F.col("line_no").alias("row"),
    )
    rows = readers.standardize_upload(upload, "row")
    per_order = rows.groupBy("shipping_mode", "customer_segment", "market", "order_id_hash").agg(
        F.count("*").alias("n"), F.sum(F.col("profit_actual").cast("decimal(18,2)")).alias("p"), F.sum("true_label").alias("late")
    )
    return per_order.groupBy("shipping_mode", "customer_segment", "market").agg(
        F.sum("n").alias("n"), F.count("*").alias("orders"), F.sum("p").alias("profit"), F.sum("late").alias("late")
    )


@query(
    "SNK-02 SRC-07 SNK-09",
    over_pred("""SELECT 'a1' AS asked, 'a1' AS got, COUNT(*) AS n, SUM(expected_penalty)::DOUBLE AS penalty FROM pred WHERE order_type = 'A'
      UNION ALL SELECT 'b2', 'default', COUNT(*), SUM(expected_penalty)::DOUBLE FROM pred WHERE order_type <> 'A'
      UNION ALL SELECT 'nobody', 'default', COUNT(*), SUM(expected_penalty)::DOUBLE FROM pred WHERE order_type <> 'A'"""),
)
def session_predictions(spark, sf_dir):
    """Three sessions written, one reset; unknown and reset sessions read the default set."""
    path = scratch_path(spark, "predictions")
    pred = predictions(spark, sf_dir, ["order_id", "order_type"])
    store.write_predictions(pred.where("order_type <> 'A'"), path, "default")
    store.write_predictions(pred.where("order_type = 'A'"), path, "a1")
    store.write_predictions(pred.where("order_type = 'R'"), path, "b2")
    store.reset_session(spark, path, "b2")
    out = None
    for asked in ("a1", "b2", "nobody"):
        rows = readers.read_session(spark, path, asked)
        one = rows.groupBy(F.lit(asked).alias("asked"), F.col("session_id").alias("got")).agg(
            F.count("*").alias("n"), F.sum("expected_penalty").alias("penalty")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "SNK-04 SET-01 PRJ-01",
    over_items("""SELECT market AS "Market", COUNT(*) AS n, SUM(profit_actual)::DOUBLE AS profit, COUNT(*) FILTER (order_type <> 'R') AS with_email,
      COUNT(*) FILTER (order_type = 'R' AND true_label = 0) AS with_carrier FROM items GROUP BY 1"""),
)
def known_results(spark, sf_dir):
    """Two batches appended to an empty store, the second with a further column, then joined by name with rows that have more."""
    path = scratch_path(spark, "known_results")
    raw = raw_orders(spark, sf_dir)
    batch = raw.where("Type = 'R'")
    store.check_known_results(batch).limit(0).write.mode("overwrite").parquet(path)
    store.append_known_results(batch.where(f"{LABEL} = 1"), path)
    store.append_known_results(batch.where(f"{LABEL} = 0").withColumn("Carrier", F.col("Market")), path)
    both = store.combined_training(raw.where("Type <> 'R'"), store.read_known_results(spark, path))
    return both.groupBy("Market").agg(
        F.count("*").alias("n"), F.sum("Order Profit Per Order").alias("profit"), F.count("Customer Email").alias("with_email"), F.count("Carrier").alias("with_carrier")
    )


@query(
    "SNK-08",
    """SELECT month, arg_max(kind, (flag_key, kind)) AS kind, MAX(flag_key) AS flagged_at FROM (
      SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS kind, o_orderkey AS flag_key FROM orders) GROUP BY 1""",
)
def event_flags(spark, sf_dir):
    """Flags arriving in three batches; the newest per month stays."""
    orders = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("kind"),
        F.col("o_orderkey").alias("flagged_at"), "o_orderstatus",
    )
    def newest(status: str):
        rows = orders.where(F.col("o_orderstatus") == status)
        return rows.groupBy("month").agg(F.max_by("kind", "flagged_at").alias("kind"), F.max("flagged_at").alias("flagged_at"))
    return store.upsert_flags(store.upsert_flags(newest("O"), newest("P")), newest("F"))


@query(
    "SNK-06 SRC-08",
    over_mart(f"""SELECT {bucket_sql('p_late')} AS risk_bucket, customer_segment, COUNT(*) AS orders, SUM(net_of_service)::DOUBLE AS net FROM mart GROUP BY 1, 2"""),
)
def stored_mart(spark, sf_dir):
    """Mart written with its summary and read back, buckets recomputed on read."""
    path = scratch_path(spark, "mart")
    full = mart_of(spark, sf_dir)
    store.write_mart(full, reports.roi_totals(full), evaluation.delay_calibration(full, ["customer_segment"]), path)
    stored = readers.read_mart(spark, f"{path}/mart")
    return stored.groupBy("risk_bucket", "customer_segment").agg(F.count("*").alias("orders"), F.sum("net_of_service").alias("net"))


@query(
    "SNK-03",
    over_pred("""SELECT shipping_mode, COUNT(*) AS n, SUM(upgrade_cost)::DOUBLE AS cost FROM pred GROUP BY 1"""),
)
def stored_selection(spark, sf_dir):
    """Report rows as CSV with header, totals as JSON, both read back."""
    path = scratch_path(spark, "selection")
    chosen = predictions(spark, sf_dir, ["order_id"])
    rows = chosen.select("order_id", "shipping_mode", "upgrade_cost")
    totals = rows.groupBy("shipping_mode").agg(F.count("*").alias("n"), F.sum("upgrade_cost").alias("cost"))
    store.write_selection(rows, totals, path)
    csv = spark.read.schema("order_id long, shipping_mode string, upgrade_cost decimal(12,2)").option("header", True).csv(f"{path}/orders")
    json = spark.read.schema("shipping_mode string, n long, cost decimal(18,2)").json(f"{path}/summary")
    return csv.groupBy("shipping_mode").agg(F.count("*").alias("n")).join(json.drop("n"), "shipping_mode")


# --- sessions ------------------------------------------------------------------------------------------


_SESSION = """, s AS (SELECT *, 'session' || order_id AS sid FROM pred)
      SELECT s.order_id, ((2*SUM(bp)+COUNT(*))//(2*COUNT(*)))::DOUBLE/10000 AS p_late, SUM(profit_pred)::DOUBLE AS profit_pred,
      ROUND(SUM(profit_pred) - {charge}, 4)::DOUBLE AS net_of_service, {flag} AS is_false_positive_value,
      MAX(upgrade_cost)::DOUBLE AS upgrade_cost FROM s GROUP BY order_id"""
_MEAN = "(((2*SUM(bp)+COUNT(*))//(2*COUNT(*)))::DECIMAL(9,0)*0.0001)::DECIMAL(9,4)"


@query("AGG-03 PRJ-34", over_pred(_SESSION.format(charge="MAX(true_label)*250", flag="0")))
def labelled_session(spark, sf_dir):
    """Upload with known outcomes: actual delay cost, predicted profit."""
    return _session(spark, sf_dir, True)


@query("AGG-03 PRJ-11 PRJ-34", over_pred(_SESSION.format(charge=f"{_MEAN}*250", flag="0")))
def unlabelled_session(spark, sf_dir):
    """Upload with gaps in the labels: the delay cost is the expected one."""
    return _session(spark, sf_dir, False)


def _session(spark, sf_dir, labelled: bool):
    cols = [*ITEM_KEYS, "customer_segment", "category_name", "discount_rate", "profit_pred", "true_label"]
    pred = predictions(spark, sf_dir, cols).withColumn("order_id_hash", F.concat(F.lit("session"), F.col("order_id").cast("string")))
    if not labelled:
        pred = pred.withColumn("true_label", F.when(F.col("line_no") != 2, F.col("true_label")))
    rows = mart.session_rows(pred.drop("order_date"), "line_no")
    per_order, _ = mart.session_mart(rows, ITEM_KEYS[1:], mart.fully_labelled(pred))
    number = F.substring("order_id_hash", 8, 20).cast("long").alias("order_id")
    return per_order.select(number, "p_late", "profit_pred", "net_of_service", "is_false_positive_value", "upgrade_cost")


@query(
    "SNK-05 JON-07 ML-02",
    over_items("""SELECT category_name, COUNT(*) AS n, 'category_name' AS from_artifact FROM items GROUP BY 1"""),
)
def decoded_categories(spark, sf_dir):
    """Categories to codes, both artifact tables written and read, codes back to labels."""
    path = scratch_path(spark, "artifacts")
    items = order_items(spark, sf_dir, ["category_name", "department_name"])
    codes = features.category_codes(items, ["category_name", "department_name"], 1)
    fitted = features.medians(order_items(spark, sf_dir, ["quantity"]), ["quantity"])
    store.write_artifacts(spark.createDataFrame(list(fitted.items()), "column string, median double"), codes, path)
    stored = spark.read.parquet(f"{path}/codes")
    coded = features.encode(items, ["category_name"], stored, suffix="_code").select(F.col("category_name_code").alias("category_name"))
    return features.decode(coded, "category_name", stored).groupBy("category_name").agg(
        F.count("*").alias("n"), F.lit("category_name").alias("from_artifact")
    )


@query(
    "JON-05",
    over_pred("""SELECT order_id, line_no, product_id, supplier_id, p_late::DOUBLE AS p_late, risk_bucket, quantity, discount_rate::DOUBLE AS discount_rate,
      order_type FROM pred"""),
)
def rows_side_by_side(spark, sf_dir):
    """Scores and what-if fields, stored apart, joined by the row key."""
    scores = predictions(spark, sf_dir, ITEM_KEYS).select(*ITEM_KEYS, "p_late", "risk_bucket")
    fields = order_items(spark, sf_dir, [*ITEM_KEYS, "quantity", "discount_rate", "order_type"])
    return mart.join_rows(scores, fields, ITEM_KEYS).drop("price_cents")


@query(
    "TOP-09",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
      ORDER BY sha256(concat_ws(':', '7', l_orderkey, l_linenumber, l_partkey, l_suppkey)), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 2000""",
)
def sampled_rows(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return reports.sample_rows(table(spark, sf_dir, "lineitem").select(*keys), keys, 2000, 7)


@query(
    "OPT-09 SRC-05 SRC-06 SNK-02",
    over_items("""SELECT shipping_mode, 'sess-1' AS session_id, COUNT(*) AS n, SUM(ROUND((0.2 + 0.1*scheduled_days) * 250, 2))::DOUBLE AS expected_penalty,
      SUM(true_label)::BIGINT AS late FROM items GROUP BY 1"""),
)
def scored_upload(spark, sf_dir):
    """Order file and a file that is none in one folder: gate, standardise, score, store, read back."""
    root = scratch_path(spark, "score_upload")
    raw = raw_orders(spark, sf_dir, ["order_id", "customer_id", "shipping_mode", "order_region", "scheduled_days", "true_label", "order_ts"])
    raw.drop("Customer Id").write.mode("overwrite").option("header", True).csv(f"{root}/in/orders")
    table(spark, sf_dir, "nation").write.mode("overwrite").option("header", True).csv(f"{root}/in/other")

    def scorer(rows):
        return rows.withColumn("p_late", (0.2 + 0.1 * F.col("days_for_shipment")).cast("decimal(8,4)"))

    sessions.score_uploads(spark, f"{root}/in", scorer, f"{root}/predictions", "sess-1")
    stored = readers.read_session(spark, f"{root}/predictions", "sess-1")
    return stored.groupBy("shipping_mode", "session_id").agg(
        F.count("*").alias("n"), F.sum("expected_penalty").alias("expected_penalty"), F.sum("true_label").alias("late")
    )
