"""The order-item view over the star-schema test tables.

Only the tables and columns a query asks for are read: customer and part are
left joins, orders a foreign-key join, and each is skipped when none of its
columns is wanted. The join with the order side comes last, so that a following
roll-up per order reuses its partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.constants import REGIONS
from parcelwise.operators.money import MONEY, with_prediction_money

_CUSTOMER = {"customer_segment", "order_region", "order_country"}
_PART = {"category_name", "department_name"}
_LINE_ONLY = {
    "order_id", "product_id", "supplier_id", "line_no", "price_cents", "order_type", "market", "category_name",
    "department_name", "quantity", "product_price", "discount_rate", "sales", "profit_ratio", "profit_actual", "profit_pred",
}

# fixed values: shipping mode by order priority, scheduled days by mode
MODE_OF_PRIORITY = {"1-URGENT": "Same Day", "2-HIGH": "First Class", "3-MEDIUM": "Second Class"}
SCHEDULED_DAYS = {"Same Day": 0, "First Class": 1, "Second Class": 2, "Standard Class": 4}

ITEM_KEYS = ["order_id", "line_no", "product_id", "supplier_id", "price_cents"]
ALL_COLUMNS = [
    "order_id", "customer_id", "product_id", "supplier_id", "line_no", "price_cents", "order_ts", "order_type", "market",
    "customer_segment", "order_region", "order_country", "category_name", "department_name", "shipping_mode",
    "scheduled_days", "quantity", "product_price", "discount_rate", "sales", "profit_ratio", "profit_actual",
    "profit_pred", "true_label", "p_late",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: dict, key, default):
    out = None
    for k, v in values.items():
        out = (F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v)))
    return out.otherwise(F.lit(default))


def order_items(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ALL_COLUMNS) -> DataFrame:
    wanted = set(columns)
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    mode = _pick(MODE_OF_PRIORITY, F.col("o_orderpriority"), "Standard Class")
    head = orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("order_ts"),
        mode.alias("shipping_mode"),
    ).withColumn("scheduled_days", _pick(SCHEDULED_DAYS, F.col("shipping_mode"), 4))
    if wanted & _CUSTOMER:
        region = F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (F.col("c_nationkey") % 23 + 1).cast("int"))
        customer = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("customer_segment"),
            region.alias("order_region"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("order_country"),
        )
        head = head.join(customer, "customer_id", "left")

    lines = lineitem
    if wanted & _PART:
        part = table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category_name"), F.col("p_brand").alias("department_name")
        )
        lines = lines.join(part, "l_partkey", "left")

    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    percent = F.round(F.col("l_discount") * 100).cast("long")
    margin = F.expr("(l_partkey * 13 + l_suppkey * 7 + l_linenumber) % 61 - 15")
    lines = lines.withColumns({"price_cents": cents, "disc_pct": percent, "margin_pct": margin}).withColumn(
        "profit_raw", F.expr("price_cents * (100 - disc_pct) * margin_pct")
    )

    def scaled(expr: str) -> Column:
        return (F.expr(expr).cast("decimal(18,0)") * F.lit("0.0001").cast("decimal(4,4)")).cast(MONEY)

    items = lines.withColumnRenamed("l_orderkey", "order_id")
    if wanted - _LINE_ONLY:
        points = F.expr(
            "3500 * true_label + (order_id * 7919 + l_partkey * 104729 + l_suppkey * 31 + l_linenumber * 17) % 6500"
        )
        items = (
            items.join(head, "order_id")
            .withColumn("true_label", (F.datediff("l_shipdate", "order_ts") > F.col("scheduled_days")).cast("int"))
            .withColumn("p_late", (points.cast("decimal(5,0)") * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(8,4)"))
        )

    made = {
        "product_id": F.col("l_partkey"), "supplier_id": F.col("l_suppkey"), "line_no": F.col("l_linenumber"),
        "order_type": F.col("l_returnflag"), "market": F.col("l_linestatus"), "quantity": F.col("l_quantity").cast("int"),
        "product_price": (F.col("price_cents").cast("decimal(14,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY),
        "discount_rate": (F.col("disc_pct").cast("decimal(4,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(5,4)"),
        "profit_ratio": (F.col("margin_pct").cast("decimal(4,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(5,4)"),
        "sales": scaled("price_cents * (100 - disc_pct) div 100"),
        "profit_actual": scaled("profit_raw div 10000"),
        "profit_pred": scaled("profit_raw * (90 + (l_partkey + l_linenumber) % 21) div 1000000"),
    }
    return items.select(*[made.get(c, F.col(c)).alias(c) for c in ALL_COLUMNS if c in wanted])


def predictions(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ALL_COLUMNS, penalty=250) -> DataFrame:
    """Order items with bucket, expected penalty and upgrade cost."""
    need = {*columns, "p_late", "shipping_mode", "order_region"}
    return with_prediction_money(order_items(spark, sf_dir, [c for c in ALL_COLUMNS if c in need]), penalty)


# raw order-file names of the view's columns
RAW_NAMES = {
    "order_id": "Order Id", "customer_id": "Customer Id", "order_ts": "order date (DateOrders)", "order_type": "Type",
    "market": "Market", "customer_segment": "Customer Segment", "order_region": "Order Region",
    "order_country": "Order Country", "category_name": "Category Name", "department_name": "Department Name",
    "shipping_mode": "Shipping Mode", "scheduled_days": "Days for shipment (scheduled)", "quantity": "Order Item Quantity",
    "product_price": "Product Price", "discount_rate": "Order Item Discount Rate", "sales": "Sales",
    "profit_ratio": "Order Item Profit Ratio", "profit_actual": "Order Profit Per Order", "true_label": "Late_delivery_risk",
}


def raw_orders(spark: SparkSession, sf_dir: str, columns: Sequence[str] = tuple(RAW_NAMES)) -> DataFrame:
    """The view under the names of a raw order file, with personal and leakage columns added."""
    items = order_items(spark, sf_dir, columns)
    date = F.date_format("order_ts", "M/d/yyyy H:mm")
    renamed = items.select(
        *[(date if c == "order_ts" else F.col(c)).alias(RAW_NAMES[c]) for c in RAW_NAMES if c in columns]
    )
    person = F.concat(F.lit("Customer#"), F.col("`Customer Id`").cast("string"))
    return renamed.withColumns(
        {
            "Customer Fname": person, "Customer Lname": F.reverse(person), "Customer Email": F.concat(person, F.lit("@example.org")),
            "Customer Password": F.lit("XXXXXXXXX"), "Customer Street": F.concat(F.lit("1 Main St, "), person),
            "Customer Zipcode": F.lit("00000"),
            "Delivery Status": F.when(F.col("Late_delivery_risk") == 1, "Late delivery").otherwise("Shipping on time"),
        }
    )
