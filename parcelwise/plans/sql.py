"""Common table expressions of the SQL twins: the order-item view and what follows from it."""

from __future__ import annotations

from parcelwise.constants import MODE_BASE_COST, REGION_MULTIPLIER, REGIONS


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MODE = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'Same Day' WHEN '2-HIGH' THEN 'First Class' "
    "WHEN '3-MEDIUM' THEN 'Second Class' ELSE 'Standard Class' END"
)
_REGION = "[" + ", ".join(_quote(r) for r in REGIONS) + "]"


def cost_sql(mode: str, region: str, ratio: str = "1") -> str:
    """Rate card as nested CASE expressions."""
    base = " ".join(f"WHEN {_quote(m)} THEN {c}" for m, c in MODE_BASE_COST.items())
    mult = " ".join(f"WHEN {_quote(r)} THEN {c}" for r, c in REGION_MULTIPLIER.items())
    return (
        f"ROUND((CASE trim({mode}) {base} ELSE 80.00 END)::DECIMAL(9,2) * "
        f"(CASE trim({region}) {mult} ELSE 1.00 END)::DECIMAL(4,2) * {ratio}, 2)::DECIMAL(12,2)"
    )


def bucket_sql(p: str) -> str:
    return f"CASE WHEN {p} >= 0.7 THEN 'High' WHEN {p} >= 0.3 THEN 'Medium' ELSE 'Low' END"


def avg4(units: str) -> str:
    """Mean of an integer column in 1/10000, rounded half up."""
    return f"(((2*SUM({units})+COUNT({units}))//(2*COUNT({units})))::DOUBLE/10000)"


def ratio4(num: str, den: str, empty: str = "0.0") -> str:
    return f"COALESCE(((20000*({num})+({den}))//(2*NULLIF({den},0)))::DOUBLE/10000, {empty})"


ITEMS = f"""
head AS (
  SELECT o_orderkey, o_custkey, o_orderdate, {_MODE} AS shipping_mode FROM orders
),
lines AS (
  SELECT l.*, h.*,
    CASE shipping_mode WHEN 'Same Day' THEN 0 WHEN 'First Class' THEN 1 WHEN 'Second Class' THEN 2 ELSE 4 END AS scheduled_days,
    CAST(round(l_extendedprice*100) AS BIGINT) AS price_cents,
    CAST(round(l_discount*100) AS BIGINT) AS disc_pct,
    (l_partkey*13 + l_suppkey*7 + l_linenumber) % 61 - 15 AS margin_pct
  FROM lineitem l JOIN head h ON l_orderkey = o_orderkey
),
labelled AS (
  SELECT *, CASE WHEN date_diff('day', o_orderdate, l_shipdate) > scheduled_days THEN 1 ELSE 0 END AS true_label,
    price_cents * (100 - disc_pct) * margin_pct AS profit_raw
  FROM lines
),
items AS (
  SELECT l_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id, l_suppkey AS supplier_id,
    l_linenumber AS line_no, price_cents, disc_pct, margin_pct, o_orderdate AS order_ts, l_returnflag AS order_type,
    l_linestatus AS market, c_mktsegment AS customer_segment,
    list_extract({_REGION}, c_nationkey % 23 + 1) AS order_region, 'NATION_' || c_nationkey AS order_country,
    p_type AS category_name, p_brand AS department_name, shipping_mode, scheduled_days,
    CAST(l_quantity AS INTEGER) AS quantity,
    (price_cents::DECIMAL(14,0) * 0.01)::DECIMAL(18,4) AS product_price,
    (disc_pct::DECIMAL(4,0) * 0.01)::DECIMAL(5,4) AS discount_rate,
    ((price_cents * (100 - disc_pct) // 100)::DECIMAL(18,0) * 0.0001)::DECIMAL(18,4) AS sales,
    (margin_pct::DECIMAL(4,0) * 0.01)::DECIMAL(5,4) AS profit_ratio,
    ((profit_raw // 10000)::DECIMAL(18,0) * 0.0001)::DECIMAL(18,4) AS profit_actual,
    ((profit_raw * (90 + (l_partkey + l_linenumber) % 21) // 1000000)::DECIMAL(18,0) * 0.0001)::DECIMAL(18,4) AS profit_pred,
    true_label,
    3500 * true_label + (l_orderkey*7919 + l_partkey*104729 + l_suppkey*31 + l_linenumber*17) % 6500 AS bp
  FROM labelled LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = l_partkey
)"""

PRED = f"""{ITEMS},
scored AS (SELECT *, (bp::DECIMAL(9,0) * 0.0001)::DECIMAL(9,4) AS p_late FROM items),
pred AS (
  SELECT *, {bucket_sql('p_late')} AS risk_bucket, ROUND(p_late * 250, 2)::DECIMAL(12,2) AS expected_penalty,
    {cost_sql('shipping_mode', 'order_region')} AS upgrade_cost
  FROM scored
)"""

MART = f"""{PRED},
rolled AS (
  SELECT order_id, (2*SUM(bp)+COUNT(*))//(2*COUNT(*)) AS p_bp, MAX(true_label) AS true_label, MAX(upgrade_cost) AS upgrade_cost,
    SUM(profit_actual)::DECIMAL(18,4) AS profit_actual, SUM(profit_pred)::DECIMAL(18,4) AS profit_pred,
    (((200*SUM(disc_pct)+COUNT(*))//(2*COUNT(*)))::DECIMAL(9,0) * 0.0001)::DECIMAL(9,4) AS discount_rate,
    MIN(customer_segment) AS customer_segment, MIN(order_region) AS order_region, MIN(shipping_mode) AS shipping_mode,
    MIN(order_ts) AS order_ts, MIN(customer_id) AS customer_id,
    arg_min(category_name, (line_no, product_id, supplier_id, price_cents)) AS category_name
  FROM pred GROUP BY order_id
),
mart0 AS (SELECT *, (p_bp::DECIMAL(9,0) * 0.0001)::DECIMAL(9,4) AS p_late FROM rolled),
mart AS (
  SELECT *, (p_late * 250)::DECIMAL(18,4) AS expected_penalty,
    (profit_actual - true_label * 250)::DECIMAL(18,4) AS net_of_service,
    ROUND(profit_actual * p_late, 4)::DECIMAL(18,4) AS epar,
    (profit_actual - profit_pred)::DECIMAL(18,4) AS profit_resid,
    CASE WHEN profit_actual > 0 AND profit_actual - true_label * 250 < 0 THEN 1 ELSE 0 END AS is_false_positive_value,
    {bucket_sql('p_late')} AS risk_bucket
  FROM mart0
)"""


def _with(base: str, rest: str) -> str:
    """``rest`` is a SELECT, or starts with a comma and further table expressions."""
    return f"WITH {base}{rest}" if rest.startswith(",") else f"WITH {base} {rest}"


def over_items(rest: str) -> str:
    return _with(ITEMS, rest)


def over_pred(rest: str) -> str:
    return _with(PRED, rest)


def over_mart(rest: str) -> str:
    return _with(MART, rest)
