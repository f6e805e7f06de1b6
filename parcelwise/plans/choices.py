"""Upgrade selection, what-if grids, rescue of losing orders, explanations."""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from parcelwise.functions.scalars import hash_id, to_number
from parcelwise.operators import decisions, explain, features, models
from parcelwise.operators.cells import scored_cells
from parcelwise.operators.money import MONEY, complete_fields
from parcelwise.plans.orders import item_codes, mart_of
from parcelwise.plans.registry import query
from parcelwise.plans.sql import avg4, cost_sql, over_items, over_mart, over_pred
from parcelwise.session import written
from parcelwise.sources.tables import ITEM_KEYS, order_items, predictions, table

TIES = ITEM_KEYS[1:]
BUDGETS = ["1000", "3000", "5000", "10000"]
EVERYTHING = "1000000000"


def _candidates(spark, sf_dir, threshold="0.3", penalty=250, basis="given"):
    """The predictions bring their costs, so the table-wide look of ``auto`` is not needed."""
    pred = predictions(spark, sf_dir, ITEM_KEYS)
    codes = item_codes(spark, sf_dir, ("shipping_mode", "order_region", "risk_bucket"), scores=True)
    return decisions.prepare(pred, "order_id", TIES, penalty=penalty, threshold=threshold, cost_basis=basis, codes=codes)


_RISKIEST = """, riskiest AS (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY bp DESC, line_no, product_id, supplier_id, price_cents) = 1),
      cand AS (SELECT *, (p_late*250)::DECIMAL(18,4) AS pen, ((p_late*250)::DECIMAL(18,4) - upgrade_cost)::DECIMAL(18,4) AS net FROM riskiest
        WHERE bp >= {t} AND p_late*250 > upgrade_cost)"""


@query(
    "WIN-01 PRJ-32 PRJ-17",
    over_pred(_RISKIEST.format(t=0) + """ SELECT order_id, line_no, product_id, p_late::DOUBLE AS p_late, risk_bucket,
      (p_late*250)::DOUBLE AS expected_penalty, upgrade_cost::DOUBLE AS upgrade_cost FROM riskiest"""),
)
def riskiest_items(spark, sf_dir):
    full = complete_fields(predictions(spark, sf_dir, ITEM_KEYS))
    codes = item_codes(spark, sf_dir, ("shipping_mode", "order_region", "risk_bucket"), scores=True)
    return decisions.riskiest_item(full, "order_id", TIES, codes).select(
        "order_id", "line_no", "product_id", "p_late", "risk_bucket", "expected_penalty", "upgrade_cost"
    )


_BASIS = """SELECT shipping_mode, SUM({cost})::DOUBLE AS cost FROM pred GROUP BY 1"""


@query("PRJ-32", over_pred(_BASIS.format(cost=cost_sql("shipping_mode", "order_region", "2"))))
def costs_from_card(spark, sf_dir):
    """All costs at the placeholder 80: the rate card is used."""
    pred = predictions(spark, sf_dir, []).withColumn("upgrade_cost", F.lit(Decimal("80.00")))
    return complete_fields(pred, unit_cost=160).groupBy("shipping_mode").agg(F.sum("upgrade_cost").alias("cost"))


@query("PRJ-32", over_pred(_BASIS.format(cost="ROUND(CASE WHEN quantity = 7 THEN 81 ELSE 80 END * 1.5, 2)")))
def costs_as_given(spark, sf_dir):
    """One cost that is not 80 anywhere in the table: given costs are kept and scaled."""
    pred = predictions(spark, sf_dir, ["quantity"]).withColumn(
        "upgrade_cost", F.when(F.col("quantity") == 7, F.lit(Decimal("81.00"))).otherwise(F.lit(Decimal("80.00")))
    )
    return complete_fields(pred, unit_cost=120).groupBy("shipping_mode").agg(F.sum("upgrade_cost").alias("cost"))


@query(
    "FLT-01 PRJ-22",
    over_pred(_RISKIEST.format(t=3000) + """ SELECT order_id, net::DOUBLE AS net_benefit, net::DOUBLE / upgrade_cost::DOUBLE AS roi FROM cand"""),
)
def upgrade_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("order_id", "net_benefit", "roi")


@query(
    "TOP-02 TOP-06",
    over_pred(_RISKIEST.format(t=3000) + " SELECT order_id, net::DOUBLE AS net_benefit, p_late::DOUBLE AS p_late FROM cand ORDER BY net DESC, order_id LIMIT 500"),
)
def capped_candidates(spark, sf_dir):
    """The list of the 500 candidates with most to gain."""
    return decisions.top_candidates(_candidates(spark, sf_dir), "order_id", 500).select("order_id", "net_benefit", "p_late")


_TOTALS = """COUNT(*) AS selected_count, ROUND(SUM(upgrade_cost), 2)::DOUBLE AS total_cost, ROUND(SUM(net), 2)::DOUBLE AS expected_total_saving,
      ROUND(SUM(pen), 2)::DOUBLE AS expected_total_penalty_avoided"""


@query(
    "OPT-01 AGG-34",
    over_pred(_RISKIEST.format(t=3000) + f""" SELECT 1000000000.0::DOUBLE AS budget, {_TOTALS},
      ROUND(SUM(upgrade_cost) * 100 / 1000000000, 2)::DOUBLE AS budget_usage_pct FROM cand"""),
)
def selection_unlimited(spark, sf_dir):
    """A budget for everything takes every candidate."""
    chosen = decisions.choose(_candidates(spark, sf_dir), "order_id", [EVERYTHING])
    return decisions.selection_totals(chosen, [EVERYTHING])


def _knapsack(budgets, rest):
    """Exact choice in SQL from ``cand``: per cost only the orders that the largest budget can pay for, best first, as a
    gain curve; then dynamic programming over spent money, cost by cost from the highest down, for all budgets at once.

    ``spent`` holds the best gain for each amount; a gain is benefit x 2^20 less the number of orders. ``best`` has
    one row per budget: of equal benefits the one with fewest orders, then the cheapest.
    """
    most = max(int(b) for b in budgets) * 100
    values = ", ".join(f"({int(b)})" for b in budgets)
    return f""", offers AS (SELECT *, (upgrade_cost * 100)::BIGINT AS cost, (net * 10000)::BIGINT AS gain, row_number() OVER (PARTITION BY upgrade_cost ORDER BY net DESC, order_id) AS place FROM cand),
      unit AS (SELECT list_reduce(list(DISTINCT cost), lambda x, y: gcd(x, y)) AS u FROM offers),
      curves AS (SELECT dense_rank() OVER (ORDER BY cost) AS i, cost, cost // u AS c, place AS k, SUM(gain * 1048576 - 1) OVER (PARTITION BY cost ORDER BY place) AS v
        FROM offers CROSS JOIN unit WHERE place * cost <= {most}),
      steps AS (SELECT i, c, k, v::BIGINT AS v FROM curves UNION ALL SELECT DISTINCT i, c, 0, 0 FROM curves),
      spent AS (WITH RECURSIVE t(i, s, v) AS (SELECT (SELECT MAX(i) FROM curves) + 1, 0::BIGINT, 0::BIGINT UNION ALL
        SELECT t.i - 1, t.s + c * k, MAX(t.v + steps.v)::BIGINT FROM t JOIN steps ON steps.i = t.i - 1
        WHERE t.s + c * k <= {most} // (SELECT u FROM unit) GROUP BY t.i - 1, t.s + c * k) SELECT * FROM t),
      best AS (SELECT b, arg_max(struct_pack(s := s, v := v), (v, -s)) AS e FROM spent CROSS JOIN (VALUES {values}) x(b) WHERE i = 1 AND s <= b * 100 // (SELECT u FROM unit) GROUP BY b),
      sums AS (SELECT b, e.s AS s, (1048576 - e.v % 1048576) % 1048576 AS n, e.s * (SELECT u FROM unit) AS cents, (e.v + n) // 1048576 AS units FROM best),
      money AS (SELECT b, n, (cents::DECIMAL(18,0) * 0.01)::DECIMAL(18,2) AS cost, (units::DECIMAL(18,0) * 0.0001)::DECIMAL(18,4) AS net FROM sums){rest}"""


# which orders one budget takes: from the lowest cost up, the most orders that still lead to the best value
_TAKEN = """, walk AS (WITH RECURSIVE w(i, s, k) AS (SELECT 0::BIGINT, s, 0::BIGINT FROM sums UNION ALL
        SELECT w.i + 1, any_value(w.s) - MAX(steps.k) * any_value(c), MAX(steps.k) FROM w JOIN steps ON steps.i = w.i + 1 JOIN spent a ON a.i = w.i + 1 AND a.s = w.s
        JOIN spent r ON r.i = w.i + 2 AND r.s = w.s - steps.k * c WHERE r.v + steps.v = a.v GROUP BY w.i) SELECT * FROM w WHERE i > 0),
      taken AS (SELECT o.* FROM offers o JOIN (SELECT DISTINCT i, cost FROM curves) USING (cost) JOIN walk USING (i) WHERE place <= k)"""

_MONEY = "b::DOUBLE AS budget, n AS selected_count, cost::DOUBLE AS total_cost, ROUND(net, 2)::DOUBLE AS expected_total_saving"


@query(
    "OPT-01 OPT-02",
    over_pred(_RISKIEST.format(t=9000) + _knapsack(["200", "777"], " SELECT b::DOUBLE AS budget, ROUND(net, 2)::DOUBLE AS expected_total_saving FROM money")),
)
def tight_selection(spark, sf_dir):
    """Total saving of the riskiest candidates under budgets that do not pay for all."""
    totals = decisions.selection_totals(decisions.choose(_candidates(spark, sf_dir, threshold="0.9"), "order_id", ["200", "777"]), ["200", "777"])
    return totals.select("budget", "expected_total_saving")


@query("OPT-01 OPT-02", over_pred(_RISKIEST.format(t=3000) + _knapsack(["200", "777"], f" SELECT {_MONEY} FROM money")))
def tight_selection_all(spark, sf_dir):
    """Saving, cost and number of orders under the same budgets with every candidate of the table competing."""
    totals = decisions.selection_totals(decisions.choose(_candidates(spark, sf_dir), "order_id", ["200", "777"]), ["200", "777"])
    return totals.select("budget", "selected_count", "total_cost", "expected_total_saving")


@query(
    "OPT-02 OPT-01 JON-11 AGG-34",
    over_pred(_RISKIEST.format(t=3000) + _knapsack(BUDGETS, f""" SELECT {_MONEY}, ROUND(net + cost, 2)::DOUBLE AS expected_total_penalty_avoided,
      ROUND(cost * 100 / b, 2)::DOUBLE AS budget_usage_pct FROM money""")),
)
def budget_scenarios(spark, sf_dir):
    """Exact selection for four budgets."""
    chosen = decisions.choose(_candidates(spark, sf_dir), "order_id", BUDGETS)
    return decisions.selection_totals(chosen, BUDGETS)


@query(
    "OPT-01 PRJ-35",
    over_pred(_RISKIEST.format(t=3000) + _knapsack(["1000"], _TAKEN + " SELECT 1000.0::DOUBLE AS budget, order_id, upgrade_cost::DOUBLE AS upgrade_cost, net::DOUBLE AS net_benefit FROM taken")),
)
def orders_of_a_tight_budget(spark, sf_dir):
    """Which orders a budget takes that does not pay for all."""
    return decisions.choose(_candidates(spark, sf_dir), "order_id", ["1000"]).select("budget", "order_id", "upgrade_cost", "net_benefit")


@query(
    "OPT-01 OPT-02 WIN-08",
    over_pred(_RISKIEST.format(t=3000) + """ SELECT b::DOUBLE AS budget, 1 AS affordable, 1 AS not_worse_than_greedy, (SELECT COUNT(*) FROM cand) AS considered
      FROM (VALUES (1000), (3000), (5000), (10000)) v(b)"""),
)
def selection_invariants(spark, sf_dir):
    """Exact choice stays inside each budget and never saves less than the greedy fill."""
    cands = written(_candidates(spark, sf_dir), "candidates")  # read by both choices and the count
    exact = decisions.selection_totals(decisions.choose(cands, "order_id", BUDGETS), BUDGETS)
    greedy = decisions.selection_totals(decisions.choose_greedy(cands, "order_id", BUDGETS), BUDGETS)
    both = exact.join(greedy.select("budget", F.col("expected_total_saving").alias("greedy")), "budget")
    return both.select(
        "budget", (F.col("total_cost") <= F.col("budget")).cast("int").alias("affordable"),
        (F.col("expected_total_saving") >= F.col("greedy") - 0.01).cast("int").alias("not_worse_than_greedy"),
        cands.agg(F.count("*").alias("n")).scalar().alias("considered"),
    )


@query(
    "OPT-01 TOP-02",
    over_pred(_RISKIEST.format(t=3000) + """ SELECT b::DOUBLE AS budget, 1 AS affordable, 1 AS not_worse_than_capped, (SELECT COUNT(*) FROM cand) AS considered
      FROM (VALUES (1000), (5000)) v(b)"""),
)
def selection_without_cap(spark, sf_dir):
    """All candidates compete, which saves no less than choosing from the list of 500."""
    every = _candidates(spark, sf_dir, basis="rate_card")
    budgets = ["1000", "5000"]
    full = decisions.selection_totals(decisions.choose(every, "order_id", budgets), budgets)
    listed = decisions.top_candidates(_candidates(spark, sf_dir), "order_id", 500)
    capped = decisions.selection_totals(decisions.choose(listed, "order_id", budgets), budgets)
    both = full.join(capped.select("budget", F.col("expected_total_saving").alias("capped")), "budget")
    return both.select(
        "budget", (F.col("total_cost") <= F.col("budget")).cast("int").alias("affordable"),
        (F.col("expected_total_saving") >= F.col("capped") - 0.01).cast("int").alias("not_worse_than_capped"),
        every.agg(F.count("*").alias("n")).scalar().alias("considered"),
    )


@query(
    "WIN-08 JON-11 AGG-34 OPT-02",
    over_pred(_RISKIEST.format(t=3000) + f""", spread AS (SELECT *, SUM(upgrade_cost) OVER (PARTITION BY b ORDER BY net::DOUBLE/upgrade_cost::DOUBLE DESC, order_id
        ROWS UNBOUNDED PRECEDING) AS spent FROM cand CROSS JOIN (VALUES (1000), (3000), (5000), (10000)) v(b))
      SELECT b::DOUBLE AS budget, {_TOTALS}, ROUND(SUM(upgrade_cost) * 100 / b, 2)::DOUBLE AS budget_usage_pct FROM spread WHERE spent <= b GROUP BY b"""),
)
def greedy_scenarios(spark, sf_dir):
    chosen = decisions.choose_greedy(_candidates(spark, sf_dir), "order_id", BUDGETS)
    return decisions.selection_totals(chosen, BUDGETS)


@query(
    "TOP-11",
    over_pred(_RISKIEST.format(t=3000) + f""", spread AS (SELECT *, SUM(upgrade_cost) OVER (PARTITION BY b ORDER BY net::DOUBLE/upgrade_cost::DOUBLE DESC, order_id
        ROWS UNBOUNDED PRECEDING) AS spent FROM cand CROSS JOIN (VALUES (1000), (3000), (5000), (10000)) v(b))
      SELECT b::DOUBLE AS budget, {_TOTALS}, ROUND(SUM(upgrade_cost) * 100 / b, 2)::DOUBLE AS budget_usage_pct FROM spread WHERE spent <= b GROUP BY b
      ORDER BY expected_total_saving DESC, selected_count DESC, b LIMIT 1"""),
)
def best_scenario(spark, sf_dir):
    chosen = decisions.choose_greedy(_candidates(spark, sf_dir), "order_id", BUDGETS)
    return decisions.best_scenario(decisions.selection_totals(chosen, BUDGETS))


_REASON = """risk_bucket || ' risk, p_late=' || ROUND(p_late, 2)::DECIMAL(5,2) || ', net benefit USD $' || ROUND(net, 0)::DECIMAL(18,0) || ', within budget'"""


@query(
    "PRJ-35 PRJ-27 TOP-06",
    over_pred(_RISKIEST.format(t=3000) + f""" SELECT 1000000000.0::DOUBLE AS budget, order_id, risk_bucket, p_late::DOUBLE AS p_late,
      upgrade_cost::DOUBLE AS upgrade_cost, ROUND(pen, 2)::DOUBLE AS expected_penalty, ROUND(net, 2)::DOUBLE AS net_benefit,
      'Upgrade' AS decision, {_REASON} AS reason FROM cand"""),
)
def selection_report(spark, sf_dir):
    chosen = decisions.choose(_candidates(spark, sf_dir), "order_id", [EVERYTHING])
    return decisions.selection_report(chosen, "order_id")


@query(
    "OPT-03 AGG-12",
    over_pred(_RISKIEST.format(t=5000) + """ SELECT COUNT(*) AS positive_roi_orders, ROUND(SUM(upgrade_cost), 2)::DOUBLE AS recommended_budget,
      ROUND(SUM(net), 2)::DOUBLE AS net_savings, ROUND(SUM(pen), 2)::DOUBLE AS expected_penalty_avoided FROM cand"""),
)
def executive_upgrade_summary(spark, sf_dir):
    return decisions.executive_upgrade_summary(_candidates(spark, sf_dir, threshold="0.5"))


@query(
    "JON-06 AGG-29 OPT-04",
    over_mart(""", c AS (SELECT *, (p_late*250 - upgrade_cost)::DECIMAL(18,4) AS net FROM mart WHERE p_late >= 0.3 AND p_late*250 > upgrade_cost),
      r AS (SELECT sha256('EXAMPLE_DELAY_SALT:' || customer_id) AS customer_id_hash, COUNT(*) AS orders, ROUND(SUM(epar), 2)::DOUBLE AS epar,
        ROUND(SUM(net), 2)::DOUBLE AS net_benefit, ROUND(SUM(upgrade_cost), 2)::DOUBLE AS upgrade_cost FROM c GROUP BY 1)
      SELECT *, 'CUST-' || upper(substr(customer_id_hash, 1, 8)) AS customer FROM r ORDER BY epar DESC, customer_id_hash LIMIT 20"""),
)
def customers_of_selection(spark, sf_dir):
    """Selection on the order mart, enriched and summed per customer."""
    full = mart_of(spark, sf_dir, ("customer_segment", "customer_id", "shipping_mode", "order_region"))
    cands = decisions.candidates(complete_fields(full, cost_basis="given"))
    chosen = decisions.choose(cands, "order_id", [EVERYTHING])
    enriched = decisions.enrich(chosen, full, "order_id").withColumn(
        "customer_id_hash", hash_id(F.col("customer_id"), "EXAMPLE_DELAY_SALT")
    )
    return decisions.customer_rollup(enriched)


@query(
    "OPT-04 JON-06",
    over_mart(""", cand AS (SELECT *, (p_late*250 - upgrade_cost)::DECIMAL(18,4) AS net FROM mart WHERE p_late >= 0.3 AND p_late*250 > upgrade_cost)"""
      + _knapsack(["5000"], _TAKEN + """ SELECT 5000.0::DOUBLE AS budget, order_id, p_late::DOUBLE AS p_late, upgrade_cost::DOUBLE AS upgrade_cost, expected_penalty::DOUBLE AS expected_penalty,
        net::DOUBLE AS net_benefit, epar::DOUBLE AS epar, profit_actual::DOUBLE AS profit_actual, customer_segment, customer_id FROM taken""")),
)
def roi_selection(spark, sf_dir):
    """Budgeted selection on the order mart with profit at risk next to each order."""
    full = mart_of(spark, sf_dir, ("customer_segment", "customer_id", "shipping_mode", "order_region"))
    cands = decisions.candidates(complete_fields(full, cost_basis="given"))
    chosen = decisions.choose(cands, "order_id", ["5000"])
    return decisions.enrich(chosen, full, "order_id").drop("risk_bucket")


@query(
    "AGG-39 ML-14",
    over_pred(_RISKIEST.format(t=3000) + f""" SELECT COUNT(*) AS selected_count, ROUND(SUM(upgrade_cost)*100/100000000, 2)::DOUBLE AS budget_usage_pct,
      ROUND(SUM(ROUND(net, 2)), 2)::DOUBLE AS expected_total_saving, (SELECT COUNT(*) FILTER (risk_bucket = 'High') FROM
        (SELECT * FROM cand ORDER BY ROUND(net, 2) DESC, p_late DESC LIMIT 5)) AS high_risk_in_sample FROM cand"""),
)
def selection_summary(spark, sf_dir):
    """A budget that pays for every candidate."""
    report = decisions.selection_report(decisions.choose(_candidates(spark, sf_dir), "order_id", ["100000000"]), "order_id")
    return decisions.action_summary(report, 100000000)


# --- grids ---------------------------------------------------------------------------------


def formula_score(mode, discount):
    """Transparent scores for a cell: profit falls with the discount, lateness with a faster mode."""
    factor = (
        F.when(mode == "Same Day", Decimal("0.50")).when(mode == "First Class", Decimal("0.70"))
        .when(mode == "Second Class", Decimal("0.90")).otherwise(Decimal("1.00"))
    )
    profit = F.col("product_price") * (1 - discount) * F.col("profit_ratio") * F.lit(Decimal("0.01"))
    return F.round(profit, 4).cast(MONEY), F.round(F.col("p_late") * factor, 4).cast("decimal(8,4)")


_GRID = f""", modes AS (SELECT * FROM (VALUES ('Standard Class', 0, 1.00), ('Second Class', 1, 0.90), ('First Class', 2, 0.70), ('Same Day', 3, 0.50)) m(cell_mode, mi, f)),
      discs AS (SELECT * FROM (VALUES (0.00, 0), (0.05, 1), (0.10, 2), (0.15, 3), (0.20, 4), (0.25, 5)) d(disc, di)),
      cells AS (SELECT order_id, any_value(order_region) AS region, cell_mode, disc::DECIMAL(5,4) AS disc, mi + 4*di AS seq,
        SUM(ROUND(product_price * (1 - disc)::DECIMAL(5,4) * profit_ratio * 0.01, 4)::DECIMAL(18,4))::DECIMAL(18,4) AS profit,
        (((2*SUM((ROUND(p_late*f, 4)*10000)::BIGINT)+COUNT(*))//(2*COUNT(*)))::DECIMAL(9,0)*0.0001)::DECIMAL(9,4) AS p
        FROM {{source}} CROSS JOIN modes CROSS JOIN discs GROUP BY order_id, cell_mode, disc, mi, di),
      priced AS (SELECT *, {cost_sql('cell_mode', 'region')} AS ship FROM cells),
      net AS (SELECT *, ROUND(profit - p*250 - ship, 4)::DECIMAL(18,4) AS net FROM priced)"""


@query(
    "OPT-05 JON-09 WIN-03 AGG-31",
    over_pred(_GRID.format(source="pred") + """ SELECT order_id, cell_mode AS shipping_mode, disc::DOUBLE AS discount_rate, profit::DOUBLE AS profit_pred, p::DOUBLE AS p_late,
      ship::DOUBLE AS shipping_cost, net::DOUBLE AS expected_net, CASE WHEN net > 0 THEN 'accept' ELSE 'decline' END AS decision
      FROM net QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY net DESC, seq) = 1"""),
)
def whatif_best(spark, sf_dir):
    """Best mode and discount of every order."""
    return decisions.best_cell(_whatif(spark, sf_dir), ["order_id"])


@query(
    "WIN-09 OPT-05",
    over_pred(_GRID.format(source="pred") + """, mean AS (SELECT disc, cell_mode, ROUND(SUM(net)::DOUBLE/COUNT(*), 4)::DECIMAL(18,4) AS net FROM net GROUP BY 1, 2),
      heat AS (SELECT disc, cell_mode, ROUND((net - MIN(net) OVER ())::DOUBLE / (MAX(net) OVER () - MIN(net) OVER ())::DOUBLE, 4) AS h FROM mean)
      SELECT disc::DOUBLE AS discount_rate, MAX(h) FILTER (cell_mode = 'Standard Class') AS "Standard Class", MAX(h) FILTER (cell_mode = 'Second Class') AS "Second Class",
      MAX(h) FILTER (cell_mode = 'First Class') AS "First Class", MAX(h) FILTER (cell_mode = 'Same Day') AS "Same Day" FROM heat GROUP BY 1"""),
)
def whatif_heat_table(spark, sf_dir):
    return decisions.heat_table(_whatif(spark, sf_dir))


def _whatif(spark, sf_dir):
    items = order_items(spark, sf_dir, ["order_id", "order_region", "product_price", "profit_ratio", "p_late"])
    return decisions.whatif(items, "order_id", formula_score)


@query(
    "PRJ-33",
    over_items("""SELECT shipping_mode, d::DOUBLE AS discount_rate, COUNT(*) AS n, SUM(ROUND(product_price::DECIMAL(12,4) * quantity * (1 - d)::DECIMAL(6,4), 4))::DOUBLE AS sales
      FROM items CROSS JOIN (VALUES (0.00), (0.20)) v(d) GROUP BY 1, 2"""),
)
def lever_sales(spark, sf_dir):
    """Sales that would follow from two discounts."""
    items = order_items(spark, sf_dir, ["shipping_mode", "product_price", "quantity"])
    rates = F.explode(F.array(*[F.lit(Decimal(d)).cast("decimal(5,4)") for d in ("0.00", "0.20")]))
    rows = decisions.lever_rows(items.withColumn("discount_rate", rates))
    return rows.groupBy("shipping_mode", "discount_rate").agg(F.count("*").alias("n"), F.sum("sales").alias("sales"))


@query(
    "PRJ-33",
    over_items("""SELECT shipping_mode, COUNT(*) AS n, COUNT(*) FILTER (line_no = 1) AS default_dates, COUNT(*) FILTER (line_no <> 3) AS priced,
      ROUND(SUM(CASE WHEN line_no = 2 THEN 5.0 WHEN line_no <> 3 THEN product_price::DOUBLE * quantity * (1 - discount_rate::DOUBLE) END), 2) AS sales,
      ROUND(SUM(CASE WHEN line_no <> 3 THEN product_price::DOUBLE END), 2) AS item_price, 0 AS set_without_lever FROM items GROUP BY 1"""),
)
def lever_profit_rows(spark, sf_dir):
    """Levers of every item, some without price, date or with sales of their own, as raw rows for the profit model."""
    items = order_items(spark, sf_dir, ["line_no", "shipping_mode", "product_price", "quantity", "discount_rate", "order_ts"])
    line = F.col("line_no")
    levers = items.select(
        "shipping_mode", F.when(line != 3, F.col("product_price")).alias("product_price"), F.col("quantity").alias("order_item_quantity"), "discount_rate",
        F.when(line != 1, F.date_format("order_ts", "M/d/yyyy H:mm")).alias("order_date"), F.when(line == 2, F.lit(5.0)).alias("sales"),
    )
    rows = decisions.raw_profit_rows(levers.withColumn("sales", F.when(F.col("product_price").isNotNull(), F.col("sales"))))
    same = (F.col("Sales").eqNullSafe(F.col("`Order Item Total`"))) & (F.col("Sales").eqNullSafe(F.col("`Sales per customer`")))
    return rows.groupBy(F.col("Shipping Mode").alias("shipping_mode")).agg(
        F.count("*").alias("n"), F.count_if(F.col("`order date (DateOrders)`") == "2017-06-15 12:00").alias("default_dates"),
        F.count_if(F.col("Sales").isNotNull() & same).alias("priced"), F.round(F.sum("Sales"), 2).alias("sales"),
        F.round(F.sum("Order Item Product Price"), 2).alias("item_price"), F.count("Latitude").cast("int").alias("set_without_lever"),
    )


_LOSING = """, losing AS (SELECT *, ROUND(profit_pred - p_late*250 - upgrade_cost, 4)::DECIMAL(18,4) AS base_net FROM mart
        WHERE ROUND(profit_pred - p_late*250 - upgrade_cost, 4) < 0)"""


@query(
    "FLT-11",
    over_mart(_LOSING + " SELECT order_id, base_net::DOUBLE AS base_net, customer_segment FROM losing"),
)
def losing_orders(spark, sf_dir):
    return decisions.losing_orders(mart_of(spark, sf_dir), "order_id").select("order_id", "base_net", "customer_segment")


@query(
    "TOP-07",
    over_mart(_LOSING + " SELECT order_id, base_net::DOUBLE AS base_net FROM losing ORDER BY losing.base_net, order_id LIMIT 200"),
)
def worst_losing_orders(spark, sf_dir):
    """The list of the 200 orders that lose most."""
    return decisions.losing_orders(mart_of(spark, sf_dir), "order_id", limit=200).select("order_id", "base_net")


@query(
    "OPT-06 JON-02 JON-09 AGG-31 WIN-03",
    over_mart(_LOSING + ", lost AS (SELECT * FROM pred WHERE order_id IN (SELECT order_id FROM losing))" + _GRID.format(source="lost") + """
      SELECT order_id, l.shipping_mode AS current_shipping, l.customer_segment AS segment, l.order_region AS region, ROUND(l.base_net, 2)::DOUBLE AS base_net,
      cell_mode AS recommend_shipping, disc::DOUBLE AS recommend_discount, ROUND(net.net, 2)::DOUBLE AS rescued_net,
      ROUND(net.net - l.base_net, 2)::DOUBLE AS improvement, p::DOUBLE AS rescued_p_late, ROUND(profit, 2)::DOUBLE AS rescued_profit,
      ship::DOUBLE AS rescued_shipping_cost, CASE WHEN net.net > 0 THEN 'accept' ELSE 'decline' END AS decision
      FROM net JOIN losing l USING (order_id) QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY net.net DESC, seq) = 1"""),
)
def rescued_orders(spark, sf_dir):
    """Best mode and discount of every order that loses."""
    full = mart_of(spark, sf_dir, ("customer_segment", "shipping_mode", "order_region"))
    items = order_items(spark, sf_dir, ["order_id", "order_region", "product_price", "profit_ratio", "p_late"])
    return decisions.rescue(full, items, "order_id", formula_score)


@query("OPT-06 ML-10 ML-11")
def rescued_by_models(spark, sf_dir):
    """The same scan with trained models as the scorer."""
    cols = ["order_id", "order_ts", "order_region", "product_price", "profit_ratio", "discount_rate", "quantity", "shipping_mode",
            "scheduled_days", "true_label", "p_late", "profit_actual"]
    numbers = ["scheduled_days", "product_price", "profit_ratio", "discount_rate", "quantity"]
    items = order_items(spark, sf_dir, cols)
    items = written(items.withColumns({c: to_number(F.col(c)) for c in numbers}), "items")  # read as doubles from here on
    items = features.group_split(items, "order_id")
    spec, codes = features.fit_features(items.where("split = 'train'"), numbers, ["order_region"], ["shipping_mode"])
    keep = ["split", "true_label", "profit_actual", "order_id"]
    data = features.transform_features(items, spec, codes, "order_ts", keep=keep).withColumnsRenamed({f"key_{k}": k for k in keep})
    data = written(data, "features")  # read by both trainings and by the scan
    late = models.train_late(data, spec.columns, "true_label", max_iter=5, max_depth=4, step=0.3)
    profit = models.train_profit(data, spec.columns, "profit_actual", max_iter=5, max_depth=4, step=0.3)

    def scorer(rows, kept, cells):
        """A cell sets mode and discount; what else the models read is the item's."""
        modes = spec.one_hot["shipping_mode"]
        given = {seq: {"discount_rate": float(rate)} | {f"shipping_mode_{m}": float(m == mode) for m in modes} for seq, mode, rate in cells}
        return scored_cells(rows, kept, spec.columns, late, profit, given)

    full = mart_of(spark, sf_dir, ("customer_segment", "shipping_mode", "order_region"))
    return decisions.rescue(full, data.select("order_id", *[F.col(f"`{c}`") for c in spec.columns]), "order_id", scorer=scorer)


# --- explanations -----------------------------------------------------------------------------

IMPORTANCES = {
    "Shipping Mode_Standard Class": 0.31, "Shipping Mode_Same Day": 0.17, "Days for shipment (scheduled)": 0.12,
    "Type_TRANSFER": 0.09, "Shipping Mode_First Class": 0.08, "Product Price": 0.04,
}


@query(
    "AGG-38 JON-13",
    over_items(f""", m AS (SELECT trim(order_region) AS k, {avg4('bp')} AS region_mean FROM items GROUP BY 1)
      SELECT order_id, MIN(region_mean) AS region_mean, COUNT(*) AS n FROM items JOIN m ON trim(order_region) = k GROUP BY 1"""),
)
def region_mean_of_orders(spark, sf_dir):
    items = order_items(spark, sf_dir, ["order_id", "order_region", "p_late"])
    return explain.with_region_mean(items, items).groupBy("order_id").agg(
        F.min("region_mean").alias("region_mean"), F.count("*").alias("n")
    )


_FACTORS = f""", m AS (SELECT trim(order_region) AS k, {avg4('bp')} AS region_mean FROM items GROUP BY 1),
      imp AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in IMPORTANCES.items())}) i(feature, weight)),
      overall AS (SELECT p.*, region_mean, feature, weight, row_number() OVER (PARTITION BY order_id, line_no, product_id, supplier_id, price_cents ORDER BY weight DESC) AS pos
        FROM pred p JOIN m ON k = trim(order_region) CROSS JOIN imp
        WHERE feature NOT LIKE 'Shipping Mode_%' OR feature = 'Shipping Mode_' || shipping_mode),
      strongest AS (SELECT * FROM overall WHERE pos <= 3),
      own AS (SELECT p.*, region_mean, 'Shipping Mode_' || shipping_mode AS feature, COALESCE((SELECT weight FROM imp WHERE feature = 'Shipping Mode_' || p.shipping_mode), 0) AS weight, 4 AS pos
        FROM pred p JOIN m ON k = trim(order_region) WHERE shipping_mode NOT IN ('Standard Class', 'Same Day', 'First Class')),
      reg AS (SELECT p.*, region_mean, 'order_region' AS feature, 0.0::DOUBLE AS weight, 5 AS pos FROM pred p JOIN m ON k = trim(order_region)),
      every AS (SELECT *, row_number() OVER (PARTITION BY order_id, line_no, product_id, supplier_id, price_cents ORDER BY pos) - 1 AS position FROM
        (SELECT * FROM strongest UNION ALL SELECT * FROM own UNION ALL SELECT * FROM reg)),
      labelled_factors AS (SELECT *, CASE WHEN feature LIKE 'Shipping Mode_%' THEN 'shipping mode' WHEN feature LIKE 'Days%' THEN 'promised days'
        WHEN feature LIKE 'Type_%' THEN 'order type' WHEN feature = 'order_region' THEN 'destination region' ELSE feature END AS label,
        CASE WHEN feature LIKE 'Shipping Mode_%' THEN CASE WHEN shipping_mode = 'Standard Class' THEN 'raises risk' ELSE 'context' END
          WHEN feature LIKE 'Days%' THEN CASE WHEN bp >= 7000 THEN 'raises risk' ELSE 'context' END
          WHEN feature = 'order_region' THEN CASE WHEN region_mean >= 0.55 THEN 'raises risk' ELSE 'neutral' END ELSE 'context' END AS impact
        FROM every WHERE position < 4)"""


@query(
    "ML-13",
    over_pred(_FACTORS + """ SELECT shipping_mode, position::INTEGER AS position, feature, label, impact, weight,
      CASE WHEN label IN ('shipping mode', 'destination region') THEN 1 ELSE 0 END AS order_specific, COUNT(*) AS n FROM labelled_factors GROUP BY ALL"""),
)
def order_factors(spark, sf_dir):
    """Factors of every row: the three strongest that apply, then own mode and region."""
    pred = predictions(spark, sf_dir, ITEM_KEYS)
    rows = explain.factor_rows(explain.explain_orders(pred, pred, IMPORTANCES), "shipping_mode")
    return rows.groupBy("shipping_mode", "position", "feature", "label", "impact", "weight", "order_specific").agg(F.count("*").alias("n"))


_ACTION = """CASE WHEN risk_bucket = 'High' AND expected_penalty > upgrade_cost THEN 'upgrade and dispatch first'
      WHEN risk_bucket = 'Medium' AND expected_penalty > upgrade_cost THEN 'keep as upgrade candidate' ELSE 'keep current shipping and monitor' END"""


@query(
    "PRJ-27 PRJ-26 ML-13",
    over_pred(_FACTORS + f""", labels AS (SELECT order_id, line_no, product_id, supplier_id, price_cents, string_agg(label, ', ' ORDER BY position) AS names FROM labelled_factors GROUP BY ALL)
      SELECT order_id, line_no, product_id, supplier_id, 'Risk ' || upper(risk_bucket) || ' (p_late=' || ROUND(p_late*100, 1)::DECIMAL(5,1) || '%), ships by ' || shipping_mode || ' to ' ||
      trim(order_region) || '. Penalty at stake USD ' || ROUND(expected_penalty, 0)::DECIMAL(18,0) || ', upgrade USD ' || ROUND(upgrade_cost, 0)::DECIMAL(18,0) ||
      ', net USD ' || ROUND(expected_penalty - upgrade_cost, 0)::DECIMAL(18,0) || '. Factors: ' || names || '. Advice: ' || {_ACTION} || '.' AS manager_summary
      FROM pred JOIN labels USING (order_id, line_no, product_id, supplier_id, price_cents)"""),
)
def order_narratives(spark, sf_dir):
    pred = predictions(spark, sf_dir, ITEM_KEYS)
    return explain.explain_orders(pred, pred, IMPORTANCES).select("order_id", "line_no", "product_id", "supplier_id", "manager_summary")


@query(
    "PRJ-36 TOP-01",
    over_pred(_FACTORS + f""", leading_factor AS (SELECT *, label || ': ' || CASE WHEN label = 'shipping mode' THEN 'ships by ' || shipping_mode ELSE 'tight promises run late more often' END AS top_factor
        FROM labelled_factors WHERE position = 0)
      SELECT order_id, 'ORD-' || substr(order_id::VARCHAR, 1, 8) AS display_order_id, shipping_mode, order_region, p_late::DOUBLE AS p_late, risk_bucket,
      upgrade_cost::DOUBLE AS upgrade_cost, expected_penalty::DOUBLE AS expected_penalty, top_factor, {_ACTION} AS recommended_action FROM leading_factor"""),
)
def explained_order_list(spark, sf_dir):
    pred = predictions(spark, sf_dir, ITEM_KEYS)
    return explain.order_list(explain.explain_orders(pred, pred, IMPORTANCES), "order_id")


def hash_of(order_id: int) -> str:
    return hashlib.sha256(f"EXAMPLE_DELAY_SALT:{order_id}".encode()).hexdigest()[:8].upper()


QUESTION = f"Why is ORD-{hash_of(17)} late, and what about {hash_of(1242).lower()}?"


@query(
    "FLT-08 JON-12",
    """SELECT o.o_orderkey AS order_id, sha256('EXAMPLE_DELAY_SALT:' || o.o_orderkey) AS order_id_hash FROM orders o
      WHERE upper(substr(sha256('EXAMPLE_DELAY_SALT:' || o.o_orderkey), 1, 8)) IN ('"""
    + f"{hash_of(17)}', '{hash_of(1242)}')",
)
def orders_named_in_text(spark, sf_dir):
    """Orders a question mentions by display id or hash."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    hashed = orders.withColumn("order_id_hash", hash_id(F.col("order_id"), "EXAMPLE_DELAY_SALT"))
    return explain.named_orders(hashed, QUESTION)
