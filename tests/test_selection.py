"""The budgeted choice: solver against a knapsack, bounded lists, hot kinds, ties, shared passes."""

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import decisions, ranking, selection


def knapsack(cost, value, budget):
    """Best (benefit, -orders, -cost) of any set within the budget."""
    best = [None] * (budget + 1)
    best[0] = (0, 0)
    for c, v in zip(cost, value, strict=True):
        for s in range(budget, c - 1, -1):
            if best[s - c] is not None:
                new = (best[s - c][0] + v, best[s - c][1] - 1)
                if best[s] is None or new > best[s]:
                    best[s] = new
    return max((b[0], b[1], -s) for s, b in enumerate(best) if b is not None)


def price_of(cost, value, budget):
    above = 0
    for d in sorted({Fraction(v, c) for c, v in zip(cost, value, strict=True)}, reverse=True):
        level = sum(c for c, v in zip(cost, value, strict=True) if Fraction(v, c) == d)
        if above + level > budget:
            return d, above
        above += level
    return None, above


def classes_of(cost, value, price, listed):
    out = []
    for c in sorted(set(cost)):
        nets = [v for x, v in zip(cost, value, strict=True) if x == c]
        above = sorted({v for v in nets if Fraction(v, c) > price})
        below = sorted({v for v in nets if Fraction(v, c) <= price}, reverse=True)
        out.append(selection.CostClass(c, [(v, nets.count(v)) for v in above[:listed]], [(v, nets.count(v)) for v in below[:listed]], len(above) > listed, len(below) > listed))
    return out


@pytest.mark.parametrize("listed", [1, 2, 100])
def test_solver_against_a_knapsack(listed):
    rng, solved = np.random.default_rng(listed), 0
    for _ in range(150):
        n = int(rng.integers(1, 60))
        cost = rng.choice(rng.choice([3, 5, 6, 7, 10, 12, 20], int(rng.integers(1, 6)), replace=False), n).tolist()
        value = rng.integers(1, int(rng.choice([4, 30, 1000])), n).tolist()
        budget = int(rng.integers(1, max(2, sum(cost))))
        pairs = [(c, v) for c, v in zip(cost, value, strict=True) if c <= budget]
        cost, value = [c for c, _ in pairs], [v for _, v in pairs]
        price, above = price_of(cost, value, budget)
        if price is None:
            continue
        number, proven = listed, False
        while not proven:
            cuts, proven = selection.solve(classes_of(cost, value, price, number), price, budget - above)
            number *= 2
        total, orders, spent = 0, 0, 0
        for cut in cuts:
            nets = [v for c, v in pairs if c == cut.cost]
            whole = [v for v in nets if v > cut.over]
            assert 0 <= cut.take <= cut.n and (not cut.n or nets.count(cut.over) == cut.n)
            total, orders, spent = total + sum(whole) + cut.take * cut.over, orders + len(whole) + cut.take, spent + cut.cost * (len(whole) + cut.take)
        assert (total, -orders, -spent) == knapsack(cost, value, budget)
        solved += 1
    assert solved > 100


def test_what_the_driver_sees_does_not_grow_with_the_kinds():
    """A hundred thousand kinds of one cost on each side: the nearest few decide."""
    c = [selection.CostClass(50, [(60 + k, 1) for k in range(64)], [(50 - k // 8, 1) for k in range(64)], True, True), selection.CostClass(70, [(90 + k, 1) for k in range(64)], [(60, 3)], True, False)]
    cuts, proven = selection.solve(c, Fraction(1), 137)
    assert proven and sum(x.take for x in cuts) <= 3


SCHEMA = "order_id {key}, p_late decimal(8,4), upgrade_cost decimal(12,2), expected_penalty decimal(18,4), net_benefit decimal(18,4), risk_bucket string"


def wide(spark, n, cost="80", net="120"):
    def number(x, kind):
        return F.expr(x).cast(kind)

    return spark.range(n).select(
        F.col("id").alias("order_id"), number("0.9", "decimal(8,4)").alias("p_late"), number(cost, "decimal(12,2)").alias("upgrade_cost"),
        number("200", "decimal(18,4)").alias("expected_penalty"), number(net, "decimal(18,4)").alias("net_benefit"), F.lit("High").alias("risk_bucket"),
    )


def test_part_of_a_small_kind_is_ranked_alike(spark, monkeypatch):
    rows, budgets = wide(spark, 3000, "80 + 10 * (id % 2)", "120"), ["8000", "40001"]
    few = sorted((r.budget, r.order_id) for r in decisions.choose(rows, "order_id", budgets).collect())
    monkeypatch.setattr(selection, "_ROWS", 0)
    assert sorted((r.budget, r.order_id) for r in decisions.choose(rows, "order_id", budgets).collect()) == few and len(few) == 600


def test_half_of_a_kind_of_a_million_orders(spark):
    chosen = decisions.choose(wide(spark, 1_000_000), "order_id", ["40000000"])
    got = chosen.agg(F.count("*"), F.min("order_id"), F.max("order_id"), F.count_distinct("order_id")).first()
    assert tuple(got) == (500_000, 0, 499_999, 500_000)
    assert "SinglePartition" not in chosen._jdf.queryExecution().executedPlan().toString()


def test_many_kinds_and_text_keys_in_few_jobs(spark):
    rows = wide(spark, 120_000, "50 + 2.5 * (id % 9)", "1 + (id * 7919 % 99991) / 1000.0").withColumn("order_id", F.concat(F.lit("k"), F.col("order_id").cast("string")))
    budgets = ["1000", "25000", "900000"]
    context = spark.sparkContext
    context.setJobGroup("choose", "choose")
    totals = {r["budget"]: r for r in decisions.selection_totals(decisions.choose(rows, "order_id", budgets), budgets).collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("choose"))
    context.setJobGroup("other", "other")
    assert jobs < 20
    pairs = [(int(r.c * 10), int(r.v)) for r in rows.select((F.col("upgrade_cost")).alias("c"), (F.col("net_benefit") * 10_000).cast("long").alias("v")).collect()]
    for budget in (1000, 25000):
        best = np.zeros(budget * 10 // 25 + 1, np.int64)
        by_cost = {}
        for c, v in pairs:
            by_cost.setdefault(c // 25, []).append(v)
        for c, values in by_cost.items():
            for v in sorted(values, reverse=True)[: budget * 10 // 25 // c]:
                best[c:] = np.maximum(best[c:], best[: len(best) - c] + v)
        assert totals[float(budget)]["expected_total_saving"] == pytest.approx(best[-1] / 10_000, abs=0.006)
    assert 0.999 * 900_000 < totals[900_000.0]["total_cost"] <= 900_000


def test_free_orders_unaffordable_orders_and_no_benefit(spark):
    rows = [(1, "0", "5"), (2, "100", "9"), (3, "100", "8"), (4, "9999", "50000"), (5, "100", "0"), (6, "-3", "9"), (7, "0", "0")]
    made = [(k, Decimal("0.5"), Decimal(c), Decimal("1"), Decimal(v), "Low") for k, c, v in rows]
    frame = spark.createDataFrame(made, SCHEMA.format(key="int"))
    got = sorted((int(r.budget), r.order_id) for r in decisions.choose(frame, "order_id", ["100", "150", "500", "-1", "0"]).collect())
    assert got == [(100, 1), (100, 2), (150, 1), (150, 2), (500, 1), (500, 2), (500, 3)]
    assert decisions.choose(frame, "order_id", ["0", "-5"]).count() == 0 and decisions.choose_greedy(frame, "order_id", []).count() == 0


def test_greedy_with_all_orders_tied_uses_no_window_over_all_rows(spark):
    tied = decisions.choose_greedy(wide(spark, 300_000, "10 * (1 + id % 3)", "20 * (1 + id % 3)"), "order_id", ["1000", "2000000", "99999999"])
    plan = tied._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    got = {int(r.budget): (r.n, r.s) for r in tied.groupBy("budget").agg(F.count("*").alias("n"), F.sum("upgrade_cost").alias("s")).collect()}
    spent = np.cumsum([10 * (1 + k % 3) for k in range(300_000)])
    for budget, (n, s) in got.items():
        fit = int((spent <= budget).sum())
        assert (n, int(s)) == (fit, int(spent[fit - 1]))
    assert len(got) == 3


def test_running_sum_cuts_groups_into_ranges(spark):
    rows = spark.range(20_000).selectExpr("id % 2 as g", "id div 2 as k", "id % 7 as v").repartition(5)
    got = ranking.running_sum(rows, ["g"], ["k"], F.col("v"), "sum")
    assert got.columns == ["g", "k", "v", "sum"]
    for g in (0, 1):
        seen = [(r.k, r.sum) for r in got.where(f"g = {g}").orderBy("k").collect()]
        assert [k for k, _ in seen] == list(range(10_000)) and [s for _, s in seen] == np.cumsum([(2 * k + g) % 7 for k in range(10_000)]).tolist()
    assert ranking.running_sum(rows.limit(0), ["g"], ["k"], F.col("v"), "sum").count() == 0
