import itertools
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import decisions, money, selection
from parcelwise.plans import choices
from parcelwise.plans.registry import QUERIES

SCHEMA = (
    "order_id long, p_late decimal(8,4), upgrade_cost decimal(12,2), expected_penalty decimal(18,4), "
    "net_benefit decimal(18,4), risk_bucket string"
)


def frame(spark, pairs):
    rows = [
        (i, Decimal("0.9"), Decimal(str(cost)), Decimal(str(pen)), Decimal(str(pen)) - Decimal(str(cost)), "High")
        for i, (pen, cost) in enumerate(pairs)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def brute(cost, value, budget):
    best = 0
    for n in range(len(cost) + 1):
        for pick in itertools.combinations(range(len(cost)), n):
            if sum(cost[i] for i in pick) <= budget:
                best = max(best, sum(value[i] for i in pick))
    return best


def test_known_optimum_and_report_order(spark):
    chosen = decisions.choose(frame(spark, [(300, 100), (250, 100), (120, 100)]), "order_id", ["250"])
    row = decisions.selection_totals(chosen, ["250"]).first()
    assert (row["selected_count"], row["total_cost"], row["expected_total_saving"], row["expected_total_penalty_avoided"]) == (2, 200.0, 350.0, 550.0)
    report = decisions.selection_report(decisions.choose(frame(spark, [(130, 100), (300, 100), (250, 100)]), "order_id", ["1000"]), "order_id")
    assert [r["net_benefit"] for r in report.collect()] == [200.0, 150.0, 30.0]
    assert report.first()["reason"] == "High risk, p_late=0.90, net benefit USD $200, within budget"


def test_empty_and_zero_budgets(spark):
    nothing = decisions.choose(frame(spark, []), "order_id", ["100"])
    assert decisions.selection_totals(nothing, ["100"]).first()["selected_count"] == 0
    poor = decisions.choose(frame(spark, [(300, 100)]), "order_id", ["50"])
    assert poor.count() == 0


def test_candidates_and_cap(spark):
    rows = [(1, Decimal("0.05"), Decimal("80"), Decimal("12.5")), (2, Decimal("0.9"), Decimal("80"), Decimal("225")), (3, Decimal("0.8"), Decimal("500"), Decimal("200"))]
    scored = spark.createDataFrame(rows, "order_id int, p_late decimal(8,4), upgrade_cost decimal(12,2), expected_penalty decimal(18,4)")
    assert [r["order_id"] for r in decisions.candidates(scored).collect()] == [2]
    capped = decisions.top_candidates(frame(spark, [(300, 100), (250, 100), (200, 100)]), "order_id", 2)
    assert sorted(r["net_benefit"] for r in capped.collect()) == [150, 200]


def test_riskiest_item_of_a_hot_order(spark):
    rows = [(1, i, Decimal("0.5") if i != 77 else Decimal("0.6")) for i in range(300)] + [(2, 4, Decimal("0.3")), (2, 3, Decimal("0.3"))]
    best = decisions.riskiest_item(spark.createDataFrame(rows, "o int, line int, p_late decimal(8,4)"), "o", ["line"])
    assert {(r["o"], r["line"]) for r in best.collect()} == {(1, 77), (2, 3)}


@pytest.mark.parametrize(("seed", "budget"), [(5, 500), (6, 1777), (7, 9000), (8, 33)])
def test_selection_equals_a_knapsack_over_all_candidates(spark, seed, budget, monkeypatch):
    monkeypatch.setattr(selection, "_NEAREST", 1)
    rng = np.random.default_rng(seed)
    pairs = [(int(rng.integers(101, 300)), int(c)) for c in rng.choice([31, 45, 50, 80, 100], 300)]
    chosen = decisions.choose(frame(spark, pairs).repartition(3), "order_id", [str(budget)])
    got = chosen.agg(F.sum("net_benefit"), F.sum("upgrade_cost"), F.count_distinct("order_id"), F.count("*")).first()
    assert int(got[0] or 0) == knapsack([c for _, c in pairs], [p - c for p, c in pairs], budget) and (got[1] or 0) <= budget and got[2] == got[3]


def test_many_equal_candidates(spark):
    rows = spark.range(250_000).select(
        F.col("id").alias("order_id"), F.lit(Decimal("0.9")).cast("decimal(8,4)").alias("p_late"), F.lit(Decimal("80")).cast("decimal(12,2)").alias("upgrade_cost"),
        F.lit(Decimal("200")).cast("decimal(18,4)").alias("expected_penalty"), F.lit(Decimal("120")).cast("decimal(18,4)").alias("net_benefit"), F.lit("High").alias("risk_bucket"),
    )
    budgets = ["20000000", "8000000", "8000079"]
    assert {r["budget"]: r["selected_count"] for r in decisions.selection_totals(decisions.choose(rows, "order_id", budgets), budgets).collect()} == {
        20_000_000.0: 250_000, 8_000_000.0: 100_000, 8_000_079.0: 100_000}
    greedy = decisions.choose_greedy(rows, "order_id", ["8000", "20000000"])
    assert sorted((r["budget"], r["n"], r["last"]) for r in greedy.groupBy("budget").agg(F.count("*").alias("n"), F.max("order_id").alias("last")).collect()) == [
        (Decimal("8000"), 100, 99), (Decimal("20000000"), 250_000, 249_999)]


def test_nothing_is_cut_unasked(spark):
    assert len(decisions.grid_cells([f"M{k}" for k in range(9)], [f"0.{k}" for k in range(10)])) == 90


def test_greedy_never_beats_exact(spark):
    cands = frame(spark, [(160, 100), (150, 60), (130, 60), (300, 200)])
    exact = decisions.selection_totals(decisions.choose(cands, "order_id", ["120", "200"]), ["120", "200"])
    greedy = decisions.selection_totals(decisions.choose_greedy(cands, "order_id", ["120", "200"]), ["120", "200"])
    saving = {r["budget"]: r["expected_total_saving"] for r in exact.collect()}
    assert all(r["expected_total_saving"] <= saving[r["budget"]] for r in greedy.collect())


def test_grid_limits_and_first_cell_wins_ties(spark):
    with pytest.raises(ValueError):
        decisions.grid_cells([], ["0.1"])
    cells = decisions.grid_cells(["A", "B", "A"], ["0.1", "0.10", "0.2"])
    assert [(i, m, str(d)) for i, m, d in cells] == [(0, "A", "0.1"), (1, "B", "0.1"), (2, "A", "0.2"), (3, "B", "0.2")]
    items = spark.createDataFrame([(1, "x", "s")], "o int, order_region string, shipping_mode string").withColumn("discount_rate", F.lit(0))

    def flat(mode, discount):
        return F.lit(Decimal("200")), F.lit(Decimal("0.0"))

    best = decisions.best_cell(decisions.whatif(items, "o", flat, cells), ["o"], cells).first()
    assert (best["shipping_mode"], str(best["discount_rate"]), best["decision"]) == ("A", "0.1000", "accept")


def test_upload_profit_needs_both_numbers(spark):
    rows = spark.createDataFrame([("100", "0.25"), ("x", "0.25"), ("10", None)], "s string, m string")
    assert [r[0] for r in rows.select(money.upload_profit(F.col("s"), F.col("m"))).collect()] == [Decimal("25.00"), None, None]


def knapsack(cost, value, budget):
    best = np.zeros(budget + 1, np.int64)
    for c, v in zip(cost, value, strict=True):
        if c <= budget:
            best[c:] = np.maximum(best[c:], best[: budget + 1 - c] + v)
    return int(best[-1])


def test_tight_budgets_over_all_candidates(spark):
    """No region, mode, score or id is left out: the query against a knapsack over every candidate of the table."""
    sf = "/root/testdata/sf0.001"
    rows = choices._candidates(spark, sf).select("order_id", "order_region", "upgrade_cost", "net_benefit").collect()
    assert {r.order_id % 5 for r in rows} == set(range(5)) and len({r.order_region for r in rows}) > 1
    cost, value = [int(r.upgrade_cost * 100) for r in rows], [int(r.net_benefit * 10_000) for r in rows]
    got = {int(r.budget): r for r in QUERIES["tight_selection_all"].build(spark, sf).collect()}
    assert set(got) == {200, 777}
    for budget, r in got.items():
        assert r.total_cost <= budget and r.expected_total_saving == pytest.approx(knapsack(cost, value, budget * 100) / 10_000, abs=0.006)


def test_choice_across_regions_against_brute_force(spark):
    rng = np.random.default_rng(11)
    pairs = [(int(c) + int(rng.integers(1, 90)), int(c)) for c in rng.choice([31, 45, 50, 80, 100], 12)]
    for budget in (60, 200, 333):
        chosen = decisions.choose(frame(spark, pairs), "order_id", [str(budget)]).agg(F.sum("net_benefit"), F.sum("upgrade_cost")).first()
        assert (chosen[0] or 0) == brute([c for _, c in pairs], [p - c for p, c in pairs], budget) and (chosen[1] or 0) <= budget
