import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import ranking


@pytest.fixture(params=[20_000, 10])
def finish_rows(request, monkeypatch):
    """Large: one sort at the end. Small: many narrowing passes."""
    monkeypatch.setattr(ranking, "_FINISH_ROWS", request.param)
    monkeypatch.setattr(ranking, "_BUCKETS", 8 if request.param == 10 else 512)


def test_quantiles_with_a_hot_value(spark, finish_rows):
    rng = np.random.default_rng(1)
    data = {"a": np.concatenate([rng.normal(0, 1, 400), np.full(300, 0.25), [1e9]]), "b": np.array([3.0]), "c": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None), ("a", float("nan"))]
    frame = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.01, 0.5, 0.95, 1.0]
    found = ranking.exact_quantiles(frame, "g", "v", probs)
    for g, vs in data.items():
        for p in probs:
            assert found[(g, p)] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12)


def test_cut_points_with_a_hot_first_key(spark, finish_rows):
    rng = np.random.default_rng(2)
    rows = [(int(t), int(i)) for i, t in enumerate(np.concatenate([rng.integers(0, 10**12, 150), np.full(200, 5 * 10**11)]))]
    frame = spark.createDataFrame(rows, "t long, i long").repartition(4)
    order = sorted(rows)
    ranks = [1, 70, 175, 260, 350]
    assert ranking.cut_points(frame, ["t", "i"], lambda n: ranks) == {r: order[r - 1] for r in ranks}
    cut = order[174]
    assert frame.where(ranking.at_or_before(["t", "i"], cut)).count() == 175


def test_cut_points_refuses_impossible_ranks(spark):
    with pytest.raises(ValueError):
        ranking.cut_points(spark.range(3), ["id"], lambda n: [n + 1])
    assert ranking.cut_points(spark.range(0), ["id"], lambda n: []) == {}


def test_dense_index_is_sorted_per_group(spark):
    rows = [("x", f"v{i:03d}") for i in range(50)] + [("y", "b"), ("y", "a"), ("y", "Z")]
    found = ranking.dense_index(spark.createDataFrame(rows, "g string, k string").repartition(4), "g", "k", start=1).collect()
    codes = {(r["g"], r["k"]): r["code"] for r in found}
    assert codes[("y", "Z")] == 1 and codes[("y", "a")] == 2 and codes[("y", "b")] == 3
    assert [codes[("x", f"v{i:03d}")] for i in range(50)] == list(range(1, 51))


@pytest.mark.parametrize("extra", [[np.inf], [-np.inf], [np.inf, -np.inf] * 3, [-1.7e308, 1.7e308], [5e-324, 1e-300, 1e300]])
def test_quantiles_end_with_extreme_values(spark, finish_rows, extra):
    values = np.concatenate([np.random.default_rng(3).normal(0, 1, 200), extra, [0.0, 0.0]])
    frame = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double").repartition(3)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    found = ranking.exact_quantiles(frame, "g", "v", probs)
    order = np.sort(values)
    for p in probs:
        at = p * (len(order) - 1)
        low, high = order[int(np.floor(at))], order[int(np.ceil(at))]
        want = low if low == high else low + (high - low) * (at - np.floor(at))
        assert found[("a", p)] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_quantiles_of_many_groups(spark):
    frame = spark.range(150_000).select((F.col("id") % 50_000).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    found = ranking.exact_quantiles(frame, "g", "v", [0.5])
    assert len(found) == 50_000 and found[("7", 0.5)] == 50_007.0


def test_sketch_and_one_pass_find_the_quantiles_of_a_large_group(spark):
    frame = spark.range(300_000).select(
        F.when(F.col("id") % 5 == 0, "small").otherwise("large").alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(7.5)).otherwise((F.col("id") * 7919 % 299_993).cast("double") / 7).alias("v"),
    )
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    context = spark.sparkContext
    context.setJobGroup("quantiles", "quantiles")
    found = ranking.exact_quantiles(frame, "g", "v", probs)
    jobs = len(context.statusTracker().getJobIdsForGroup("quantiles"))
    context.setJobGroup("other", "other")
    assert jobs <= 5  # two passes, each a shuffle and its result, and what keeps the rows
    rows = frame.toPandas()
    for g in ("small", "large"):
        for p in probs:
            assert found[(g, p)] == pytest.approx(np.quantile(rows[rows.g == g].v, p), rel=1e-12)


def test_a_wrong_bracket_is_narrowed_after_all(spark, monkeypatch):
    inside = ranking._inside
    monkeypatch.setattr(ranking, "_inside", lambda base, brackets: inside(base, {(g, low - 5, low - 4): r for (g, low, high), r in brackets.items()}))
    frame = spark.range(30_000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    assert ranking.exact_quantiles(frame, "g", "v", [0.3, 0.5])[("a", 0.5)] == 14_999.5


def listed(spark, n):
    return spark.range(n).select(
        F.when(F.col("id") % 11 != 0, ((F.col("id") * 7919 % 40) / 8).cast("decimal(8,4)")).alias("p"), F.when(F.col("id") % 13 != 0, F.concat(F.lit("k"), F.col("id") * 31 % 997)).alias("t"), "id"
    ).repartition(4)


@pytest.mark.parametrize("order", [["-p", "t", "id"], ["t", "-p", "-id"], ["-t", "id"]])
def test_far_places_by_composite_keys(spark, monkeypatch, order):
    monkeypatch.setattr(ranking, "_FINISH_ROWS", 500)
    monkeypatch.setattr(ranking, "_SAMPLE", 900)
    frame = listed(spark, 30_000)
    whole = [r.id for r in frame.orderBy(*ranking.sort_columns(order)).collect()]
    for start in (0, 12_345, 29_990):
        rows, before = ranking.around_places(frame, order, start, start + 20)
        inside = [r.id for r in rows.orderBy(*ranking.sort_columns(order)).collect()]
        assert inside == whole[before : before + len(inside)] and before <= start and before + len(inside) >= min(start + 20, 30_000)
        assert len(inside) < 3_000
    rows, before = ranking.around_places(frame, order, 30_000, 30_020)
    assert rows.count() == 0 and before == 30_000


def test_far_places_among_equal_keys(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_FINISH_ROWS", 100)
    rows, before = ranking.around_places(spark.range(5_000).select(F.lit("x").alias("k")), ["k"], 4_000, 4_010)
    assert (rows.count(), before) == (5_000, 0)


def test_ranges_are_narrowed_without_a_shuffle_by_group(spark, finish_rows):
    frame = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("g"), F.col("id") % 3)).alias("g"), (F.col("id") * 7919 % 3_001).cast("double").alias("v"))
    found = ranking.exact_quantiles(frame, "g", "v", [0.5])
    for g, rest in ((None, 0), ("g1", 1), ("g2", 2)):
        assert found[(g, 0.5)] == np.median([i * 7919 % 3_001 for i in range(3_000) if i % 3 == rest])
    plan = ranking._in_ranges(frame, [("g1", 0.0, 100.0)])._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
