"""Steps on long tables: quantiles without a row per column, and what lies in files is not kept."""

import numpy as np

from parcelwise.operators import features, ranking
from parcelwise.session import stored, written


def test_quantiles_of_columns_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_COLUMN_SKETCH", 60)
    monkeypatch.setattr(ranking, "_FINISH_ROWS", 100)
    r = np.random.default_rng(5)
    n = 6_000
    values = {"smooth": r.normal(size=n), "tied": r.integers(0, 4, n).astype(float), "skewed": np.exp(r.normal(size=n) * 8)}
    rows = [(float(a), float(b) if i % 3 else None, float(c) if i % 5 else float("nan"), None) for i, (a, b, c) in enumerate(zip(*values.values()))]
    frame = spark.createDataFrame(rows, "smooth double, tied double, skewed double, empty double")
    want = {"smooth": values["smooth"], "tied": values["tied"][np.arange(n) % 3 > 0], "skewed": values["skewed"][np.arange(n) % 5 > 0]}
    probs = [0.0, 0.01, 0.5, 0.777, 1.0]
    found = features.numeric_quantiles(frame, [*want, "empty"], probs)
    assert set(found) == {(c, p) for c in want for p in probs}
    assert all(np.isclose(found[(c, p)], np.quantile(v, p), rtol=1e-12) for c, v in want.items() for p in probs)
    assert ranking.column_quantiles(frame.limit(0), ["smooth"], [0.5]) == {}


def test_written_tables_are_read_again_instead_of_kept(spark, monkeypatch):
    frame = spark.range(300).selectExpr("id % 7 as k", "id as i")
    kept = written(frame, "items")
    joined = kept.join(spark.range(5).withColumnRenamed("id", "k"), "k")
    assert stored(kept.where("k > 2").selectExpr("k + 1 as k", "i")) and not stored(joined)
    seen = []
    persist = type(frame).persist
    monkeypatch.setattr(type(frame), "persist", lambda self, *a: seen.append(1) or persist(self, *a))
    cuts = ranking.cut_points(kept, ["k", "i"], lambda n: [100])
    assert not seen and cuts == ranking.cut_points(joined.unionByName(kept.where("k > 4").select("k", "i")), ["k", "i"], lambda n: [100]) and seen
