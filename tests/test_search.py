"""Search by a part of an id: equal to comparing all ids, with fewer files read."""

import random

import pytest
from pyspark.sql import functions as F

from parcelwise.functions.scalars import hash_id, search_token
from parcelwise.sources import search

ODD = [None, "", "-", "ORD-00ab", "ab", "a", "Ab/cd", "ab cd", "ÄB01é", "ab01ab01ab01ab01", "AB01-AB01", "01", "0", "x" * 3000 + "7q"]


def files_read(frame):
    frame.collect()
    kept = [leaf.metrics() for leaf in _leaves(frame._jdf.queryExecution().executedPlan())]
    return sum(m.apply("numFiles").value() for m in kept if m.contains("numFiles"))


def _leaves(plan):
    leaves = plan.collectLeaves()
    return [leaves.apply(i) for i in range(leaves.size())]


def found(spark, path, text, gram):
    return sorted(r.k for r in search.search_ids(spark, path, "id", text, gram).collect())


def expected(rows, text):
    token = search_token(text)
    return sorted(k for k, i in rows if not token or i is not None and token in i.lower())


@pytest.mark.parametrize("gram", [2, 3, 8])
def test_equal_to_the_scan(spark, tmp_path, gram):
    draw = random.Random(gram)
    ids = ODD * 2 + ["".join(draw.choice("ab01-") for _ in range(draw.randrange(1, 14))) for _ in range(300)] + ["hot-a1"] * 300
    rows, path = list(enumerate(ids)), str(tmp_path / "t")
    for half in (rows[::2], rows[1::2]):
        search.write_searchable(spark.createDataFrame(half, "k int, id string"), path, "id", folders=8, gram=gram)
    tokens = ["", " ORD-", "a", "0", "ab", "01a", "ORD-ab", "ab01ab01", "ab01ab01ab01ab01", "hot", "zz", "7q", "x" * 2999, "b01", "é1"]
    for text in tokens + ["".join(draw.choice("ab01") for _ in range(draw.randrange(1, 10))) for _ in range(5)]:
        assert found(spark, path, text, gram) == expected(rows, text), text


def test_reads_fewer_files(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2000).withColumn("h", hash_id(F.col("id")))
    search.write_searchable(rows, path, "h", folders=32)
    whole = files_read(search.search_ids(spark, path, "h", ""))
    wanted = rows.where("id = 77").first().h
    for token in (wanted[:8], wanted[20:40], wanted):
        hit = search.search_ids(spark, path, "h", token)
        assert [r.id for r in hit.collect()] == [77] and files_read(hit) <= 2 < whole
    assert files_read(search.search_ids(spark, path, "h", "0" * 12)) == 0


def test_nothing_stored_and_names(spark, tmp_path):
    none = spark.createDataFrame([], "id string")
    assert search.search_ids(spark, str(tmp_path / "no"), "id", "a") is None
    search.write_searchable(none, str(tmp_path / "e"), "id")
    assert search.search_ids(spark, str(tmp_path / "e"), "id", "a") is None
    with pytest.raises(ValueError):
        search.write_searchable(none.withColumn(search.FOLDER, F.lit(1)), str(tmp_path / "c"), "id")
