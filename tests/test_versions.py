"""Versioned stores: whole versions, repeated batches, writers at the same time, contracts read from stored lists."""

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import audits, mart
from parcelwise.sources import store, versions


def rows(spark, first, n):
    return spark.range(first, first + n).select(F.col("id").alias("k"), F.lit("x").alias("v"))


def keys(df):
    return sorted(r.k for r in df.collect())


def test_append_replace_and_repeat(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read(spark, path) is None and versions.history(spark, path).count() == 0
    assert versions.commit(spark, path, "a", lambda old: rows(spark, 0, 3)) == {"version": 1, "added": 3}
    before = versions.read(spark, path)
    assert versions.commit(spark, path, "b", lambda old: rows(spark, 3, 2).withColumn("w", F.lit(1))) == {"version": 2, "added": 2}
    assert versions.commit(spark, path, "a", lambda old: rows(spark, 50, 9)) == {"version": 1, "added": 0}
    now = versions.read(spark, path)
    assert keys(now) == [0, 1, 2, 3, 4] and now.where("w is null").count() == 3
    assert versions.commit(spark, path, "c", lambda old: old.where("k > 3"), replace=True) == {"version": 3, "added": 1}
    assert keys(versions.read(spark, path)) == [4] and keys(versions.read(spark, path, 2)) == [0, 1, 2, 3, 4] and keys(before) == [0, 1, 2]
    assert versions.read(spark, path, 9) is None and sorted(r.batch for r in versions.history(spark, path).collect()) == ["a", "b", "c"]


def test_failed_write_leaves_the_version(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.commit(spark, path, "a", lambda old: rows(spark, 0, 3))
    broken = rows(spark, 0, 3).withColumn("k", F.expr("assert_true(k < 2)"))
    with pytest.raises(Exception):
        versions.commit(spark, path, "b", lambda old: broken)
    assert keys(versions.read(spark, path)) == [0, 1, 2] and versions.history(spark, path).count() == 1


def test_a_slower_writer_starts_again_on_what_the_faster_left(spark, tmp_path):
    path, seen = str(tmp_path / "t"), []
    versions.commit(spark, path, "a", lambda old: rows(spark, 0, 1))

    def slow(old):
        seen.append(old.count())
        if len(seen) == 1:
            versions.commit(spark, path, "fast", lambda _: rows(spark, 1, 1))
        return rows(spark, 2, 1)

    assert versions.commit(spark, path, "slow", slow) == {"version": 3, "added": 1}
    assert seen == [1, 2] and keys(versions.read(spark, path)) == [0, 1, 2]


def test_two_records_under_one_number(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.commit(spark, path, "a", lambda old: rows(spark, 0, 1))
    rows(spark, 5, 1).write.parquet(f"{path}/data/!")
    spark.createDataFrame([(1, "other", 1, f"{path}/data/!", [f"{path}/data/!"])], versions._RECORD).write.mode("append").json(f"{path}/commits/{1:012d}")
    assert keys(versions.read(spark, path)) == [5] and [r.batch for r in versions.history(spark, path).collect()] == ["other"]
    assert versions.commit(spark, path, "a", lambda old: rows(spark, 0, 1)) == {"version": 2, "added": 1}


def known(spark, n, profit="1.5"):
    return spark.range(n).selectExpr("id as `Order Id`", "1 as Late_delivery_risk", f"{profit} as `Order Profit Per Order`", "'a' as `Shipping Mode`", "'m' as Market", "'e' as `Customer Email`")


def test_known_results_are_stored_once_and_keep_their_types(spark, tmp_path):
    path = str(tmp_path / "k")
    assert store.append_batch(known(spark, 4), path, "monday")["added"] == 4
    assert store.append_batch(known(spark, 4), path, "monday")["added"] == 0
    with pytest.raises(ValueError, match="type"):
        store.append_batch(known(spark, 1, "'x'"), path, "tuesday")
    assert versions.read(spark, path).count() == 4 and "Customer Email" not in versions.read(spark, path).columns


def test_flags_are_updated_in_the_store(spark, tmp_path):
    path, schema = str(tmp_path / "f"), "month string, kind string, flagged_at int"
    store.store_flags(spark.createDataFrame([("2020-01", "strike", 1), ("2020-02", "storm", 1)], schema), path, "1")
    store.store_flags(spark.createDataFrame([("2020-01", "fair", 3), ("2020-03", "x", 1)], schema), path, "2")
    store.store_flags(spark.createDataFrame([("2020-01", "late news", 2)], schema), path, "3")
    assert sorted(map(tuple, versions.read(spark, path).collect())) == [("2020-01", "fair", 3), ("2020-02", "storm", 1), ("2020-03", "x", 1)]


def test_stored_contracts(spark, tmp_path):
    lists = {("r", "manifest"): "ab", ("r", "model"): "ba", ("r", "artifacts"): "a", ("s", "model"): "a", ("t", "manifest"): "aI", ("t", "model"): "aI"}
    for (run, part), names in lists.items():
        store.write_contract(spark.createDataFrame([(k, "Order Id" if c == "I" else c) for k, c in enumerate(names)], "position int, feature string"), str(tmp_path), run, part)
    got = {(r.run, r.part): r for r in audits.stored_contract_audit(store.read_contracts(spark, str(tmp_path)), ["Order Id", "Order Id"]).collect()}
    assert {k: r.status for k, r in got.items()} == {
        ("r", "manifest"): "PASS", ("r", "model"): "FAIL", ("r", "artifacts"): "FAIL", ("s", "model"): "FAIL", ("t", "manifest"): "FAIL", ("t", "model"): "FAIL"}
    assert got["r", "model"].reordered == 1 and got["r", "artifacts"].missing == ["b"] and got["s", "model"].extra == ["a"] and got["t", "model"].blocked == ["Order Id"]


def test_hydration_groups_only_wanted_orders(spark):
    orders = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "o int, w string")
    pred = spark.createDataFrame([(1, 2, "late"), (1, 1, "first"), (3, 1, "other")], "o int, line int, kind string")
    got = mart.hydrate(orders, pred, "o", ["line"])
    assert sorted(map(tuple, got.select("o", "w", "kind").collect()), key=repr) == sorted([(1, "a", "first"), (2, "b", None), (None, "c", None)], key=repr)
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_parts_that_are_not_touched_keep_their_folders(spark, tmp_path):
    path = str(tmp_path / "p")

    def add(first, n):
        def make(old):
            new = rows(spark, first, n).withColumn("part", (F.col("k") % 4).cast("int"))
            return new if old is None else old.withColumn("part", (F.col("k") % 4).cast("int")).unionByName(new)
        return make

    versions.commit(spark, path, "a", add(0, 8), part="part", only=[0, 1, 2, 3])
    assert versions.commit(spark, path, "b", add(8, 2), part="part", only=[0, 1]) == {"version": 2, "added": 6}
    first, second = (set(r.folders) for r in versions.history(spark, path).orderBy("version").collect())
    assert keys(versions.read(spark, path)) == list(range(10)) and len(first & second) == 2 and len(second) == 4
    assert keys(versions.read(spark, path, 1)) == list(range(8))


ITEMS = "order_id int, line int, p_late decimal(8,4), true_label int, upgrade_cost decimal(12,2), profit_actual decimal(18,4), profit_pred decimal(18,4), discount_rate decimal(5,4), customer_segment string, order_region string"


def test_mart_after_batches_equals_the_mart_of_all(spark, tmp_path):
    rng = random.Random(5)
    made = [
        (rng.choice([None, *range(30)]), line, D(rng.randrange(10_000)) / 10_000, rng.randrange(2), D(rng.randrange(50, 90)), D(rng.randrange(-99, 99)), D(rng.randrange(99)), D(rng.randrange(9)) / 100,
         rng.choice([None, "a", "b"]), rng.choice(["x", "y"])) for line in range(400)
    ]
    everything, path = spark.createDataFrame(made, ITEMS).repartition(3), str(tmp_path / "m")
    dims = ["customer_segment", "order_region"]
    for batch in (2, 0, 0, 1):
        store.update_mart(everything.where(F.col("line") % 3 == batch), path, f"batch {batch}", "order_id", ["line"], dims, parts=8)
    whole = mart.decision_mart_single(everything, "order_id", ["line"], dims=dims)
    got = store.read_updated_mart(spark, path, "order_id", dims)
    assert sorted(map(tuple, got.select(*whole.columns).collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    last = store.update_mart(spark.createDataFrame([(1, 900, D(0), 0, D(1), D(1), D(1), D(0), "z", "z")], ITEMS), path, "one order", "order_id", ["line"], dims, parts=8)
    folders = [set(r.folders) for r in versions.history(spark, path).orderBy("version").collect()]
    assert last["version"] == 4 and len(folders[-1] - folders[-2]) == 1
