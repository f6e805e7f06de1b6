"""Steps that must grow with the input only: what is made once, and what is not shuffled."""

from pyspark.sql import functions as F

from parcelwise.operators import decisions, features, ranking, reports
from parcelwise.plans import modelling
from parcelwise.sources import search, store

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def counted(spark, n):
    """Rows that count how often they are made."""
    made = spark.sparkContext.accumulator(0)

    def row(i):
        made.add(1)
        return ((i * 7919) % n, i)

    return spark.sparkContext.parallelize(range(n), 4).map(row).toDF("k long, i long"), made


def test_the_list_is_made_once_to_find_a_far_page(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_FINISH_ROWS", 200)
    monkeypatch.setattr(ranking, "_SAMPLE", 900)
    frame, made = counted(spark, 20_000)
    rows, before = ranking.around_places(frame, ["-k", "i"], 12_000, 12_010)
    assert made.value == 20_000 and before <= 12_000 < before + rows.count()


def test_the_list_is_made_once_to_find_the_last_page(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_FINISH_ROWS", 200)
    frame, made = counted(spark, 20_001)
    last = reports.clamped_page(frame, ["k", "i"], 10**6, 100)
    assert made.value == 20_001
    assert [(r.k, r.row_number) for r in last.collect()] == [(20_000, 20_001)]


def test_dictionaries_of_unknown_size_are_broadcast(spark, monkeypatch):
    codes = spark.createDataFrame([("c", "a", 0), ("c", "b", 1)], "column string, category string, code int")
    rows = spark.range(100).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"))
    plans = [plan_of(features.encode(rows, ["c"], codes)), plan_of(features.decode(features.encode(rows, ["c"], codes).select(F.col("c_encoded").alias("c")), "c", codes))]
    assert all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
    monkeypatch.setattr(features, "BROADCAST_CODES", 1)
    assert "SortMergeJoin" in plan_of(features.encode(rows, ["c"], codes))


def test_models_read_a_written_table(spark):
    data, _ = modelling.late_table(spark, SF)
    assert all("/features-" in f for f in data.inputFiles())
    assert all("/items-" in f for f in modelling._time_split(spark, SF).inputFiles())


def test_pieces_of_ids_are_not_shuffled(spark):
    ids = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), (F.col("id") % 4).cast("int").alias(search.FOLDER))
    plan = plan_of(search._pieces(ids, 5, 4))
    assert "hashpartitioning(gram" not in plan and f"hashpartitioning({search.FOLDER}" in plan


def test_heat_table_does_not_multiply_orders(spark):
    orders = spark.createDataFrame([([{"net": n}, {"net": -n}, {"net": None}],) for n in (1, 10**17, 5, -(2**33))], "cells array<struct<net:long>>")
    cells = [(0, "Standard Class", "0.00"), (1, "Same Day", "0.00"), (2, "First Class", "0.00")]
    heat = decisions.heat_table(orders, ["Standard Class", "Same Day", "First Class"], cells)
    row = heat.first()
    assert "explode(cells" not in plan_of(heat)
    assert (row["Standard Class"], row["Same Day"], row["First Class"]) == (1.0, 0.0, 0.0)
    assert decisions.heat_table(orders.limit(0), ["Same Day"], cells).count() == 0


def test_a_large_part_is_not_written_by_one_task(spark, tmp_path):
    path = str(tmp_path / "mart")
    items = spark.range(6_000).select(
        F.col("id").alias("order_id"), F.lit(1).alias("line_no"), F.lit("0.5").cast("decimal(8,4)").alias("p_late"), F.lit("0.1").cast("decimal(5,4)").alias("discount_rate"),
        F.lit(1).alias("true_label"), F.lit("3").cast("decimal(12,2)").alias("upgrade_cost"), F.lit("1").cast("decimal(18,4)").alias("profit_actual"),
        F.lit("1").cast("decimal(18,4)").alias("profit_pred"), F.sha2(F.col("id").cast("string"), 256).alias("shipping_mode"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        store.update_mart(items, path, "a", "order_id", ["line_no"], ["shipping_mode"], parts=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "mart" / "data").glob("*/part=0/*.parquet"))) > 1
    assert store.read_updated_mart(spark, path, "order_id", ["shipping_mode"]).count() == 6_000
