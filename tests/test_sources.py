import json

import pytest
from pyspark.sql import functions as F

from parcelwise.constants import LABEL
from parcelwise.operators import audits, features, models, privacy
from parcelwise.operators import mart
from parcelwise.sources import readers, store
from parcelwise.streaming import uploads


def test_header_gate_of_a_table():
    good = ["Order Id", "Shipping Mode", "Order Region", "Late_delivery_risk", "other"]
    assert len(readers.check_header(good)) == 4
    for bad in ([*good, "order id "], ["foo", "bar", "baz"]):
        with pytest.raises(ValueError):
            readers.check_header(bad)


@pytest.mark.parametrize("whole_scan", [False, True])
def test_header_gate_of_a_folder(spark, tmp_path, whole_scan):
    texts = {
        "a.csv": "﻿Order Id,Shipping Mode,Order Region\n1,x,y\n", "b.csv": "Order Id,Type,Type,Market\n1,2,3,4\n", "c.csv": "foo,bar\n1,2\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    gated = readers.gate_uploads(readers.upload_headers(spark, str(tmp_path), whole_scan)).collect()
    assert {r["path"][-5:]: r["accepted"] for r in gated} == {"a.csv": 1, "b.csv": 0, "c.csv": 0}


def test_csv_header_without_byte_order_mark(spark, tmp_path):
    (tmp_path / "o.csv").write_text("﻿Type,Order Id,Sales\nCASH,7,abc\n", encoding="utf-8")
    assert readers.csv_header(spark, str(tmp_path)) == ["Type", "Order Id", "Sales"]
    row = readers.read_raw_orders(spark, str(tmp_path), "UTF-8").first()
    assert (row["Type"], row["Order Id"], row["Sales"]) == ("CASH", 7, None)
    with pytest.raises(ValueError, match="Market"):
        readers.require_columns(readers.read_raw_orders(spark, str(tmp_path)), ["Type", "Market"])


def test_latin1_text(spark, tmp_path):
    (tmp_path / "o.csv").write_bytes("Customer City,Order Id\nMálaga,1\n".encode("latin-1"))
    assert readers.read_raw_orders(spark, str(tmp_path)).first()["Customer City"] == "Málaga"


def test_aliases_and_defaults(spark):
    assert readers.resolve_aliases(["SALES", "order item total", "x"]) == {"sales": "order item total"}
    upload = spark.createDataFrame([(0, "10", "0.5"), (1, "x", "0.5")], "row int, Sales string, `order item profit ratio` string")
    first, second = readers.standardize_upload(upload, "row").orderBy("row_id").collect()
    assert (first["shipping_mode"], first["order_region"], first["order_date"], first["market"]) == ("Standard Class", "Western Europe", None, "Unknown")
    assert float(first["profit_actual"]) == 5.0 and second["profit_actual"] is None
    assert len(first["order_id_hash"]) == 32 and first["order_id_hash"] != second["order_id_hash"]


def batch(spark, start, n):
    return spark.range(start, start + n).select(
        F.col("id").alias("Order Id"), F.lit("Same Day").alias("Shipping Mode"), F.lit("Canada").alias("Order Region"),
        F.lit(1).alias(LABEL), F.lit(2.5).alias("Order Profit Per Order"), F.lit("a@b").alias("Customer Email"),
    )


def test_append_and_union_counts(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.append_known_results(batch(spark, 0, 5), path) == {"added": 5, "total": 5}
    assert store.append_known_results(batch(spark, 5, 3), path) == {"added": 3, "total": 8}
    kept = spark.read.parquet(path)
    assert "Customer Email" not in kept.columns
    both = store.combined_training(batch(spark, 100, 10), kept)
    assert both.count() == 18 and both.where("`Customer Email` is null").count() == 8
    for missing in (LABEL, "Order Profit Per Order"):
        with pytest.raises(ValueError):
            store.append_known_results(batch(spark, 0, 1).drop(missing), path)


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "pred")
    for name, n in (("default", 3), ("s1", 2), ("s2", 4), ("s1", 5)):
        store.write_predictions(spark.range(n), path, name)
    assert [readers.read_session(spark, path, s).count() for s in ("s1", "s2", "none")] == [5, 4, 3]
    store.reset_session(spark, path, "s1")
    assert [readers.read_session(spark, path, s).count() for s in ("s1", "s2")] == [3, 4]


def test_known_results_stream(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    columns = batch(spark, 0, 1).columns
    batch(spark, 0, 4).write.option("header", True).csv(folder)
    uploads.append_stream(uploads.known_results_stream(spark, folder, columns), out, check).awaitTermination(60)
    batch(spark, 4, 2).write.mode("append").option("header", True).csv(folder)
    uploads.append_stream(uploads.known_results_stream(spark, folder, columns), out, check).awaitTermination(60)
    stored = spark.read.parquet(out)
    assert stored.count() == 6 and "Customer Email" not in stored.columns


def test_flags_and_artifacts(spark, tmp_path):
    flags = spark.createDataFrame([("2020-01", "storm", 1), ("2020-02", "strike", 1)], "month string, kind string, flagged_at int")
    changed = store.upsert_flags(flags, spark.createDataFrame([("2020-01", "fair", 2)], flags.schema))
    assert {(r["month"], r["kind"]) for r in changed.collect()} == {("2020-01", "fair"), ("2020-02", "strike")}
    (tmp_path / "a.json").write_text(json.dumps({"feature_medians": {"q": 2.0}, "label_classes": {"r": ["A", "B"]}}, indent=1))
    assert readers.read_artifacts(spark, str(tmp_path / "a.json")).first()["value"] == 2.0
    classes = readers.read_label_classes(spark, str(tmp_path / "a.json")).collect()
    assert {(r["column"], r["code"], r["category"]) for r in classes} == {("r", 0, "A"), ("r", 1, "B")}


def test_privacy(spark):
    clean = privacy.de_identify(batch(spark, 0, 2))
    assert "Customer Email" not in clean.columns and "Order Id" not in clean.columns
    assert len(clean.first()["Order Id_hash"]) == 64
    other = privacy.hash_ids(batch(spark, 0, 1), "other").first()["Order Id_hash"]
    assert other != clean.orderBy("Order Id_hash").first()["Order Id_hash"]
    with pytest.raises(ValueError):
        privacy.drop_leakage(clean.drop(LABEL))


def profit_rows(spark):
    return spark.range(120).select(
        "id", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("id") % 3 + 1).cast("int")).alias("cat"),
        F.when(F.col("id") != 5, (F.col("id") * 1.5)).alias("num"),
        F.expr("timestamp'2020-01-01' + make_interval(0,0,0,0,cast(id as int))").alias("ts"),
    )


def test_unknown_category_and_missing_number(spark):
    train = profit_rows(spark)
    spec, codes = features.fit_features(train, ["num"], ["cat"], (), 1, 0, True, "")
    strange = train.limit(1).withColumn("cat", F.lit("NEW")).withColumn("num", F.lit(None).cast("double"))
    row = features.transform_features(strange, spec, codes, "ts").first()
    assert row["cat"] == 0 and row["num"] == pytest.approx(90.0)
    assert list(row.asDict()) == spec.columns
    assert features.transform_features(train, spec, codes, "ts").count() == 120


def test_time_split_sizes_and_order(spark):
    split = features.time_split(profit_rows(spark).limit(100), "ts", ["id"])
    parts = {r["split"]: r for r in split.groupBy("split").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()}
    assert [parts[p]["n"] for p in ("train", "val", "test")] == [70, 15, 15]
    assert parts["train"]["hi"] <= parts["val"]["lo"] <= parts["val"]["hi"] <= parts["test"]["lo"]


def test_group_split_shares(spark):
    rows = features.group_split(spark.range(20_000).withColumn("o", F.col("id") % 8000), "o")
    shares = {r["split"]: r["count"] / 20_000 for r in rows.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.7) < 0.02 and abs(shares["val"] - 0.15) < 0.02
    assert rows.groupBy("o").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_ready_table_policy(spark):
    ready = spark.createDataFrame([(1.0, 2.0)], "a double, y double")
    assert models.load_ready(ready, "y").columns == ["a", "y"]
    leaky = ready.withColumn("Benefit per order", F.lit(2.0))
    with pytest.raises(ValueError, match="forbidden"):
        models.load_ready(leaky, "y")
    assert models.load_ready(leaky, "y", "drop").columns == ["a", "y"]
    with pytest.raises(ValueError, match="numeric"):
        models.load_ready(ready.withColumn("t", F.lit("x")), "y")
    with pytest.raises(ValueError):
        models.same_features(["a"], ["b"], "val")


def test_feature_groups():
    columns = ["Shipping Mode_A", "Shipping Mode_B", "Sales", "Sales per customer", "Type_X", "Order Region_encoded"]
    assert models.resolve_features(["Shipping Mode"], columns) == ["Shipping Mode_A", "Shipping Mode_B"]
    assert models.resolve_features(["Order Region"], columns) == ["Order Region_encoded"]
    assert "Sales" in models.resolve_features(["Sales"], columns)
    assert models.resolve_features(["nothing"], columns) == []


def test_late_model_finds_a_planted_signal(spark):
    from parcelwise.operators import evaluation

    rows = spark.range(4000).select(
        F.col("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 37 % 11).cast("double").alias("b")
    ).withColumn("y", ((F.col("a") + F.col("b") > 8) != (F.col("id") % 19 == 0)).cast("int"))
    data = features.group_split(rows, "id")
    model = models.train_late(data, ["a", "b"], "y", max_iter=5, max_depth=4, step=0.3)
    scored = models.score_late(model, data.where("split = 'test'"), ["a", "b"]).withColumnRenamed("y", "true_label")
    assert evaluation.classifier_report(scored).first()["auc"] > 0.9
    assert models.importance_table(model, ["a", "b"], spark).count() == 2


def test_session_keys_stay_in_the_store(spark, tmp_path):
    path = str(tmp_path / "pred")
    spark.range(3).write.parquet(str(tmp_path / "other"))
    store.write_predictions(spark.range(2), path, "s2")
    for bad in ("s/2", "a/../../other", "..", "", "a b", "x" * 200):
        with pytest.raises(ValueError, match="session id"):
            store.write_predictions(spark.range(1), path, bad)
        with pytest.raises(ValueError, match="session id"):
            store.reset_session(spark, path, bad)
        with pytest.raises(ValueError, match="session id"):
            readers.read_session(spark, path, bad)
    store.reset_session(spark, path, "s1")
    assert spark.read.parquet(str(tmp_path / "other")).count() == 3
    assert readers.read_session(spark, path, "s2").count() == 2


def test_known_results_with_different_columns(spark, tmp_path):
    path = str(tmp_path / "known")
    store.append_known_results(batch(spark, 0, 2), path)
    wider = batch(spark, 2, 3).withColumn("Extra", F.lit(7))
    assert store.append_known_results(wider, path) == {"added": 3, "total": 5}
    assert store.read_known_results(spark, path).where("Extra = 7").count() == 3
    with pytest.raises(ValueError, match="changed their type"):
        store.append_known_results(batch(spark, 5, 1).withColumn("Extra", F.lit("x")), path)
    assert store.read_known_results(spark, str(tmp_path / "none")) is None


def test_headers_with_quoted_commas(spark):
    lines = [('"Order Id","Shipping Mode","Order Region","Note, free"', 4), ("Order Id, Shipping Mode ,Order Region", 3), ('"a ""b"", c",d,', 3), ("", 1)]
    frame = spark.createDataFrame([(str(k), line) for k, (line, _) in enumerate(lines)], "path string, header string")
    got = {r[0]: r[1] for r in frame.select("path", readers.header_names(F.col("header"))).collect()}
    assert [len(got[str(k)]) for k in range(4)] == [n for _, n in lines]
    assert got["0"][3] == "Note, free" and got["1"] == ["Order Id", "Shipping Mode", "Order Region"] and got["2"][0] == 'a "b", c'
    assert readers.gate_uploads(frame).where("path = '0'").first()["total_columns"] == 4


def test_labels_written_as_decimals(spark):
    rows = spark.createDataFrame([("1.0",), (" 0 ",), ("1",), ("x",), ("0.5",), (None,)], "t string")
    assert [r[0] for r in rows.select(readers.whole_number(F.col("t"))).collect()] == [1, 0, 1, None, None, None]


def test_newest_flag_wins_and_ties_are_decided(spark):
    kind = "month string, kind string, flagged_at long"
    stored = spark.createDataFrame([("a", "x", 1), ("b", "x", 5)], kind)
    changes = spark.createDataFrame([("a", "w", 1), ("b", "z", 4), ("c", "p", 2), ("c", "q", 2)], kind)
    got = store.upsert_flags(stored, changes).collect()
    assert sorted(tuple(r) for r in got) == [("a", "w", 1), ("b", "x", 5), ("c", "q", 2)]


def test_correlation_with_gaps(spark):
    rows = [(float(k), float(k) if k % 3 else None, float(-k) if k % 5 else None) for k in range(40)] + [(None, 1e9, 1e9)]
    found = audits.identity_leakage(spark.createDataFrame(rows, "y double, a double, b double"), ["a", "b"], "y").collect()
    assert {r["candidate"]: r["leaks"] for r in found}["a"] == 1 and {r["candidate"]: r["abs_corr"] for r in found}["b"] == 1.0


def test_outliers_of_missing_values(spark):
    frame = spark.createDataFrame([(None,), (5.0,), (50.0,)], "v double")
    assert [r[0] for r in frame.select(features.outlier_flag(F.col("v"), 0, 10)).collect()] == [0, 0, 1]


def test_joins_of_bucketed_tables_need_no_shuffle(spark, tmp_path):
    def stored(n, name):
        rows = spark.range(n).selectExpr("id % 97 as order_id", "id as line", f"id * 3 as {name}")
        return store.write_bucketed(rows, str(tmp_path / name), f"bucketed_{name}", "order_id", 8)

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = stored(5_000, "a"), stored(60, "b")
        joins = {
            "semi": mart.items_of_orders(left, right, "order_id"), "anti": mart.orders_missing(left, right, "order_id"), "rows": mart.join_rows(left, right, ["order_id", "line"]),
        }
        for df in joins.values():
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert {k: df.count() for k, df in joins.items()} == {"semi": sum(k % 97 < 60 for k in range(5_000)), "anti": 37, "rows": 60}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for name in ("a", "b"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")
