from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import audits, evaluation, explain, mart, reports
from parcelwise.operators.money import session_scope, with_value_risk

ITEMS = (
    "order_id long, line int, p_late decimal(8,4), true_label int, profit_actual decimal(18,4), profit_pred decimal(18,4), "
    "discount_rate decimal(8,4), customer_segment string, upgrade_cost decimal(12,2)"
)


def items(spark):
    rows = [
        (1, 1, D("0.9"), 1, D("100"), D("90"), D("0.1"), None, D("80")),
        (1, 2, D("0.7"), 0, D("50"), D("60"), D("0.2"), "B", D("90")),
        (2, 1, D("0.1"), 0, D("40"), D("40"), D("0"), "A", D("80")),
        (None, 1, D("0.1"), 0, D("7"), D("7"), D("0"), "A", D("80")),
    ]
    return spark.createDataFrame(rows, ITEMS)


def test_order_rollup_and_false_positive(spark):
    full = mart.decision_mart_single(items(spark), "order_id", ["line"], dims=["customer_segment"])
    one, two = full.orderBy("order_id").collect()
    assert full.count() == 2
    assert (one["p_late"], one["true_label"], one["profit_actual"], one["customer_segment"]) == (D("0.8"), 1, D("150"), "B")
    assert (one["net_of_service"], one["is_false_positive_value"], one["risk_bucket"]) == (D("-100"), 1, "High")
    assert (two["net_of_service"], two["is_false_positive_value"], two["risk_bucket"]) == (D("40"), 0, "Low")


def test_penalty_zero_leaves_book_profit(spark):
    full = mart.decision_mart_single(items(spark), "order_id", ["line"], dims=["customer_segment"])
    row = reports.roi_totals(full, 0).first()
    assert row["book_profit_total"] == row["net_of_service_total"] and row["service_erosion_total"] == 0.0


def test_joined_mart_drops_orders_without_items(spark):
    pred = items(spark).withColumns({c: F.lit("x") for c in ("shipping_mode", "order_region")}).withColumn("order_ts", F.current_timestamp())
    side = items(spark).withColumn("customer_id", F.lit(5)).withColumn("category_name", F.lit("c")).where("order_id = 1")
    full = mart.decision_mart(pred, side, "order_id", ["line"])
    assert [r["order_id"] for r in full.collect()] == [1]
    assert [r["order_id"] for r in mart.orders_missing(pred.where("order_id is not null"), side, "order_id").collect()] == [2]


def test_unlabelled_session(spark):
    rows = [("a", D("0.91"), 100.0, 1), ("b", D("0.22"), -20.0, None)]
    pred = spark.createDataFrame(rows, "order_id_hash string, p_late decimal(8,4), profit_pred double, true_label int")
    scored = mart.session_rows(pred.withColumn("row", F.lit(0)), "row")
    assert not mart.fully_labelled(pred)
    full, scope = mart.session_mart(scored, ["row"], mart.fully_labelled(pred))
    total = reports.roi_totals(full, 250, scope).first()
    assert total["service_erosion_total"] == 282.5
    assert total["false_positive_value_orders"] == 0 and total["false_positive_value_pct"] == 0.0
    assert scope.delay_cost_basis == "expected_probability" and scope.profit_basis == "predicted_profit"


def test_labelled_session_and_blank_ids(spark):
    rows = [("", D("1.7"), D("100"), 1, 1), (" ", None, D("50"), 0, 2), ("k", D("0.4"), D("9"), 0, 3)]
    pred = spark.createDataFrame(rows, "order_id_hash string, p_late decimal(8,4), profit_pred decimal(18,4), true_label int, row int")
    full, scope = mart.session_mart(mart.session_rows(pred, "row"), ["row"], mart.fully_labelled(pred))
    assert full.count() == 3 and scope.labelled
    scores = sorted(r["p_late"] for r in full.collect())
    assert scores == [D("0"), D("0.4"), D("1")]


def test_value_axes(spark):
    full = mart.decision_mart_single(items(spark), "order_id", ["line"], dims=["customer_segment"])
    labelled = with_value_risk(full, "book_profit", "true_label").orderBy("order_id").first()
    assert (labelled["value"], labelled["risk"]) == (D("150"), D("1"))
    unlabelled = with_value_risk(full, "net_of_service", "true_label", 250, session_scope(False)).orderBy("order_id").first()
    assert unlabelled["risk"] == D("0.8") and unlabelled["is_false_positive_value"] == 0


def test_sweep_equals_single_thresholds(spark):
    rows = [(D(i) / 100, int(i * 7 % 10 > 4)) for i in range(100)] * 3
    pred = spark.createDataFrame(rows, "p_late decimal(8,4), true_label int")
    sweep = {r["threshold"]: r for r in evaluation.threshold_sweep(pred).collect()}
    assert len(sweep) == 17
    for t in ("0.1", "0.5", "0.55", "0.9"):
        one = evaluation.threshold_metrics(pred, t).first()
        assert all(one[c] == sweep[float(t)][c] for c in one.asDict())
    with pytest.raises(ValueError):
        evaluation.threshold_grid("0.5", "0.4")


def test_auc_with_ties_and_single_class(spark):
    rows = [("g", D("0.1"), 0), ("g", D("0.4"), 0), ("g", D("0.4"), 1), ("g", D("0.8"), 1), ("h", D("0.3"), 1)]
    found = {r["k"]: r["auc"] for r in evaluation.auc_by(spark.createDataFrame(rows, "k string, p_late decimal(8,4), true_label int"), ["k"]).collect()}
    assert found == {"g": 0.875, "h": None}


def test_no_errors_without_labels(spark):
    pred = spark.createDataFrame([(D("0.9"),)], "p_late decimal(8,4)")
    assert reports.error_rows(pred, "0.5").count() == 0


def test_pages(spark):
    frame = spark.range(95).withColumn("v", F.col("id") * 7 % 10)
    order = ["-v", "id"]
    rows = reports.page(frame, order, 2, 10).collect()
    assert [r["row_number"] for r in rows] == list(range(11, 21))
    last = reports.clamped_page(frame, order, 99, 10).collect()
    far = reports.clamped_page(frame, order, 10**7, 10).collect()
    assert sorted(r["row_number"] for r in last) == sorted(r["row_number"] for r in far) == list(range(91, 96))
    middle = reports.clamped_page(frame, order, 3, 10).collect()
    assert sorted(r["row_number"] for r in middle) == list(range(21, 31))


def test_batches_of_small_tables(spark):
    sizes = [r["count"] for r in reports.with_batches(spark.range(30), ["id"]).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [3] * 10
    assert {r["batch"] for r in reports.with_batches(spark.range(2), ["id"]).collect()} == {1, 2}
    assert reports.with_batches(spark.range(0), ["id"]).count() == 0


def test_short_series_are_left_out(spark):
    rows = [("a", "2020-01", D("3"), 0), ("a", "2020-02", D("2"), 1), ("a", "2020-03", D("1"), 2), ("b", "2020-01", D("9"), 0)]
    series = spark.createDataFrame(rows, "group string, month string, net_of_service decimal(18,4), month_index int")
    trend = reports.deterioration_trend(series).collect()
    assert [(r["group"], r["trend_slope"], r["last_net_of_service"], r["forecast_next"]) for r in trend] == [("a", -1.0, 1.0, 0.0)]
    assert reports.dense_series(series).where("net_of_service is null").count() == 2


def test_leakage_guard(spark):
    rows = [(float(a), float(b), float(a * b), 5.0) for a, b in [(1, 9), (4, 2), (7, 8), (3, 3), (9, 1), (2, 6), (8, 5)]]
    frame = spark.createDataFrame(rows, "a double, b double, y double, c double")
    leaks = {r["candidate"] for r in audits.identity_leakage(frame, ["a", "b", "c"], "y").where("leaks = 1").collect()}
    assert leaks == {"a x b"}
    assert audits.identity_leakage(frame, ["a", "b", "c"], "y", ["b"]).where("leaks = 1").count() == 0
    twin = frame.withColumn("t", F.col("y") * 2)
    assert audits.identity_leakage(twin, ["t"], "y").first()["leaks"] == 1


def test_contract_audit(spark):
    audit = {r["source"]: r for r in audits.contract_audit(spark, {"m": ["a", "b"], "x": ["b", "a"], "y": ["a", "Order Id"]}, ["Order Id"]).collect()}
    assert [audit[k]["status"] for k in ("m", "x", "y")] == ["PASS", "FAIL", "FAIL"]
    assert audit["y"]["blocked"] == ["Order Id"]


def test_factors(spark):
    importances = {"Shipping Mode_Standard Class": 0.3, "Days for shipment (scheduled)": 0.2, "Order Region_encoded": 0.1}
    rows = [
        (1, "Second Class", "South Asia", D("0.9"), "High", D("225"), D("80")), (2, "Standard Class", "Canada ", D("0.2"), "Low", D("50"), D("50")),
    ]
    pred = spark.createDataFrame(
        rows, "order_id int, shipping_mode string, order_region string, p_late decimal(8,4), risk_bucket string, expected_penalty decimal(12,2), upgrade_cost decimal(12,2)"
    )
    one, two = explain.explain_orders(pred, pred, importances).orderBy("order_id").collect()
    assert [(f["label"], f["order_specific"]) for f in one["factors"]] == [("promised days", 0), ("destination region", 1), ("shipping mode", 1)]
    assert one["factors"][1]["evidence"] == "South Asia mean late probability 90%"
    assert [f["label"] for f in two["factors"]] == ["shipping mode", "promised days", "destination region"]
    assert one["recommended_action"] == "upgrade and dispatch first" and two["recommended_action"] == "keep current shipping and monitor"
    other = explain.with_region_mean(pred.limit(1).withColumn("order_region", F.lit("Nowhere")), pred).first()
    assert other["region_mean"] == 0.55
