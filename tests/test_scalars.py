import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from parcelwise.functions import scalars as S
from parcelwise.operators import money


def values(spark, schema, rows, expr):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {schema}")
    return [r["y"] for r in frame.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_risk_bucket_boundaries(spark):
    scores = [0.0, 0.2999, 0.30, 0.6999, 0.70, 1.0, None, float("nan")]
    assert values(spark, "double", scores, S.risk_bucket) == ["Low", "Low", "Medium", "Medium", "High", "High", "Low", "Low"]
    assert values(spark, "string", ["text"], lambda c: S.risk_bucket(S.to_number(c))) == ["Low"]


def test_mask_name(spark):
    names = ["John", "Doe", "Al", "X", "", None, "  ", " Mary "]
    assert values(spark, "string", names, S.mask_name) == ["J**n", "D*e", "A*", "X", "***", "***", "***", "M**y"]


def test_hashes_agree_with_hashlib(spark):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    assert values(spark, "long", [7], lambda c: S.hash_id(c, "s")) == [digest("s:7")]
    assert values(spark, "long", [7], lambda c: S.hash_id(c, "s", "", 16)) == [digest("s7")[:16]]
    long_id = "a" * 24
    assert values(spark, "string", ["7", long_id, None], S.upload_id) == [digest("7")[:32], long_id, digest("nan")[:32]]


def test_display_id_and_search_token(spark):
    assert values(spark, "string", ["ab-12.cd34ef", "", None], S.display_id) == ["ORD-AB12CD34", "ORD-UNKNOWN", "ORD-UNKNOWN"]
    assert [S.search_token(t) for t in (" ORD-Ab12 ", "ord_xy", "order")] == ["ab12", "xy", "er"]


def test_dates_and_numbers(spark):
    texts = ["1/31/2018 22:56", "2018-01-31 22:56:00", "2018-01-31", "nonsense", None]
    months = values(spark, "string", texts, lambda c: S.month_key(S.parse_order_ts(c)))
    assert months == ["2018-01", "2018-01", "2018-01", None, None]
    weekdays = values(spark, "string", texts, lambda c: S.date_parts(S.parse_order_ts(c), -1)["order_dayofweek"])
    assert weekdays == [2, 2, 2, -1, -1]
    assert values(spark, "string", ["1.5", "NaN", "x", None], S.to_number) == [1.5, None, None, None]
    assert values(spark, "string", ["x", "2"], lambda c: S.number_or(c, 9)) == [9.0, 2.0]
    assert values(spark, "double", [-1.0, 0.4, 7.0], S.clip_unit) == [0.0, 0.4, 1.0]
    assert values(spark, "int", [0, 4], lambda c: S.safe_divide(F.lit(2), c)) == [0.0, 0.5]


def test_one_hot_decode_takes_first_maximum(spark):
    frame = spark.createDataFrame([(0, 1), (0, 0), (None, 1)], "m_a int, m_b int")
    assert [r[0] for r in frame.select(S.one_hot_decode(["m_a", "m_b"], "m_")).collect()] == ["b", "a", "b"]


def test_rate_card(spark):
    rows = [("Same Day", "Oceania"), ("First Class", " Western Europe "), ("unknown", "nowhere"), (None, None)]
    frame = spark.createDataFrame(rows, "m string, r string")
    cost = [r[0] for r in frame.select(money.upgrade_cost(F.col("m"), F.col("r"))).collect()]
    assert cost == [Decimal("234.00"), Decimal("132.00"), Decimal("80.00"), Decimal("80.00")]
    modes = spark.createDataFrame([("Same Day", Decimal("180.00"))], "shipping_mode string, base_cost decimal(9,2)")
    regions = spark.createDataFrame([("Oceania ", Decimal("1.30"))], "order_region string, multiplier decimal(4,2)")
    named = frame.toDF("shipping_mode", "order_region")
    joined = money.join_rate_card(named, modes, regions).where("shipping_mode = 'Same Day'").first()
    assert joined["upgrade_cost"] == Decimal("234.00")


def test_cost_basis_looks_at_the_whole_table(spark):
    schema = "p_late decimal(8,4), shipping_mode string, order_region string, upgrade_cost decimal(12,2)"
    def costs(given, **options):
        rows = [(Decimal("0.5"), "Same Day", "x", None if g is None else Decimal(g)) for g in given]
        return sorted((r["upgrade_cost"] for r in money.complete_fields(spark.createDataFrame(rows, schema), **options).collect()), key=str)

    assert costs(["80", "80"]) == [Decimal("180.00")] * 2
    assert costs(["80", "90"], unit_cost=160) == [Decimal("160.00"), Decimal("180.00")]
    assert None in costs(["80", None])
    assert costs(["90"], cost_basis="rate_card") == [Decimal("180.00")]
    assert costs([]) == []
