"""Roll-ups in hash aggregation: positions and texts as numbers."""

import pytest

from parcelwise.operators import decisions, mart
from parcelwise.operators.codes import MAX_TEXTS, SHORT_TEXTS, Codes, measured
from parcelwise.plans.registry import QUERIES
from test_plans import SF, plan_of

ROWS = [
    (1, 2, 7, "b", None, "0.5000"), (1, 1, 9, None, "y", "0.5000"), (1, 1, 3, None, None, None),
    (2, None, 5, "c", "x", "0.2000"), (2, 0, 0, "a", "z", "0.9000"), (3, 1, 1, None, None, None),
]


def rows(spark, n=1):
    frame = spark.createDataFrame(ROWS * n, "o int, line int, part long, mode string, region string, p string")
    return frame.selectExpr("o", "line", "part", "mode", "region", "cast(p as decimal(8,4)) p_late")


def firsts(frame, codes):
    grouped, first, finish = mart.first_values(frame, ("mode", "region"), ["line", "part"], codes)
    return sorted(map(tuple, finish(grouped.groupBy("o").agg(*first)).collect()))


@pytest.mark.parametrize("known", [{}, {"line": (0, 10**9), "part": (0, 10**17)}])
def test_first_values_equal_those_of_the_sort(spark, known):
    frame = rows(spark, 3)
    codes = measured(frame, ["line", "part"], {"mode": frame.select("mode"), "region": ["x", "y", "z", *map(str, range(SHORT_TEXTS))]}, known)
    assert firsts(frame, codes) == firsts(frame, None) == [(1, "b", "y"), (2, "c", "x"), (3, None, None)]


def test_riskiest_item_equals_that_of_the_sort(spark):
    frame = rows(spark)
    codes = measured(frame, ["p_late", "line", "part"], {"mode": frame.select("mode"), "region": frame.select("region")})
    both = [sorted(map(repr, decisions.riskiest_item(frame, "o", ["line", "part"], c).select("o", "line", "part", "mode", "region", "p_late").collect())) for c in (codes, None)]
    assert both[0] == both[1] and len(both[0]) == 3


def test_positions_sort_as_their_columns_do(spark):
    frame = rows(spark)
    for nulls_first, spans in ((True, {"line": (0, 2), "part": (0, 9)}), (False, {"line": (0, 10**12), "part": (0, 10**12)})):
        codes = Codes(spans)
        got = [r[0] for r in frame.select("line", "part", codes.position(frame, ["line", "-part"], nulls_first).alias("p")).orderBy("p").select("line").collect()]
        lines = sorted((r[1] for r in ROWS if r[1] is not None))
        assert got == ([None, *lines] if nulls_first else [*lines, None])


def test_what_the_numbers_cannot_hold(spark):
    frame = rows(spark)
    assert measured(frame, ["mode"]) is None  # a text is no position
    assert measured(frame, ["line", "part"], known={"line": (0, 10**20), "part": (0, 10**19)}) is None
    assert measured(frame, ["line"], {"mode": [str(i) for i in range(MAX_TEXTS + 1)]}) is None
    assert measured(frame.limit(0), ["line"]).spans == {"line": (0, 0)}
    with pytest.raises(Exception, match="outside its span"):
        firsts(frame, Codes({"line": (0, 1), "part": (0, 9)}))
    with pytest.raises(Exception, match="dictionary lacks"):
        firsts(frame, Codes({"line": (0, 2), "part": (0, 9)}, {"mode": ("a", "b")}))


@pytest.mark.parametrize("name", ["roi_by_segment", "order_rollup_delay", "order_rollup_profit", "decision_mart_joined", "riskiest_items", "profit_rows_with_dimensions"])
def test_no_sort_below_the_roll_up(spark, name):
    assert "SortAggregate" not in plan_of(QUERIES[name].build(spark, SF))
