"""Scores of trained models for the cells of a grid."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import cells, decisions, models

FEATURES = ["a", "b b", "mode_x", "discount_rate"]


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(3)
    n = 1_500
    x = np.column_stack([r.normal(size=n), r.normal(size=n), r.integers(0, 2, n), r.integers(0, 6, n) / 20])
    y = 3 * x[:, 0] + x[:, 1] ** 2 + x[:, 2] * x[:, 0] - 4 * x[:, 3] + r.normal(size=n) / 5
    rows = pd.DataFrame(x, columns=FEATURES).assign(y=y, late=(y > 1).astype(int), i=range(n), split=np.where(np.arange(n) % 5 == 0, "val", "train"))
    return spark.createDataFrame(rows).repartition(3).cache()


def test_cells_are_scored_like_rows_of_their_own(table):
    late = models.train_late(table, FEATURES, "late", max_iter=3, max_depth=3, step=0.3)
    profit = models.train_profit(table, FEATURES, "y", max_iter=3, max_depth=3, step=0.3)
    grid = decisions.grid_cells(["x", "other"], ["0.00", "0.10", "0.25"])
    given = {seq: {"discount_rate": float(rate), "mode_x": float(mode == "x"), "mode_unknown": 1.0} for seq, mode, rate in grid}
    found = cells.scored_cells(table, ["i"], FEATURES, late, profit, given).toPandas().set_index("i")
    for seq, values in given.items():
        rows = table.withColumns({c: F.lit(v) for c, v in values.items()})
        both = models.score_profit(profit, models.score_late(late, rows, FEATURES), FEATURES).toPandas().set_index("i")
        assert ((both["profit_pred"] * 10_000).astype(int) == found[f"_profit{seq}"]).all()
        assert ((both["p_late"] * 10_000).astype(int) == found[f"_late{seq}"]).all()


def test_cells_that_cut_a_tree_alike_share_its_scores():
    tree = (0, 0.5, (1, 2.0, 1.0, 3.0), 4.0)
    assert cells.cut_down(tree, {0: 0.2}) == (1, 2.0, 1.0, 3.0) and cells.cut_down(tree, {0: 0.7}) == 4.0
    assert cells.cut_down((0, 0.5, (1, 2.0, 1.0, 3.0), (1, 2.0, 1.0, 3.0)), {}) == (1, 2.0, 1.0, 3.0)


def test_units_are_rounded_as_printed():
    values = [0.00005, -0.00005, 1.00015, 2.00025, -7.12345, 0.0, 3.14159, 12345.67895, 1e-9]
    want = [int(Decimal(repr(v)).quantize(Decimal("0.0001"), ROUND_HALF_UP) * 10_000) for v in values]
    assert cells.whole_units(np.array(values)).tolist() == want
