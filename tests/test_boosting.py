"""Models over tables too long for Spark ML's trainer."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from parcelwise.operators import boosting, models
from parcelwise.session import scratch_path

FEATURES = ["a", "b b", "mode_x", "discount_rate"]


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(3)
    n = 1_500
    x = np.column_stack([r.normal(size=n), r.normal(size=n), r.integers(0, 2, n), r.integers(0, 6, n) / 20])
    y = 3 * x[:, 0] + x[:, 1] ** 2 + x[:, 2] * x[:, 0] - 4 * x[:, 3] + r.normal(size=n) / 5
    rows = pd.DataFrame(x, columns=FEATURES).assign(y=y, late=(y > 1).astype(int), i=range(n), split=np.where(np.arange(n) % 5 == 0, "val", "train"))
    return spark.createDataFrame(rows).repartition(3).cache()


def trainer(kind, **options):
    return kind(
        featuresCol="features", labelCol="label", validationIndicatorCol="is_val", maxIter=3, maxDepth=3, stepSize=0.3, seed=42, subsamplingRate=1.0, minInstancesPerNode=20, **options
    )


def predicted(model, table):
    return np.array([r[0] for r in model.transform(models.assemble(table, FEATURES)).orderBy("i").select("prediction").collect()])


def test_binned_trees_are_those_of_spark_ml(table):
    made = trainer(GBTRegressor)
    theirs = models._fitted(made, table, FEATURES, "y", "split")
    ours = boosting.fit(made, table, FEATURES, F.col("y"), F.col("split") == "val")
    assert np.allclose(predicted(ours, table), predicted(theirs, table), atol=1e-9)
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray())


def test_weighted_binned_classes_are_those_of_spark_ml(table):
    made, weight = trainer(GBTClassifier, weightCol="weight"), F.when(F.col("late") == 1, F.lit(1.7)).otherwise(F.lit(1.0))
    theirs = models._fitted(made, table, FEATURES, "late", "split", weight)
    ours = boosting.fit(made, table, FEATURES, F.col("late"), F.col("split") == "val", weight)
    scores = [[float(r[0]) for r in models.score_late(m, table, FEATURES).orderBy("i").select("p_late").collect()] for m in (ours, theirs)]
    assert np.allclose(*scores, atol=1e-4) and ours.getNumTrees == theirs.getNumTrees


def test_long_tables_are_binned(spark, table, monkeypatch):
    monkeypatch.setattr(models, "OBJECT_ROWS", 1_000)
    seen, fit = [], boosting.fit
    monkeypatch.setattr(models.boosting, "fit", lambda *args: seen.append(args) or fit(*args))
    model = models.train_profit(table, FEATURES, "y", max_iter=3, max_depth=3, step=0.5)
    scored = models.score_profit(model, table, FEATURES).select("y", F.col("profit_pred").cast("double")).toPandas()
    assert len(seen) == 1 and np.corrcoef(scored["y"], scored["profit_pred"])[0, 1] > 0.8
    root = scratch_path(spark, "").removeprefix("file:")
    assert not any(f.startswith("bins-") for f in os.listdir(root))


def test_missing_labels_are_refused(table):
    with pytest.raises(ValueError, match="1 labels"):
        boosting.fit(trainer(GBTRegressor), table.withColumn("y", F.when(F.col("i") != 7, F.col("y"))), FEATURES, F.col("y"), F.col("split") == "val")
