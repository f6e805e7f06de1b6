"""How good the scores are: thresholds, AUC, calibration, regression errors."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.constants import DEFAULT_PENALTY, DEFAULT_UNIT_COST, HIGH_RISK, MIN_GROUP_ROWS
from parcelwise.functions.scalars import ratio
from parcelwise.operators.money import dec
from parcelwise.operators.ranking import exact_quantiles


def _confusion(pred: DataFrame, threshold) -> dict[str, Column]:
    hit, late = F.col("p_late") >= dec(threshold), F.col("true_label") == 1
    return {
        "tp": F.count_if(hit & late),
        "fp": F.count_if(hit & ~late),
        "fn": F.count_if(~hit & late),
        "tn": F.count_if(~hit & ~late),
    }


def _quality(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


def _costs(tp: Column, fp: Column, fn: Column, unit_cost, penalty) -> dict[str, Column]:
    selected = tp + fp
    return {
        "selected_count": selected,
        "upgrade_spend": (selected * dec(unit_cost)).cast("double"),
        "missed_delay_cost": (fn * dec(penalty)).cast("double"),
        "false_alarm_cost": (fp * dec(unit_cost)).cast("double"),
        "expected_cost": (fp * dec(unit_cost) + fn * dec(penalty)).cast("double"),
    }


def threshold_metrics(
    pred: DataFrame, threshold, unit_cost=DEFAULT_UNIT_COST, penalty=DEFAULT_PENALTY
) -> DataFrame:
    """Confusion matrix, quality and cost at one threshold."""
    counted = pred.agg(*[c.alias(name) for name, c in _confusion(pred, threshold).items()])
    return _finish(counted.withColumn("threshold", F.lit(float(threshold))), unit_cost, penalty)


def _finish(counted: DataFrame, unit_cost, penalty) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.withColumns({**_quality(tp, fp, fn), **_costs(tp, fp, fn, unit_cost, penalty)})


def threshold_grid(start="0.1", stop="0.9", step="0.05") -> list[Decimal]:
    first, last, width = Decimal(start), Decimal(stop), Decimal(step)
    if width <= 0 or not 0 <= first <= last <= 1:
        raise ValueError("thresholds must rise within 0..1")
    return [first + i * width for i in range(int((last - first) / width) + 1)]


def threshold_sweep(
    pred: DataFrame, thresholds: Sequence[Decimal] | None = None,
    unit_cost=DEFAULT_UNIT_COST, penalty=DEFAULT_PENALTY,
) -> DataFrame:
    """Metrics at every threshold from one scan.

    Each row falls between two neighbouring thresholds, so the table shrinks to
    one count pair per interval before anything is multiplied by the thresholds.
    """
    grid = sorted(thresholds or threshold_grid())
    interval = sum((F.col("p_late") >= F.lit(t)).cast("int") for t in grid)
    counts = pred.where("p_late is not null").groupBy(interval.alias("interval")).agg(
        F.count_if(F.col("true_label") == 1).alias("late"), F.count_if(F.col("true_label") == 0).alias("on_time")
    )
    steps = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(grid)])
    spread = counts.select("*", F.explode(steps).alias("s")).select("*", "s.*")
    reached = F.col("interval") >= F.col("i")
    counted = spread.groupBy("threshold").agg(
        F.sum(F.when(reached, F.col("late")).otherwise(0)).alias("tp"),
        F.sum(F.when(reached, F.col("on_time")).otherwise(0)).alias("fp"),
        F.sum(F.when(reached, 0).otherwise(F.col("late"))).alias("fn"),
        F.sum(F.when(reached, 0).otherwise(F.col("on_time"))).alias("tn"),
    )
    return _finish(counted, unit_cost, penalty)


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """Best F1 and lowest cost; equal rows go to the lowest threshold."""
    by_f1 = F.struct("f1", "recall", "precision", (-F.col("threshold")).alias("t"))
    by_cost = F.struct((-F.col("expected_cost")).alias("c"), (-F.col("fn")).alias("n"), (-F.col("fp")).alias("p"), (-F.col("threshold")).alias("t"))
    fields = F.struct("threshold", "precision", "recall", "f1", "tp", "fp", "fn", "tn", "expected_cost")
    best = sweep.agg(F.max_by(fields, by_f1).alias("best_f1"), F.max_by(fields, by_cost).alias("best_expected_cost"))
    pair = F.expr("stack(2, 'best_f1', best_f1, 'best_expected_cost', best_expected_cost) as (criterion, r)")
    return best.select(pair).select("criterion", "r.*")


def metrics_row(pred: DataFrame, threshold) -> DataFrame:
    """The KPI row of the model page: counts, exposure and quality in one aggregation."""
    c = _confusion(pred, threshold)
    hit = F.col("p_late") >= dec(threshold)
    label_share = ratio(F.sum(F.col("true_label").cast("long")), F.count("true_label"))
    return pred.agg(
        F.count("*").alias("total_orders"),
        F.count_if(hit).alias("high_risk_orders"),
        ratio(F.count_if(hit), F.count("*")).alias("predicted_late_rate"),
        label_share.alias("actual_late_rate"),
        F.round(F.sum(F.when(hit, F.col("expected_penalty").cast("decimal(18,4)"))), 2).cast("double").alias("expected_penalty_sum"),
        *[col.alias(name) for name, col in c.items()],
        *[col.alias(name) for name, col in _quality(c["tp"], c["fp"], c["fn"]).items()],
    )


def _histogram(df: DataFrame, groups: Sequence[str], label: str, score: str) -> DataFrame:
    # four-digit scores: at most 10,001 rows per group leave this step
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        *groups, F.round(F.col(score), 4).alias("score")
    ).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def _auc(hist: DataFrame, groups: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    big = "decimal(20,0)"
    pairs = F.sum(F.col("pos").cast(big) * (2 * F.col("neg_upto") - F.col("neg")).cast("decimal(18,0)"))
    p, n = F.sum("pos"), F.sum("neg")
    scores = F.sum(F.col("score").cast("decimal(8,4)") * (F.col("pos") + F.col("neg")).cast(big))
    return (
        hist.withColumn("neg_upto", F.sum("neg").over(w))
        .groupBy(*groups)
        .agg(
            (p + n).alias("n"),
            F.round(F.try_divide(pairs.cast("double"), 2.0 * p.cast("double") * n.cast("double")), 4).alias("auc"),
            ratio(p, p + n).alias("late_rate"),
            ratio(scores, p + n).alias("mean_p_late"),
            *extra,
        )
    )


def _one_histogram(df: DataFrame, label: str, score: str) -> DataFrame:
    return _histogram(df, [], label, score).withColumn("_all", F.lit(1))


def auc_by(df: DataFrame, groups: Sequence[str] = (), label: str = "true_label", score: str = "p_late") -> DataFrame:
    """Area under the ROC curve per group from the score histogram, ties included.

    NULL where a group holds one class only.
    """
    if groups:
        return _auc(_histogram(df, groups, label, score), groups)
    return _auc(_one_histogram(df, label, score), ["_all"]).drop("_all")


def _in_dimensions(df: DataFrame, dimensions: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per dimension value, so that several dimensions share a scan."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("group")) for d in dimensions])
    )
    return df.select(pairs.alias("_d"), *keep).select("_d.*", *keep).where(F.col("group").isNotNull())


def delay_calibration(mart: DataFrame, dimensions: Sequence[str], min_rows: int = MIN_GROUP_ROWS) -> DataFrame:
    long = _in_dimensions(mart, dimensions, ["true_label", "p_late"])
    return auc_by(long, ["dimension", "group"]).where(F.col("n") >= min_rows)


def _regression(actual: Column, predicted: Column) -> dict[str, Column]:
    a, p = actual.cast("decimal(18,4)"), predicted.cast("decimal(18,4)")
    res = (a - p).cast("decimal(18,4)")
    n = F.count("*")
    squares = F.sum(res * res).cast("double")
    spread = F.sum(a * a).cast("double") - F.sum(a).cast("double") * F.sum(a).cast("double") / n
    return {
        "n": n,
        "mae": F.round(F.sum(F.abs(res)).cast("double") / n, 2),
        "rmse": F.round(F.sqrt(squares / n), 2),
        "r2": F.when((n >= 2) & (spread > 1e-9), F.round(1 - F.try_divide(squares, spread), 4)),
        "resid_mean": F.round(F.sum(res).cast("double") / n, 2),
    }


def profit_calibration(df: DataFrame, dimensions: Sequence[str], min_rows: int = MIN_GROUP_ROWS,
                       actual: str = "profit_actual", predicted: str = "profit_pred") -> DataFrame:
    """Errors of the profit prediction per group of each dimension."""
    long = _in_dimensions(df.dropna(subset=[actual, predicted]), dimensions, [actual, predicted])
    measures = _regression(F.col(actual), F.col(predicted))
    return long.groupBy("dimension", "group").agg(*[c.alias(k) for k, c in measures.items()]).where(F.col("n") >= min_rows)


def trust_map(mart: DataFrame, profit_rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Delay and profit calibration in one table."""
    delay = delay_calibration(mart, dimensions).withColumn("kind", F.lit("delay"))
    profit = profit_calibration(profit_rows, dimensions).withColumn("kind", F.lit("profit"))
    return delay.unionByName(profit, allowMissingColumns=True)


def classifier_report(df: DataFrame, threshold=Decimal("0.5")) -> DataFrame:
    """AUC with precision, recall, F1, late rate and high-risk count, all from the score histogram."""
    hit, high = F.col("score") >= dec(threshold), F.col("score") >= F.lit(HIGH_RISK)

    def total(column: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(column)).otherwise(0))

    tp, fp, fn, tn = total("pos", hit), total("neg", hit), total("pos", ~hit), total("neg", ~hit)
    extra = {"tp": tp, "fp": fp, "fn": fn, "tn": tn, **_quality(tp, fp, fn)}
    extra["high_risk_orders"] = total("pos", high) + total("neg", high)
    report = _auc(_one_histogram(df, "true_label", "p_late"), ["_all"], [c.alias(k) for k, c in extra.items()])
    return report.withColumnRenamed("late_rate", "actual_late_rate").drop("_all", "mean_p_late")


def regression_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """RMSE, MAE, R2, mean residual and 95th percentile of the absolute residual."""
    clean = df.dropna(subset=[actual, predicted])
    absolute = clean.select(F.lit("r").alias("g"), F.abs(F.col(actual).cast("decimal(18,4)") - F.col(predicted).cast("decimal(18,4)")).alias("v"))
    p95 = exact_quantiles(absolute, "g", "v", [0.95]).get(("r", 0.95))
    measures = _regression(F.col(actual), F.col(predicted))
    return clean.agg(*[c.alias(k) for k, c in measures.items()]).withColumn(
        "residual_p95_abs", F.round(F.lit(p95).cast("double"), 4)
    )


def compare_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new model side by side: ``(metric, value)`` tables joined on the name."""
    return (
        old.select("metric", F.col("value").alias("old_value"))
        .join(new.select("metric", F.col("value").alias("new_value")), "metric", "full")
        .withColumn("difference", F.round(F.col("new_value") - F.col("old_value"), 4))
    )


def as_metric_rows(row: DataFrame, names: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    return row.select(F.expr(f"stack({len(names)}, {pairs}) as (metric, value)"))
