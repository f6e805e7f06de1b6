"""Checks on tables: profiles, leakage, keys, schemas, splits."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.constants import (
    ID_COLUMNS, IDENTITY_CORRELATION, LOSS_SHARE_TOLERANCE, MEAN_SHIFT_TOLERANCE, PII_COLUMNS, PROFIT_LEAKAGE,
)
from parcelwise.functions.scalars import ratio
from parcelwise.operators.ranking import exact_quantiles


def abs_correlation(x: Column, y: Column) -> Column:
    """Absolute Pearson correlation over the rows that have both values, 0 for a constant column."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.abs(F.try_divide(F.covar_pop(x, y), F.when(spread > 1e-12, spread))), F.lit(0.0))


def identity_leakage(
    df: DataFrame, numeric: Sequence[str], target: str, allowed: Iterable[str] = (),
    limit: float = IDENTITY_CORRELATION,
) -> DataFrame:
    """Single columns and pair products that reproduce the target.

    One aggregation for all candidates; columns in ``allowed`` are exempt.
    """
    checked = [c for c in numeric if c not in set(allowed)]
    y = F.col(f"`{target}`").cast("double")
    number = {c: F.col(f"`{c}`").cast("double") for c in checked}
    candidates = {c: number[c] for c in checked}
    candidates.update({f"{a} x {b}": number[a] * number[b] for a, b in itertools.combinations(checked, 2)})
    row = df.agg(*[abs_correlation(expr, y).alias(f"c{i}") for i, expr in enumerate(candidates.values())])
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("candidate"), F.col(f"c{i}").alias("abs_corr"))
                for i, name in enumerate(candidates)
            ]
        )
    )
    return row.select(pairs.alias("x")).select(
        "x.candidate", F.round("x.abs_corr", 4).alias("abs_corr"), (F.col("x.abs_corr") > limit).cast("int").alias("leaks")
    )


def _profile(y: Column, ts: Column) -> list[Column]:
    n = F.count("*")
    double = y.cast("double")
    known = F.count(y)
    size = known.cast("double")
    bias = F.try_divide(F.sqrt(size * (size - 1)), size - 2)
    return [
        n.alias("n"),
        F.round(F.sum(y).cast("double") / known, 4).alias("profit_mean"),
        F.round(F.stddev_samp(double), 4).alias("profit_std"),
        ratio(F.count_if(y < 0), known).alias("neg_pct"),
        ratio(F.count_if(y == 0), known).alias("zero_pct"),
        F.round(F.skewness(double) * bias, 4).alias("skew"),
        F.date_format(F.min(ts), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max(ts), "yyyy-MM-dd").alias("date_max"),
    ]


def split_profile(df: DataFrame, target: str, ts: str, split: str = "split") -> DataFrame:
    """Distribution of the target per split and overall, medians exact."""
    target_col, ts_col = F.col(target), F.col(ts)
    labelled = df.select(
        F.explode(F.array(F.col(split), F.lit("overall"))).alias("part"), target_col.alias("y"), ts_col.alias("ts")
    )
    profile = labelled.groupBy("part").agg(*_profile(F.col("y"), F.col("ts")))
    medians = exact_quantiles(labelled, "part", "y", [0.5])
    table = df.sparkSession.createDataFrame([(g, v) for (g, _), v in medians.items()], "part string, m double")
    return profile.join(table, "part", "left").withColumn("profit_median", F.round("m", 4)).drop("m")


def balance_warnings(profile: DataFrame) -> DataFrame:
    """Splits whose loss share or mean profit is far from the whole table's."""
    overall = profile.where("part = 'overall'").select(F.struct("neg_pct", "profit_mean").alias("o")).scalar()
    scale = F.when(F.col("o.profit_mean") == 0, F.lit(1.0)).otherwise(F.abs("o.profit_mean"))
    return profile.where("part <> 'overall'").withColumn("o", overall).select(
        "part",
        (F.abs(F.col("neg_pct") - F.col("o.neg_pct")) > LOSS_SHARE_TOLERANCE).cast("int").alias("loss_share_off"),
        (F.abs(F.col("profit_mean") - F.col("o.profit_mean")) / scale > MEAN_SHIFT_TOLERANCE).cast("int").alias("mean_off"),
    )


def split_integrity(df: DataFrame, ts: str, split: str = "split") -> DataFrame:
    """Sizes and date range per split, with the checks on order in time."""
    parts = df.groupBy(F.col(split).alias("part")).agg(
        F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )
    rank = {"train": 0, "val": 1, "test": 2}
    ranked = parts.withColumn("rank", F.coalesce(*[F.when(F.col("part") == p, F.lit(r)) for p, r in rank.items()]))
    earlier = ranked.select((F.col("rank") + 1).alias("rank"), F.col("last_ts").alias("previous_last"))
    return (
        ranked.join(earlier, "rank", "left")
        .withColumn("in_order", F.coalesce((F.col("previous_last") <= F.col("first_ts")).cast("int"), F.lit(1)))
        .drop("rank", "previous_last")
    )


def table_audit(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """NULL count, type and uniqueness of the key, one row per column."""
    types = dict(df.dtypes)
    numeric = ("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")
    # duplicates by two-step counting: no task holds all keys
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d"))
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("nulls"),
                F.lit(int(types[c].startswith(numeric))).alias("is_numeric"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return row.select(F.explode(entries).alias("x"), repeated.scalar().alias("duplicate_keys")).select("x.*", "duplicate_keys")


def column_difference(expected: Sequence[str], actual: Sequence[str], blocked: Iterable[str] = ()) -> dict[str, list[str]]:
    """Missing, extra and blocked names, and whether the order agrees."""
    return {
        "missing": sorted(set(expected) - set(actual)),
        "extra": sorted(set(actual) - set(expected)),
        "blocked": sorted(set(blocked) & set(actual)),
        "reordered": [] if list(expected) == list(actual) or set(expected) != set(actual) else list(actual),
    }


def contract_audit(spark, contracts: Mapping[str, Sequence[str]], blocked: Iterable[str]) -> DataFrame:
    """Feature lists of manifest, artifacts and model compared: PASS only if equal and clean."""
    names = list(contracts)
    first = contracts[names[0]]
    rows = []
    for name in names:
        diff = column_difference(first, contracts[name], blocked)
        rows.append(
            (
                name, len(contracts[name]), diff["missing"], diff["extra"], diff["blocked"],
                "PASS" if not any(diff.values()) and contracts[name] else "FAIL",
            )
        )
    schema = "source string, feature_count int, missing array<string>, extra array<string>, blocked array<string>, status string"
    return spark.createDataFrame(rows, schema)


def stored_contract_audit(contracts: DataFrame, blocked: Iterable[str], first: str = "manifest") -> DataFrame:
    """Stored feature lists (run, part, position, feature) compared with their run's ``first`` part, one row per list.

    PASS only if a list has the same names in the same order as the first and none that must not be a feature;
    a run without a first part fails. Lists are feature names of a model, which fit into a row.
    """
    lists = contracts.groupBy("run", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "feature"))), lambda x: x["feature"]).alias("own"))
    wanted = lists.where(F.col("part") == first).select("run", F.col("own").alias("wanted"))
    both = lists.join(wanted, "run", "left").withColumn("wanted", F.coalesce("wanted", F.expr("array()")))
    diff = both.select(
        "run", "part", F.size("own").alias("feature_count"), F.array_sort(F.array_except("wanted", "own")).alias("missing"),
        F.array_sort(F.array_except("own", "wanted")).alias("extra"),
        F.array_sort(F.array_intersect("own", F.array(*[F.lit(c) for c in dict.fromkeys(blocked)]))).alias("blocked"),
        (F.array_sort("own") == F.array_sort("wanted")).alias("_same"), (F.col("own") == F.col("wanted")).alias("_ordered"),
    )
    clean = (F.size("blocked") == 0) & F.col("_ordered")
    return diff.withColumn("reordered", (F.col("_same") & ~F.col("_ordered")).cast("int")).withColumn("status", F.when(clean, "PASS").otherwise("FAIL")).drop("_same", "_ordered")


def leakage_gate(df: DataFrame, features: Sequence[str], numeric: Sequence[str], target: str, allowed: Iterable[str]) -> DataFrame:
    """One row: names that must not be features, columns that reproduce the target, verdict."""
    blocked = column_difference(features, features, PROFIT_LEAKAGE + PII_COLUMNS + ID_COLUMNS)["blocked"]
    found = identity_leakage(df, numeric, target, allowed)
    return found.agg(
        F.lit(len(features)).alias("feature_count"),
        F.lit(len(blocked)).alias("blocked_features"),
        F.count_if(F.col("leaks") == 1).alias("identity_leaks"),
        F.when((F.count_if(F.col("leaks") == 1) > 0) | F.lit(bool(blocked)), F.lit("FAIL")).otherwise(F.lit("PASS")).alias("gate_status"),
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    ordered = counted.orderBy(F.desc("count"), "value")
    return ordered.limit(top) if top else ordered


def describe_number(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, spread, extremes and quartiles of a column."""
    long = df.select(F.lit("x").alias("g"), F.col(column).cast("double").alias("v"))
    q = exact_quantiles(long, "g", "v", [0.25, 0.5, 0.75])
    value = F.col(column)
    return df.agg(
        F.count(value).alias("count"),
        F.round(F.sum(value).cast("double") / F.count(value), 4).alias("mean"),
        F.round(F.stddev_samp(value.cast("double")), 4).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    ).withColumns({f"p{int(p * 100)}": F.round(F.lit(v).cast("double"), 4) for (_, p), v in q.items()})
