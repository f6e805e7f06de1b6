"""Splits, fitted statistics and feature tables for both models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.constants import SYNONYM_GROUPS
from parcelwise.functions.scalars import date_parts, to_number
from parcelwise.operators.ranking import at_or_before, column_quantiles, cut_points, dense_index


#: entries of a dictionary that is broadcast; beyond, the join is left to Spark
BROADCAST_CODES = 100_000


def col(name: str) -> Column:
    return F.col(f"`{name}`")


# --- splits ---------------------------------------------------------------------


def group_split(df: DataFrame, key: str, train: float = 0.70, val: float = 0.15, seed: str = "42") -> DataFrame:
    """Random split in which all items of an order go to one side.

    The side follows from the order id alone, so no shuffle is needed and every
    run, also a recomputed task, gives the same answer.
    """
    if not (train > 0 and val > 0 and train + val < 1):
        raise ValueError("train and val must be positive and leave a test share")
    digest = F.sha2(F.concat(F.lit(seed + ":"), col(key).cast("string")), 256)
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10000
    return df.withColumn(
        "split",
        F.when(place < round(train * 10000), "train").when(place < round((train + val) * 10000), "val").otherwise("test"),
    )


def stratified_split(df: DataFrame, key: str, label: str, train: float = 0.70, val: float = 0.15, seed: str = "42") -> DataFrame:
    """Fall-back without order ids: the hash is taken of the row id and the label,
    so each label is cut in the same shares."""
    both = F.concat_ws("|", col(label).cast("string"), col(key).cast("string"))
    return group_split(df.withColumn("_strata", both), "_strata", train, val, seed).drop("_strata")


def time_split(
    df: DataFrame, ts: str, tie_keys: Sequence[str], train: float = 0.70, val: float = 0.15
) -> DataFrame:
    """Oldest rows to train, newest to test; sizes as round(n*share).

    Only the two border rows are looked up; the split itself is a comparison per
    row. ``tie_keys`` are integer columns that order rows of equal time.
    """
    keyed = df.withColumn("_ts", F.unix_micros(col(ts).cast("timestamp")))
    keys = ["_ts", *tie_keys]

    sides: dict[int, str] = {}

    def borders(n: int) -> list[int]:
        n_train, n_val = round(n * train), round(n * val)
        sides.update({n_train + n_val: "val"} | {n_train: "train"})
        return sorted(r for r in sides if 0 < r <= n)

    cuts = cut_points(keyed, keys, borders)
    side = F.lit("test")
    for rank in sorted(cuts, reverse=True):
        side = F.when(at_or_before(keys, cuts[rank]), F.lit(sides[rank])).otherwise(side)
    return keyed.withColumn("split", side).drop("_ts")


# --- cleaning ---------------------------------------------------------------------


def fill_synonyms(df: DataFrame, groups: Sequence[Sequence[str]] = SYNONYM_GROUPS) -> DataFrame:
    """Columns that mean the same fill each other's gaps, first named first."""
    filled: dict[str, Column] = {}
    for names in groups:
        present = [c for c in names if c in df.columns]
        if len(present) > 1:
            base = F.coalesce(*[col(c) for c in present])
            filled.update({c: F.coalesce(col(c), base) for c in present})
    return df.withColumns(filled) if filled else df


def align(df: DataFrame, contract: Sequence[str]) -> DataFrame:
    """Exactly the contract's columns in its order; what is missing becomes 0."""
    return df.select(
        *[
            (F.coalesce(col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c)
            for c in contract
        ]
    )


# --- fitted statistics ---------------------------------------------------------------


def category_codes(df: DataFrame, columns: Sequence[str], start: int = 0) -> DataFrame:
    """Long table ``(column, category, code)``, codes in code-point order."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("category")) for c in columns])
    )
    distinct = df.select(pairs.alias("x")).select("x.*").where("category is not null").distinct()
    return dense_index(distinct, "column", "category", "code", start)


def numeric_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[tuple[str, float], float]:
    return column_quantiles(df.select(*[to_number(col(c)).alias(c) for c in columns]), columns, probs)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {c: v for (c, _), v in numeric_quantiles(df, columns, [0.5]).items()}


def encode(df: DataFrame, columns: Sequence[str], codes: DataFrame, unknown: int = 0, suffix: str = "_encoded") -> DataFrame:
    """Attach the code of each category; unknown or missing becomes ``unknown``.

    One left join per column on its dictionary; the sides are distinct by
    construction and are broadcast only if their counted size allows it: Spark
    does not know it, and would sort all rows of a category in one task.
    """
    out = df
    short = _short_dictionaries(codes, columns)
    for c in columns:
        side = codes.where(F.col("column") == c).select(F.col("category").alias("_cat"), F.col("code").alias("_code"))
        side = F.broadcast(side) if c in short else side
        out = (
            out.join(side, col(c).cast("string") == F.col("_cat"), "left")
            .withColumn(c + suffix, F.coalesce("_code", F.lit(unknown)))
            .drop("_cat", "_code")
        )
    return out


def _short_dictionaries(codes: DataFrame, columns: Sequence[str]) -> set[str]:
    """The columns whose dictionary may be broadcast."""
    counted = codes.where(F.col("column").isin(list(columns))).groupBy("column").agg(F.count("*").alias("n")).collect() if columns else []
    long = {r["column"] for r in counted if r["n"] > BROADCAST_CODES}
    return set(columns) - long


def decode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Label of each code; codes without a label are shown as they are."""
    side = codes.where(F.col("column") == column).select(F.col("code").alias("_code"), F.col("category").alias("_cat"))
    side = F.broadcast(side) if _short_dictionaries(codes, [column]) else side
    return (
        df.join(side, col(column) == F.col("_code"), "left")
        .withColumn(column, F.coalesce("_cat", col(column).cast("string")))
        .drop("_code", "_cat")
    )


def one_hot_values(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values per column, one pass. Each value becomes a column of the feature table."""
    if not columns:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), col(c).cast("string").alias("v")) for c in columns]))
    distinct = df.select(pairs.alias("x")).select("x.*").where("v is not null").distinct()
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in distinct.collect():
        found[row["c"]].append(row["v"])
    return {c: sorted(values) for c, values in found.items()}


def one_hot(values: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    return {
        f"{c}_{v}": F.coalesce((col(c).cast("string") == v).cast("int"), F.lit(0)) for c, vs in values.items() for v in vs
    }


@dataclass
class FeatureSpec:
    """What a model was fitted on; everything scoring needs besides the rows."""

    numeric: list[str]
    coded: list[str]
    one_hot: dict[str, list[str]] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    date_missing: int = -1
    calendar: bool = False
    code_suffix: str = "_encoded"

    @property
    def columns(self) -> list[str]:
        dates = list(date_parts(F.lit(None).cast("timestamp"), 0, self.calendar))
        hot = [f"{c}_{v}" for c, vs in self.one_hot.items() for v in vs]
        return [*self.numeric, *hot, *[c + self.code_suffix for c in self.coded], *dates]


def fit_features(
    train: DataFrame, numeric: Sequence[str], coded: Sequence[str], hot: Sequence[str] = (),
    code_start: int = 0, date_missing: int = -1, calendar: bool = False, code_suffix: str = "_encoded",
) -> tuple[FeatureSpec, DataFrame]:
    """Medians and dictionaries from the training rows only."""
    clean = fill_synonyms(train)
    spec = FeatureSpec(
        list(numeric), list(coded), one_hot_values(clean, hot), medians(clean, numeric),
        date_missing, calendar, code_suffix,
    )
    return spec, category_codes(clean, coded, code_start)


def transform_features(df: DataFrame, spec: FeatureSpec, codes: DataFrame, ts: str, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric feature table in contract order, next to the columns in ``keep``."""
    clean = fill_synonyms(df)
    coded = encode(clean, spec.coded, codes, suffix="__code")
    made: dict[str, Column] = {
        c: F.coalesce(to_number(col(c)), F.lit(spec.medians.get(c, 0.0))) for c in spec.numeric
    }
    made.update(one_hot(spec.one_hot))
    made.update({c + spec.code_suffix: col(c + "__code") for c in spec.coded})
    made.update(date_parts(col(ts), spec.date_missing, spec.calendar))
    return coded.select(
        *[col(k).alias(f"_keep_{i}") for i, k in enumerate(keep)], *[made[c].cast("double").alias(c) for c in spec.columns]
    ).withColumnsRenamed({f"_keep_{i}": f"key_{k}" for i, k in enumerate(keep)})


def outlier_flag(value: Column, low: float, high: float) -> Column:
    """1 outside the bounds, 0 inside or missing."""
    number = value.cast("double")
    return F.coalesce(((number < low) | (number > high)).cast("int"), F.lit(0))
