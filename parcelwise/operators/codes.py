"""Positions and texts as numbers, so that first values and best rows stay in hash aggregation.

Spark keeps only values of a fixed width in a hash aggregate; the first text of an order by a composite position
makes every task sort its rows instead. Here the position columns are packed into one whole number by the spans
measured in the table, texts are replaced by their place in a dictionary of checked size before the roll-up, and
turned back after it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITION = "_position"
#: entries of a dictionary; beyond, :func:`measured` gives None
MAX_TEXTS = 4096
SHORT_TEXTS = 32


@dataclass(frozen=True)
class Codes:
    """Least and greatest value of each position column, in whole units, and the sorted texts of each coded column."""

    spans: Mapping[str, tuple[int, int]]
    texts: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def places(self) -> int:
        """Number of positions: each column takes its span and one place for NULL."""
        out = 1
        for low, high in self.spans.values():
            out *= high - low + 2
        return out

    def position(self, df: DataFrame, order_by: Sequence[str], nulls_first: bool = True) -> Column:
        """One number that sorts as the columns do; a name with a leading minus sorts descending.

        A value outside its span is an error rather than a wrong order. Up to 63 bits stay a long.
        """
        parts: list[tuple[Column, int]] = []  # numbers that fit into a long, and how many values each may take
        for signed in order_by:
            name = signed.lstrip("-")
            low, high = self.spans[name]
            width, value = high - low + 2, _whole(df, name)
            place = F.lit(high) - value if signed.startswith("-") else value - F.lit(low)
            missing = 0 if nulls_first else width - 1
            outside = F.raise_error(F.lit(f"{name} lies outside its span")).cast("long")
            code = F.when(value.isNull(), F.lit(missing).cast("long")).when(value.between(low, high), place + int(nulls_first)).otherwise(outside)
            if parts and parts[-1][1] * width < 1 << 63:
                parts[-1] = (parts[-1][0] * F.lit(width).cast("long") + code, parts[-1][1] * width)
            else:
                parts.append((code, width))
        out = parts[0][0]
        for part, width in parts[1:]:
            out = (out.cast("decimal(38,0)") * F.lit(Decimal(width)) + part.cast("decimal(20,0)")).cast("decimal(38,0)")
        return out

    def encode(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Texts of the coded ones among ``columns`` replaced by their numbers; a text that the dictionary lacks is an error.

        A short dictionary is looked up in place, a longer one is broadcast: it holds at most ``MAX_TEXTS`` entries.
        """
        for name in [c for c in columns if c in self.texts]:
            texts, text = F.array(*[F.lit(t) for t in self.texts[name]]), F.col(name)
            unknown = F.raise_error(F.lit(f"{name} holds a text that its dictionary lacks")).cast("int")
            if len(self.texts[name]) <= SHORT_TEXTS:
                at = F.array_position(texts, text).cast("int")
                df = df.withColumn(name, F.when(at > 0, at - 1).when(text.isNotNull(), unknown))
                continue
            entries = df.sparkSession.range(1).select(F.posexplode(texts).alias("_code", "_text"))
            code = F.when(text.isNotNull() & F.col("_code").isNull(), unknown).otherwise(F.col("_code"))
            df = df.join(F.broadcast(entries), text == F.col("_text"), "left").withColumn(name, code).drop("_text", "_code")
        return df

    def decode(self, df: DataFrame) -> DataFrame:
        """Numbers of the coded columns turned back into texts."""
        back = {c: F.get(F.array(*[F.lit(t) for t in self.texts[c]]), F.col(c)) for c in df.columns if c in self.texts}
        return df.withColumns(back) if back else df


def _whole(df: DataFrame, name: str) -> Column:
    """A whole-number or decimal column as its unscaled long."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DecimalType):
        return (F.col(name) * F.lit(10**kind.scale)).cast("long")
    return F.col(name).cast("long")


def _packs(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.precision <= 18


def measured(
    rows: DataFrame, order_by: Sequence[str], texts: Mapping[str, DataFrame | Sequence[str]] | None = None,
    known: Mapping[str, tuple[int, int]] | None = None,
) -> Codes | None:
    """Spans of the position columns in ``rows`` and the dictionaries of ``texts``; ``known`` spans are not measured.

    ``texts`` gives for each column its values, as a list or as a frame with one column, such as the dimension
    table's. One scan of the position columns and one of each frame. None where a position column is neither a
    whole number nor a decimal of up to 18 digits, where the positions take more than 38 digits, or where a
    dictionary has more than ``MAX_TEXTS`` entries: the roll-ups then sort. Empty tables have spans of nothing.
    """
    known = dict(known or {})
    asked = [c for c in order_by if c not in known]
    if not all(_packs(rows.schema[c].dataType) for c in asked):
        return None
    if asked:
        row = rows.agg(*[f(_whole(rows, c)).alias(f"{f.__name__}_{c}") for c in asked for f in (F.min, F.max)]).first()
        known |= {c: (row[f"min_{c}"] or 0, row[f"max_{c}"] or 0) for c in asked}
    dictionaries: dict[str, tuple[str, ...]] = {}
    for name, values in (texts or {}).items():
        if isinstance(values, DataFrame):
            value = F.col(f"`{values.columns[0]}`")
            values = [r[0] for r in values.select(value).where(value.isNotNull()).distinct().limit(MAX_TEXTS + 1).collect()]
        dictionaries[name] = tuple(sorted(set(values)))
        if not 0 < len(dictionaries[name]) <= MAX_TEXTS:
            return None
    codes = Codes({c: known[c] for c in order_by}, dictionaries)
    return codes if codes.places < 10**38 else None
