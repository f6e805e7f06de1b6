"""Named queries with the inventory lines they cover and their SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and flags as integers, for comparison with other engines."""
    def out(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, (T.BooleanType, T.ByteType, T.ShortType)):
            c = c.cast("int")
        return c.alias(field.name)

    return df.select(*[out(f) for f in df.schema.fields])


def query(covers: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a function under its own name; ``sql`` is the twin for another engine."""
    def register(build: Build) -> Build:
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, tuple(covers.split()), lambda s, d: plain(build(s, d)), sql)
        return build

    return register
