"""Written intermediate tables and the word pattern the operators share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.session import scratch_path

#: A word: a run of anything but space and the control characters 9 to 13. ``bytes.split()`` gives the same words.
WORD = r"[^\x20\x09-\x0D]+"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and a lost executor costs only its running tasks."""
    path = scratch_path(df.sparkSession, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without_null_ids(df: DataFrame) -> DataFrame:
    """``doc_id`` as it may go through pandas, which would turn a column with nulls into doubles: 0 for null, and ``no_id``."""
    return df.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))


def with_null_ids(df: DataFrame) -> DataFrame:
    """The ids of :func:`without_null_ids` as they were."""
    return df.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def as_bytes(texts: pa.Array) -> pa.Array:
    """A text column as UTF-8 bytes, without a copy."""
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())


def n_words(text: Column) -> Column:
    """Number of words as long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
