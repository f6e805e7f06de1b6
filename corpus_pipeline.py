"""Documents to packed training sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import exact, langid, mixing, packing, simhash
from parcelwise.llm.common import keep


_ROW = "_row_of_stage"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, written, so that all that follows sees the same numbers."""
    return keep(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")


def _one_of_each(rows: DataFrame, groups: DataFrame, best: Column) -> DataFrame:
    """Of the numbered ``rows``, that with the least ``best`` of each of ``groups`` (row number, _group), and all without a group."""
    members = keep(rows.select(_ROW, F.col("doc_id").cast("long").alias("doc_id")).join(groups, _ROW).select("_group", _ROW, best.alias("_best")), "members")
    winners = keep(members.groupBy("_group").agg(F.min_by(_ROW, "_best").alias(_ROW)).select(_ROW), "winners")
    dropped = keep(members.select(_ROW).join(winners, _ROW, "left_anti"), "dropped")
    return rows.join(dropped, _ROW, "left_anti").drop(_ROW)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the models know; null, letterless and unlikely texts go."""
    return langid.accepted(docs, langid.train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row: that with the largest doc_id, one without an id only if no other has one."""
    rows = _numbered(docs)
    found = exact.exact_dedup(rows, id_col=_ROW).filter("group_size > 1")
    best = F.struct(F.col("doc_id").isNull(), -F.col("doc_id").cast("decimal(20,0)"), F.col(_ROW))
    return _one_of_each(rows, found.select(F.col("doc_id").alias(_ROW), F.col("keep_id").alias("_group")), best)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by at most 4 differing bits: that with the smallest doc_id, one without an id only if no other has one."""
    rows = _numbered(docs)
    found = simhash.simhash_dedup(rows, width=4, max_bits=4, id_col=_ROW)
    best = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(_ROW))
    return _one_of_each(rows, found.select(F.col("doc_id").alias(_ROW), F.col("component_id").alias("_group")), best)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document is left out, or comes up to three times."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens go in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language id", language_id),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("source mix", mix),
    ("best-fit packing", pack),
]

#: SQL cannot express the language models, the fingerprints' links or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
