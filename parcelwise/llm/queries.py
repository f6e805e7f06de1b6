"""The queries of the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import align, embeddings, exact, html, langid, lines, merkle, mixing, packing, secrets, simhash, substrings, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query()
def op1_embedding_dedup(spark, sf_dir):
    return embeddings.embedding_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.93)


@_query()
def op2_simhash_dedup(spark, sf_dir):
    return simhash.simhash_dedup(_table(spark, sf_dir, "documents"), width=4, max_bits=4)


@_query()
def op3_language_id(spark, sf_dir):
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


@_query(lines.SQL)
def op4_line_dedup(spark, sf_dir):
    kept = lines.line_dedup(_table(spark, sf_dir, "documents"), F.col("source"))
    return kept.select("doc_id", "host", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query(exact.SQL)
def op5_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


@_query()
def op6_html_extraction(spark, sf_dir):
    return html.extract_text(_table(spark, sf_dir, "pages"))


@_query()
def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query()
def op8_substring_dedup(spark, sf_dir):
    kept = substrings.substring_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query()
def op9_secret_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    dictionary = secrets.common_words(docs)
    model = secrets.train(secrets.labelled(docs, dictionary))
    found = secrets.scan(secrets.candidates(docs, dictionary), model)
    return found.select("doc_id", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "p_secret", "is_secret")


@_query(mixing.SQL)
def op10_source_mix(spark, sf_dir):
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


@_query(warc.SQL)
def op11_arc_to_warc(spark, sf_dir):
    return warc.archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query()
def op12_token_alignment(spark, sf_dir):
    return align.align(_table(spark, sf_dir, "documents"))


@_query(merkle.SQL)
def op13_merkle_manifest(spark, sf_dir):
    return merkle.tampered(_table(spark, sf_dir, "documents"))
