"""Reading raw order files, uploads, predictions, marts and fitted artifacts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.constants import (
    KNOWN_UPLOAD_COLUMNS, MIN_KNOWN_COLUMNS, PROFIT_CATEGORICAL, PROFIT_NUMERIC, PROFIT_TARGET, ORDER_DATE,
    UPLOAD_ALIASES, UPLOAD_DEFAULTS,
)
from parcelwise.functions.scalars import hash_id, risk_bucket, upload_id
from parcelwise.operators.money import upload_profit

_LONGS = {
    "Order Id", "Order Item Id", "Customer Id", "Order Customer Id", "Category Id", "Department Id",
    "Product Card Id", "Product Category Id", "Order Item Cardprod Id",
}
_INTS = {"Days for shipment (scheduled)", "Days for shipping (real)", "Order Item Quantity", "Product Status"}
# read as text: files write it as 1, 1.0 or "1"
_LABEL = "Late_delivery_risk"
_DOUBLES = {
    "Sales", "Sales per customer", "Order Item Total", "Product Price", "Order Item Product Price",
    "Order Item Discount", "Order Item Discount Rate", "Order Item Profit Ratio", "Latitude", "Longitude",
    "Order Profit Per Order", "Benefit per order",
}


def raw_schema(columns: Sequence[str]) -> T.StructType:
    """Explicit types by column name; everything unknown is text. No inference pass."""
    def type_of(name: str) -> T.DataType:
        if name in _LONGS:
            return T.LongType()
        if name in _INTS:
            return T.IntegerType()
        return T.DoubleType() if name in _DOUBLES else T.StringType()

    return T.StructType([T.StructField(c, type_of(c)) for c in columns])


def csv_header(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """Column names of the files, byte-order mark removed."""
    names = spark.read.option("header", True).option("encoding", encoding).option("inferSchema", False).csv(path).columns
    return [n.lstrip("﻿") for n in names]


def read_raw_orders(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", columns: Sequence[str] | None = None) -> DataFrame:
    """Order items from CSV with explicit types; values that do not fit become NULL."""
    names = list(columns) if columns else csv_header(spark, path, encoding)
    rows = (
        spark.read.schema(raw_schema(names))
        .option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE").option("escape", '"')
        .csv(path)
    )
    return with_label(rows)


def with_label(rows: DataFrame) -> DataFrame:
    """The label of a raw file as integer."""
    return rows.withColumn(_LABEL, whole_number(F.col(_LABEL))) if _LABEL in rows.columns else rows


def whole_number(text: Column) -> Column:
    """Integer of a text such as 1, 1.0 or `` 1 ``; NULL for anything else, fractions too."""
    number = F.trim(text.cast("string")).try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def require_columns(df: DataFrame, required: Sequence[str] | None = None) -> DataFrame:
    needed = required or [*PROFIT_NUMERIC, *PROFIT_CATEGORICAL, PROFIT_TARGET, ORDER_DATE]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


# --- header gate -----------------------------------------------------------------------


_MAX_HEADER = 1 << 20


def _first_line(uri: str) -> str:
    from pyarrow import fs

    uri = uri if "://" in uri else uri.replace("file:/", "file:///", 1)
    filesystem, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    taken = b""
    with filesystem.open_input_stream(path) as stream:
        while b"\n" not in taken and len(taken) < _MAX_HEADER:
            block = stream.read(64 * 1024)
            if not block:
                break
            taken += block
    return taken.split(b"\n", 1)[0].decode("utf-8-sig", errors="replace").rstrip("\r")


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(header=[_first_line(p) for p in batch["path"]])


def upload_headers(spark: SparkSession, folder: str, whole_scan: bool = False) -> DataFrame:
    """Path and header line of every CSV below a folder.

    Only the header bytes are read, through Arrow's file systems (local, HDFS, S3,
    GCS). For any other storage ``whole_scan`` reads the files as Spark text: a
    file's first block lies in one task and is read in order, so the first line
    seen there is the header.
    """
    if whole_scan:
        lines = (
            spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder)
            .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
        )
        first = lines.where("at = 0").groupBy("path").agg(F.first("value").alias("header"))
        return first.select("path", F.regexp_replace("header", "^\ufeff", "").alias("header"))
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
        .load(folder).select("path")
    )
    return files.mapInPandas(_headers, "path string, header string")


# a quoted field, whose quotes may be doubled, or one without quotes, up to the next comma or the end
_FIELD = r'(?:^|,)[ \t]*("(?:[^"]|"")*"|[^,]*)'


def header_names(line: Column) -> Column:
    """Column names of a CSV header line; commas inside quotes belong to a name."""
    fields = F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1))
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"')
    return F.transform(fields, bare)


def gate_uploads(headers: DataFrame) -> DataFrame:
    """Known columns and duplicates per file and whether the file is accepted."""
    cleaned = headers.select("path", F.explode(F.transform(header_names(F.col("header")), lambda c: F.lower(F.trim(c)))).alias("name"))
    per_name = cleaned.groupBy("path", "name").agg(F.count("*").alias("n"))
    known = F.col("name").isin(KNOWN_UPLOAD_COLUMNS)
    return per_name.groupBy("path").agg(
        F.sum("n").alias("total_columns"),
        F.count_if(known).alias("matched_known_columns"),
        F.count_if(F.col("n") > 1).alias("duplicated_columns"),
    ).withColumn(
        "accepted",
        ((F.col("duplicated_columns") == 0) & (F.col("matched_known_columns") >= MIN_KNOWN_COLUMNS)).cast("int"),
    )


def check_header(columns: Sequence[str]) -> list[str]:
    """The same rule for one table; returns the known columns or raises."""
    lowered = [c.strip().lower() for c in columns]
    repeated = sorted({c for c in lowered if lowered.count(c) > 1})
    if repeated:
        raise ValueError(f"duplicate columns: {repeated}")
    known = [c for c in lowered if c in KNOWN_UPLOAD_COLUMNS]
    if len(known) < MIN_KNOWN_COLUMNS:
        raise ValueError(f"only {len(known)} known order columns, need {MIN_KNOWN_COLUMNS}")
    return known


# --- uploads --------------------------------------------------------------------------------


def resolve_aliases(columns: Sequence[str], aliases: Mapping[str, Sequence[str]] = UPLOAD_ALIASES) -> dict[str, str]:
    """Target name -> header present in the file, any letter case, last alias wins."""
    by_lower = {c.lower(): c for c in reversed(columns)}
    found = {}
    for target, accepted in aliases.items():
        present = [by_lower[a.lower()] for a in accepted if a.lower() in by_lower]
        if present:
            found[target] = present[-1]
    return found


RAW_PREFIX = "raw "


def standardize_upload(df: DataFrame, row_id: str, features: Sequence[str] = ()) -> DataFrame:
    """Metadata columns of an upload under their common names.

    Missing texts get defaults, a missing date stays NULL. ``row_id`` numbers the
    rows and stands in for absent order ids. ``features`` are raw columns that a
    model reads, in whatever letter case the file has them: they follow as
    ``raw <name>``, NULL where the file lacks them.
    """
    found = resolve_aliases(df.columns)
    own = {c.strip().lower(): c for c in reversed(df.columns)}
    columns = {t: F.col(f"`{h}`") for t, h in found.items()}
    if "order_id_hash" in columns:
        columns["order_id_hash"] = upload_id(columns["order_id_hash"])
    else:
        columns["order_id_hash"] = hash_id(F.concat(F.lit("upload_order_"), F.col(row_id).cast("string")), length=32)
    for target in UPLOAD_ALIASES:
        if target not in columns and target != "order_item_profit_ratio":
            columns[target] = F.lit(UPLOAD_DEFAULTS.get(target)).cast("string")
    out = [c.alias(t) for t, c in columns.items()]
    if "order_item_profit_ratio" in found:
        out.append(upload_profit(columns["sales"], columns["order_item_profit_ratio"]).alias("profit_actual"))
    label = {c.lower(): c for c in df.columns}.get("late_delivery_risk")
    if label:
        out.append(whole_number(F.col(f"`{label}`")).alias("true_label"))
    if row_id in df.columns:
        out.append(F.col(row_id).alias("row_id"))
    for name in features:
        header = own.get(name.lower())
        out.append((F.col(f"`{header}`") if header else F.lit(None)).cast("string").alias(RAW_PREFIX + name))
    return df.select(*out)


# --- stored tables -----------------------------------------------------------------------------


def session_key(session_id: str) -> str:
    """``session_id`` if it may name a session: letters, digits, ``-`` and ``_``; raises on anything else."""
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,128}", session_id):
        raise ValueError(f"not a session id: {session_id!r}")
    return session_id


def read_session(spark: SparkSession, path: str, session_id: str, default: str = "default") -> DataFrame:
    """Predictions of a session, or the default set if the session has none.

    The table is partitioned by session, so either filter reads one partition.
    """
    table = spark.read.parquet(path)
    own = table.where(F.col("session_id") == session_key(session_id))
    return own if own.limit(1).count() else table.where(F.col("session_id") == default)


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    """Order mart with the bucket recomputed from the score."""
    return spark.read.parquet(path).withColumn("risk_bucket", risk_bucket(F.col("p_late")))


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Fitted values kept as JSON: ``{"feature_medians": {...}}`` becomes (column, value) rows."""
    schema = "feature_medians map<string,double>, label_classes map<string,array<string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.explode("feature_medians").alias("column", "value"))


def read_label_classes(spark: SparkSession, path: str) -> DataFrame:
    schema = "feature_medians map<string,double>, label_classes map<string,array<string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    classes = raw.select(F.explode("label_classes").alias("column", "classes"))
    return classes.select("column", F.posexplode("classes").alias("code", "category"))

