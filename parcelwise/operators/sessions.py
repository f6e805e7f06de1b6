"""An upload from folder to stored predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions.scalars import parse_order_ts
from parcelwise.operators.features import FeatureSpec, transform_features
from parcelwise.operators.models import score_late
from parcelwise.operators.money import with_prediction_money
from parcelwise.sources import readers, store


def accepted_layouts(spark: SparkSession, folder: str) -> list[tuple[list[str], list[str]]]:
    """Header names and files of each layout that passes the gate.

    The driver holds header lines and file names, as it does for any folder it lists.
    """
    headers = readers.upload_headers(spark, folder)
    passed = readers.gate_uploads(headers).where("accepted = 1").select("path")
    layouts: dict[tuple[str, ...], list[str]] = {}
    for row in headers.join(passed, "path", "left_semi").select("path", readers.header_names(F.col("header")).alias("names")).toLocalIterator():
        layouts.setdefault(tuple(n.strip() for n in row["names"]), []).append(row["path"])
    return [(list(names), sorted(paths)) for names, paths in sorted(layouts.items())]


def late_scorer(model: GBTClassificationModel, spec: FeatureSpec, codes: DataFrame, ts: str) -> Callable[[DataFrame], DataFrame]:
    """Adds ``p_late`` by a trained model: features made as at training, gaps filled with the training medians.

    ``ts`` names the order date as the raw file writes it.
    """
    def score(rows: DataFrame) -> DataFrame:
        raw = [c for c in rows.columns if c.startswith(readers.RAW_PREFIX)]
        own = F.struct(*[c for c in rows.columns if c not in raw]).alias("_row")
        named = rows.select(own, *[F.col(f"`{c}`").alias(c.removeprefix(readers.RAW_PREFIX)) for c in raw])
        dated = named.withColumn("_ts", parse_order_ts(F.col(f"`{ts}`")))
        made = transform_features(dated, spec, codes, "_ts", keep=["_row"])
        return score_late(model, made, spec.columns).select("key__row.*", "p_late")

    return score


def score_uploads(
    spark: SparkSession, folder: str, scorer: Callable[[DataFrame], DataFrame], store_path: str, session_id: str,
    penalty=250, features: Sequence[str] = (),
) -> int:
    """Gate, standardise, score and store every accepted file; returns the number of layouts.

    ``scorer`` adds ``p_late`` to the standardised rows, which carry the raw columns
    ``features``, see :func:`late_scorer`. Rows without an order id get one from
    their file and position.
    """
    layouts = accepted_layouts(spark, folder)
    rows = None
    for columns, paths in layouts:
        raw = spark.read.schema(readers.raw_schema(columns)).option("header", True).option("encoding", "UTF-8").csv(paths)
        place = F.concat_ws(":", F.input_file_name(), F.monotonically_increasing_id().cast("string"))
        one = readers.standardize_upload(raw.withColumn("upload_row", place), "upload_row", features)
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    if rows is not None:
        store.write_predictions(with_prediction_money(scorer(rows), penalty), store_path, session_id)
    return len(layouts)
