"""Known-result files arriving in a folder, appended to the store as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from parcelwise.sources.readers import raw_schema, with_label
from parcelwise.sources.store import check_known_results


def known_results_stream(spark: SparkSession, folder: str, columns: Sequence[str], max_files: int = 1000) -> DataFrame:
    """New CSV files of one layout, checked and without personal columns."""
    raw = (
        spark.readStream.schema(raw_schema(columns))
        .option("header", True).option("enforceSchema", False).option("maxFilesPerTrigger", max_files)
        .csv(folder)
    )
    return check_known_results(with_label(raw))


def append_stream(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived, then stop; the checkpoint makes it exactly once."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
