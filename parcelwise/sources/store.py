"""Writing tables: splits, predictions, marts, known results, event flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.constants import DEFAULT_PENALTY, LABEL, PROFIT_TARGET
from parcelwise.operators import mart
from parcelwise.operators.privacy import drop_pii
from parcelwise.session import written
from parcelwise.sources import versions
from parcelwise.sources.readers import check_header, session_key


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_predictions(df: DataFrame, path: str, session_id: str) -> None:
    """Replace the predictions of one session and leave the others alone."""
    (
        df.withColumn("session_id", F.lit(session_key(session_id)))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)
    )


def write_bucketed(df: DataFrame, path: str, name: str, key: str, buckets: int = 256) -> DataFrame:
    """Store a table in ``buckets`` buckets by ``key``, sorted inside them, and return it as read back.

    Tables stored with the same number of buckets are joined, reduced to distinct keys and grouped on the key
    without a shuffle; joins on more columns than the key need ``spark.sql.requireAllClusterKeysForCoPartition``
    off, as :func:`session.get_spark` sets it. ``name`` is the table's name in the session's catalog; the files lie in ``path``. One
    file per bucket and task would be many, so rows meet by bucket first.
    """
    spark = df.sparkSession
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def reset_session(spark: SparkSession, path: str, session_id: str) -> None:
    """Remove one session's predictions.

    Its partition is overwritten by no rows; the other partitions are not rewritten. The key is checked, so
    nothing outside the store can be named.
    """
    wanted = session_key(session_id)
    stored = spark.read.parquet(path)
    if not stored.where(F.col("session_id") == wanted).limit(1).count():
        return
    empty = spark.createDataFrame([], stored.drop("session_id").schema)
    empty.write.mode("overwrite").parquet(f"{path.rstrip('/')}/session_id={wanted}")


def write_json_artifacts(spark: SparkSession, medians: dict[str, float], codes: DataFrame, path: str) -> None:
    """The same as one JSON record, as :func:`readers.read_artifacts` and :func:`readers.read_label_classes` read it."""
    classes = codes.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "category"))), lambda x: x["category"]).alias("c"))
    fitted = spark.createDataFrame([(medians,)], "feature_medians map<string,double>")
    every = classes.agg(F.map_from_entries(F.collect_list(F.struct("column", "c")))).scalar()
    fitted.withColumn("label_classes", every).write.mode("overwrite").json(path)


def write_artifacts(medians: DataFrame, codes: DataFrame, path: str) -> None:
    """The two fitted tables: medians per column, code per category."""
    medians.write.mode("overwrite").parquet(f"{path}/medians")
    codes.write.mode("overwrite").parquet(f"{path}/codes")


def write_mart(orders: DataFrame, summary: DataFrame, trust: DataFrame, path: str) -> None:
    orders.write.mode("overwrite").parquet(f"{path}/mart")
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    trust.write.mode("overwrite").parquet(f"{path}/trust_map")


def update_mart(
    items: DataFrame, path: str, batch: str, key: str, order_by: Sequence[str], dims: Sequence[str], parts: int = 256,
) -> dict[str, int]:
    """Add a batch of items to a stored mart: only the parts that hold its orders are read and written again.

    What is stored are mergeable states per order in ``parts`` parts by a hash of the key, see
    :func:`mart.order_state`; a repeated batch adds nothing. Read the mart by :func:`read_updated_mart`.
    """
    spark, place = items.sparkSession, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")
    done = versions.stored(spark, path, batch)
    if done:
        return done
    fresh = written(mart.order_state(items, key, order_by, dims), "mart-batch")
    touched = [r["part"] for r in fresh.select(place).distinct().collect()]  # at most ``parts`` numbers

    def make(stored: DataFrame | None) -> DataFrame:
        states = fresh if stored is None else mart.merged_state(stored.unionByName(fresh), key, dims)
        # rows meet by part, so that a part has few files; a large part is split by size, not sorted in one task
        return states.withColumn("part", place).hint("rebalance", "part")

    return versions.commit(spark, path, batch, make, part="part", only=touched)


def read_updated_mart(spark: SparkSession, path: str, key: str, dims: Sequence[str], penalty=DEFAULT_PENALTY, version: int | None = None) -> DataFrame | None:
    states = versions.read(spark, path, version)
    return mart.mart_of_states(states, key, dims, penalty) if states is not None else None


def write_thresholds(sweep: DataFrame, best: DataFrame, path: str) -> None:
    sweep.write.mode("overwrite").parquet(f"{path}/sweep")
    best.write.mode("overwrite").parquet(f"{path}/best")


def write_selection(report: DataFrame, totals: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(f"{path}/orders")
    totals.write.mode("overwrite").json(f"{path}/summary")


def write_model_outputs(metrics: DataFrame, features: Sequence[str], predictions: DataFrame, path: str) -> None:
    """Metrics, feature manifest and profit predictions of a training run."""
    spark = metrics.sparkSession
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    spark.createDataFrame(list(enumerate(features)), "position int, feature string").write.mode("overwrite").json(f"{path}/manifest")
    predictions.withColumn("residual", F.col("actual_profit") - F.col("predicted_profit")).write.mode("overwrite").parquet(f"{path}/predictions")


# --- known results ----------------------------------------------------------------------------


def check_known_results(df: DataFrame) -> DataFrame:
    """Header gate, label and profit present, personal columns dropped."""
    check_header(df.columns)
    lowered = {c.lower() for c in df.columns}
    for needed in (LABEL, PROFIT_TARGET):
        if needed.lower() not in lowered:
            raise ValueError(f"known results need the column {needed!r}")
    return drop_pii(df)


def append_known_results(df: DataFrame, path: str) -> dict[str, int]:
    """Append a checked batch; returns the rows it added and the rows stored.

    A column that stored batches have must keep its type; new columns are fine, see :func:`read_known_results`.
    """
    spark = df.sparkSession
    clean = check_known_results(df)
    _same_types(read_known_results(spark, path), clean)
    seen = Observation()
    clean.observe(seen, F.count(F.lit(1)).alias("added")).write.mode("append").parquet(path)
    return {"added": seen.get["added"], "total": stored_rows(spark, path)}


def _same_types(stored: DataFrame | None, batch: DataFrame) -> None:
    kinds = dict(stored.dtypes) if stored is not None else {}
    changed = {c: (kinds[c], t) for c, t in batch.dtypes if kinds.get(c, t) != t}
    if changed:
        raise ValueError(f"columns changed their type: {changed}")


def append_batch(df: DataFrame, path: str, batch: str) -> dict[str, int]:
    """Append a checked batch to a versioned store, once: repeated under its name it adds nothing.

    The types are compared with the version the batch is added to, also if another writer was faster.
    """
    clean = check_known_results(df)

    def checked(stored: DataFrame | None) -> DataFrame:
        _same_types(stored, clean)
        return clean

    return versions.commit(df.sparkSession, path, batch, checked)


def read_known_results(spark: SparkSession, path: str) -> DataFrame | None:
    """All batches with all their columns, NULL where a batch lacks one; None if nothing is stored."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stored_rows(spark: SparkSession, path: str) -> int:
    stored = read_known_results(spark, path)
    return stored.count() if stored is not None else 0


def combined_training(raw: DataFrame, store: DataFrame) -> DataFrame:
    """Original rows and known results, missing columns as NULL."""
    return raw.unionByName(store, allowMissingColumns=True)


# --- event flags --------------------------------------------------------------------------------


def upsert_flags(flags: DataFrame, changes: DataFrame) -> DataFrame:
    """Newest flag per month: at most one row per calendar month and change; of equal times a change beats the stored flag, then the last value."""
    both = flags.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [F.desc(c) for c in flags.columns if c not in ("month", "flagged_at")]
    w = Window.partitionBy("month").orderBy(F.desc("flagged_at"), F.desc("_new"), *rest)
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def store_flags(changes: DataFrame, path: str, batch: str) -> dict[str, int]:
    """Upsert a batch of flags into a versioned store; see :func:`upsert_flags`. Read them with :func:`versions.read`."""
    def merged(stored: DataFrame | None) -> DataFrame:
        return upsert_flags(stored if stored is not None else changes.limit(0), changes)

    return versions.commit(changes.sparkSession, path, batch, merged, replace=True)


# --- feature contracts --------------------------------------------------------------------------


def write_contract(features: DataFrame, path: str, run: str, part: str) -> None:
    """The (position, feature) list of one part (manifest, artifacts, model) of a training run, as JSON."""
    features.select("position", "feature").write.mode("overwrite").json(f"{path}/run={run}/part={part}")


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """(run, part, position, feature) of all stored lists."""
    return spark.read.schema("position int, feature string, run string, part string").json(path)
