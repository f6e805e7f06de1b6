"""Tables in versions: what a writer adds is seen as a whole or not at all, and a repeated batch adds nothing.

A commit writes its rows to a folder of their own first and then one small JSON record that names all folders of
the new version. Readers follow the newest record; folders are never changed, so a reader keeps the version it
began with. Both are plain Spark writes, which appear under their name only when they are complete.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RECORD = "version long, batch string, added long, written string, folders array<string>"


def history(spark: SparkSession, path: str) -> DataFrame:
    """(version, batch, added, written, folders), one row per version; empty where nothing was committed.

    Should two writers have put a record under one number, the one with the smaller folder name counts.
    """
    try:
        records = spark.read.schema(_RECORD).json(f"{path}/commits/*")
        first = Window.partitionBy("version").orderBy("written")
        return records.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _RECORD)


def _newest(spark: SparkSession, path: str, version: int | None = None):
    commits = history(spark, path)
    if version is not None:
        commits = commits.where(F.col("version") == version)
    rows = commits.orderBy(F.desc("version")).limit(1).collect()
    return rows[0] if rows else None


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest version, or a given one; None if there is none. Columns that a batch lacks are NULL."""
    found = _newest(spark, path, version)
    return _read_folders(spark, found["folders"]) if found else None


def _read_folders(spark: SparkSession, folders: Sequence[str]) -> DataFrame | None:
    return spark.read.option("mergeSchema", True).parquet(*folders) if folders else None


def stored(spark: SparkSession, path: str, batch: str) -> dict[str, int] | None:
    """What a commit of a batch that is already there returns, else None."""
    done = history(spark, path).where(F.col("batch") == batch).limit(1).collect()
    return {"version": done[0]["version"], "added": 0} if done else None


def commit(
    spark: SparkSession, path: str, batch: str, make: Callable[[DataFrame | None], DataFrame], replace: bool = False,
    part: str | None = None, only: Sequence[int] | None = None, tries: int = 5,
) -> dict[str, int]:
    """Add the rows that ``make`` gives for the newest version, or put them in its place; the new version and the rows it wrote.

    A batch that is already in the history adds nothing. ``make`` may refuse the version it sees with an
    exception. Of writers at the same time one wins a version's number; the others run ``make`` again on what it
    left, so a check made on the old version is made again on the new one.

    With ``part``, a column of small whole numbers, a version is a set of parts: ``make`` sees those in ``only``
    and what it gives takes their place; the folders of all other parts go over to the new version as they are.
    """
    for _ in range(tries):
        done = stored(spark, path, batch)
        if done:
            return done
        last = _newest(spark, path)
        old = list(last["folders"]) if last else []
        seen = [f for f in old if f.endswith(tuple(f"/{part}={k}" for k in only or ()))] if part else old
        folder = f"{path}/data/{uuid.uuid4().hex}"
        rows = make(_read_folders(spark, seen))
        (rows.write.partitionBy(part) if part else rows.write).parquet(folder)
        written = spark.read.schema(rows.schema).parquet(folder)
        added = written.count()
        folders = [folder] if replace or not last else [*old, folder]
        if part:
            new = [f"{folder}/{part}={r[0]}" for r in written.select(part).distinct().collect()]
            folders = [f for f in old if f not in seen] + sorted(new)
        number = last["version"] + 1 if last else 1
        record = spark.createDataFrame([(number, batch, added, folder, folders)], _RECORD)
        try:
            record.coalesce(1).write.mode("error").json(f"{path}/commits/{number:012d}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            continue  # another writer was first
        if _newest(spark, path, number)["written"] == folder:
            return {"version": number, "added": added}
    raise RuntimeError(f"{path}: other writers were first {tries} times")
