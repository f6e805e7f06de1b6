"""Tables whose ids are found by any part of them, without reading all files.

Rows lie in folders by a hash of their id. Next to them, an index says which folders hold which pieces of an id:
every run of ``gram`` letters and digits, and the shorter ones at the end of a run, sorted and in folders by their
first two characters. A search asks the index for the pieces of its token, reads only the folders that hold all of
them, and compares the ids there. With random ids most folders hold every piece of three characters, so pieces are
longer: a folder of n ids of length k holds about n * k of the 16 ** gram pieces of hexadecimal ids.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions.scalars import search_token
from parcelwise.session import written

FOLDER = "id_folder"
GRAM = 8
_LEAD = 2
_TASKS = 256  # that cut up ids, at most; each holds the different pieces of its folders
_INDEX = f"gram string, {FOLDER} int, lead string"


def write_searchable(df: DataFrame, path: str, id_col: str, folders: int = 1024, gram: int = GRAM, mode: str = "append") -> None:
    """Add rows to a table that :func:`search_ids` searches by ``id_col``.

    The index is written first: a reader in between finds pieces without rows, never rows without pieces, and a
    write that failed half-way costs a search some folders but no result. All writes to one table need the same
    ``folders`` and ``gram``. Rows without an id are stored and never found. A hot id does not meet in one task:
    its folder is split by size.
    """
    if FOLDER in df.columns:
        raise ValueError(f"the column {FOLDER!r} is taken")
    if gram < _LEAD:
        raise ValueError(f"pieces need {_LEAD} characters at least")
    kept = df.withColumn(FOLDER, F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(folders)).cast("int"))
    index = written(_pieces(kept.select(F.col(id_col).cast("string").alias("id"), FOLDER), gram, min(folders, _TASKS)), "pieces")  # read for the ranges and for the sort
    index.repartitionByRange("gram", FOLDER).sortWithinPartitions("gram").write.mode(mode).partitionBy("lead").parquet(f"{path}/index")
    kept.hint("rebalance", FOLDER).write.mode(mode).partitionBy(FOLDER).parquet(f"{path}/rows")


def _pieces(ids: DataFrame, gram: int, tasks: int) -> DataFrame:
    """(gram, folder, lead), one row each. A token holds letters and digits only, so pieces end before anything else.

    Different ids meet by folder before they are cut up, so that equal pieces are dropped in the task that makes
    them: what is shuffled is ids, not pieces.
    """
    runs = F.split(F.lower("id"), "[^a-z0-9]+")
    grams = F.flatten(F.transform(runs, lambda run: F.transform(F.sequence(F.lit(1), F.length(run)), lambda at: F.substr(run, at, F.lit(gram)))))
    met = ids.where("length(id) > 0").distinct().repartition(tasks, FOLDER)
    pieces = met.select(F.explode(F.array_distinct(grams)).alias("gram"), FOLDER)
    return pieces.where("gram <> ''").distinct().withColumn("lead", F.substring("gram", 1, _LEAD))


def folders_with(spark: SparkSession, path: str, token: str, gram: int = GRAM) -> list[int]:
    """The folders that hold every piece of a token, at most as many as the table has; a superset of those with a hit."""
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")
    if len(token) < gram:
        found = index.where(F.col("lead").startswith(token[:_LEAD]) & F.col("gram").startswith(token)).select(FOLDER).distinct()
    else:
        pieces = sorted({token[i:i + gram] for i in range(len(token) - gram + 1)})
        asked = index.where(F.col("lead").isin(sorted({p[:_LEAD] for p in pieces})) & F.col("gram").isin(pieces))
        found = asked.groupBy(FOLDER).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(pieces)).select(FOLDER)
    return sorted(r[0] for r in found.collect())


def search_ids(spark: SparkSession, path: str, id_col: str, text: str, gram: int = GRAM) -> DataFrame | None:
    """Rows whose id holds the typed text, normalised by :func:`search_token`; all rows if nothing is left of it.

    Equal to comparing every id. None if no row is stored.
    """
    token = search_token(text)
    try:
        rows = spark.read.parquet(f"{path}/rows")
        if token:
            near = F.col(FOLDER).isin(folders_with(spark, path, token, gram))
            rows = rows.where(near & F.lower(F.col(id_col).cast("string")).contains(token))
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return rows.drop(FOLDER)
