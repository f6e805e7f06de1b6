"""Line dedup by site-relative frequency: lines that too large a share of a host's pages carry are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import keep


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digest(line: Column) -> Column:
    """Key of a line: the first 16 hex digits pairs of its SHA-256, surrounding spaces ignored; null for a blank line."""
    bare = F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")
    return F.when(bare != "", F.substring(F.sha2(bare, 256), 1, 32))


def boilerplate_lines(docs: DataFrame, host: Column, text: Column, ratio: float, min_pages: int) -> DataFrame:
    """(host, line, pages, of_pages): lines on more than ``ratio`` of the host's pages and on ``min_pages`` at least."""
    rows = docs.select(host.alias("host"), text.alias("text"))
    totals = rows.groupBy("host").agg(F.count("*").alias("of_pages"))
    lines = rows.select("host", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _digest))).alias("line"))
    lines = lines.filter(F.col("line").isNotNull()).groupBy("host", "line").agg(F.count("*").alias("pages"))
    often = lines.filter(F.col("pages") >= min_pages).join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    return often.filter(F.col("pages") > ratio * F.col("of_pages")).select("host", "line", "pages", "of_pages")


def line_dedup(
    docs: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text", ratio: float = 0.02, min_pages: int = 5
) -> DataFrame:
    """(doc_id, host, n_lines, n_removed, kept_text): every row without its host's boilerplate lines.

    Lines end at \\n; blank lines are never boilerplate and stay. A line counts once a page. Rows with a null
    host are one site. A null text is one blank line. Rows that repeat a doc_id count as pages each and get a
    row each. Other columns are not read; an empty table gives no rows. All lines of a host that pass ``ratio``
    number at most (mean lines of its pages / ratio), which bounds the list attached to a row.
    """
    text = F.col(text_col).cast("string")
    drop = boilerplate_lines(docs, host, text, ratio, min_pages)
    drop = keep(drop.groupBy("host").agg(F.collect_set("line").alias("drop")), "boilerplate")
    rows = docs.select(F.col(id_col).alias("doc_id"), host.alias("host"), text.alias("text"))
    rows = rows.join(drop.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")), "left")
    lines = _lines(F.col("text"))
    stays = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("drop"), _digest(x)), F.lit(False)))
    rows = rows.select("doc_id", "host", F.size(lines).cast("long").alias("n_lines"), stays.alias("stays"))
    return rows.select(
        "doc_id", "host", "n_lines", (F.col("n_lines") - F.size("stays")).alias("n_removed"),
        F.array_join("stays", "\n").alias("kept_text"),
    )


#: DuckDB's form of the query: host is the source, the digest of what is left stands for the text.
SQL = """
with rows as (select doc_id, source as host, string_split(coalesce(text, ''), chr(10)) as lines from documents),
bare as (select host, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13))))) as line from rows),
often as (select host, line, count(*) as pages from bare where line <> '' group by all having count(*) >= 5),
totals as (select host, count(*) as of_pages from rows group by all),
boiler as (select o.host, list(line) as dropped from often o join totals t on o.host is not distinct from t.host
           where pages > 0.02 * of_pages group by all),
cut as (select doc_id, r.host, lines, list_filter(lines, lambda x: not coalesce(list_contains(b.dropped, trim(x, ' ' || chr(9) || chr(13))), false)) as stays
        from rows r left join boiler b on r.host is not distinct from b.host)
select doc_id, host, len(lines) as n_lines, len(lines) - len(stays) as n_removed,
       sha256(array_to_string(stays, chr(10))) as kept_sha256 from cut
"""
