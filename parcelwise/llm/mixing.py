"""Mixing sources to target weights: quotas split over output shards, blocks drawn without overlap, shuffled locally.

1. **Targets.** Sources by code point, null last, weigh 1, 2, 3, repeating. They share the total size by weight;
   a target stops at ``max_repeat`` times its source's size and the excess is shared by weight again.
2. **Copies.** A document is taken ``floor(target / source size)`` times, and once more if it comes early enough in
   its source's permutation (by MD5 of the id, then a hash of the text, then a number among rows that share both) to
   fill the rest. The permutation's border is found by descending through its bits: five passes over (source, key,
   size), each summing at most 4,096 cells for a source; five more over the rows at the border if several share its key.
3. **Splitting tree.** Each source's copies form blocks. A node holds the blocks of a range of shards; its left
   half draws its share from the multivariate hypergeometric distribution, source after source, until each
   shard has its exact count of each source's blocks.
4. **Blocks.** A source's permuted blocks go to the shards in disjoint runs of those counts. Within a shard, rows
   are ordered by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import WORD, keep, n_words

_DIGIT = 12
_KEY = 60
_KEYS = ("key", "text_key", "number")  # rows are ordered by these, each from 0 to 2**60 - 1


def source_targets(sources: DataFrame, max_repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sources`` (source, source_size, ...) with weight and target; one row per source, so ranking them is small work."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    big = lambda c: c.cast("decimal(38,0)")
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank - 1, F.lit(len(weights))) + 1))
    rows = rows.withColumn("cap", max_repeat * F.col("source_size"))
    # those that reach their cap first come first; from the first that does not, all share what is left
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select(
        "*", (F.sum("source_size").over(whole) - before).alias("rest"),
        F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("weights"),
        F.row_number().over(by_cap).alias("turn"),
    )
    free = big(F.col("cap")) * F.col("weights") > big(F.col("rest")) * F.col("weight")
    first = F.min(F.when(free, F.struct("turn", "rest", "weights"))).over(whole)
    share = (first["rest"] * F.col("weight")).cast("double") / first["weights"].cast("double")
    target = F.when(F.col("turn") >= first["turn"], share).otherwise(F.col("cap").cast("double"))
    return rows.select(*sources.columns, "weight", target.alias("target"))


def _key(doc_id: Column, seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _text_key(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))), 64 - _KEY)


def _numbered(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` as (row, the keys), and (source, the keys, size) of each row.

    Numbers are 0 unless rows share source, id and text: then all rows are written with a number of their own, so
    that both tables have the same.
    """
    def keyed(row: DataFrame, number: Column) -> tuple[DataFrame, DataFrame]:
        held = row.select(
            "row", F.col(f"row.`{source_col}`").cast("string").alias("src"), _key(F.col(f"row.`{id_col}`"), seed).alias("key"),
            _text_key(F.col(f"row.`{text_col}`")).alias("text_key"), number.alias("number"),
        )
        return held, keep(held.select(F.col("src").alias("source"), *_KEYS, n_words(F.col(f"row.`{text_col}`").cast("string")).alias("size")), "mix-sizes")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    held, sizes = keyed(rows, F.lit(0).cast("long"))
    if sizes.groupBy("source", "key", "text_key").count().filter("count > 1").isEmpty():
        return held, sizes
    numbered = keep(rows.select("row", F.monotonically_increasing_id().alias("at")), "mix-numbered")
    return keyed(numbered, F.shiftrightunsigned(F.xxhash64(F.lit(seed), "at"), 64 - _KEY))


def _same(a: str, b: str) -> Column:
    return F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}"))


def _descend(rows: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """(source, quota, prefix, below, last, n): the ``key`` at which the sizes of ``rows`` exceed the quota of ``state``, what comes before, and size and number of the rows there."""
    state = state.select("source", "quota", F.lit(0).cast("long").alias("prefix"), "below")
    for level in range(_KEY // _DIGIT):
        shift = _KEY - _DIGIT * (level + 1)
        joined = rows.alias("a").join(state.alias("b"), _same("source", "source")).select("b.source", "b.quota", "b.prefix", "b.below", F.col(f"a.{key}").alias("key"), "a.size")
        inside = joined.filter(F.shiftright("key", shift + _DIGIT) == F.col("prefix"))
        cells = inside.groupBy("source", "quota", "prefix", "below", F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("cell"))
        cells = cells.withColumn("upto", F.col("below") + upto).filter(F.col("upto") > F.col("quota"))
        hit = cells.groupBy("source", "quota").agg(F.min(F.struct("cell", "upto", "size", "n")).alias("hit"))
        state = hit.select(
            "source", "quota", F.col("hit.cell").alias("prefix"), (F.col("hit.upto") - F.col("hit.size")).alias("below"), F.col("hit.size").alias("last"), F.col("hit.n").alias("n")
        )
        state = keep(state, "mix-border")
    return state


def _borders(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """``quotas`` with the array border: of ``rows`` (source, the keys, size), those before it in the order of the keys sum up to the source's ``quota`` as nearly as whole rows can."""
    state, found = quotas.select("source", "quota", F.lit(0).cast("long").alias("below")), []
    zero, passed = F.lit(0).cast("long"), []
    for depth, key in enumerate(_KEYS):
        state = _descend(rows, state, key)
        if depth:
            state = keep(state.alias("a").join(before.alias("b"), _same("source", "source")).select("a.*", *[f"b.{c}" for c in passed]), "mix-border-keys")  # noqa: F821 - of the turn before
        last = depth == len(_KEYS) - 1
        taken = (2 * F.col("below") + F.col("last") <= 2 * F.col("quota")).cast("long")
        ends = state if last else state.filter("n = 1")
        found.append(ends.select("source", F.array(*passed, F.col("prefix") + taken, *[zero] * (len(_KEYS) - 1 - depth)).alias("border")))
        state = state.filter("n > 1")
        if last or state.isEmpty():
            break
        passed.append(f"border_{key}")
        before = state = state.withColumnRenamed("prefix", passed[-1])
        rows = keep(rows.alias("a").join(state.alias("b"), _same("source", "source") & (F.col(f"a.{key}") == F.col(f"b.{passed[-1]}"))).select("a.*"), "mix-border-rows")
    borders = found[0]
    for more in found[1:]:
        borders = borders.unionByName(more)
    out = quotas.alias("a").join(borders.alias("b"), _same("source", "source"), "left")
    return out.select("a.*", F.coalesce("border", F.array(F.lit(1 << _KEY), zero, zero)).alias("border"))


def _draw(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Hypergeometric count of ``good`` among ``drawn`` of ``total``, from the uniform ``u`` by its inverse distribution.

    Sums run over 12 standard deviations around the mode; what lies beyond is below the precision of a double.
    """
    n, k, d = (c.cast("double") for c in (F.greatest(total, F.lit(1)), good, drawn))
    sd = F.sqrt(F.greatest(d * k / n * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
    mode = F.floor((d + 1) * (k + 1) / (n + 2))
    reach = F.ceil(12 * sd) + 10
    low = F.greatest(F.lit(0), drawn - (total - good), mode - reach).cast("long")
    high = F.least(drawn, good, mode + reach).cast("long")
    ratio = lambda x: F.log((k - x + 1) * (d - x + 1) / (x * (n - k - d + x)))
    steps = F.sequence(low + 1, F.greatest(high, low + 1))
    whole = F.aggregate(
        steps, F.struct(F.lit(0.0).alias("l"), F.lit(1.0).alias("t")),
        lambda s, x: F.struct((s["l"] + ratio(x)).alias("l"), (s["t"] + F.exp(s["l"] + ratio(x))).alias("t")),
    )["t"]
    found = F.aggregate(
        steps, F.struct(F.lit(0.0).alias("l"), F.lit(1.0).alias("t"), low.alias("at")),
        lambda s, x: F.struct(
            (s["l"] + ratio(x)).alias("l"), (s["t"] + F.exp(s["l"] + ratio(x))).alias("t"),
            F.when(s["t"] < u * whole, x).otherwise(s["at"]).alias("at"),
        ),
    )["at"]
    return F.when((total <= 0) | (low >= high), F.greatest(low, F.lit(0).cast("long"))).otherwise(found)


def shard_quotas(blocks: DataFrame, shards: int, seed: str) -> DataFrame:
    """(place, ends): for the sources ``place`` of ``blocks`` (place, blocks), how many of its blocks lie in shards 0 to s."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards is a power of two")
    nodes = blocks.agg(F.array_sort(F.collect_list(F.struct("place", "blocks"))).alias("held"))
    nodes = nodes.select(F.lit(0).alias("shard"), "held")
    width = shards
    while width > 1:
        width //= 2
        total = F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["blocks"])
        # an odd block goes left or right by the seed
        odd = F.pmod(F.xxhash64(F.lit(seed), F.lit(width), "shard"), F.lit(2))
        half = F.floor((total + odd) / 2).cast("long")

        level = F.lit(width)

        def step(s: Column, x: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed), level, F.col("shard"), x["place"]), F.lit(1 << 52)) / float(1 << 52)
            got = _draw(s["total"], x["blocks"], s["drawn"], u)
            mine = F.struct(x["place"].alias("place"), got.alias("blocks"))
            return F.struct(
                (s["total"] - x["blocks"]).alias("total"), (s["drawn"] - got).alias("drawn"), F.concat(s["left"], F.array(mine)).alias("left")
            )

        none = F.slice(F.transform("held", lambda x: F.struct(x["place"].alias("place"), x["blocks"].alias("blocks"))), 1, 0)
        nodes = nodes.select("shard", "held", F.aggregate("held", F.struct(total.alias("total"), half.alias("drawn"), none.alias("left")), step)["left"].alias("left"))
        right = F.zip_with("held", "left", lambda a, b: F.struct(a["place"].alias("place"), (a["blocks"] - b["blocks"]).alias("blocks")))
        halves = F.array(F.struct(F.col("shard"), F.col("left").alias("held")), F.struct((F.col("shard") + width).alias("shard"), right.alias("held")))
        nodes = nodes.select(F.explode(halves).alias("n")).select("n.shard", "n.held")
    leaves = nodes.select("shard", F.explode("held").alias("h")).select("shard", "h.place", "h.blocks")
    leaves = leaves.withColumn("end", F.sum("blocks").over(Window.partitionBy("place").orderBy("shard")))
    return leaves.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))


def mix_plan(rows: DataFrame, shards: int = 16, block_rows: int = 64, max_repeat: int = 3, seed: str = "mix") -> DataFrame:
    """(source, source_size, rows, target, repeats, border, ends, place): what each source of ``rows`` (source, the keys, size) gives to the mix, one row per source."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = source_targets(sources, max_repeat)
    ratio = F.col("target") / F.col("source_size")
    repeats = F.when(F.col("source_size") > 0, F.least(F.floor(ratio), F.lit(max_repeat))).otherwise(F.lit(0)).cast("int")
    sources = sources.withColumn("repeats", repeats)
    sources = keep(sources.withColumn("quota", F.col("target") - F.col("repeats") * F.col("source_size")), "mix-sources")
    sources = keep(_borders(rows, sources), "mix-borders")
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    # the extra copies are the quota's share of a source's rows, near enough to size its blocks
    copies = F.col("rows") * F.when(F.col("source_size") > 0, ratio).otherwise(F.lit(0.0))
    sources = sources.withColumn("place", place).withColumn("blocks", F.greatest(F.lit(1), F.ceil(copies / block_rows)).cast("long"))
    sources = keep(sources, "mix-blocks")
    return keep(sources.join(shard_quotas(sources, shards, seed), "place"), "mix-plan")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    shards: int = 16, block_rows: int = 64, max_repeat: int = 3, seed: str = "mix",
) -> DataFrame:
    """(row, size, source_size, target, taken, copies): every input row, its columns in the struct ``row``.

    ``copies`` is an array of (copy, shard, turn), empty for a row that the mix leaves out; ``taken`` is its
    length times the row's size. Sizes are words; null and empty texts have size 0, and a source of size 0 gives
    nothing. Each row has a draw of its own, also those that share an id or have none; of rows that share id and text
    some may be taken. A null source is a source of its own. Clashing column names cannot arise, since the row is a struct. Reruns
    agree; which of several rows with the same id and text are taken follows their order in the files. An empty table gives no rows. A source's taken words are within half a document of its target.
    """
    rows, sizes = _numbered(docs, id_col, text_col, source_col, seed)
    plan = mix_plan(sizes, shards, block_rows, max_repeat, seed)
    # ends and counts of a source are a few dozen bytes for each shard; one row per source
    rows = rows.join(plan, F.col("src").eqNullSafe(F.col("source")))
    size = n_words(F.col(f"row.`{text_col}`").cast("string"))
    count = F.col("repeats") + F.when((F.array(*_KEYS) < F.col("border")) & (F.col("quota") > 0), 1).otherwise(0)
    rows = rows.withColumn("n", count)

    def placed(copy: Column) -> Column:
        block = F.pmod(F.xxhash64(F.lit(seed), *_KEYS, copy), F.col("blocks"))
        shard = F.size(F.filter("ends", lambda e: e <= block))
        return F.struct(copy.alias("copy"), shard.alias("shard"), F.xxhash64(F.lit(seed), F.lit("turn"), *_KEYS, copy).alias("turn"))

    copies = F.transform(F.slice(F.sequence(F.lit(0), F.lit(max_repeat)), F.lit(1), F.col("n")), placed)
    return rows.select("row", size.alias("size"), "source_size", "target", (size * F.col("n")).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, shards: int | None = None, shard_rows: int = 8192, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each copy, in shards that are shuffled within.

    Without ``shards``, the next power of two that gives shards of at most about ``shard_rows`` rows, 16 at least,
    so that a shard stays one task's work however many rows there are.
    """
    if shards is None:
        shards = 1 << max(4, (docs.count() // shard_rows).bit_length())
    rows = mix(docs, shards=shards, **options).select("row", F.explode("copies").alias("c"))
    rows = rows.repartition(shards, "c.shard").sortWithinPartitions("c.shard", "c.turn")
    return rows.select("row.*")


#: DuckDB's form of the query: what the mix takes of each document.
SQL = f"""
with rows as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as size,
         substr(md5('mix' || coalesce(cast(doc_id as varchar), '')), 1, 15) as key from documents),
sources as (select source, sum(size)::bigint as source_size from rows group by source),
weighed as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from sources),
turns as (select *, 3 * source_size as cap, row_number() over w as turn,
                 sum(source_size) over () - coalesce(sum(3 * source_size) over (w rows between unbounded preceding and 1 preceding), 0) as rest,
                 sum(weight) over (w rows between current row and unbounded following) as weights
          from weighed window w as (order by 3 * source_size / weight, source nulls last)),
shared as (select rest, weights, turn from turns where cap::hugeint * weights > rest::hugeint * weight order by turn limit 1),
targets as (select t.source, source_size, case when t.turn >= (select turn from shared)
              then ((select rest from shared) * weight)::double / (select weights from shared)::double else cap::double end as target from turns t),
quotas as (select *, case when source_size > 0 then least(floor(target / source_size), 3)::bigint else 0 end as repeats from targets),
runs as (select r.*, q.source_size, q.target, q.repeats, q.target - q.repeats * q.source_size as quota,
                coalesce(sum(size) over (partition by r.source order by key rows between unbounded preceding and 1 preceding), 0) as below
         from rows r join quotas q on r.source is not distinct from q.source)
select doc_id, size::bigint as size, source_size, target,
       (size * (repeats + case when quota > 0 and 2 * below + size <= 2 * quota then 1 else 0 end))::bigint as taken from runs
"""
