"""Merkle manifest: a hash tree over each source's documents and one over the sources, with a proof per document.

A tree's nodes are stored in aligned blocks, subtrees of up to ``height`` levels over 16 ** height neighbouring
nodes. A block is one binary value of digests in van Emde Boas order: the levels are split in half, the upper
half comes first, then the lower subtrees from left to right, each laid out by the same rule. ``address`` gives
a node's place for any level and number; construction writes and sibling retrieval reads through it. The roots
of the blocks are the leaves of the next tier's blocks, until a tree has one block left.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import keep

ARITY = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
_BLOCK = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("leaves", pa.int32()), ("nodes", pa.binary()), ("root", pa.string())])
_ENTRY = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.list_(_STEP))])
_PROOF = pa.schema([(c, pa.int64() if c == "doc_id" else pa.string()) for c in ("doc_id", "tree", "leaf", "proof_sha256", "folded_root")])
_BLOCK_SQL = "tree string, block long, n long, leaves int, nodes binary, root string"
_ENTRY_SQL = "tree string, block long, path array<struct<left:string,right:string>>"
_PROOF_SQL = "doc_id long, tree string, leaf string, proof_sha256 string, folded_root string"


# --- a block ------------------------------------------------------------------------------------


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def size(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Places, in the van Emde Boas order of a full tree of ``levels`` levels, of the nodes ``number`` of a depth (root: 0)."""
    base = np.zeros(len(number), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
        else:
            depth, levels = depth - top, levels - top
            below, number = np.divmod(number, ARITY**depth)
            base += size(top) + below * size(levels)
    return base


def climbs(n: int, height: int) -> int:
    """Levels from the leaves to the root of a block of a tree of ``n`` leaves in this tier."""
    up = 0
    while up < height and n > 1:
        n, up = -(-n // ARITY), up + 1
    return up


def build_block(leaves: list[str], up: int) -> tuple[bytes, str]:
    """The block's nodes in van Emde Boas order (absent ones are zero) and its root; every run of up to 16 becomes its hash."""
    nodes, level = np.zeros((size(up + 1), 32), np.uint8), leaves
    for depth in range(up, -1, -1):
        at = address(up + 1, depth, np.arange(len(level)))
        nodes[at] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, 32)
        if depth:
            level = [digest(level[k : k + ARITY]) for k in range(0, len(level), ARITY)]
    return nodes.tobytes(), level[0]


def read_levels(stored: bytes, leaves: int, up: int) -> list[list[str]]:
    """The digests of each level that has siblings to give, leaves first."""
    nodes, out, n = np.frombuffer(stored, np.uint8).reshape(-1, 32), [], leaves
    for depth in range(up, 0, -1):
        text = nodes[address(up + 1, depth, np.arange(n))].tobytes().hex()
        out.append([text[k : k + 64] for k in range(0, len(text), 64)])
        n = -(-n // ARITY)
    return out


def steps(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    """Siblings left and right of the path from leaf ``place`` upwards."""
    out = []
    for level in levels:
        first = place - place % ARITY
        out.append(("".join(level[first:place]), "".join(level[place + 1 : first + ARITY])))
        place //= ARITY
    return out


def fold(value: str, path: Sequence[tuple[str, str]]) -> str:
    for left, right in path:
        value = digest((left, value, right))
    return value


# --- trees of blocks ----------------------------------------------------------------------------


def _built(height: int) -> Callable[[pa.Table], pa.Table]:
    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        n, leaves = part["n"][0].as_py(), part["digest"].to_pylist()
        nodes, root = build_block(leaves, climbs(n, height))
        row = {"tree": part["tree"][0].as_py(), "block": part["pos"][0].as_py() // ARITY**height, "n": n, "leaves": len(leaves), "nodes": nodes, "root": root}
        return pa.Table.from_pylist([row], _BLOCK)

    return build


def build_tiers(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Written blocks of every tier over ``nodes`` (tree, pos, n, digest); ``n`` is the tree's number of nodes."""
    span, tiers = ARITY**height, []
    while True:
        placed = nodes.select("tree", "pos", "n", "digest", F.expr(f"pos div {span}").alias("block"))
        blocks = placed.groupBy("tree", "block").applyInArrow(_built(height), _BLOCK_SQL)
        tiers.append(keep(blocks, "merkle-blocks"))
        more = tiers[-1].filter(F.col("n") > span)
        if more.isEmpty():
            return tiers
        nodes = more.select("tree", F.col("block").alias("pos"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col("root").alias("digest"))


def tree_roots(tiers: list[DataFrame], height: int) -> DataFrame:
    """(tree, root): the root of each tree's last block."""
    last = [t.filter(F.col("n") <= ARITY**height).select("tree", "root") for t in tiers]
    return functools.reduce(DataFrame.unionByName, last)


def _entries(height: int) -> Callable[[pa.Table], pa.Table]:
    def entries(part: pa.Table) -> pa.Table:
        out = []
        for row in part.to_pylist():
            levels, above = read_levels(row["nodes"], row["leaves"], climbs(row["n"], height)), [(s["left"], s["right"]) for s in row["path"]]
            for place in range(row["leaves"]):
                path = [{"left": a, "right": b} for a, b in steps(levels, place) + above]
                out.append({"tree": row["tree"], "block": row["block"] * ARITY**height + place, "path": path})
        return pa.Table.from_pylist(out, _ENTRY)

    return entries


def entry_paths(blocks: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """(tree, block, path) for each leaf of ``blocks``, that is for each block of the tier below; ``above`` has the blocks' own paths."""
    return blocks.join(above, ["tree", "block"]).groupBy("tree", "block").applyInArrow(_entries(height), _ENTRY_SQL)


def block_paths(tiers: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """(tree, block, path) for each block of the first tier; ``tops`` (tree, path) leads from a tree's root upwards."""
    above = None
    for k in range(len(tiers) - 1, -1, -1):
        done = tiers[k].filter(F.col("n") <= ARITY**height).select("tree", "block").join(tops, "tree")
        above = done if above is None else done.unionByName(keep(entry_paths(tiers[k + 1], above, height), "merkle-paths"))
    return above


# --- rows ---------------------------------------------------------------------------------------


def leaf(columns: Sequence[Column]) -> Column:
    """SHA-256 over all values in turn: ``-`` for null, else number of UTF-8 bytes, colon, value."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def ranked(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with pos, from 0 within each tree by ``order`` (nulls first), and n, the tree's rows.

    Rows are sorted by ranges that cut through a tree and even through equal rows, then numbered from their
    place in the range and the sizes of the ranges before it: no tree is sorted in one task.
    """
    rows = keep(rows, "unsorted").withColumn("_tie", F.monotonically_increasing_id())
    by = [tree, *order, "_tie"]
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    sorted_ = keep(sorted_.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    sorted_ = sorted_.withColumn("_range", F.shiftright("_at", 33))
    runs = sorted_.groupBy(tree, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    all_, before = Window.partitionBy(tree), Window.partitionBy(tree).orderBy("_range")
    runs = runs.select(tree, "_range", "_first", (F.sum("_rows").over(before) - F.col("_rows")).alias("_before"), F.sum("_rows").over(all_).alias("n"))
    placed = sorted_.join(runs, [tree, "_range"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
    return placed.drop("_at", "_range", "_first", "_before")


def _proved(height: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def prove(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        block = blocks.to_pylist()[0]
        levels, above = read_levels(block["nodes"], block["leaves"], climbs(block["n"], height)), [(s["left"], s["right"]) for s in block["path"]]
        rest, first = "".join(a + b for a, b in above).encode(), block["block"] * ARITY**height
        to_root = functools.cache(lambda value: fold(value, above))
        out = {c: [] for c in ("proof_sha256", "folded_root")}
        for pos, own, claimed in zip(rows["pos"].to_pylist(), rows["leaf"].to_pylist(), rows["claimed"].to_pylist(), strict=True):
            path = steps(levels, pos - first)
            out["proof_sha256"].append(hashlib.sha256("".join(a + b for a, b in path).encode() + rest).hexdigest())
            out["folded_root"].append(to_root(fold(claimed or own, path)))
        return pa.table([rows["doc_id"], rows["tree"], rows["leaf"], pa.array(out["proof_sha256"], pa.string()), pa.array(out["folded_root"], pa.string())], schema=_PROOF)

    return prove


def manifest(
    docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", tree_col: str = "source",
    height: int = 3,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of ``docs``.

    A leaf is the hash of ``columns``. Leaves of a source ascend by id, equal ids by leaf; runs of 16 become
    their hash until one node, the subroot, is left; subroots, ordered by source, lead to the root in the same
    way. ``proof_sha256`` is the hash over all siblings on the way up, ``folded_root`` is recomputed from the leaf
    and the stored siblings; :func:`verify` takes another, claimed leaf for that.

    Null ids and null sources come first, null values of a column have their own mark. Repeated rows are leaves
    of their own; which of them has which place does not show. An empty table gives no rows. Other columns of
    ``docs`` are not read and may have any name. A task holds a block of 16 ** ``height`` rows at most.
    """
    own, none = leaf([F.col(c) for c in columns]).alias("leaf"), F.lit(None).cast("string").alias("claimed")
    return verify(docs.select(F.col(id_col).cast("long").alias("doc_id"), _tree(F.col(tree_col)), own, none), height)


def _tree(source: Column) -> Column:
    """The source as a key that is never null and sorts as UTF-8 bytes with null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")).alias("tree")


def verify(rows: DataFrame, height: int = 3) -> DataFrame:
    """The columns of :func:`manifest` from ``rows`` (doc_id, tree, leaf, claimed); a null claimed leaf is the leaf itself."""
    placed = keep(ranked(rows, "tree", ["doc_id", "leaf"]), "placed")
    tiers = build_tiers(placed.withColumnRenamed("leaf", "digest"), height)
    subroots = tree_roots(tiers, height).select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest"))
    sources = keep(ranked(subroots, "tree", ["source"]), "sources")
    over = build_tiers(sources.drop("source"), height)
    root = tree_roots(over, height).select("root").scalar()
    ends = over[0].sparkSession.createDataFrame([("", [])], "tree string, path array<struct<left:string,right:string>>")
    ways = entry_paths(over[0], block_paths(over, ends, height), height).select(F.col("block").alias("pos"), "path")
    tops = keep(sources.join(ways, "pos").select(F.col("source").alias("tree"), "path", F.col("digest").alias("subroot")), "merkle-tops")
    blocks = tiers[0].join(block_paths(tiers, tops.drop("subroot"), height), ["tree", "block"])
    rows = placed.withColumn("block", F.expr(f"pos div {ARITY**height}"))
    proved = rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(_proved(height), _PROOF_SQL)
    out = proved.join(tops.select("tree", "subroot"), "tree").withColumn("root", root)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered(docs: DataFrame, height: int = 3) -> DataFrame:
    """The manifest of ``documents``, verified against a copy in which some texts have lost their capitals.

    Where 5 divides the CRC-32 of the decimal doc_id, A to Z of the text are lower case in the copy; null texts
    and rows without an id stay. Other rules as in :func:`manifest`.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = leaf([*columns, F.translate(F.col("text"), _UPPER, _LOWER)])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tree(F.col("source")), leaf([*columns, F.col("text")]).alias("leaf"), F.when(hit, changed).alias("claimed"))
    return verify(rows, height)


# --- SQL twin -----------------------------------------------------------------------------------


def _levels_sql(name: str, first: str, rows: str, levels: int) -> str:
    """CTEs that build ``levels`` levels over ``first`` (tree, pos, digest, n) and lead ``rows`` (tree, place, proof, fold, ...) upwards."""
    out = [f"{name}_n0 as ({first})", f"{name}_p0 as ({rows})"]
    for k in range(levels):
        out.append(f"{name}_r{k} as (select tree, pos // 16 as pos, list(digest order by pos) as run, any_value(n) as n from {name}_n{k} where n > 1 group by tree, pos // 16)")
        out.append(f"{name}_n{k + 1} as (select tree, pos, sha256(array_to_string(run, '')) as digest, (n + 15) // 16 as n from {name}_r{k})")
        left, right = "coalesce(array_to_string(run[1:place % 16], ''), '')", "coalesce(array_to_string(run[place % 16 + 2:], ''), '')"
        out.append(
            f"{name}_p{k + 1} as (select p.* replace (place // 16 as place, case when run is null then proof else proof || {left} || {right} end as proof,"
            f" case when run is null then fold else sha256({left} || fold || {right}) end as fold)"
            f" from {name}_p{k} p left join {name}_r{k} r on p.tree = r.tree and p.place // 16 = r.pos)"
        )
    done = " union all ".join(f"select tree, digest from {name}_n{k} where n = 1" for k in range(levels + 1))
    return ",\n".join([*out, f"{name}_roots as ({done})"])


def _value(c: str) -> str:
    return f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"


def _sql(source_levels: int = 7, levels: int = 5) -> str:
    """For up to 16 ** 7 documents a source and 16 ** 5 sources."""
    head = " || ".join(_value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = _value(f"translate(text, '{_UPPER}', '{_LOWER}')")
    # CRC-32, bit by bit: list_reduce over the bytes, each folded by eight steps of the polynomial
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint)), lambda c, b: {byte}), 4294967295)"
    return f"""with base as (
select doc_id, coalesce('=' || source, '') as tree, sha256({head} || {_value('text')}) as leaf,
       case when {crc} % 5 = 0 then sha256({head} || {lowered}) else sha256({head} || {_value('text')}) end as claimed
from documents),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from base),
{_levels_sql('s', "select tree, pos, leaf as digest, n from placed", "select doc_id, leaf, tree, pos as place, '' as proof, claimed as fold from placed", source_levels)},
tops as (select tree as source, digest, row_number() over (order by tree) - 1 as pos, count(*) over () as n from s_roots),
{_levels_sql('t', "select '' as tree, pos, digest, n from tops", f"select doc_id, leaf, '' as tree, t.pos as place, proof, fold, t.digest as subroot from s_p{source_levels} p join tops t on p.tree = t.source", levels)}
select doc_id, leaf, subroot, digest as root, sha256(proof) as proof_sha256, fold as folded_root, fold = digest as verified
from t_p{levels}, t_roots"""


SQL = _sql()
