"""SimHash near-dedup: fingerprints, and a binary trie self-join that prunes by the Hamming budget.

**Fingerprints.** Words of the lower-cased text (A-Z only), shingles of ``width`` words, XXH64 with seed 42;
a bit is set if it is set in over half of the shingles' hashes.

**Join.** Two fingerprints within ``max_bits`` agree on at least ``blocks - max_bits`` of ``blocks`` bit
blocks. So for every choice of that many blocks a trie is built whose top levels are the chosen bits. Below
one top node, pairs of trie nodes are walked down together, their differing bits add up, and a pair is left
when they exceed the budget. Small nodes are compared leaf by leaf. All links within the budget are found.
What a task returns is a spanning forest of its links, at most a row for each fingerprint it holds, so a
group of copies never becomes all its pairs. A top node with more than ``split`` fingerprints is cut into
hashed parts whose pairs are separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import as_bytes, keep
from parcelwise.llm.components import connected_components, merge

_CHUNK = 1 << 15
_LEAF = 24
_FRONT = 1 << 18


def _counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Fingerprint of one UTF-8 text as an unsigned integer; null or no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), 42)
    ones, total = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, total, _CHUNK):
        part = words[at : at + _CHUNK + width - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [
            digest(line[a:b], 42)
            for a, b in zip(starts[: len(part) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
        ]
        ones += _counts(np.array(hashes, np.uint64))
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            found = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- the trie


def _order(chosen: tuple[int, ...], blocks: int) -> np.ndarray:
    """Bit places in the order in which a trie with these top blocks tests them."""
    cuts = np.linspace(0, 64, blocks + 1).astype(int)
    place = [np.arange(cuts[b], cuts[b + 1]) for b in range(blocks)]
    return np.concatenate([place[b] for b in (*chosen, *(b for b in range(blocks) if b not in chosen))])


def _turned(fps: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Fingerprints with the bits of ``order`` as their highest first."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, order]
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="big")).view(">u8").astype(np.uint64).ravel()


def _products(a0, a1, b0, b1):
    """Index pairs of the products of ranges a0:a1 and b0:b1."""
    wide = b1 - b0
    count = (a1 - a0) * wide
    which = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return a0[which] + nth // wide[which], b0[which] + nth % wide[which]


def trie_links(keys: np.ndarray, starts: list[tuple[int, int, int, int]], depth: int, budget: int) -> Iterator:
    """Index pairs (i < j) within ``budget`` bits.

    ``keys`` are sorted within each range. ``starts`` are node pairs (a0, a1, b0, b1) whose keys agree on the
    first ``depth`` bits; a pair of a node with itself has equal ranges.
    """
    first = np.array(starts, np.int64).reshape(-1, 4)
    stack = [(depth, first, np.zeros(len(first), np.int64))] if len(first) else []
    while stack:
        depth, nodes, spent = stack.pop()
        if len(nodes) > _FRONT:
            stack += [(depth, nodes[k : k + _FRONT], spent[k : k + _FRONT]) for k in range(0, len(nodes), _FRONT)]
            continue
        a0, a1, b0, b1 = nodes.T
        leaf = (np.maximum(a1 - a0, b1 - b0) <= _LEAF) | (depth == 64)
        size = np.cumsum((a1 - a0)[leaf] * (b1 - b0)[leaf])
        cuts = [0, *np.flatnonzero(np.diff(size // (1 << 21))) + 1, len(size)] if len(size) else []
        small = nodes[leaf]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            i, j = _products(*small[lo:hi].T)
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if near.any():
                yield i[near], j[near]
        nodes, spent = nodes[~leaf], spent[~leaf]
        if not len(nodes):
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        ones = np.concatenate(([0], np.cumsum((keys & bit) != 0)))
        a0, a1, b0, b1 = nodes.T
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        below = []
        for x0, x1, y0, y1, differ in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            live = (x0 < x1) & (y0 < y1) & (spent + differ <= budget)
            if (x0 is am) and differ:
                live &= ~same  # a node with itself: its children meet once
            below.append((np.stack([x0, x1, y0, y1], axis=1)[live], (spent + differ)[live]))
        stack.append((depth + 1, np.concatenate([n for n, _ in below]), np.concatenate([s for _, s in below])))


def _forest(task: np.ndarray, part: np.ndarray, trie: np.ndarray, fps: np.ndarray, orders, depths, budget) -> tuple:
    """Spanning forest of the links in each task: pairs of fingerprints."""
    keys = np.empty(len(fps), np.uint64)
    for t in np.unique(trie):
        keys[trie == t] = _turned(fps[trie == t], orders[t])
    node = keys >> (64 - np.array(depths, np.uint64)[trie])
    at = np.lexsort((keys, part, node, trie, task))
    task, part, trie, node, fps, keys = task[at], part[at], trie[at], node[at], fps[at], keys[at]
    fresh = (np.diff(task) != 0) | (np.diff(trie) != 0) | (np.diff(node) != 0)
    edge = np.flatnonzero(fresh | (np.diff(part) != 0)) + 1
    lows, highs = np.concatenate(([0], edge)), np.concatenate((edge, [len(task)]))
    goes_on = np.concatenate((~fresh[edge - 1], [False]))  # the next range belongs to the same task
    starts: dict[int, list] = {}
    k = 0
    while k < len(lows):
        other = k + 1 if goes_on[k] else k
        # a task of two parts compares them with each other only; each part has a task of its own
        starts.setdefault(depths[trie[lows[k]]], []).append((lows[k], highs[k], lows[other], highs[other]))
        k = other + 1
    root = np.arange(len(fps))
    for depth, nodes in starts.items():
        for i, j in trie_links(keys, nodes, depth, budget):
            merge(root, i, j)
    linked = root != np.arange(len(fps))
    return fps[linked], fps[root[linked]]


def simhash_links(distinct: DataFrame, max_bits: int = 4, blocks: int = 5, split: int = 1024) -> DataFrame:
    """(u, v): a spanning forest of all links between the distinct fingerprints ``fp`` within ``max_bits`` bits."""
    if not 0 <= max_bits < blocks <= 16:
        raise ValueError("blocks must exceed max_bits")
    tries = list(combinations(range(blocks), blocks - max_bits))
    orders = [_order(c, blocks) for c in tries]
    cuts = np.linspace(0, 64, blocks + 1).astype(int)
    depths = [int(sum(cuts[b + 1] - cuts[b] for b in c)) for c in tries]

    def top(c: tuple[int, ...]):
        mask = sum(((1 << int(cuts[b + 1])) - (1 << int(cuts[b]))) for b in c)
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))

    tops = F.explode(F.array(*[F.struct(F.lit(t).alias("trie"), top(c).alias("top")) for t, c in enumerate(tries)]))
    rows = distinct.select("fp", tops.alias("n")).select("fp", "n.trie", "n.top")
    sizes = keep(rows.groupBy("trie", "top").count().filter("count > 1"), "trie-nodes")
    parts = F.ceil(F.col("count") / split).cast("int")
    rows = rows.join(sizes, ["trie", "top"]).withColumn("parts", parts)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("task", F.xxhash64("trie", "top", F.least("part", "other"), F.greatest("part", "other")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not sum(p.num_rows for p in parts):
            return
        table = pa.Table.from_batches(parts)
        task, part, trie, fps = (table.column(k).to_numpy() for k in ("task", "part", "trie", "fp"))
        u, v = _forest(task, part, trie, fps.view(np.uint64), orders, depths, max_bits)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    rows = rows.select("task", "part", "trie", "fp").repartition("task")
    return rows.mapInArrow(run, "u long, v long")


def simhash_dedup(
    docs: DataFrame, width: int = 4, max_bits: int = 4, blocks: int = 5, split: int = 1024,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept), one row per input row.

    ``component_id`` is the smallest doc_id reachable over links of at most ``max_bits`` differing bits, itself
    included; ``kept`` marks the rows whose doc_id it is. Null and wordless texts have the fingerprint 0 and
    link like any other. A null doc_id never names a component (it is null if a component has no other id).
    Rows that repeat a doc_id each get a row. Other columns are not read; an empty table gives no rows.
    """
    rows = keep(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    groups = connected_components(simhash_links(nodes.select("fp"), max_bits, blocks, split))
    groups = keep(groups.withColumnRenamed("node", "fp"), "fingerprint-groups")
    nodes = nodes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    nodes = keep(nodes.select("fp", "least", "component"), "fingerprint-components")
    least = keep(nodes.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    named = keep(nodes.join(least, "component").select("fp", "component_id"), "fingerprint-names")
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
