"""Substring dedup: recurring passages, found by Aho-Corasick automata over recurring phrases.

1. **Phrases.** Each run of ``window`` words holds ``window - phrase + 1`` phrases of ``phrase`` words; the one with
   the least hash is its anchor. Equal windows have equal anchors. Anchors are counted over all documents.
2. **Automata.** Anchors that occur once cannot lie in a recurring window. The others are compiled into one
   Aho-Corasick automaton for each shard of documents, with the phrases that the shard needs, and all its
   documents are streamed through it: every place of every recurring phrase.
3. **Confirmation.** The windows around those places are compared by 128 bits of hash; for each that recurs, the
   first start (smallest doc_id, then place) is found.
4. **Removal.** Words covered by a window that is not the first of its kind go.

Documents with the very same words as one with a smaller id add nothing but their own removal, so only the first of
them enters steps 1 to 3. Of rows that share id and text, one enters; what is found for it holds for all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import as_bytes, keep

_BASE, _PRIME, _OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93  # odd, so each has an inverse
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20  # bytes of a text that are hashed at once
_SHARD_BYTES = 4 << 20  # of text under one automaton


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.bases, self.held = (base, pow(base, -1, 1 << 64)), [np.ones(1, np.uint64)] * 2

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[0]) < n:
            size = 1 << max(12, (n - 1).bit_length())
            steps = [np.full(size, b, np.uint64) for b in self.bases]
            for s in steps:
                s[0] = 1
            self.held = [np.cumprod(s, dtype=np.uint64) for s in steps]
        return self.held[0][:n], self.held[1][:n]


class Hasher:
    """Word and word-run hashes of texts: differences of running sums, so a run of any length costs the same."""

    def __init__(self) -> None:
        self.of_bytes, self.of_words, self.of_other = _Powers(_BASE), _Powers(_PRIME), _Powers(_OTHER)

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and length in bytes of each word."""
        hashes, lengths, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        while at < len(raw):
            cut = _BREAK.search(raw, min(at + _PIECE, len(raw)))
            end = cut.start() if cut else len(raw)
            codes = np.frombuffer(raw, np.uint8, end - at, at)
            space = np.concatenate(([True], _SPACE[codes], [True]))
            edge = np.flatnonzero(space[1:] != space[:-1])
            first, last = edge[::2], edge[1::2]
            up, down = self.of_bytes(len(codes) + 1)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
            hashes.append(_scramble((sums[last] - sums[first]) * down[first]))
            lengths.append(last - first)
            at = end
        return np.concatenate(hashes), np.concatenate(lengths)

    def runs(self, hashes: np.ndarray, n: int, other: bool = False) -> np.ndarray:
        """Hash of each run of n words."""
        total = len(hashes) - n + 1
        if total <= 0:
            return np.zeros(0, np.uint64)
        up, down = (self.of_other if other else self.of_words)(len(hashes) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)))
        return _scramble((sums[n:] - sums[:total]) * down[:total])


def _anchors(phrases: np.ndarray, wide: int) -> np.ndarray:
    """Place of the least phrase hash (the first of equals) under each window of ``wide`` phrases."""
    if len(phrases) < wide:
        return np.zeros(0, np.int64)
    # least of a window of any width by doubling
    value, place, span = phrases, np.arange(len(phrases)), 1
    while span < wide:
        step = min(span, wide - span)
        a, b = value[: len(value) - step], value[step:]
        left = a <= b
        place = np.where(left, place[: len(a)], place[step:])
        value = np.where(left, a, b)
        span += step
    return place


def _automaton(phrases: set[bytes]):
    out = ahocorasick.Automaton()
    for p in phrases:
        text = f" {p.decode('latin-1')} "
        out.add_word(text, len(text) - 1)
    out.make_automaton()
    return out


def _located(line: bytes, starts: np.ndarray, automaton) -> np.ndarray:
    """Word places at which a phrase of the automaton starts; ``starts`` are the words' places in ``line``."""
    # phrase and line have a space on both sides, so a phrase starts where its leading space is in the padded line
    found = [end - size for end, size in automaton.iter(f" {line.decode('latin-1')} ")]
    return np.searchsorted(starts, np.array(found, np.int64))


def _runs(starts: np.ndarray, total: int, window: int) -> np.ndarray:
    """Whether each of ``total`` words is covered by a window at one of ``starts``."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, total), -1)
    return np.cumsum(edge)[:total] > 0


def _split_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in order, in tables of about ``size`` bytes."""
    held, room = [], size
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, max(1, min(256, batch.num_rows - at)))
            held.append(part)
            at, room = at + part.num_rows, room - part.nbytes
            if room <= 0:
                yield pa.Table.from_batches(held)
                held, room = [], size
    if held:
        yield pa.Table.from_batches(held)


_FOUND = pa.schema([("route", pa.int64()), ("asks", pa.bool_()), *((k, pa.binary()) for k in ("w1", "w2", "did", "tk", "start"))])
_FOUND_SQL = "route long, asks boolean, w1 binary, w2 binary, did binary, tk binary, start binary"


def _gone_rows(did: np.ndarray, tk: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """One row per document: its removed starts as a list."""
    at = np.lexsort((start, tk, did))
    did, tk, start = did[at], tk[at], start[at]
    heads = np.concatenate(([0], np.flatnonzero((np.diff(did) != 0) | (np.diff(tk) != 0)) + 1)) if len(did) else np.zeros(0, np.int64)
    ends = np.concatenate((heads, [len(did)])).astype(np.int32)
    return did[heads], tk[heads], pa.ListArray.from_arrays(pa.array(ends), pa.array(start.astype(np.int32)))


def _first_of_each(w1: np.ndarray, w2: np.ndarray, did: np.ndarray) -> np.ndarray:
    """For each row, the smallest did among the rows with its (w1, w2)."""
    at = np.lexsort((did, w2, w1))
    fresh = np.concatenate(([True], (np.diff(w1[at]) != 0) | (np.diff(w2[at]) != 0))) if len(at) else np.zeros(0, bool)
    out = np.empty(len(at), np.int64)
    out[at] = did[at][np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(at) else out
    return out


def _packed(asks: bool, columns: list[np.ndarray], routes: int) -> list[dict]:
    """One row per route: the arrays as bytes. Windows are routed by w1, known repeats by id and text."""
    did, tk = columns[2].view(np.uint64), columns[3].view(np.uint64)
    route = (columns[0].view(np.uint64) if asks else _scramble(did) ^ tk) % np.uint64(routes)
    order = np.argsort(route, kind="stable")
    route, columns = route[order], [c[order] for c in columns]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(route)) + 1, [len(route)])) if len(route) else np.zeros(1, np.int64)
    names = _FOUND.names[2:]
    return [
        {"route": int(route[a]), "asks": asks, **{n: c[a:b].tobytes() for n, c in zip(names, columns, strict=True) if asks or n[0] != "w"}}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
    ]


def _windows_of_shard(table: pa.Table, window: int, phrase: int, routes: int, hasher: Hasher) -> pa.RecordBatch:
    """Recurring windows of one shard of documents, packed by route.

    A window that ``asks`` wants to know whether it starts at a smaller doc_id elsewhere. Within the shard only
    the smallest doc_id of a window asks; its other documents, and later places of one document, are already
    known to be repeats.
    """
    wide = window - phrase + 1
    docs, phrases = [], set()
    for text, anchors in zip(table.column("text"), table.column("anchors"), strict=True):
        raw = text.as_py()
        hashes, lengths = hasher.words(raw)
        line, starts = b" ".join(raw.split()), np.concatenate(([0], np.cumsum(lengths + 1)))
        grams = hasher.runs(hashes, phrase)
        places = _anchors(grams, wide)
        distinct = np.unique(places)
        wanted = distinct[np.isin(grams[distinct].view(np.int64), anchors.values.to_numpy())]
        phrases.update(line[a:b] for a, b in zip(starts[wanted].tolist(), (starts[wanted + phrase] - 1).tolist(), strict=True))
        docs.append((line, starts, hashes, places))
    automaton = _automaton(phrases)
    parts = []
    ids, keys = table.column("did").to_numpy(), table.column("tk").to_numpy()
    for k, (line, starts, hashes, places) in enumerate(docs):
        if not phrases or not len(places):
            continue
        hit = np.zeros(len(starts), bool)
        hit[_located(line, starts, automaton)] = True
        at = np.flatnonzero(hit[places])
        w1, w2 = (hasher.runs(hashes, window, other)[at].view(np.int64) for other in (False, True))
        parts.append((w1, w2, np.full(len(at), ids[k]), np.full(len(at), keys[k]), at.astype(np.int32)))
    if not sum(len(p[0]) for p in parts):
        return pa.RecordBatch.from_pylist([], schema=_FOUND)
    w1, w2, did, tk, start = (np.concatenate(c) for c in zip(*parts, strict=True))
    # the first place of a window in its document stands for the document
    at = np.lexsort((start, tk, did, w2, w1))
    w1, w2, did, tk, start = (c[at] for c in (w1, w2, did, tk, start))
    fresh = np.concatenate(([True], (np.diff(w1) != 0) | (np.diff(w2) != 0)))
    again = ~fresh & np.concatenate(([False], (np.diff(did) == 0) & (np.diff(tk) == 0)))
    ask = ~again & (did == did[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]])
    rows = [_packed(asks, [c[which] for c in (w1, w2, did, tk, start)], routes) for asks, which in ((True, ask), (False, ~ask))]
    return pa.RecordBatch.from_pylist(rows[0] + rows[1], schema=_FOUND)


def _column(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in rows.column(name)), kind)


def _answers(table: pa.Table, routes: int) -> pa.RecordBatch:
    """Repeats among the windows whose hash lies in this partition, and those already known, packed by document."""
    asked, told = table.filter(table.column("asks")), table.filter(pa.compute.invert(table.column("asks")))
    w1, w2, did = (_column(asked, c, np.int64) for c in ("w1", "w2", "did"))
    late = did > _first_of_each(w1, w2, did)
    gone = [np.concatenate((_column(asked, c, kind)[late], _column(told, c, kind))) for c, kind in (("did", np.int64), ("tk", np.int64), ("start", np.int32))]
    none = np.zeros(len(gone[0]), np.int64)
    return pa.RecordBatch.from_pylist(_packed(False, [none, none, *gone], routes), schema=_FOUND)


def _of_documents(table: pa.Table) -> pa.RecordBatch:
    """(did, tk, gone): one row per document, all whose repeats meet in this partition."""
    did, tk, gone = _gone_rows(_column(table, "did", np.int64), _column(table, "tk", np.int64), _column(table, "start", np.int32))
    return pa.RecordBatch.from_arrays([pa.array(did), pa.array(tk), gone], ["did", "tk", "gone"])


def substring_dedup(docs: DataFrame, window: int = 20, phrase: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row per input row.

    Words are runs of anything but space and the control characters 9 to 13, unchanged; null: none. A word goes if
    a window of ``window`` consecutive words covers it whose words also start earlier: at a smaller doc_id, or
    earlier in the same row. Windows are judged on the input. ``kept_text`` has the kept words, joined by one
    space. A null doc_id comes before all others. Rows that share a doc_id are not earlier than each other. Texts
    shorter than a window keep all words. Other columns are not read; an empty table gives no rows.
    """
    if not 1 <= phrase < window:
        raise ValueError("a phrase is shorter than a window")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64(text).alias("tk"), text.alias("text"))

    routes = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            count, same, twice, lists = [], [], [], []
            for raw in as_bytes(batch.column(2)):
                hashes, lengths = hasher.words(raw.as_py())
                phrases = hasher.runs(hashes, phrase)
                found = phrases[np.unique(_anchors(phrases, window - phrase + 1))]
                distinct = np.unique(found)
                count.append(len(hashes))
                same.append(hashlib.sha256(hashes.tobytes() + lengths.tobytes()).digest())
                twice.append(len(distinct) < len(found))
                lists.append(distinct.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(same, pa.binary()), pa.array(twice, pa.bool_()), pa.array(lists, pa.list_(pa.int64()))],
                ["did", "tk", "n_words", "same", "twice", "anchors"],
            )

    scanned = keep(rows.mapInArrow(scan, "did long, tk long, n_words long, same binary, twice boolean, anchors array<long>"), "anchors")
    firsts = keep(scanned.groupBy("same").agg(F.min("did").alias("first"), F.count("*").alias("n")).filter("n > 1"), "same-words")
    copies = scanned.join(firsts, "same").filter("did > first").select("did", "tk").distinct()
    copies = keep(copies, "copies")
    anchors = scanned.join(copies, ["did", "tk"], "left_anti").select("did", "tk", "twice", F.explode("anchors").alias("anchor"))
    # repeated rows (same did, same tk) are one place, so places are told apart by their hash and not counted
    place = F.xxhash64("did", "tk")
    often = anchors.groupBy("anchor").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.bool_or("twice").alias("twice"))
    often = often.filter("low < high or twice")
    often = keep(often.select("anchor"), "recurring-phrases")
    needs = anchors.join(often, "anchor").groupBy("did", "tk").agg(F.collect_set("anchor").alias("anchors"), F.count("*").alias("n"))
    # a row lists an anchor once, so a document with more of them than distinct ones is a repeated row
    needs = keep(needs.select("did", "tk", "anchors", (F.col("n") > F.size("anchors")).alias("repeated")), "phrases-of-documents")
    repeated = keep(needs.filter("repeated"), "phrases-of-repeated-rows")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for table in _split_batches(batches, _SHARD_BYTES):
            yield _windows_of_shard(table.set_column(2, "text", table.column("text").cast(pa.large_binary())), window, phrase, routes, hasher)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield _answers(pa.Table.from_batches(held), routes)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield _of_documents(pa.Table.from_batches(held))

    shards = rows.join(needs.filter("not repeated"), ["did", "tk"]).select("did", "tk", "text", "anchors")
    if not repeated.isEmpty():
        one = rows.join(repeated.select("did", "tk"), ["did", "tk"]).groupBy("did", "tk").agg(F.any_value("text").alias("text"))
        shards = shards.unionByName(one.join(repeated, ["did", "tk"]).select("did", "tk", "text", "anchors"))
    found = shards.mapInArrow(locate, _FOUND_SQL)
    repeats = found.repartition("route").mapInArrow(answer, _FOUND_SQL)
    gone = repeats.repartition("route").mapInArrow(gather, "did long, tk long, gone array<int>")
    gone = gone.unionByName(copies.withColumn("gone", F.lit(None).cast("array<int>")).withColumn("copy", F.lit(True)), allowMissingColumns=True)
    gone = keep(gone, "removed-windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for raw, starts, copy in zip(as_bytes(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                words = raw.as_py().split()
                gone_ = np.zeros(len(words), bool)
                if copy.is_valid and len(words) >= window:
                    gone_[:] = True
                elif starts.is_valid and len(starts):
                    gone_ = _runs(starts.values.to_numpy(), len(words), window)
                total.append(len(words))
                removed.append(int(gone_.sum()))
                kept.append(b" ".join(words if not removed[-1] else [w for w, g in zip(words, gone_.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(batch.column(1).type)],
                ["did", "n_words", "n_removed", "kept_text"],
            )

    out = rows.join(gone, ["did", "tk"], "left").select("did", "text", "gone", "copy")
    out = out.mapInArrow(cut, "did long, n_words long, n_removed long, kept_text string")
    return out.select(F.when(F.col("did") > -(1 << 63), F.col("did")).alias("doc_id"), "n_words", "n_removed", "kept_text")
