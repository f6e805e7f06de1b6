"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

The texts of a batch are merged in lockstep. One NumPy vector holds a pointer pair (A token, B token) for every
lane; each step emits the pairs as links, records a cut where both tokens end at the same byte, and moves the
pointer whose token ends first, or both. Finished lanes are compacted away. A document is a lane, a long one
several: a lane starts at any A token and at the B token that holds its first byte, so no link is lost or made
twice and the number of steps does not follow the longest text.

Counts of id pairs over the corpus go through blocks of documents: a block lists its distinct pairs once, the
documents refer to that list, and only the lists are joined with the corpus counts.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import keep

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"

# fixed value: the public pattern by which byte-level BPE of this family cuts a text into pieces
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LANE = 256  # A tokens of a lane
_BATCH_CHARS, _BLOCK_CHARS = 2_000_000, 16_000_000
_LONG_SPACE = re.compile(r"\s{4096}")

_LISTS = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("entries", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32())),
])
_LISTS_SQL = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "entries array<int>, times array<int>, pairs array<long>, docs array<int>"
)
_OUT_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# --- the two tokenizers -------------------------------------------------------------------------


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in turn."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE given as JSON. Ids by ``encode``, each id's bytes in ``bytes_of``.

    Where the merges are numbered in the order of their rank, as usual, the ranks are those of the ids and a
    faster encoder of the same ids takes them; texts with very long runs of white space, and files with
    another order or pre-tokenizer, go through the ``tokenizers`` library. No special token is looked for.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            text = file.read()
        model = json.loads(text)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        table = byte_of_char()
        ranks = {bytes(table[c] for c in word): number for word, number in vocab.items()}
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for word, number in ranks.items():
            self.bytes_of[number] = word
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        before = model["pre_tokenizer"] or {}
        plain = all(vocab.get(m) == 256 + k for k, m in enumerate(joined)) and len(vocab) == 256 + len(joined) and model["normalizer"] is None
        self._fast = None
        if plain and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            self._fast = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._slow = Tokenizer.from_str(text)
        self._slow.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        if self._fast and not (len(text) >= 4096 and _LONG_SPACE.search(text)):
            return self._fast(text)
        return self._slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model that puts a space before a text. Ids by ``encode``, each id's bytes in ``bytes_of``."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [self._bytes(k) for k in range(self._model.vocab_size())]

    def _bytes(self, number: int) -> bytes:
        piece = self._model.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self._model.is_byte(number) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def _loaded(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces, list[bytes]]:
    """Both tokenizers and the written form of every id, kept by the worker process from task to task."""
    store = sys.modules.setdefault("_tokenizers_of_this_worker", types.ModuleType("_tokenizers_of_this_worker"))
    if (a_path, b_path) not in store.__dict__:
        a, b = ByteLevel(a_path), Pieces(b_path)
        written = [f"{k}{end}".encode() for ids in (a.bytes_of, b.bytes_of) for k in range(len(ids)) for end in ",|;"]
        store.__dict__[a_path, b_path] = a, b, written
    return store.__dict__[a_path, b_path]


# --- one batch ----------------------------------------------------------------------------------


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links (A tokens, B tokens) and cuts (A tokens, B tokens) of the lanes from A token ``first`` up to, not with, ``last``.

    ``ends_a`` and ``ends_b`` are ascending byte ends of all tokens of the batch, over one numbering of its bytes.
    """
    a, stop = first, last
    start = np.where(a > 0, ends_a[a - 1], 0)
    b = np.searchsorted(ends_b, start, side="right")
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(a):
        links_a.append(a)
        links_b.append(b)
        end_a, end_b = ends_a[a], ends_b[b]
        both = end_a == end_b
        cuts_a.append(a[both])
        cuts_b.append(b[both])
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        open_ = a < stop
        if not open_.all():
            a, b, stop = a[open_], b[open_], stop[open_]
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (links_a, links_b, cuts_a, cuts_b))


def lanes(offsets: np.ndarray, longest: int = _LANE) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) A token of each lane; ``offsets`` are the documents' first A tokens and the total."""
    n = -(-np.diff(offsets) // longest)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(offsets[:-1], n) + number * longest
    return first, np.minimum(first + longest, np.repeat(offsets[1:], n))


def _flat(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
    return np.fromiter((i for x in lists for i in x), np.int64, int(offsets[-1])), offsets


def align_batch(texts: Sequence[str | None], a: ByteLevel, b: Pieces, written: list[bytes]) -> dict[str, list | np.ndarray]:
    """n_a, n_b, n_groups, n_links and groups_sha256 of each text, and its distinct id pairs: pairs, times, and pairs' ``starts``.

    A pair is A id x (number of B ids) + B id. Null and empty texts, and texts that a tokenizer does not give
    back byte by byte, have no tokens.
    """
    ids_a = [a.encode(" " + t) if t else [] for t in texts]
    ids_b = b.encode([t or "" for t in texts]) if len(texts) else []
    for k, t in enumerate(texts):
        own = (" " + (t or "")).encode()
        if not t or b"".join(map(a.bytes_of.__getitem__, ids_a[k])) != own or b"".join(map(b.bytes_of.__getitem__, ids_b[k])) != own:
            ids_a[k], ids_b[k] = [], []
    (ta, oa), (tb, ob) = _flat(ids_a), _flat(ids_b)
    n, base = len(texts), len(b.bytes_of)
    ends_a = np.cumsum(np.array([len(x) for x in a.bytes_of], np.int64)[ta])
    ends_b = np.cumsum(np.array([len(x) for x in b.bytes_of], np.int64)[tb])
    la, lb, ca, cb = lockstep(ends_a, ends_b, *lanes(oa))
    doc = np.repeat(np.arange(n), np.diff(oa))
    keys = doc[la] * (len(a.bytes_of) * base) + ta[la] * base + tb[lb]
    keys, times = np.unique(keys, return_counts=True)
    of, pairs = np.divmod(keys, len(a.bytes_of) * base)

    # groups: the tokens in the order A of the first group, B of the first group, A of the second, ...
    ca, cb = np.sort(ca), np.sort(cb)
    last_a, last_b = np.zeros(len(ta), np.int64), np.zeros(len(tb), np.int64)
    last_a[ca], last_b[cb] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    order = np.empty(len(ta) + len(tb), np.int64)
    order[np.arange(len(ta)) + np.concatenate(([0], cb + 1))[group_a]] = ta * 3 + last_a
    order[np.arange(len(tb)) + (ca + 1)[group_b]] = (len(a.bytes_of) + tb) * 3 + 2 * last_b
    hashes = []
    for k in range(n):
        part = order[oa[k] + ob[k] : oa[k + 1] + ob[k + 1]].tolist()
        hashes.append(hashlib.sha256(b"".join(map(written.__getitem__, part))[:-1]).hexdigest() if part else "")
    return {
        "n_a": np.diff(oa), "n_b": np.diff(ob), "n_groups": np.bincount(doc[ca], minlength=n), "n_links": np.bincount(doc[la], minlength=n),
        "groups_sha256": hashes, "pairs": pairs, "times": times, "starts": np.searchsorted(of, np.arange(n + 1)),
    }


# --- blocks -------------------------------------------------------------------------------------


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, int]]:
    """Ids and texts in runs of about ``_BATCH_CHARS``, with their characters."""
    ids, texts, chars = [], [], 0
    for part in parts:
        for number, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            ids.append(number)
            texts.append(text.as_py())
            chars += len(texts[-1] or "")
            if chars >= _BATCH_CHARS:
                yield ids, texts, chars
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts, chars


def _block(number: int, rows: list[tuple[list, dict]]) -> Iterator[pa.RecordBatch]:
    """The documents' rows of a block, then the row with its list of distinct pairs."""
    pairs = np.concatenate([r["pairs"] for _, r in rows])
    distinct, entries, docs = np.unique(pairs, return_inverse=True, return_counts=True)
    at = 0
    for ids, r in rows:
        n, total = len(ids), len(r["pairs"])
        lists = pa.array(r["starts"], pa.int32())
        columns = {
            "block": pa.array(np.full(n, number)), "doc_id": pa.array(ids, pa.int64()), "groups_sha256": pa.array(r["groups_sha256"], pa.string()),
            "entries": pa.ListArray.from_arrays(lists, pa.array(entries[at : at + total], pa.int32())),
            "times": pa.ListArray.from_arrays(lists, pa.array(r["times"], pa.int32())),
        } | {c: pa.array(r[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}
        yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _LISTS], schema=_LISTS)
        at += total
    if len(distinct):
        whole = pa.array([0, len(distinct)], pa.int32())
        columns = {
            "block": pa.array([number]), "pairs": pa.ListArray.from_arrays(whole, pa.array(distinct, pa.int64())),
            "docs": pa.ListArray.from_arrays(whole, pa.array(docs, pa.int32())),
        }
        yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(1, f.type)) for f in _LISTS], schema=_LISTS)


def _lists(a_path: str, b_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, number = _loaded(a_path, b_path), TaskContext.get().partitionId() << 33
        rows, size = [], 0
        for ids, texts, chars in _batches(parts):
            rows.append((ids, align_batch(texts, *loaded)))
            size += chars
            if size >= _BLOCK_CHARS:
                yield from _block(number, rows)
                rows, size, number = [], 0, number + 1
        if rows:
            yield from _block(number, rows)

    return run


def _scored(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of a block's documents; ``counts`` has a row for each entry of the block's list."""
    counts = counts.sort_by("pair")
    count, best = counts["count"].to_numpy(), counts["best"].to_numpy()
    columns = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    entries, times = docs["entries"].combine_chunks(), docs["times"].combine_chunks().flatten().to_numpy()
    ends, at = np.cumsum(entries.value_lengths().to_numpy()), entries.flatten().to_numpy()

    def total(weights: np.ndarray) -> pa.Array:
        sums = np.concatenate(([0], np.cumsum(times * weights[at], dtype=np.int64)))[np.concatenate(([0], ends))]
        return pa.array(np.diff(sums), pa.int64())

    columns |= {"n_best": total(best.astype(np.int64)), "count_sum": total(count)}
    return pa.table([columns[name.split(" ")[0]] for name in _OUT_SQL.split(", ")], names=[name.split(" ")[0] for name in _OUT_SQL.split(", ")])


# --- the operator -------------------------------------------------------------------------------


def linked_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """Written table of :func:`align_batch` by document, with each block's list of distinct pairs as a row of its own."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return keep(rows.mapInArrow(_lists(a_path, b_path), _LISTS_SQL), "linked-pairs")


def pair_counts(lists: DataFrame, n_b_ids: int) -> DataFrame:
    """(pair, a_id, b_id, count, best): documents that hold an id pair linked, and whether no pair of its A id has more.

    An A id has at most as many pairs as there are B ids, which bounds the window.
    """
    held = lists.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    counts = held.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("count"))
    counts = counts.withColumn("a_id", F.expr(f"pair div {n_b_ids}")).withColumn("b_id", F.expr(f"pair % {n_b_ids}"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a_id")))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    A encodes a space and the text, B the text (and adds the space). Links are all pairs of an A and a B token
    whose bytes overlap; groups are what lies between the bytes at which both have a token's end. A pair's
    count is the number of rows that hold it linked; repeated rows count each, null ids too. Null and empty
    texts, and texts not given back byte by byte, have no tokens: zeros and an empty ``groups_sha256``. An
    empty table gives no rows. Other columns are not read and may have any name. A text is encoded and linked
    whole; a task holds about 16 million characters of links, or one longer text.
    """
    lists = linked_pairs(docs, id_col, text_col, a_path, b_path)
    counts = pair_counts(lists, len(_loaded(a_path, b_path)[1].bytes_of))
    entries = lists.filter("pairs is not null").select(F.col("block").alias("held_by"), F.explode("pairs").alias("pair"))
    entries = entries.join(counts.select("pair", "count", "best"), "pair")
    by_doc = lists.filter("pairs is null").drop("pairs", "docs")
    return by_doc.groupBy("block").cogroup(entries.groupBy("held_by")).applyInArrow(_scored, _OUT_SQL)
