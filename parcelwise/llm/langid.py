"""Language ID: one interpolated Kneser-Ney character model per language, in sorted hash arrays.

A model predicts the letters of a word and its end from up to ``order - 1`` characters before, the word's start
included. All its n-grams lie in one sorted array of 64-bit hashes, beside the interpolated log probability and
the log back-off weight. A text gets the language of least cross-entropy per predicted character; a text whose
least cross-entropy lies above what calibration texts of that length and language reach is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import keep

_LETTERS = regex.compile(r"\p{L}+")
_START, _END = 1, 2
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 100_000
_CACHE_CHARS = 1 << 16  # of words that are scored together
_ROWS = 200  # texts that are scored together
_BUCKETS = 24  # lengths by powers of two, for calibration
_POOL, _QUANTILE = 100, 0.99  # calibration texts that a limit is taken from at least, and how many of them it lets pass


def words_of(text: str | None) -> Counter:
    """Lower-cased runs of letters with their counts."""
    return Counter(_LETTERS.findall(text.lower())) if text else Counter()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Places at which a character is predicted, over all words joined.

    Returns each place's word, its longest usable n-gram length, and the hashes of its n-grams of length
    1..order and of their contexts (those of length 0..order - 1; length 0 hashes to 0).
    """
    joined = "".join(f"\x01{w}\x02" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    within = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    hashes = [np.zeros(len(codes), np.uint64)]
    mixed = _scramble((codes + np.uint64(1)) * _PRIME)
    run = np.zeros(len(codes), np.uint64)
    for n in range(1, order + 1):
        # hash of the n characters that end here; shifts make places matter
        back = np.concatenate((np.zeros(n - 1, np.uint64), mixed[: len(mixed) - n + 1]))
        run = _scramble(run * _PRIME + back + np.uint64(n)) if n > 1 else _scramble(back + np.uint64(1))
        hashes.append(run)
    place = within > 0
    usable = np.minimum(within + 1, order)
    grams = [h[place] for h in hashes[1:]]
    contexts = [np.concatenate((np.zeros(1, np.uint64), h[:-1]))[place] for h in hashes[:-1]]
    return word[place], usable[place], grams, contexts


def _tally(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their weights, and each row's place among them."""
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(back, weights, len(distinct)), back


def fit(words: Counter, order: int = 5, characters: int = 1 << 16) -> dict[str, np.ndarray]:
    """Sorted hash arrays of one language: hash, logp (natural log, interpolated), backoff.

    The longest n-grams keep their counts; shorter ones count the distinct characters before them, except those
    that begin at the word's start, which nothing precedes. Discounts are n1 / (n1 + 2 n2) for each length; the
    lowest length is interpolated with a uniform share of ``characters``.
    """
    names = list(words)
    word, usable, grams, contexts = _grams(names, order)
    times = np.array([words[w] for w in names], float)[word]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lower: dict[int, float] = {}
    for n in range(1, order + 1):
        fits = usable >= n
        if not fits.any():
            break
        gram, context = grams[n - 1][fits], contexts[n - 1][fits]
        if n < order:
            # distinct characters before: distinct (n+1)-grams that end here; a gram at the word's start counts itself
            begins = usable[fits] == n
            longer = np.where(begins, _scramble(gram ^ np.uint64(n)), grams[n][fits])
            weight = np.zeros(len(gram))
            weight[np.unique(longer, return_index=True)[1]] = 1.0
            weight = np.where(begins, times[fits], weight)
        else:
            weight = times[fits]
        keys, count, back = _tally(gram, weight)
        first = np.unique(back, return_index=True)[1]
        heads = context[first]
        head, total, at = _tally(heads, count)
        discount = (n1 := (count == 1).sum()) / max(1, n1 + 2 * (count == 2).sum())
        discount = min(max(discount, 0.1), 0.9)
        kinds = np.bincount(at, minlength=len(head))
        gamma = discount * kinds / total
        if n == 1:
            below = np.full(len(keys), 1.0 / characters)
        else:
            shorter = grams[n - 2][fits][first]
            below = np.exp(found[-1][1][np.searchsorted(found[-1][0], shorter)])
        p = np.maximum(count - discount, 0) / total[at] + gamma[at] * below
        found.append((keys, np.log(p), np.zeros(len(keys))))
        if n == 1:
            lower["start"] = float(np.log(gamma[0]))
        else:
            keys_below, logp, _ = found[-2]
            place = np.searchsorted(keys_below, head)
            known = (place < len(keys_below)) & (keys_below[np.minimum(place, len(keys_below) - 1)] == head)
            found[-2][2][place[known]] = np.log(gamma[known])
            # the word's start is a context but never predicted: it joins the arrays with no probability of its own
            extra = ~known
            if extra.any():
                merged = np.concatenate((keys_below, head[extra]))
                turn = np.argsort(merged)
                found[-2] = (
                    merged[turn], np.concatenate((logp, np.full(extra.sum(), -np.inf)))[turn],
                    np.concatenate((found[-2][2], np.log(gamma[extra])))[turn],
                )
    keys = np.concatenate([f[0] for f in found])
    turn = np.argsort(keys)
    return {
        "hash": keys[turn], "logp": np.concatenate([f[1] for f in found])[turn].astype(np.float32),
        "backoff": np.concatenate([f[2] for f in found])[turn].astype(np.float32),
        "floor": np.array([lower["start"] - np.log(characters)], np.float32),
    }


def _find(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return np.where(hashes[at] == keys, at, -1)


def word_costs(words: list[str], models: list[dict], order: int) -> np.ndarray:
    """Nats that each model (column) needs for each word (row) and its end."""
    word, usable, grams, contexts = _grams(words, order)
    out = np.zeros((len(words), len(models)))
    for m, model in enumerate(models):
        cost = np.zeros(len(word))
        open_ = np.arange(len(word))
        for n in range(order, 0, -1):
            fits = usable[open_] >= n
            asked = open_[fits]
            at = _find(model["hash"], grams[n - 1][asked])
            logp = np.where(at >= 0, model["logp"][at], -np.inf)
            hit = logp > -np.inf
            cost[asked[hit]] -= logp[hit]
            missed = asked[~hit]
            if n > 1 and len(missed):
                before = _find(model["hash"], contexts[n - 1][missed])
                cost[missed] -= np.where(before >= 0, model["backoff"][before], 0.0)
            open_ = np.concatenate((open_[~fits], missed))
        cost[open_] -= model["floor"][0]
        out[:, m] = np.bincount(word, cost, len(words))
    return out


class Scorer:
    """Cross-entropy per predicted character of texts under every model; a task keeps the words it has seen."""

    def __init__(self, models: list[dict], order: int):
        self.models, self.order = models, order
        self.seen: dict[str, int] = {}  # word to its row in held
        self.held = np.zeros((0, len(models)), np.float32)

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per predicted character by model, predicted characters) of each text."""
        counted = [words_of(t) for t in texts]
        fresh = {w for c in counted for w in c if w not in self.seen}
        if len(self.seen) + len(fresh) > _CACHE_WORDS:
            self.seen, self.held = {}, self.held[:0]
            fresh = {w for c in counted for w in c}
        self._score(list(fresh))
        total, length = np.zeros((len(texts), len(self.models))), np.zeros(len(texts), np.int64)
        for k, words in enumerate(counted):
            if words:
                rows = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
                times = np.fromiter(words.values(), np.float64, len(words))
                total[k] = times @ self.held[rows]
                length[k] = times @ (np.fromiter(map(len, words), np.float64, len(words)) + 1)
        return total / np.maximum(length, 1)[:, None], length

    def _score(self, words: list[str]) -> None:
        at, parts = 0, [self.held]
        while at < len(words):  # by characters, so that one very long word or many short ones take the same room
            end, room = at, _CACHE_CHARS
            while end < len(words) and (room > 0 or end == at):
                room -= len(words[end]) + 2
                end += 1
            parts.append(word_costs(words[at:end], self.models, self.order).astype(np.float32))
            at = end
        start = len(self.held)
        self.seen.update(zip(words, range(start, start + len(words)), strict=True))
        self.held = np.concatenate(parts)


def held_out(doc_id: Column) -> Column:
    """CRC-32 of the id as text, modulo 4, is 2. A missing id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def _bucket(length: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(length, 1)).astype(int), _BUCKETS - 1)


def _limits(cost: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Highest cost accepted by bucket of length: a quantile over its texts and the nearest in length, so that a garbled text or two lift nothing."""
    limit, bucket = np.full(_BUCKETS, np.inf), _bucket(length)
    for b in range(_BUCKETS) if len(cost) else ():
        near = np.argsort(np.abs(bucket - b), kind="stable")[: max(_POOL, int((bucket == b).sum()))]
        limit[b] = np.quantile(cost[near], _QUANTILE, method="lower")
    return np.maximum.accumulate(limit[::-1])[::-1] + 1.0


def train(docs: DataFrame, sample_chars: int = 1_500_000, order: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[dict]:
    """One model per language of the rows that are not held out, from about ``sample_chars`` characters of each.

    The sample takes whole texts by a hash of id and text, at a rate from the language's total, and the first by
    that hash always, so that no language of few long texts is lost; four fifths of it
    fit the model, a fifth calibrates the rejection: a high quantile of the cross-entropy (nats per character) by length,
    one nat added, never falling with shorter texts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    totals = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.min(draw).alias("first"))
    totals = keep(totals.select("lang", "first", F.least(F.lit(1.0), sample_chars / F.col("chars")).alias("rate")), "languages")
    picked = rows.join(totals, "lang").filter((draw <= F.col("rate") * (1 << 30)) | (draw == F.col("first"))).select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(5)).alias("fold"))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        spare = part["fold"] == 0
        spare = spare if (~spare).any() else part["fold"] < 0
        words: Counter = Counter()
        for text in part.loc[~spare, "text"]:
            words.update(words_of(text))
        model = fit(words, order)
        cost, length = Scorer([model], order).costs(part.loc[spare, "text"].tolist())
        limit = _limits(cost[:, 0], length)
        arrays = {k: v.tobytes() for k, v in model.items()}
        return pd.DataFrame([{"lang": part["lang"].iat[0], **arrays, "limit": limit.tobytes()}])

    kinds = "lang string, hash binary, logp binary, backoff binary, floor binary, limit binary"
    found = picked.groupBy("lang").applyInPandas(learn, kinds)
    types = {"hash": np.uint64, "logp": np.float32, "backoff": np.float32, "floor": np.float32, "limit": np.float64}
    rows = sorted(found.collect(), key=lambda r: r["lang"])  # a model's size follows sample_chars
    return [{"lang": r["lang"], **{k: np.frombuffer(bytes(r[k]), t) for k, t in types.items()}} for r in rows]


def identify(docs: DataFrame, models: list[dict], order: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected): one row per input row, from the text alone.

    ``score`` is the share of the best language when each weighs exp(-20 x its nats per character). A null text,
    one without a letter, or no models at all: ``und``, score 0, rejected. Otherwise ``rejected`` marks texts less
    likely than calibration texts of their length. Equal costs go to the language first in order.
    """
    langs = [m["lang"] for m in models]
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample they were fitted on
    limits = np.stack([m["limit"] for m in models]) if models else np.zeros((0, _BUCKETS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, order)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                ids, texts = batch.column(0).slice(at, _ROWS), batch.column(1).slice(at, _ROWS).to_pylist()
                if not langs:
                    cost, length, best = np.zeros((len(texts), 1)), np.zeros(len(texts), np.int64), np.zeros(len(texts), int)
                else:
                    cost, length = scorer.costs(texts)
                    best = cost.argmin(axis=1)
                known = length > 0
                weigh = np.exp(-20 * (cost - cost.min(axis=1, keepdims=True)))
                least = cost[np.arange(len(best)), best]
                reject = ~known
                if langs:
                    reject |= least > limits[best, _bucket(length)]
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([langs[b] if k else "und" for b, k in zip(best, known, strict=True)]),
                    pa.array(np.where(known, 1 / weigh.sum(axis=1), 0.0)), pa.array(np.where(known, least, 0.0)), pa.array(reject),
                ], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")


def accepted(docs: DataFrame, models: list[dict], order: int = 5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``identify`` doesn't reject, all columns unchanged."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # column names may repeat or clash
    text = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    limits = np.stack([m["limit"] for m in models]) if models else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, order)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                if limits is None:
                    continue
                cost, length = scorer.costs(part.column(text).to_pylist())
                best = cost.argmin(axis=1)
                fine = (length > 0) & (cost[np.arange(len(best)), best] <= limits[best, _bucket(length)])
                yield part.filter(pa.array(fine))

    renamed = docs.toDF(*names)
    return renamed.mapInArrow(run, renamed.schema).toDF(*docs.columns)


def identify_languages(docs: DataFrame, sample_chars: int = 1_500_000, order: int = 5) -> DataFrame:
    """``docs`` (doc_id, text, lang) trained on and predicted: the rows of ``identify`` with held_out.

    ``und`` where the text is null or has no letter. Rows without a language, or an empty table, teach nothing.
    Other columns are not read; repeated rows get a row each.
    """
    found = identify(docs, train(docs, sample_chars, order), order)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
