"""Secret scan: candidates by pattern, false positives removed by a random forest on labelled findings.

Candidates are assigned values (``name = value``, the name quoted or not, six characters or more, of any kind inside quotes), passwords in URLs, values with a known
prefix, private keys from BEGIN to END and long runs of token characters.
The forest sees length, character transitions, dictionary coverage, whether the value or its surroundings look
like a path, and the neighbouring words; it is trained on findings with labels.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import keep

_VALUE = r"[A-Za-z0-9+/=_.~$@!%^&*-]"
_KEYS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "accesskey", "auth", "credential", "private_key", "privatekey")
_NAME = r"[A-Za-z0-9_.-]"
# a name is a whole run of its characters, so that no run is read again from each of its places
_NAMED = re.compile(rf"(?<!{_NAME})(?={_NAME}*?(?ai:{'|'.join(_KEYS)})){_NAME}++[\"'`]?\s*+(?:=>|=|:)\s*+(?:([\"'`])([^\s\"'`]{{6,}}+)\1|[\"'`]?({_VALUE}{{6,}}))")
_LONG = re.compile(r"\S{15,}")
_KNOWN = re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}|\bxox[abprs]-[A-Za-z0-9-]{10,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_BEGIN = "-----BEGIN "
_KEY_HEAD = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----")
_NOT_KEY = re.compile(r"[^A-Za-z0-9+/=:,.\s\\-]")
_URL = re.compile(r"(?<=://)[^\s/:@\"'`<>]*+:([^\s/@\"'`<>]{3,}+)@(?=[A-Za-z0-9\[])")
_ORDINARY = re.compile(r"(?<!\S)[^\W\d_]{12,}(?!\S)")
_WORDS = re.compile(r"[A-Za-z]{3,}")
_ASKS = frozenset("password passwd pwd secret token key apikey api auth credential credentials bearer private access login".split())
_DENIES = frozenset("example sample dummy placeholder test changeme your xxx sha sha1 sha256 md5 checksum commit digest hash uuid guid integrity version".split())
FEATURES = (
    "length", "entropy", "digits", "upper", "lower", "other", "switches", "repeats", "hex", "dictionary", "longest_word", "slashes", "dots",
    "path", "named", "known", "asks", "denies", "quoted",
)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def features(value: str, before: str, after: str, named: bool, known: bool, dictionary: frozenset[str]) -> list[float]:
    """The values of ``FEATURES`` for one candidate; ``before`` and ``after`` are the text around it."""
    n = len(value)
    counts = Counter(value)
    kinds = [_kind(c) for c in value]
    words = [w.lower() for w in _WORDS.findall(value)]
    covered = [len(w) for w in words if w in dictionary]
    near = {w.lower() for w in re.findall(r"[A-Za-z0-9]+", before[-80:] + " " + after[:40])}
    around = before[-1:] + value + after[:1]
    return [
        float(n), -sum(c / n * math.log2(c / n) for c in counts.values()), kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n,
        kinds.count(3) / n, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        sum(a == b for a, b in zip(value, value[1:], strict=False)) / max(1, n - 1), float(all(c in "0123456789abcdefABCDEF" for c in value)),
        sum(covered) / n, float(max(covered, default=0)), value.count("/") / n, value.count(".") / n,
        float(bool(re.search(r"(?:^|[\s\"'])(?:\.{0,2}/|[A-Za-z]:\\|https?:)", around))), float(named), float(known),
        float(len(near & _ASKS)), float(len(near & _DENIES)), float(before[-1:] in "\"'`" and before[-1:] != ""),
    ]


def _key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Private keys from BEGIN to END, the BEGIN line alone where no END follows or other characters stand before it.

    The next END of each kind and the next character that no key holds are looked for only once they are passed.
    """
    ends: dict[str, int] = {}
    foreign, at = -1, 0
    while head := _KEY_HEAD.search(text, at):
        at, end = head.end(), f"-----END {head[1]}-----"
        if ends.get(end, -1) < at:
            place = text.find(end, at)
            ends[end] = place if place >= 0 else len(text)
        if foreign < at:
            odd = _NOT_KEY.search(text, at)
            foreign = odd.start() if odd else len(text)
        if ends[end] < len(text) and ends[end] <= foreign:
            at = ends[end] + len(end)
        yield head.start(), at


def _apart(found: list[tuple[int, int, bool, bool]], text: str) -> list[tuple[int, int, bool, bool]]:
    """Of candidates that overlap, whole keys stay, then named ones, then known forms, then the first; in text order."""
    starts: list[int] = []
    kept: list[tuple[int, int, bool, bool]] = []  # apart from each other, so the one before a place is the only one to ask
    for span in sorted(found, key=lambda f: (not (f[3] and text.startswith(_BEGIN, f[0])), not f[2], not f[3], f[0])):
        at = bisect.bisect_left(starts, span[1])
        if not at or kept[at - 1][1] <= span[0]:
            starts.insert(at, span[0])
            kept.insert(at, span)
    return kept


def find(text: str) -> list[tuple[int, int, bool, bool]]:
    """Start, end, whether it is assigned to a secret's name, and whether its form is known, of each candidate.

    Plain searches come first, so patterns only meet the few places that can hold a candidate.
    """
    found = []
    low = text.lower()
    # lower-casing may change a text's length, so the search for names is only asked whether there are any
    if any(k in low for k in _KEYS):
        found += [(*m.span(m.lastindex), True, bool(_KNOWN.fullmatch(m[m.lastindex]))) for m in _NAMED.finditer(text)]
    if _BEGIN in text:
        found += [(*span, False, True) for span in _key_blocks(text)]
    if "://" in text:
        found += [(*m.span(1), True, bool(_KNOWN.fullmatch(m[1]))) for m in _URL.finditer(text)]
    for word in _LONG.finditer(text):
        at, value = word.start(), word[0]
        if "_" in value or "-" in value or "AKIA" in value or "ASIA" in value:
            found += [(at + m.start(), at + m.end(), False, True) for m in _KNOWN.finditer(value)]
        if any(c.isdigit() for c in value):
            found += [
                (at + m.start(), at + m.end(), False, False) for m in _RUN.finditer(value)
                if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])
            ]
    return _apart(found, text)


def candidates(
    docs: DataFrame, dictionary: frozenset[str] = frozenset(), id_col: str = "doc_id", text_col: str = "text", ordinary: bool = False
) -> DataFrame:
    """(doc_id, start, value, features), one row per candidate in the whole text; places count characters from 0.

    ``ordinary`` takes long words of the running text instead, which are examples of what is no secret. Null and empty texts have none. ``dictionary`` is a bounded set of common words. Repeated rows repeat theirs,
    null ids stay, other columns are not read, an empty table has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, values, rows = [], [], [], []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                for a, b, named, known in [(*m.span(), False, False) for m in _ORDINARY.finditer(text)] if ordinary else find(text):
                    ids.append(id_)
                    starts.append(a)
                    values.append(text[a:b])
                    rows.append(features(text[a:b], text[max(0, a - 100) : a], text[b : b + 50], named, known, dictionary))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(starts, pa.int64()), pa.array(values, pa.string()), pa.array(rows, pa.list_(pa.float64()))],
                ["doc_id", "start", "value", "features"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, start long, value string, features array<double>")


def common_words(docs: DataFrame, size: int = 5000, text_col: str = "text") -> frozenset[str]:
    """The ``size`` words of 3 to 20 letters that most documents use, ties by word: a bounded dictionary from the whole corpus.

    Empty where no text holds a word; a null text has none.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"\b([a-z]{3,20})\b"), F.lit(1)))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").count()
    return frozenset(r["word"] for r in counted.orderBy(F.desc("count"), "word").limit(size).collect())


def labelled(docs: DataFrame, dictionary: frozenset[str], sample_docs: int = 20_000, per_class: int = 20_000) -> DataFrame:
    """(features, label) from about ``sample_docs`` documents, for tables without reviewed findings.

    A value of a known form is a finding (1). One assigned to a secret's name is, too, unless its neighbours deny it,
    words cover it or it is a path; these and the long words of the running text are none (0). Candidates in between
    are left to the forest. Texts are drawn by a hash of id and text, findings by a hash of their features, so a
    rerun trains the same forest; rows without an id are drawn like others, repeated rows together. Null texts and
    empty tables have no findings.
    """
    total = docs.count()
    rate = int(min(1.0, sample_docs / max(total, 1)) * (1 << 30))
    picked = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) <= F.lit(rate)).select("doc_id", "text")
    f = lambda name: F.col("features")[FEATURES.index(name)]
    denied = (f("denies") > 0) | (f("path") > 0) | (f("dictionary") > 0.5) | (f("entropy") < 2)
    label = F.when(f("known") > 0, 1).when(denied, 0).when((f("named") > 0) & (f("length") >= 16) & (f("digits") > 0), 1)
    findings = candidates(picked, dictionary).select("features", label.alias("label")).filter("label is not null")
    words = candidates(picked, dictionary, ordinary=True).select("features", F.lit(0).alias("label"))
    words = words.filter(F.pmod(F.xxhash64("features"), F.lit(50)) == 0)
    first = lambda df: df.orderBy(F.xxhash64("features"), "features", "label").limit(per_class)
    return first(findings).unionByName(first(words))


def train(findings: DataFrame, trees: int = 40, depth: int = 8, sample_rows: int = 50_000, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest from ``findings`` (features, label 0/1); at most about ``sample_rows`` of them, by a hash. None without both labels."""
    known = findings.filter(F.col("label").isNotNull() & F.col("features").isNotNull())
    total = known.count()
    rate = min(1.0, sample_rows / max(total, 1))
    picked = known.filter(F.pmod(F.xxhash64("features"), F.lit(1 << 30)) <= F.lit(int(rate * (1 << 30))))
    rows = picked.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    rows = keep(rows, "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def scan(found: DataFrame, model: RandomForestClassificationModel | None, least: float = 0.5) -> DataFrame:
    """``found`` with p_secret and is_secret (p_secret of at least ``least``). Without a model every candidate is reported, at 1."""
    if model is None:
        return found.select("doc_id", "start", "value", F.lit(1.0).alias("p_secret"), F.lit(True).alias("is_secret"))
    rows = model.transform(found.withColumnRenamed("features", "values").withColumn("features", array_to_vector("values")))
    p = vector_to_array("probability")[1]
    return rows.select("doc_id", "start", "value", p.alias("p_secret"), (p >= least).alias("is_secret"))
