"""Cross-tokenizer alignment against one text at a time and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from parcelwise.llm import align

SCHEMA = "doc_id long, text string, block string, pair string, count string"


@pytest.fixture(scope="module")
def tokenizers():
    return align.ByteLevel(align.A_PATH), align.Pieces(align.B_PATH)


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(align.A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=align.B_PATH)
    table, words = align.byte_of_char(), {i: w for w, i in a.get_vocab(with_added_tokens=False).items()}

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()

    done = []
    for _, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a, bytes_b = [bytes(table[c] for c in words[i]) for i in ids_a], [of_b(i) for i in ids_b]
        if text and not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ids_a, ids_b = [], []
        spans = []
        for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
            ends = np.cumsum([len(p) for p in parts[: len(ids)]]).tolist()
            spans.append(list(zip(ids, [0, *ends], ends)))
        links = [(x, y) for x, s, e in spans[0] for y, f, g in spans[1] if s < g and f < e] if len(ids_a) < 400 else None
        if links is None:  # the same by a walk, for long texts
            links, i, j = [], 0, 0
            while i < len(spans[0]):
                links.append((spans[0][i][0], spans[1][j][0]))
                x, y = spans[0][i][2], spans[1][j][2]
                i, j = i + (x <= y), j + (y <= x)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, start = [], 0
        inside = [defaultdict(list), defaultdict(list)]
        for side in (0, 1):
            k = 0
            for x, _, e in spans[side]:
                inside[side][k].append(str(x))
                k += k < len(cuts) and e == cuts[k]
        groups = [",".join(inside[0][k]) + "|" + ",".join(inside[1][k]) for k in range(len(cuts))]
        done.append((len(ids_a), len(ids_b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""))
    count = Counter(p for *_, links, _ in done for p in set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(
        ((i, na, nb, ng, len(ls), sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls), h) for (i, _), (na, nb, ng, ls, h) in zip(rows, done, strict=True)),
        key=repr,
    )


def got(spark, rows):
    frame = align.align(spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3))
    assert frame.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, frame.collect()), key=repr)


ODD = [
    None, "", " ", "  \n\t ", "a", "<|endoftext|> <s></s> <unk> <0x41>", "▁ under", "naïve café Ünïcödé", "日本語の文章", "🙂🙃", "\x00\x01\x7f", "x y\u0085z",
    "ﬁ ½ Ⅳ x", "    def f(x):\n        return x  # y\r\n", "éé", "don't can't WE'LL", "aaaa" * 500, "1234567890" * 30,
]


def test_alignment_against_plain_loops(spark):
    rng = random.Random(4)
    words = ["the", "The", " ", "\n", "straße", "tokenizer", "unbelievable", "日", "🙂", "x1", "...", "ing", "'s"]
    texts = ODD + ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    rows = [(rng.choice([k, None, 7]), t) for k, t in enumerate(texts)] + [(5, "the same")] * 4 + [(None, None)]
    assert got(spark, rows) == plain(rows)


def test_long_texts_and_long_white_space(spark):
    rows = [(1, "antidisestablishmentarianism straße 日本 " * 20_000), (2, " " * 60_000 + "x"), (3, "ab" * 30_000), (4, "\n" * 9_000)]
    assert got(spark, rows) == plain(rows)


def test_empty_table_and_table_without_tokens(spark):
    assert got(spark, [])== []
    assert got(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_lanes_cut_a_long_document_without_losing_links():
    rng = np.random.default_rng(1)
    total = 5000
    ends_a = np.union1d(rng.choice(total, 1500, replace=False) + 1, [total])
    ends_b = np.union1d(rng.choice(total, 1700, replace=False) + 1, [total])
    whole = align.lockstep(ends_a, ends_b, np.array([0]), np.array([len(ends_a)]))
    cut = align.lockstep(ends_a, ends_b, *align.lanes(np.array([0, len(ends_a)]), 16))
    for x, y in ((0, 1), (2, 3)):
        assert sorted(zip(whole[x].tolist(), whole[y].tolist())) == sorted(zip(cut[x].tolist(), cut[y].tolist()))
    starts_a, starts_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    pairs = {(i, j) for i in range(len(ends_a)) for j in range(len(ends_b)) if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]}
    assert set(zip(cut[0].tolist(), cut[1].tolist())) == pairs


def test_blocks_share_corpus_counts(spark, monkeypatch):
    monkeypatch.setattr(align, "_BLOCK_CHARS", 60)
    monkeypatch.setattr(align, "_BATCH_CHARS", 20)
    rows = [(k, "the cat sat on the mat " * (1 + k % 3)) for k in range(40)]
    assert got(spark, rows) == plain(rows)


def test_fast_and_slow_encoder_agree(tokenizers):
    a, _ = tokenizers
    for text in [t for t in ODD if t]:
        assert a.encode(" " + text) == a._slow.encode(" " + text, add_special_tokens=False).ids
