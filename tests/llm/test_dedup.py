"""Near, exact and substring dedup against brute force, with the odd rows every operator must take."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parcelwise.llm import components, embeddings, exact, simhash, substrings

SCHEMA = "doc_id long, text string, kept string, component_id string, n string"


def docs(spark, rows):
    """Rows with extra columns whose names clash with what the operators add."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)


def reach(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(x) for x in range(n)]


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Ä", "É", "x" * 300]
    made = [" ".join(rng.choices(words, k=rng.randrange(0, 120))) for _ in range(n)]
    for k in range(0, n, 3):  # copies with a word changed, put in or moved
        a = made[rng.randrange(n)].split()
        if a:
            a[rng.randrange(len(a))] = rng.choice(words)
        made[k] = "\t".join(a)
    return made


def test_components_of_chains_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    frame = spark.createDataFrame([*edges, (7, None)], "u long, v long").repartition(7)
    got = dict(components.connected_components(frame).collect())
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200, 202: 200}
    assert components.connected_components(frame.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_rounds_without_local_merging(spark, seed, monkeypatch):
    def as_they_are(batches):
        yield from batches

    monkeypatch.setattr(components, "_forest", as_they_are)
    rng = random.Random(seed)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect())
    want = reach(90, edges)
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}


def plain_fingerprint(text, width=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(monkeypatch):
    for text in [None, "", " \n", "A", "a b C", "a b c d", "É Ü a\x0bb\x1fc d e f", *texts(3, 30)]:
        assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)
    long = " ".join(str(k % 977) for k in range(5000))
    whole = simhash.fingerprint(long.encode())
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    assert simhash.fingerprint(long.encode()) == whole == plain_fingerprint(long)


def close_numbers(seed, n):
    rng = random.Random(seed)
    found = {0}
    centres = [rng.getrandbits(64) for _ in range(6)]
    while len(found) < n:
        x = rng.choice(centres) if rng.random() < 0.7 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randrange(0, 8)):
            x ^= 1 << b
        found.add(x)
    return sorted(found)


@pytest.mark.parametrize(("blocks", "split", "bits"), [(5, 1024, 4), (5, 16, 4), (6, 8, 4), (3, 50, 2), (2, 10, 0)])
def test_links_of_the_trie_join(spark, blocks, split, bits):
    fps = close_numbers(blocks, 400)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long").repartition(3)
    got = simhash.simhash_links(frame, bits, blocks, split).collect()
    place = {x: k for k, x in enumerate(fps)}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits]
    found = [(place[u % (1 << 64)], place[v % (1 << 64)]) for u, v in got]
    assert reach(len(fps), found) == reach(len(fps), links)


def test_trie_links_are_exactly_those_within_the_budget():
    keys = np.array(close_numbers(9, 300), np.uint64)
    got = {p for i, j in simhash.trie_links(keys, [(0, 300, 0, 300)], 0, 4) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {(i, j) for j in range(300) for i in range(j) if (int(keys[i]) ^ int(keys[j])).bit_count() <= 4}
    got = {p for i, j in simhash.trie_links(keys, [(0, 1, 0, 1)], 0, 4) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert not got


def test_simhash_dedup(spark):
    made = texts(5, 80) + [None, "", " ", "a", "a"]
    rows = list(enumerate(made)) + [(3, made[3]), (None, "a"), (None, "zz yy xx")]
    got = simhash.simhash_dedup(docs(spark, rows)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    groups = reach(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for (i, _), g in zip(rows, groups, strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    want = sorted((repr(i), f"{f:016x}", repr(least[g]), i == least[g]) for (i, _), f, g in zip(rows, fps, groups, strict=True))
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id), r.kept) for r in got) == want
    assert simhash.simhash_dedup(docs(spark, rows).limit(0)).count() == 0


def vectors(seed, n, dim=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    out = base[rng.integers(0, len(base), n)] + rng.normal(scale=0.12, size=(n, dim))
    return [[float(np.float32(x)) for x in v] for v in out]


@pytest.mark.parametrize(("per_cell", "block"), [(8192, 1024), (40, 7), (15, 1000)])
def test_embedding_dedup(spark, per_cell, block):
    made = vectors(4, 240)
    rows = [(k, v, k % 3, "x", "y") for k, v in enumerate(made)]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 12, 0), (303, [float("nan")] * 12, 0), (304, [float("inf")] + [1.0] * 11, 0), (305, [None] * 12, 0)]
    rows += [(306, made[0], None), (307, made[0], None), (308, [1.0, 2.0], 0), (309, [2.0, 4.0], 0), (310, [x * 1e30 for x in made[0]], 0), (None, made[0], 0)]
    rows += [(0, made[0], 0)]
    frame = spark.createDataFrame([(*r[:3], "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, kept string, cell string").repartition(3)
    got = {r.vec_id: r for r in embeddings.embedding_dedup(frame, per_cell=per_cell, block=block).collect()}
    live = [r for r in rows[:240]] + [(308, [1.0, 2.0], 0), (309, [2.0, 4.0], 0), (310, [float(np.float32(x * 1e30)) for x in made[0]], 0)]
    links = []
    for a in range(len(live)):
        for b in range(a):
            x, y = np.array(live[a][1]), np.array(live[b][1])
            if live[a][2] == live[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links.append((a, b))
    groups = reach(len(live), links)
    for k, r in enumerate(live):
        assert got[r[0]].n_links == sum(k in e for e in links)
        assert got[r[0]].component_id == live[groups[k]][0]
        assert got[r[0]].kept == (groups[k] == k)
    for k in (300, 301, 302, 303, 304, 305, 306, 307):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[None].n_links == 0 and len(got) == 240 + 12
    assert embeddings.embedding_dedup(frame.limit(0)).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    bits, sizes = exact.perfect_hash(keys)
    assert sorted(exact.slots(keys, bits, sizes)) == list(range(len(keys)))
    assert len(exact.slots(np.array([5], np.uint64), *exact.perfect_hash(keys[:1]))) == 1
    with pytest.raises(ValueError, match="distinct"):
        exact.perfect_hash(np.array([7, 7], np.uint64))


def test_exact_dedup(spark):
    rows = [(1, "a"), (5, "a"), (5, "a"), (2, "A"), (3, None), (4, ""), (9, " "), (None, "q"), (None, "q"), (None, "r"), (6, "r"), (7, "é" * 50_000), (8, "é" * 50_000)]
    rows += [(100 + k, f"t{k % 40}") for k in range(300)] + [(1000 + k, "hot") for k in range(500)]
    for shard, task in ((16_384, 16_384), (4, 50)):
        got = exact.exact_dedup(docs(spark, rows), shard_digests=shard, task_rows=task).collect()
        groups = {}
        for i, t in rows:
            groups.setdefault(t or "", []).append(i)
        best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
        want = [(repr(i), repr(best[t or ""]), len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
        assert sorted((repr(r[0]), repr(r[1]), *r[2:]) for r in got) == sorted(want)
    assert exact.exact_dedup(docs(spark, rows).limit(0)).count() == 0


def test_the_history_splits_the_rows(spark, monkeypatch):
    """Texts of the history's half are grouped by slot, all others by digest: without the index nothing would be a member."""
    rows = [(k, f"text {k % 40}") for k in range(80)] + [(k, f"alone {k}") for k in range(100, 160)]
    seen, real = {}, exact._of_their_groups

    def watched(looked, key, parts):
        seen[key] = {r.doc_id for r in looked.select("doc_id").collect()}
        return real(looked, key, parts)

    monkeypatch.setattr(exact, "_of_their_groups", watched)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_dedup(docs(spark, rows)).collect()}
    assert got == {k: (k % 40 + 40, 2) if k < 80 else (k, 1) for k, _ in rows}
    assert len(seen["slot"]) > 60 and len(seen["digest"]) > 20 and not seen["slot"] & seen["digest"]


def test_large_ids_next_to_null_ids(spark):
    big = (1 << 60) + 1
    got = exact.exact_dedup(docs(spark, [(None, "a"), (big, "a"), (big - 1, "b"), (None, "c")])).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, [
        type(got[0])(doc_id=i, keep_id=k, group_size=n, kept=i == k, text_sha256=hashlib.sha256(t.encode()).hexdigest())
        for i, t, k, n in ((None, "a", big, 2), (big, "a", big, 2), (big - 1, "b", big - 1, 1), (None, "c", None, 1))
    ]))


def test_equal_rows_without_ids_run_in_many_tasks(spark):
    rows = docs(spark, [(None, "same")] * 3000 + [(1, "same"), (2, "x")])
    looked = exact.digests(rows)
    parts = spark.createDataFrame([(0, 10)], "shard int, parts int")
    index = exact.build_index(exact.keep(looked, "d").groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("n")), 1)
    dealt = exact.look_up(exact.keep(looked, "d"), index, 1, parts).groupBy("part").count().collect()
    assert len(dealt) == 10 and max(r["count"] for r in dealt) < 450
    got = exact.exact_dedup(rows, task_rows=100).groupBy("keep_id", "group_size", "kept").count().collect()
    assert sorted((r.keep_id, r.group_size, r.kept, r["count"]) for r in got) == [(1, 3001, False, 3000), (1, 3001, True, 1), (2, 1, True, 1)]


def test_exact_dedup_against_history(spark):
    old = [(b"\x01" * 32, 77, 3), (hashlib.sha256(b"a").digest(), 50, 2)]
    # agrees with the digest of "b" in the bytes that are hashed, not in the rest
    near = bytearray(hashlib.sha256(b"b").digest())
    near[31] ^= 1
    history = spark.createDataFrame([*old, (bytes(near), 60, 2)], "digest binary, winner long, n long")
    got = exact.exact_dedup(docs(spark, [(1, "a"), (2, "b"), (3, "b"), (4, "c")]), history=history)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == [(1, 50, 2, False), (2, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True)]


def plain_substrings(rows, window):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        inside = set()
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if seen.get(key, i) != i or key in inside:
                gone[k : k + window] = [True] * window
            seen.setdefault(key, i)
            inside.add(key)
        out.append((repr(i), len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize(("seed", "vocabulary", "window", "phrase"), [(1, 3, 6, 2), (2, 200, 20, 6), (3, 2, 8, 7), (4, 40, 5, 1)])
def test_substring_dedup(spark, seed, vocabulary, window, phrase, monkeypatch):
    monkeypatch.setattr(substrings, "_SHARD_BYTES", 2000)
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(vocabulary)]
    passages = [rng.choices(words, k=rng.randrange(window, 3 * window)) for _ in range(5)]
    rows = []
    for i in range(60):
        text = rng.choices(words, k=rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            text += rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(60, None), (61, ""), (62, " \n "), (63, rows[5][1]), (64, rows[5][1]), (None, rows[6][1]), (65, " ".join(["same"] * 4000)), (66, "a\x1fb \x85c\xa0d " * 30)]
    got = substrings.substring_dedup(docs(spark, rows), window, phrase).collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == plain_substrings(rows, window)


def test_substring_dedup_of_odd_tables(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(1, passage), (1, passage), (2, "x " + passage)]
    got = sorted(substrings.substring_dedup(docs(spark, rows)).collect())
    assert [(r.doc_id, r.n_removed) for r in got] == [(1, 0), (1, 0), (2, 30)] and got[2].kept_text == "x"
    assert substrings.substring_dedup(docs(spark, rows).limit(0)).count() == 0
    assert substrings.substring_dedup(docs(spark, [(1, None), (2, "a b")])).agg(F.sum("n_removed")).first()[0] == 0


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_repeated_rows_keep_their_first_place(spark, broadcast):
    """Rows that share id and text meet in one shard; they are no copies of each other, with an id or without."""
    passage, other = (" ".join(f"{c}{k}" for k in range(30)) for c in "pq")
    rows = [(1, passage), (1, passage), (1, passage), (2, "x " + passage), (None, other), (None, other), (3, other + " y"), (4, passage + " " + passage), (4, passage + " " + passage)]
    rows += [(5, " ".join(f"r{k}" for k in range(25)))] * 2
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = substrings.substring_dedup(docs(spark, rows).coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert sorted((repr(r[0]), *r[1:]) for r in got) == plain_substrings(rows, 20)


def test_repeats_without_an_id_are_dealt_out():
    """All documents without an id have one did; their repeats go to many routes, each document's to one."""
    did, tk = np.full(4000, -(1 << 63)), np.repeat(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 1000), 4)
    start = np.arange(4000, dtype=np.int32)
    none = np.zeros(4000, np.int64)
    rows = substrings._packed(False, [none, none, did, tk, start], 16)
    held = [set(np.frombuffer(r["tk"], np.int64).tolist()) for r in rows]
    assert len(rows) == 16 and max(map(len, held)) < 2 * min(map(len, held)) and sum(map(len, held)) == 1000
