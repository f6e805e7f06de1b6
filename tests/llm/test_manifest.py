"""The Merkle manifest against a plain tree, and its block layout."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from parcelwise.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos string, leaf string, block string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """Sorted result rows of the contract, one list per tree level."""
    def leaf_of(row, text):
        return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text))

    def climb(level, at):
        siblings, sides = [], []
        while len(level) > 1:
            first = at - at % 16
            run = level[first : first + 16]
            siblings += run[: at - first] + run[at - first + 1 :]
            sides.append((run[: at - first], run[at - first + 1 :]))
            level, at = [h(level[k : k + 16]) for k in range(0, len(level), 16)], at // 16
        return level[0], siblings, sides

    def order(v):
        return (v is not None, v if v is not None else 0)

    trees = {}
    for row in rows:
        lowered = None if row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
        hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        trees.setdefault(row[1], []).append((order(row[0]), leaf_of(row, row[4]), leaf_of(row, lowered if hit else row[4]), row[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for tree in trees.values():
        tree.sort(key=lambda x: x[:2])
    tops = [climb([x[1] for x in trees[s]], 0)[0] for s in names]
    out = []
    for k, s in enumerate(names):
        for at, (_, leaf, claimed, doc_id) in enumerate(trees[s]):
            subroot, low, sides = climb([x[1] for x in trees[s]], at)
            root, high, more = climb(tops, k)
            value = claimed
            for left, right in sides + more:
                value = h([*left, value, *right])
            out.append((doc_id, leaf, subroot, root, h(low + high), value, value == root))
    return sorted(out, key=repr)


def made(n, sources, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = rng.choice(sources)
        rows.append((rng.choice([k, None, k % 7]), source, rng.choice(["en", None, ""]), rng.choice([None, k]), rng.choice([None, "", "Ab cÄ" * rng.randrange(50), "low", "X"])))
    return rows + rows[: n // 5]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("height", [1, 3])
def test_manifest_against_a_plain_tree(spark, height):
    rows = made(420, [None, "", "a", "a", "a", "a", "é", "Z", "=", "one"], 3) + [(5, f"s{k}", "en", 1, "T") for k in range(19)] + [(1, "long", None, None, "Q" * 3_000_000)]
    got = merkle.tampered(frame(spark, rows), height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_manifest_of_one_row_and_of_none(spark):
    assert sorted(map(tuple, merkle.tampered(frame(spark, [(None, None, None, None, None)])).collect())) == plain([(None, None, None, None, None)])
    assert merkle.tampered(frame(spark, []).limit(0)).count() == 0
    untouched = merkle.manifest(frame(spark, made(40, ["a", "b"], 1)))
    assert untouched.filter("not verified").count() == 0 and untouched.count() == 48


def test_a_tree_of_equal_rows_is_cut_into_ranges(spark):
    rows = spark.range(6000).selectExpr("cast(null as long) as doc_id", "'=a' as tree", "'x' as leaf")
    placed = merkle.ranked(rows, "tree", ["doc_id", "leaf"])
    assert sorted(r.pos for r in placed.collect()) == list(range(6000)) and {r.n for r in placed.collect()} == {6000}


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_layout_is_a_bijection_with_whole_subtrees_together(levels):
    places = [merkle.address(levels, d, np.arange(16**d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.size(levels)))
    top = levels // 2
    if top:  # the upper half comes first, then each lower subtree in one stretch
        assert max(p.max() for p in places[:top]) == merkle.size(top) - 1
        for tree in (0, 16**top - 1):
            parts = [places[d][tree * 16 ** (d - top) : (tree + 1) * 16 ** (d - top)] for d in range(top, levels)]
            assert np.ptp(np.concatenate(parts)) == merkle.size(levels - top) - 1


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 700])
def test_block_gives_back_what_was_put_in(n):
    leaves, up = [h([str(k)]) for k in range(n)], merkle.climbs(n, 3)
    stored, root = merkle.build_block(leaves, up)
    levels = merkle.read_levels(stored, n, up)
    assert (levels[0] == leaves) if up else (root == leaves[0])
    for place in {0, n // 2, n - 1}:
        assert merkle.fold(leaves[place], merkle.steps(levels, place)) == root
        assert merkle.fold(h(["else"]), merkle.steps(levels, place)) != root
