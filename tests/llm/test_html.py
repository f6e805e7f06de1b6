"""HTML extraction: the ratio method against a plain version, on every page, however deep it nests."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from parcelwise.llm import html


def tree(rng, depth=0):
    """A div as a list of divs and paragraphs; a paragraph is (text, number of bold words)."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        if depth < 4 and rng.random() < 0.5:
            out.append(tree(rng, depth + 1))
        else:
            words = ["w" * rng.randrange(1, 9) for _ in range(rng.choice([1, 2, 3, 25, 60]))]
            out.append((words, rng.choice([0, 0, 1, min(6, len(words))])))
    return out


def written(node):
    if isinstance(node, list):
        return "<div>" + "\n".join(written(n) for n in node) + "</div>"
    words, bold = node
    return "<p>" + " ".join([f"<b>{w}</b>" for w in words[:bold]] + words[bold:]) + "</p>"


def plain(root):
    """The region's paragraphs, by walking the tree for every element."""
    lines = []  # text, ratio, path of the divs around

    def walk(node, path):
        for at, child in enumerate(node):
            if isinstance(child, list):
                walk(child, (*path, at))
            else:
                text = " ".join(child[0])
                lines.append((text, len(text) / (2 + 2 * child[1]), path, (*path, at)))

    walk(root, (0,))
    weight = [math.exp(-0.5 * d * d) for d in range(-3, 4)]
    smooth = []
    for k in range(len(lines)):
        near = [lines[min(max(k + d, 0), len(lines) - 1)][1] for d in range(-3, 4)]
        smooth.append(sum(w * r for w, r in zip(weight, near, strict=True)) / sum(weight))
    logs = [math.log1p(v) for v in smooth]
    low, high = min(logs), max(logs)
    for _ in range(50):
        upper, lower = [x for x in logs if x >= (low + high) / 2], [x for x in logs if x < (low + high) / 2]
        if not lower:
            break
        low, high = sum(lower) / len(lower), sum(upper) / len(upper)
    border = (low + high) / 2 if high - low > math.log(2) else -1
    chosen = [line for line, x in zip(lines, logs, strict=True) if x >= border]
    total = sum(len(line[0]) for line in chosen)
    elements = sorted({line[3][:k] for line in lines for k in range(1, len(line[3]) + 1)})  # page order: an element before what it holds
    region = [e for e in elements if sum(len(t) for t, _, _, own in chosen if own[: len(e)] == e) >= 0.8 * total][-1]
    return "\n\n".join(t for t, _, _, own in lines if own[: len(region)] == region)


@pytest.mark.parametrize("seed", range(150))
def test_ratio_method_against_a_plain_version(seed):
    root = tree(random.Random(seed))
    assert html.main_text(f"<html><body>{written(root)}</body></html>") == plain(root)


def test_the_ratios_decide_on_every_page(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    real, seen = html.smoothed_ratios, []
    monkeypatch.setattr(html, "smoothed_ratios", lambda lines: seen.append(1) or real(lines))
    texts = [html.main_text(p) for p in pages]
    assert len(seen) == len([p for p in pages if p]) and all(texts)


def test_the_upper_cluster_chooses_between_named_elements():
    story, links = "<p>" + "A long line of the story itself goes on here. " * 6 + "</p>", "<p><b>a</b> <i>b</i> <b>teaser word</b></p>"
    page = f"<body><div class=entry-content>{story * 3}</div><article>{links * 70}</article></body>"
    assert html.main_text(page).count("story itself") == 18 and "teaser" not in html.main_text(page)


@pytest.mark.parametrize("part", ["<div>x y ", "<div>", "<b>t<p>", "<li><div>", "<a><i>t", "<div></section>x", "<table><tr><td>x", "<p></div>"])
def test_deep_nesting_takes_linear_time(part):
    start = time.perf_counter()
    html.main_text(part * (1_000_000 // len(part)))
    assert time.perf_counter() - start < 20


def test_odd_tables(spark):
    rows = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "<p>a  b</p>", 3), (1, "u", "<p>a  b</p>", 3)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract_text(rows.withColumn("n_chars", F.lit("x"))).collect())
    assert got == [(0, "", 0), (1, "", 0), (1, "a b", 3), (1, "a b", 3)]
    assert html.extract_text(rows.limit(0)).collect() == []
