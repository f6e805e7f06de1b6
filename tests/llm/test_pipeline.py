"""The pipeline against plain Python, the registered queries, and the guard around the package."""

import collections
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from parcelwise.llm import exact, langid, simhash
from parcelwise.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language id", "exact dedup", "simhash near-dedup", "source mix", "best-fit packing"]


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = docs
        if name != "best-fit packing":
            assert docs.dtypes == before.dtypes
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    after = [{r.doc_id for r in kept[n].collect()} for n in ("language id", "exact dedup", "simhash near-dedup")]
    assert after[0] <= set(texts) and len(after[0]) >= 0.99 * len(texts)
    latest = {}
    for i in sorted(after[0]):
        latest[texts[i]] = i
    assert after[1] == set(latest.values())
    ids = sorted(after[1])
    fps = [simhash.fingerprint(texts[i].encode()) for i in ids]
    first = list(range(len(ids)))

    def find(x):
        return x if first[x] == x else find(first[x])

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                first[y] = x
    assert after[2] == {ids[k] for k in range(len(ids)) if find(k) == k}
    packed = kept["best-fit packing"].toPandas()
    mixed = collections.Counter(r.doc_id for r in kept["source mix"].collect())
    whole = packed.groupby("doc_id")["length"].sum()
    assert {i: n * (len(texts[i].split()) + 1) for i, n in mixed.items()} == whole.to_dict()


def test_run_is_the_stages(spark):
    frame = corpus_pipeline.run(spark, SF)
    assert frame.columns == ["doc_id", "piece", "length", "bin_id", "capacity", "bin_offset", "text_hash", "copy"] and frame.count() > 0


def test_stages_take_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "one two three", "en", "a", 13), (3, "one two three", "en", "a", 13), (None, "four five", "en", None, 9)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
            assert name == "best-fit packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    frame = QUERIES[name](spark, SF)
    assert set(frame.columns) == set(names)
    assert sorted(map(repr, (tuple(r) for r in frame.select(*names).collect()))) == sorted(map(repr, result.fetchall()))


def test_contract_columns(spark):
    want = {
        "op1_": ["vec_id", "n_links", "component_id", "kept"], "op2_": ["doc_id", "fingerprint", "component_id"], "op3_": ["doc_id", "held_out", "lang_pred", "score"],
        "op5_": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op6_": ["page_id", "url", "text", "n_chars"],
        "op8_": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op10_": ["doc_id", "size", "source_size", "target", "taken"],
    }
    for start, columns in want.items():
        name = next(q for q in QUERIES if q.startswith(start))
        frame = QUERIES[name](spark, SF)
        assert set(columns) <= set(frame.columns)
        table = {"op1_": "embeddings", "op6_": "pages"}.get(start, "documents")
        assert frame.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_native_operators_run_no_python(spark):
    for name in ("op4_line_dedup", "op10_source_mix"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {q.split("_")[0] for q in entry.queries()}


def test_nothing_else_imports_the_package():
    code = "import sys, parcelwise.plans; assert not [m for m in sys.modules if m.startswith('parcelwise.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0], capture_output=True)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify_languages(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null")
    right, total = found.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert right / total > 0.97


def test_known_copies_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = exact.exact_dedup(docs).filter("kept").count()
    assert kept == docs.select("text").distinct().count()


def test_dedup_stages_decide_by_row(spark):
    """Rows without an id, and different texts under one id, stand or fall by their own text."""
    words = lambda c: " ".join(f"{c}{k}" for k in range(40))
    texts = {c: words(c) for c in ("copied", "alone", "lonely", "under", "shared", "noid", "twin")}
    rows = [
        (5, texts["copied"]), (None, texts["copied"]), (None, texts["alone"]), (None, texts["lonely"]),
        (7, texts["copied"]), (7, texts["under"]), (8, texts["under"]), (7, texts["shared"]),
        (None, texts["noid"]), (None, texts["noid"]), (None, texts["noid"]), (9, texts["twin"]), (9, texts["twin"]),
    ]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = {"copied": 7, "alone": None, "lonely": None, "under": 8, "shared": 7, "noid": None, "twin": 9}
    exactly = corpus_pipeline.exact_dedup(spark, docs, SF)
    assert exactly.columns == docs.columns
    assert sorted((r.text, repr(r.doc_id)) for r in exactly.collect()) == sorted((texts[c], repr(i)) for c, i in want.items())
    want |= {"copied": 5, "under": 7}
    nearly = corpus_pipeline.simhash_dedup(spark, docs, SF).collect()
    assert sorted((r.text, repr(r.doc_id)) for r in nearly) == sorted((texts[c], repr(i)) for c, i in want.items())
