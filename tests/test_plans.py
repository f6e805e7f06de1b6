"""Every registered query at the smallest scale: its SQL twin, and what its plan must not contain."""

import contextlib
import io

import duckdb
import pytest

import __spark_entry__ as entry
from parcelwise.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
# what these read is the header bytes of files, see upload_headers
HEADERS = {"upload_gate", "scored_upload", "upload_scored_by_model"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


def plan_of(frame):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain()
    return text.getvalue()


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    plan = plan_of(frame)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    if name not in HEADERS:
        assert "InPandas" not in plan
    result = duck.execute(QUERIES[name].sql)
    got = table_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert got == table_of([d[0] for d in result.description], result.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pruned_scan_of_the_flagship(spark):
    plan = plan_of(QUERIES["summary_by_mode"].build(spark, SF))
    assert "c_custkey" not in plan and "p_partkey" not in plan and "l_tax" not in plan


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_query_without_a_twin(spark, name):
    frame = entry.queries()[name](spark, SF)
    rows = frame.collect()
    assert rows and all(any(v is not None for v in r) for r in rows)


def test_explanations_read_their_source_once(spark):
    plan = plan_of(QUERIES["region_mean_of_orders"].build(spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_grids_shuffle_partial_sums_only(spark):
    plan = plan_of(QUERIES["whatif_best"].build(spark, SF))
    assert "REBALANCE" not in plan
