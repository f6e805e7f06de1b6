"""Connected components of an edge table, without taking edges to one task or the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import keep


def _with_min(pairs: DataFrame) -> DataFrame:
    """Rows (u, v) with the smallest of u's neighbours and u itself as ``m``.

    The minimum is combined before its shuffle and written, so that the join reads two plain tables and
    Spark may split a u that holds most edges.
    """
    least = keep(pairs.groupBy("u").agg(F.min("v").alias("m")), "star")
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked places the smallest root among them, in place."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that link the same nodes: each node of a batch to the smallest it reaches within the batch."""
    for batch in batches:
        u, v = (batch.column(k).to_numpy() for k in (0, 1))
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        root = np.arange(len(nodes))
        merge(root, at[: len(u)], at[len(u) :])
        rest = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[rest]), pa.array(nodes[root[rest]])], ["u", "v"])


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node has two centres, no centre has one."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"))))
    roles = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.count("*").alias("n"))
    return roles.filter((F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("n") > F.col("ups"))).isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node that each node of ``edges`` (u, v; longs) reaches.

    Large-star and small-star rounds, each written to the shared folder, until the edges are stars; every task
    first merges the edges it holds. Nodes without an edge to another node are not returned; null ends, self
    edges and repeated edges do nothing; an empty table gives an empty result.
    """
    kinds = "u long, v long"
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    ends = keep(ends.filter("u > v").distinct().mapInArrow(_forest, kinds), "edges")
    for _ in range(max_rounds):
        if _settled(ends):
            break
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.filter("u <> v").distinct().mapInArrow(_forest, kinds), "edges")
        small = _with_min(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        ends = keep(small.filter("u <> v").distinct().mapInArrow(_forest, kinds), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = ends.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(ends.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
