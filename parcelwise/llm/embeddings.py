"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one kept per group.

The cells only say which products are made; no link is lost to them. A vector belongs to the cell of its
nearest centre and visits each lower-numbered cell whose border lies within the linking distance: unit vectors
linked by cosine c are at most sqrt(2 - 2c) apart, so a linked pair with homes a < b always meets in a.
Isotropic vectors visit most cells (then it is a blocked product of everything with an equal label, at worst);
clustered ones few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import keep
from parcelwise.llm.components import connected_components, merge


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centres of unit vectors; started at rows spread over the sample, empty cells keep their centre."""
    k = min(k, len(vectors))
    centres = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def _unit(column: pa.Array | pd.Series) -> np.ndarray:
    values = np.stack([np.asarray(x, np.float64) for x in column])
    # the largest component goes out first: squares of very large or small numbers would leave the double range
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _visits(unit: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and role (0 home, 1 visit) of every cell that a vector enters."""
    scores = unit @ centres.T
    home = scores.argmax(axis=1)
    gap = np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2)
    near = (scores[np.arange(len(unit)), home][:, None] - scores) <= reach * gap[home] + 1e-9
    near &= np.arange(len(centres))[None, :] < home[:, None]
    row, cell = np.nonzero(near)
    return np.concatenate((np.arange(len(unit)), row)), np.concatenate((home, cell)), np.repeat([0, 1], [len(unit), len(row)])


def embedding_dedup(
    vectors: DataFrame, threshold: float = 0.93, per_cell: int = 8192, max_cells: int = 1024,
    sample_rows: int = 8192, block: int = 1024,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vec_id of ``vectors`` (vec_id, embedding, label).

    Vectors with equal non-null labels link at a cosine of ``threshold`` or more, in double precision.
    Vectors that are null, empty, zero or hold a null or non-finite component, null labels and vectors of
    different lengths link with nothing. Rows that repeat a vec_id are one vector, the smallest (label,
    embedding) of them; rows without a vec_id form one that links with nothing. Other columns are not read; an
    empty table gives no rows. ``sample_rows`` bounds the sample on which the centres are fitted,
    ``max_cells`` their number; a cell is compared in blocks of about ``block`` rows.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").alias("embedding")
    )
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    rows = keep(rows, "vectors")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("embedding", lambda x: x == 0)
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0))
    usable = usable.filter(~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True)))

    common = usable.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, total = (common["dim"], common["count"]) if common else (0, 0)
    rate = sample_rows / max(total, 1)
    sampled = usable.filter(F.size("embedding") == dim).filter(
        F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) <= F.lit(int(min(1.0, rate) * (1 << 40)))
    )
    picked = [r[0] for r in sampled.select("embedding").limit(2 * sample_rows).collect()]
    cells = max(1, min(max_cells, -(-total // per_cell)))
    centres = spherical_kmeans(_unit(picked), cells) if picked else np.zeros((1, max(dim, 1)))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, same in batch.groupby(batch["embedding"].map(len)):
                for at in range(0, len(same), 2048):
                    part = same.iloc[at : at + 2048]
                    here = centres if length == dim else np.eye(1, length)
                    row, cell, role = _visits(_unit(part["embedding"]), here, reach)
                    out = part.iloc[row].copy()
                    out["dim"], out["cell"], out["role"] = length, cell, role
                    yield out

    kinds = dict(usable.dtypes)
    entered = usable.mapInPandas(assign, f"vec_id long, label {kinds['label']}, embedding {kinds['embedding']}, dim int, cell int, role int")
    entered = keep(entered, "cells")
    key = ["label", "dim", "cell"]
    sizes = entered.groupBy(*key).agg(
        F.count_if(F.col("role") == 0).alias("homes"), F.count_if(F.col("role") == 1).alias("guests")
    )
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    sizes = keep(sizes.select(*key, blocks("homes").alias("homes"), blocks("guests").alias("guests")).filter("homes > 0"), "cell-sizes")
    # block b of the residents meets every resident block and every guest block of its cell
    parts = F.when(F.col("role") == 0, F.col("homes")).otherwise(F.col("guests"))
    own = entered.join(sizes, key).withColumn("b", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
    meets = F.when(
        F.col("role") == 0,
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda o: F.struct(
                F.least("b", o).alias("x"), F.greatest("b", o).alias("y"), F.lit(0).alias("kind"))),
            F.transform(F.slice(F.sequence(F.lit(0), F.col("guests")), 1, F.col("guests")), lambda o: F.struct(
                F.col("b").alias("x"), o.alias("y"), F.lit(1).alias("kind"))),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda o: F.struct(
        o.alias("x"), F.col("b").alias("y"), F.lit(1).alias("kind"))))
    own = own.withColumn("m", F.explode(meets)).select("vec_id", "embedding", "role", "b", *key, "m.x", "m.y", "m.kind")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        kind, x, y = group["kind"].iat[0], group["x"].iat[0], group["y"].iat[0]
        ids, unit = group["vec_id"].to_numpy(), _unit(group["embedding"])
        left = np.flatnonzero((group["role"] == 0) & (group["b"] == x))
        right = np.flatnonzero((group["role"] == kind) & (group["b"] == y)) if kind or x != y else left
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        near = unit[left] @ unit[right].T >= threshold
        if not kind and x == y:
            np.fill_diagonal(near, False)
            links[left] = near.sum(axis=1)
        else:
            links[left] = near.sum(axis=1)
            links[right] = near.sum(axis=0)
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        merge(root, i, j)
        return pd.DataFrame({"vec_id": ids, "links": links, "root": ids[root]})[links > 0]

    found = keep(own.groupBy(*key, "x", "y", "kind").applyInPandas(compare, "vec_id long, links long, root long"), "links")
    groups = connected_components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    groups = keep(groups, "vector-groups")
    links = keep(found.groupBy("vec_id").agg(F.sum("links").alias("n_links")), "link-counts")
    out = rows.select("vec_id").join(links, "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
