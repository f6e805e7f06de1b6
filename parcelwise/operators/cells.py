"""Scores of trained models for every cell of a what-if grid, without a row per item and cell.

What a cell sets is known before the rows are: each tree is cut down to the branches the cell leaves open, and trees
that are then equal are evaluated once for all their cells. Profit and late score come back as whole ten-thousandths,
rounded as :func:`models.score_profit` and :func:`models.score_late` round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNITS = 10_000
_BATCH = 16_384
Node = float | tuple  # a leaf's value, or (feature, threshold, left, right)
Model = list[tuple[float, Node]]


def trees_of(model) -> Model:
    """The trees of a Spark ML model with their weights."""
    def node(jvm) -> Node:
        if jvm.subtreeDepth() == 0:
            return float(jvm.prediction())
        split = jvm.split()
        return split.featureIndex(), float(split.threshold()), node(jvm.leftChild()), node(jvm.rightChild())

    return [(float(w), node(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees, strict=True)]


def cut_down(node: Node, given: Mapping[int, float]) -> Node:
    """The tree for rows whose features have the values ``given`` by their number."""
    if not isinstance(node, tuple):
        return node
    feature, threshold, left, right = node
    if feature in given:
        return cut_down(left if given[feature] <= threshold else right, given)
    left, right = cut_down(left, given), cut_down(right, given)
    return left if left == right else (feature, threshold, left, right)


def whole_units(x: np.ndarray) -> np.ndarray:
    """Ten-thousandths, half away from zero in the digits that a double is printed with."""
    size = np.abs(x) * _UNITS
    out = np.copysign(np.floor(size + 0.5), x)
    for i in np.flatnonzero(np.abs(size - np.floor(size) - 0.5) < 1e-6 * np.maximum(size, 1.0)):
        out[i] = int(Decimal(repr(float(x[i]))).quantize(Decimal("0.0001"), ROUND_HALF_UP) * _UNITS)
    return out.astype(np.int64)


def _sum_of(model: Model, columns: Sequence[np.ndarray], made: dict, n: int) -> np.ndarray:
    """Weighted sum of the trees; ``made`` keeps what equal parts have given for these rows."""
    def below(node: Node):
        if not isinstance(node, tuple):
            return node
        if node not in made:
            feature, threshold, left, right = node
            test = (feature, threshold)
            if test not in made:
                made[test] = columns[feature] <= threshold
            made[node] = np.where(made[test], below(left), below(right))
        return made[node]

    out = np.zeros(n)
    for weight, tree in model:
        out += weight * below(tree)
    return out


def scored_cells(df: DataFrame, keep: Sequence[str], features: Sequence[str], late, profit, given: Mapping[int, Mapping[str, float]]) -> DataFrame:
    """``keep`` of each row, with ``_profit{seq}`` and ``_late{seq}`` for the cells whose feature values are ``given`` by number."""
    place = {name: i for i, name in enumerate(features)}
    models = {"late": trees_of(late), "profit": trees_of(profit)}
    wanted: dict[tuple[str, str], int] = {}
    distinct: dict[str, list[Model]] = {"late": [], "profit": []}
    for seq, values in given.items():
        set_to = {place[name]: v for name, v in values.items() if name in place}
        for kind, model in models.items():
            cut = [(w, cut_down(tree, set_to)) for w, tree in model]
            if cut not in distinct[kind]:
                distinct[kind].append(cut)
            wanted[(kind, seq)] = distinct[kind].index(cut)
    kept = [F.col(c) for c in keep]
    numbers = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"_f{i}") for i, c in enumerate(features)]
    made = [f"_{kind}_of{i}" for kind, cuts in distinct.items() for i in range(len(cuts))]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), *(f"{c} long" for c in made)])
    scored = df.select(*kept, *numbers).mapInArrow(_scorer(len(keep), distinct["late"], distinct["profit"], made), schema)
    return scored.select(*keep, *[F.col(f"_{kind}_of{i}").alias(f"_{kind}{seq}") for (kind, seq), i in wanted.items()])


def _scorer(keep: int, late: list[Model], profit: list[Model], made: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(start, _BATCH)
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[keep:]]
                out, parts = [], {}
                for model in late:
                    with np.errstate(over="ignore"):
                        p = 1 - 1 / (1 + np.exp(2 * _sum_of(model, columns, parts, batch.num_rows)))
                    out.append(whole_units(p))
                out += [whole_units(_sum_of(model, columns, parts, batch.num_rows)) for model in profit]
                yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *map(pa.array, out)], [*batch.schema.names[:keep], *made])

    return score
