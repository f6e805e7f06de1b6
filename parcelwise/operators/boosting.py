"""Boosted trees over binned rows, for tables that Spark ML's trainer cannot hold.

Spark ML keeps an object of some 150 bytes for each row and reads all of them for every level of every tree; what the
executors cannot hold is serialised to disk and read back each time. Here a row is one byte per feature besides its
label, in a written table of blocks, and each level is one pass that adds up histograms with NumPy. The method is that
of ``GBTRegressor`` and ``GBTClassifier`` with the parameters of the trainer given: thresholds from a sample of as many
rows, variance as impurity, subsampling, least rows a node, early stopping on the validation rows. Every row is read;
only which rows a tree's subsample draws differs, as it does between two partitionings of Spark ML's input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.session import dropped, scratch_path

#: rows of a block, which is one row of the written table
BLOCK_ROWS = 16_384
_BLOCKS = "is_val boolean, place long, n int, bins binary, label binary, weight binary"
_SUMS = "counts binary, weights binary, sums binary, nodes binary, error double, weight double"
_LEAST_SAMPLE = 10_000  # rows that thresholds are taken from, as in Spark ML


@dataclass
class Tree:
    """Nodes by their number in a heap: the root is 1, the children of i are 2 i and 2 i + 1."""

    split: dict[int, tuple[int, int]] = field(default_factory=dict)  # feature and last bin that goes left
    value: dict[int, float] = field(default_factory=dict)
    stats: dict[int, tuple] = field(default_factory=dict)  # gain, impurity, weight, sum, sum of squares, rows

    def places(self, bins: np.ndarray, number: dict[int, int]) -> np.ndarray:
        """For each row the number of the node it ends in."""
        kind = np.uint8 if len(number) < 256 else np.uint16 if len(number) < 65536 else np.uint32

        def below(node: int):
            if node not in self.split:
                return kind(number[node])
            feature, last = self.split[node]
            left, right = below(2 * node), below(2 * node + 1)
            # all bits where the row goes right: which of two numbers is taken without a branch
            goes = np.negative((bins[feature] > last).view(np.int8))
            goes = goes.view(kind) if kind is np.uint8 else goes.astype(kind)
            return left ^ ((left ^ right) & goes)

        out = below(1)
        return out if isinstance(out, np.ndarray) else np.full(bins.shape[1], out)

    def ends(self) -> list[int]:
        return [i for i in sorted(self.value) if i not in self.split]

    def predict(self, bins: np.ndarray) -> np.ndarray:
        ends = self.ends()
        return np.array([self.value[i] for i in ends])[self.places(bins, {node: i for i, node in enumerate(ends)})]


@dataclass
class Plan:
    """What a pass needs: the trees so far with their weights, the one that grows and its open nodes."""

    trees: list[tuple[float, Tree]]
    growing: Tree
    open: list[int]
    width: int
    rate: float
    seed: int
    logistic: bool
    weighted: bool
    errors: bool  # validation rows are read, too


def thresholds(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Split points of one feature, as Spark ML finds them: between all values, or where about equal weights lie between."""
    held = ~np.isnan(values)
    distinct, at = np.unique(values[held], return_inverse=True)
    counts = np.bincount(at, weights=weights[held]) if len(distinct) else np.empty(0)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(middles) <= most:
        return middles
    stride = counts.sum() / (most + 1)
    found, seen, target = [], counts[0], stride
    for i in range(1, len(distinct)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            found.append(middles[i - 1])
            target += stride
    return np.array(found)


def _blocks(cuts: list[np.ndarray], weighted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [f.split()[0] for f in _BLOCKS.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bool, list] = {False: [], True: []}
        task = TaskContext.get()
        place = (task.partitionId() if task else 0) << 24

        def block(is_val: bool, rows: int):
            nonlocal place
            bins, label, weight = (np.concatenate(x, axis=-1) for x in zip(*kept[is_val], strict=True))
            kept[is_val] = [(bins[:, rows:], label[rows:], weight[rows:])]
            place += 1
            cells = [is_val, place, len(label[:rows]), np.ascontiguousarray(bins[:, :rows]).tobytes(), label[:rows].tobytes(), weight[:rows].tobytes() if weighted else None]
            kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names)

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            label, weight, is_val = columns[-3:]
            bins = np.empty((len(cuts), len(label)), np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16)
            for i, (cut, values) in enumerate(zip(cuts, columns, strict=False)):
                bins[i] = np.searchsorted(cut, np.asarray(values, float))
            for side in (False, True):
                here = is_val.astype(bool) == side
                if here.any():
                    kept[side].append((bins[:, here], label[here], weight[here]))
                while sum(len(x[1]) for x in kept[side]) >= BLOCK_ROWS:
                    yield block(side, BLOCK_ROWS)
        for side in (False, True):
            if sum(len(x[1]) for x in kept[side]):
                yield block(side, BLOCK_ROWS)

    return pack


def _passes(plan: Plan, features: int, wide: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [f.split()[0] for f in _SUMS.split(", ")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, width = len(plan.open), plan.width
        size = (nodes + 1) * width  # the last node takes the rows that are not counted
        counts, weights, sums = (np.zeros((features, size)) for _ in range(3))
        totals = np.zeros(nodes + 1)
        error = errors_of = 0.0
        number = {node: nodes for node in plan.growing.ends()} | {node: i for i, node in enumerate(plan.open)}
        kind = np.uint16 if size < 65536 else np.int64
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                bins = np.frombuffer(row["bins"], np.uint16 if wide else np.uint8).reshape(features, n)
                label, weight = np.frombuffer(row["label"]), np.frombuffer(row["weight"]) if plan.weighted else None
                label = 2 * label - 1 if plan.logistic else label
                seen = np.zeros(n)
                for share, tree in plan.trees:
                    seen += share * tree.predict(bins)
                if row["is_val"]:
                    off = 2 * np.logaddexp(0.0, -2 * label * seen) if plan.logistic else (label - seen) ** 2
                    error += float((off * weight).sum() if plan.weighted else off.sum())
                    errors_of += float(weight.sum()) if plan.weighted else n
                    continue
                if not nodes:
                    continue
                aim = label
                if plan.trees and plan.logistic:
                    with np.errstate(over="ignore"):
                        aim = 4 * label / (1 + np.exp(2 * label * seen))
                elif plan.trees:
                    aim = 2 * (label - seen)
                at = plan.growing.places(bins, number).astype(kind)
                if plan.rate < 1:
                    drawn = np.random.default_rng([plan.seed, len(plan.trees), row["place"]]).random(n) < plan.rate
                    at = np.where(drawn, at, kind(nodes))
                pulled = aim * weight if plan.weighted else aim
                totals += np.bincount(at, pulled * aim, nodes + 1)
                at = at * kind(width)
                for i in range(features):
                    cell = at + bins[i]
                    counts[i] += np.bincount(cell, minlength=size)
                    sums[i] += np.bincount(cell, pulled, size)
                    if plan.weighted:
                        weights[i] += np.bincount(cell, weight, size)
        cut = lambda x: x[:, : nodes * width].tobytes()
        cells = [cut(counts), cut(weights) if plan.weighted else None, cut(sums), totals[:nodes].tobytes(), error, errors_of]
        kinds = [pa.binary()] * 4 + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names)

    return add


@contextmanager
def _small_batches(spark: SparkSession, rows: int):
    """Python gets a few blocks at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _summed(blocks: DataFrame, plan: Plan, features: int, wide: bool):
    """Histograms of the open nodes (rows, weights, targets; by node, feature and bin), squares by node, mean validation error."""
    table = blocks if plan.errors else blocks.where(~F.col("is_val"))
    table = table if plan.open else table.where("is_val")
    shape = (features, len(plan.open), plan.width)
    counts, sums, totals = np.zeros(shape), np.zeros(shape), np.zeros(len(plan.open))
    weights = np.zeros(shape) if plan.weighted else counts
    error = of = 0.0
    for row in table.mapInArrow(_passes(plan, features, wide), _SUMS).collect():
        counts += np.frombuffer(row["counts"]).reshape(shape)
        sums += np.frombuffer(row["sums"]).reshape(shape)
        totals += np.frombuffer(row["nodes"])
        if plan.weighted:
            weights += np.frombuffer(row["weights"]).reshape(shape)
        error, of = error + row["error"], of + row["weight"]
    return counts, weights, sums, totals, (error / of if of else None)


def _grow(tree: Tree, opened: list[int], found, cuts: list[np.ndarray], least: int, min_gain: float, deepest: bool) -> list[int]:
    """Best split of each open node; returns the children that stay open."""
    counts, weights, sums, totals, _ = found
    last = np.array([len(c) for c in cuts])
    children = []
    for at, node in enumerate(opened):
        rows, weight, total = counts[0, at].sum(), weights[0, at].sum(), sums[0, at].sum()
        mean = total / weight if weight else 0.0
        impurity = max(0.0, totals[at] / weight - mean * mean) if weight else 0.0
        tree.value[node], tree.stats[node] = mean, (-1.0, impurity, weight, total, totals[at], rows)
        left, left_weight, left_sum = (x[:, at].cumsum(axis=1)[:, :-1] for x in (counts, weights, sums))
        with np.errstate(divide="ignore", invalid="ignore"):
            # between the means, since the squares of large sums would hide small gains
            apart = left_sum / left_weight - (total - left_sum) / (weight - left_weight)
            gain = left_weight * (weight - left_weight) / (weight * weight) * apart * apart
        allowed = (left >= least) & (rows - left >= least) & (np.arange(left.shape[1]) < last[:, None])
        gain = np.where(allowed & (gain >= min_gain), gain, -1.0)
        feature, bin_ = np.unravel_index(gain.argmax(), gain.shape)
        best = float(gain[feature, bin_])
        if best <= 0 or impurity < np.finfo(float).eps:
            continue
        tree.split[node], tree.stats[node] = (int(feature), int(bin_)), (best, *tree.stats[node][1:])
        ls, lw, lc = left_sum[feature, bin_], left_weight[feature, bin_], left[feature, bin_]
        for child, s, w, c in ((2 * node, ls, lw, lc), (2 * node + 1, total - ls, weight - lw, rows - lc)):
            tree.value[child], tree.stats[child] = float(s / w), (-1.0, -1.0, w, s, 0.0, c)
            if not deepest:
                children.append(child)
    return children


def _boost(blocks: DataFrame, cuts: list[np.ndarray], trainer, weighted: bool, logistic: bool) -> list[tuple[float, Tree]]:
    """The trees with their weights; growing ends where the validation error no longer falls by the trainer's tolerance."""
    wide, features = max(map(len, cuts)) >= 256, len(cuts)
    width = max(map(len, cuts)) + 1
    get = trainer.getOrDefault
    trees: list[tuple[float, Tree]] = []
    best, kept = None, 0

    def settled(error: float | None) -> bool:
        """Takes the error of the trees so far; True where the last of them was not worth it."""
        nonlocal best, kept
        if error is None or best is None:
            best, kept = error, len(trees)
            return False
        if best - error < get("validationTol") * max(error, 0.01):
            return True
        if error < best:
            best, kept = error, len(trees)
        return False

    for _ in range(get("maxIter")):
        tree, opened, level = Tree(value={1: 0.0}), [1], 0
        while opened:
            plan = Plan(trees, tree, opened, width, get("subsamplingRate"), get("seed") % 2**63, logistic, weighted, errors=bool(trees) and level == 0)
            found = _summed(blocks, plan, features, wide)
            if plan.errors and settled(found[-1]):
                return trees[:kept]
            level += 1
            opened = _grow(tree, opened, found, cuts, get("minInstancesPerNode"), get("minInfoGain"), level >= get("maxDepth"))
        trees.append((get("stepSize") if trees else 1.0, tree))
    plan = Plan(trees, Tree(value={1: 0.0}), [], width, 1.0, 0, logistic, weighted, errors=True)
    settled(_summed(blocks, plan, features, wide)[-1])
    return trees[:kept]


def _spark_model(spark: SparkSession, trees: list[tuple[float, Tree]], cuts: list[np.ndarray], logistic: bool, trainer):
    """The trees as a model of Spark ML, which scores, saves and weighs features like any other."""
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    ml, impurity = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib.tree.impurity

    def doubles(values):
        out = gateway.new_array(jvm.double, len(values))
        for i, v in enumerate(values):
            out[i] = float(v)
        return out

    def node(tree: Tree, at: int):
        gain, noise, weight, total, squares, rows = tree.stats[at]
        held = impurity.VarianceCalculator(doubles([weight, total, squares]), int(rows))
        if at in tree.split:
            feature, last = tree.split[at]
            left, right = node(tree, 2 * at), node(tree, 2 * at + 1)
            split = ml.tree.ContinuousSplit(feature, float(cuts[feature][last]))
            return ml.tree.InternalNode(float(tree.value[at]), float(noise), float(gain), left, right, split, held)
        return ml.tree.LeafNode(float(tree.value[at]), float(noise), held)

    kind = ml.regression.DecisionTreeRegressionModel
    made = gateway.new_array(kind, len(trees))
    for i, (_, tree) in enumerate(trees):
        made[i] = kind(f"dtr_{uuid.uuid4().hex[:12]}", node(tree, 1), len(cuts))
    name = f"{type(trainer).__name__}_{uuid.uuid4().hex[:12]}"
    shares = doubles([share for share, _ in trees])
    if logistic:
        return trainer._copyValues(GBTClassificationModel(ml.classification.GBTClassificationModel(name, made, shares, len(cuts), 2)))
    return trainer._copyValues(GBTRegressionModel(ml.regression.GBTRegressionModel(name, made, shares, len(cuts))))


def fit(trainer, table: DataFrame, features: Sequence[str], label: Column, is_val: Column, weight: Column | None = None):
    """``trainer`` fitted to all rows of ``table``; ``is_val`` marks those that only decide when to stop."""
    spark, logistic = table.sparkSession, isinstance(trainer, GBTClassifier)
    numbers = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"f{i}") for i, c in enumerate(features)]
    rows = table.select(*numbers, label.cast("double").alias("label"), (F.lit(1.0) if weight is None else weight).alias("weight"), is_val.alias("is_val"))
    bad = F.col("label").isNull() | F.isnan("label") | (~F.col("label").isin(0.0, 1.0) if logistic else F.lit(False))
    counted = rows.agg(F.count_if(~F.col("is_val")).alias("n"), F.count_if(bad).alias("bad")).first()
    if counted["bad"]:
        raise ValueError(f"{counted['bad']} labels are missing or not allowed")
    seed, most = trainer.getOrDefault("seed"), min(trainer.getOrDefault("maxBins"), counted["n"])
    train, share = rows.where(~F.col("is_val")), max(most * most, _LEAST_SAMPLE) / counted["n"]
    sample = (train if share >= 1 else train.sample(share, seed=seed)).drop("label", "is_val").toPandas()
    cuts = [thresholds(sample[f"f{i}"].to_numpy(float), sample["weight"].to_numpy(float), most - 1) for i in range(len(features))]
    path = scratch_path(spark, f"bins-{uuid.uuid4().hex}")
    rows.mapInArrow(_blocks(cuts, weight is not None), _BLOCKS).write.option("parquet.block.size", 1 << 24).parquet(path)
    try:
        with _small_batches(spark, 16):
            trees = _boost(spark.read.schema(_BLOCKS).parquet(path), cuts, trainer, weight is not None, logistic)
    finally:
        dropped(spark, path)
    return _spark_model(spark, trees, cuts, logistic, trainer)
