"""Exact ranks, cut points and quantiles without a one-task sort.

A global ``row_number`` or an exact ``percentile`` puts the whole table (or all
its distinct values) into one task. Here a mergeable rank sketch brackets a wanted
quantile and one pass over the bracket finds it; wider brackets, and the cut points
of row keys, are narrowed by counting rows per value range. Each pass is a scan
with a small partial aggregation: no wide shuffle, and a value held by a third
of all rows is one counter.
"""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.session import shared_dir, stored

_BUCKETS = 512
_FINISH_ROWS = 20_000
_MAX_PASSES = 400
_LARGEST = sys.float_info.max
_SKETCH = 10_000
_COLUMN_SKETCH = 1_000  # of each of several columns: the sketches of all tasks meet in one, so they are kept small
_SAMPLE = 4_000


def exact_quantiles(
    long_df: DataFrame, group: str, value: str, probs: Sequence[float]
) -> dict[tuple[str, float], float]:
    """Linear-interpolated quantiles per group, exact.

    The driver keeps one range per group and quantile, so ``group`` is meant for
    columns, splits or segments. Infinite values take part like any other; a
    quantile between unlike infinities is NaN.
    """
    base = long_df.select(
        F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v")
    ).where("v is not null and not isnan(v)")
    with _kept(base):
        return _quantiles(base, probs)


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[tuple[str, float], float]:
    """The same for columns of doubles, side by side: a row is not multiplied by its columns.

    One pass makes a sketch of each column, one counts the rows below and inside the brackets, and only rows inside
    a bracket are listed by column.
    """
    if not columns or not probs:
        return {}
    values = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"v{i}") for i, c in enumerate(columns)]
    base = df.select(*values)
    with _kept(base):
        return _quantiles_of_columns(base, list(columns), probs)


@contextmanager
def _kept(base: DataFrame) -> Iterator[None]:
    """Narrow columns that several passes read: worth keeping instead of redoing what made them, unless they lie in files."""
    keep = not stored(base)
    if keep:
        base.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield
    finally:
        if keep:
            base.unpersist()


def _marks(probs: Sequence[float], reach: float) -> list[float]:
    """The ranks that a sketch is asked for: each wanted one and its reach to both sides."""
    return sorted({min(1.0, max(0.0, p + side)) for p in probs for side in (-reach, reach)})


def _quantiles_of_columns(base: DataFrame, columns: list[str], probs: Sequence[float]) -> dict[tuple[str, float], float]:
    reach = 4 / _COLUMN_SKETCH  # a sketch is off by a rank of n / _COLUMN_SKETCH at most
    marks = _marks(probs, reach)
    asked = F.array(*[F.lit(m) for m in marks])
    made = [
        F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.approx_percentile(v, asked, F.lit(_COLUMN_SKETCH)).alias("marks")).alias(v)
        for v in base.columns
    ]
    totals = {c: row for c, row in zip(columns, base.agg(*made).first(), strict=True) if row["n"]}
    sizes = {c: row["n"] for c, row in totals.items()}
    found: dict[tuple[str, int], float] = {}
    brackets: dict[tuple[str, float, float], set[int]] = {}
    for c, row in totals.items():
        n, at = row["n"], dict(zip(marks, row["marks"], strict=True))
        found.update({(c, 0): row["lo"], (c, n - 1): row["hi"]})
        for p in probs:
            ranks = {r for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))) if (c, r) not in found}
            low, high = (at[max(0.0, p - reach)], at[min(1.0, p + reach)]) if n > _COLUMN_SKETCH else (row["lo"], row["hi"])
            if ranks:
                brackets.setdefault((c, low, high), set()).update(ranks)
    if brackets:
        _inside_of_columns(base, columns, totals, brackets, found)
    return _interpolated(sizes, probs, found)


def _inside_of_columns(base: DataFrame, columns: list[str], totals: dict, brackets: dict[tuple[str, float, float], set[int]], found: dict[tuple[str, int], float]) -> None:
    """Adds the wanted ranks of every bracket to ``found``."""
    spans, place = list(brackets), {c: F.col(f"v{i}") for i, c in enumerate(columns)}
    counts = base.agg(*[x for c, lo, hi in spans for x in (F.count_if(place[c] < lo), F.count_if(place[c] <= hi))]).first()
    ranges: dict[tuple[str, float, float, int], dict[int, int]] = {}
    for k, (c, low, high) in enumerate(spans):
        below, upto = counts[2 * k], counts[2 * k + 1]
        for r in brackets[(c, low, high)]:
            if not below <= r < upto:  # the sketch was off by more than it promises
                ranges.setdefault((c, totals[c]["lo"], totals[c]["hi"], totals[c]["n"]), {})[r] = r
            elif low == high:
                found[(c, r)] = low
            else:
                ranges.setdefault((c, low, high, upto - below), {})[r] = r - below
    if not ranges:
        return
    edges: dict[str, list[Column]] = {}
    for c, low, high, _ in ranges:
        edges.setdefault(c, []).append(place[c].between(low, high))
    within = {c: functools.reduce(lambda a, b: a | b, each) for c, each in edges.items()}
    listed = F.array(*[F.struct(F.lit(c).alias("g"), F.when(here, place[c]).alias("v")) for c, here in within.items()])
    near = base.where(functools.reduce(lambda a, b: a | b, within.values())).select(F.explode(listed).alias("x")).select("x.*").where("v is not null")
    near.persist(StorageLevel.MEMORY_AND_DISK)  # few rows, made by a pass over all
    try:
        _narrowed(near, ranges, found)
    finally:
        near.unpersist()


def _quantiles(base: DataFrame, probs: Sequence[float]) -> dict[tuple[str, float], float]:
    """A rank sketch brackets every quantile, one pass over the brackets finds it; what that cannot finish is narrowed."""
    reach = 4 / _SKETCH  # the sketch is off by a rank of n / _SKETCH at most
    marks = _marks(probs, reach)
    totals = base.groupBy("g").agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.approx_percentile("v", F.array(*[F.lit(m) for m in marks]), F.lit(_SKETCH)).alias("marks"),
    ).collect()
    sizes = {row["g"]: row["n"] for row in totals}
    found: dict[tuple[str, int], float] = {}
    brackets: dict[tuple[str, float, float], set[int]] = {}
    expected = 0
    for row in totals:
        g, n = row["g"], row["n"]
        found.update({(g, 0): row["lo"], (g, n - 1): row["hi"]})
        at = dict(zip(marks, row["marks"], strict=True))
        for p in probs:
            ranks = {r for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))) if (g, r) not in found}
            low, high = (at[max(0.0, p - reach)], at[min(1.0, p + reach)]) if n > _SKETCH else (row["lo"], row["hi"])
            if ranks:
                brackets.setdefault((g, low, high), set()).update(ranks)
    expected = sum(min(sizes[g], max(_SKETCH, sizes[g] * 4 * reach)) for g, *_ in brackets)
    if brackets and expected <= 10 * _FINISH_ROWS:
        found.update(_inside(base, brackets))
    edges = {row["g"]: (row["lo"], row["hi"]) for row in totals}
    left: dict[str, dict[int, int]] = {}
    for (g, *_), ranks in brackets.items():
        left.setdefault(g, {}).update({r: r for r in ranks if (g, r) not in found})
    _narrowed(base, {(g, *edges[g], sizes[g]): ranks for g, ranks in left.items() if ranks}, found)
    return _interpolated(sizes, probs, found)


def _narrowed(base: DataFrame, ranges: dict[tuple[str, float, float, int], dict[int, int]], found: dict[tuple[str, int], float]) -> None:
    """Adds to ``found`` the ranks wanted of each range of values, given with their place inside it."""
    small: dict[tuple[str, float, float], dict[int, int]] = {}
    for _ in range(_MAX_PASSES):
        wide = {}
        for (g, low, high, n), inside in ranges.items():
            if low == high:
                found.update({(g, r): low for r in inside})
            elif n <= _FINISH_ROWS:
                small[(g, low, high)] = inside
            else:
                wide[(g, low, high)] = inside
        if not wide:
            break
        ranges = _narrow_values(base, wide)
        stuck = {key[:3] for key in ranges} & set(wide)
        if stuck:
            raise RuntimeError(f"no progress in the value ranges {sorted(map(str, stuck))[:3]}")
    else:
        raise RuntimeError(f"quantiles not found in {_MAX_PASSES} passes")
    if small:
        found.update(_pick_values(base, small))


def _interpolated(sizes: dict[str, int], probs: Sequence[float], found: dict[tuple[str, int], float]) -> dict[tuple[str, float], float]:
    result = {}
    for g, n in sizes.items():
        for p in probs:
            pos = p * (n - 1)
            low, high = found[(g, math.floor(pos))], found[(g, math.ceil(pos))]
            share = pos - math.floor(pos)
            # the weighted form where the difference of the two leaves the double range
            between = low + (high - low) * share if math.isfinite(high - low) else low * (1 - share) + high * share
            result[(g, p)] = low if low == high or not share else between
    return result


def _inside(base: DataFrame, brackets: dict[tuple[str, float, float], set[int]]) -> dict[tuple[str, int], float]:
    """The wanted ranks that lie in their bracket: rows below it are counted, values inside it are listed with their number."""
    spans = list(brackets)
    if len(spans) <= 100:
        each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("rg"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (g, lo, hi) in enumerate(spans)])
        rows = base.select("v", F.explode(F.filter(each, lambda x: x["rg"].eqNullSafe(F.col("g")) & (F.col("v") <= x["hi"]))).alias("x")).select("v", "x.*")
    else:
        ranges = base.sparkSession.createDataFrame([(i, *span) for i, span in enumerate(spans)], "i int, rg string, lo double, hi double")
        rows = base.join(F.broadcast(ranges), F.col("g").eqNullSafe(F.col("rg")) & (F.col("v") <= F.col("hi")))
    counted = rows.groupBy("i", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("at")).agg(F.count("*").alias("n")).collect()
    listed: dict[int, list[tuple[float, int]]] = {}
    before = dict.fromkeys(range(len(spans)), 0)
    for row in counted:
        if row["at"] is None:
            before[row["i"]] = row["n"]
        else:
            listed.setdefault(row["i"], []).append((row["at"], row["n"]))
    out = {}
    for i, span in enumerate(spans):
        wanted, seen = sorted(r for r in brackets[span] if r >= before[i]), before[i]
        for value, n in sorted(listed.get(i, ())):
            while wanted and wanted[0] < seen + n:
                out[(span[0], wanted.pop(0))] = value
            seen += n
    return out


def _range_row(i: int, g: str, low: float, high: float) -> tuple:
    """How the values of an open range are placed: infinite ends apart, far-reaching ranges by magnitude."""
    ends = [x for x in (low, high) if math.isfinite(x)]
    by_size = len(ends) < 2 or not math.isfinite(high - low) or abs(high - low) > 1024 * max(min(abs(low), abs(high)), 1e-300)
    if not by_size:
        return i, g, low, high, False, low, high - low
    sized = [math.copysign(math.log1p(min(abs(x), _LARGEST)), x) for x in (low, high)]
    if sized[0] == sized[1]:
        return i, g, low, high, False, low, high - low
    return i, g, low, high, True, sized[0], sized[1] - sized[0]


def _in_ranges(base: DataFrame, spans: list[tuple[str, float, float]]) -> DataFrame:
    """Rows inside the open ranges, joined on the group where they lie.

    The driver holds the ranges, a few per group, so they are broadcast: Spark does not know their size and would
    shuffle all rows by the group, and sort each group in one task.
    """
    rows = [_range_row(i, g, lo, hi) for i, (g, lo, hi) in enumerate(spans)]
    ranges = base.sparkSession.createDataFrame(rows, "i int, rg string, lo double, hi double, by_size boolean, zero double, span double")
    return base.join(F.broadcast(ranges), F.col("g").eqNullSafe(F.col("rg")) & F.col("v").between(F.col("lo"), F.col("hi")))


def _narrow_values(base: DataFrame, wide: dict) -> dict:
    """Count each open range in steps and keep the steps that hold a wanted rank.

    The lowest value always falls into the first step and the highest into the last, so every range shrinks.
    """
    spans = list(wide)
    sized = F.signum("v") * F.log1p(F.least(F.abs("v"), F.lit(_LARGEST)))
    place = F.floor((F.when(F.col("by_size"), sized).otherwise(F.col("v")) - F.col("zero")) / F.col("span") * _BUCKETS)
    step = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), _BUCKETS - 1)
    step = step.otherwise(F.greatest(F.lit(0), F.least(place, F.lit(_BUCKETS - 1))))
    counted = (
        _in_ranges(base, spans)
        .groupBy("i", step.alias("b"))
        .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()
    )
    steps: dict[int, list] = {}
    for row in counted:
        steps.setdefault(row["i"], []).append(row)
    out: dict[tuple[str, float, float, int], dict[int, int]] = {}
    for i, (span, inside) in enumerate(wide.items()):
        below = 0
        for row in sorted(steps.get(i, ()), key=lambda r: r["b"]):
            held = {r: left - below for r, left in inside.items() if below <= left < below + row["n"]}
            if held:
                out.setdefault((span[0], row["lo"], row["hi"], row["n"]), {}).update(held)
            below += row["n"]
    return out


def _pick_values(base: DataFrame, small: dict) -> dict[tuple[str, int], float]:
    """Read the wanted ranks out of ranges of a few thousand rows."""
    spans = list(small)
    rank = F.row_number().over(Window.partitionBy("i").orderBy("v")) - 1
    picks = {(i, left): (spans[i][0], r) for i, inside in enumerate(small.values()) for r, left in inside.items()}
    wanted = base.sparkSession.createDataFrame(list(picks), "i int, rn int")
    rows = _in_ranges(base, spans).select("i", "v").withColumn("rn", rank).join(F.broadcast(wanted), ["i", "rn"]).collect()
    return {picks[(r["i"], r["rn"])]: r["v"] for r in rows}


def cut_points(
    df: DataFrame, keys: Sequence[str], ranks: Callable[[int], Iterable[int]]
) -> dict[int, tuple[int, ...]]:
    """The rows at 1-based ranks in the order of integer ``keys``.

    ``ranks`` gives the wanted ranks for a row count. The keys together must
    identify a row. NULL keys sort last. All ranks share the counting passes;
    what is sorted in the end is a few thousand rows per rank.
    """
    last = 2**62
    base = df.select(*[F.coalesce(F.col(k).cast("long"), F.lit(last)).alias(f"k{i}") for i, k in enumerate(keys)])
    with _kept(base):
        return _cuts(base, [f"k{i}" for i in range(len(keys))], lambda n: {r: r for r in ranks(n)})


def _cuts(
    frame: DataFrame, names: list[str], ranks: Callable[[int], dict[int, int]]
) -> dict[int, tuple[int, ...]]:
    """``ranks`` maps ranks of the whole table to ranks inside ``frame``."""
    key = F.col(names[0])
    edge = frame.agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    wanted = ranks(edge["n"])
    if not wanted:
        return {}
    if not all(1 <= left <= edge["n"] for left in wanted.values()):
        raise ValueError(f"ranks outside 1..{edge['n']}")
    ranges = {(edge["lo"], edge["hi"], edge["n"]): wanted}
    found: dict[int, tuple[int, ...]] = {}
    small: dict[tuple[int, int], dict[int, int]] = {}
    while ranges:
        wide: dict[tuple[int, int, int], dict[int, int]] = {}
        for (low, high, n), inside in ranges.items():
            if n <= _FINISH_ROWS:
                small[(low, high)] = inside
            elif low < high:
                wide[(low, high, n)] = inside
            elif len(names) > 1:
                rest = _cuts(frame.where(key == low), names[1:], lambda _, inside=inside: inside)
                found.update({r: (low, *tail) for r, tail in rest.items()})
            else:
                found.update({r: (low,) for r in inside})
        ranges = _narrow(frame, key, wide) if wide else {}
    return {**found, **(_finish(frame, names, small) if small else {})}


def _range_number(key: Column, spans: Sequence[tuple[int, int]]) -> Column:
    return F.coalesce(*[F.when(key.between(lo, hi), F.lit(i)) for i, (lo, hi) in enumerate(spans)])


def _narrow(frame: DataFrame, key: Column, wide: dict) -> dict:
    """Count each open range in equal steps and keep the steps that hold a wanted rank."""
    spans = [(lo, hi) for lo, hi, _ in wide]
    steps = [-(-(hi - lo + 1) // _BUCKETS) for lo, hi in spans]
    step_of = [
        F.when(key.between(lo, hi), F.floor((key - lo) / F.lit(step))) for (lo, hi), step in zip(spans, steps)
    ]
    counted = (
        frame.select(_range_number(key, spans).alias("i"), F.coalesce(*step_of).alias("b"), key.alias("k"))
        .where("i is not null")
        .groupBy("i", "b")
        .agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
        .collect()
    )
    out: dict[tuple[int, int, int], dict[int, int]] = {}
    for i, inside in enumerate(wide.values()):
        below = 0
        for row in sorted((r for r in counted if r["i"] == i), key=lambda r: r["b"]):
            held = {r: left - below for r, left in inside.items() if below < left <= below + row["n"]}
            if held:
                out[(row["lo"], row["hi"], row["n"])] = held
            below += row["n"]
    return out


def _finish(frame: DataFrame, names: list[str], small: dict) -> dict[int, tuple[int, ...]]:
    spans = list(small)
    number = F.row_number().over(Window.partitionBy("i").orderBy(*names))
    picks = [(i, left, rank) for i, inside in enumerate(small.values()) for rank, left in inside.items()]
    wanted = F.struct("i", "rn").isin([F.struct(F.lit(i), F.lit(left)) for i, left, _ in picks])
    rows = (
        frame.withColumn("i", _range_number(F.col(names[0]), spans))
        .where("i is not null")
        .withColumn("rn", number)
        .where(wanted)
        .collect()
    )
    at = {(r["i"], r["rn"]): tuple(r[n] for n in names) for r in rows}
    return {rank: at[(i, left)] for i, left, rank in picks}


def at_or_before(keys: Sequence[str], cut: tuple[int, ...]) -> Column:
    """True for rows not after ``cut`` in key order: a plain projection."""
    last = 2**62
    here = [F.coalesce(F.col(k).cast("long"), F.lit(last)) for k in keys]
    there = [F.lit(v).cast("long") for v in cut]
    out = here[-1] <= there[-1]
    for mine, other in zip(here[-2::-1], there[-2::-1], strict=True):
        out = (mine < other) | (mine == other) & out
    return out


def dense_index(distinct_df: DataFrame, group: str, key: str, out: str = "code", start: int = 0) -> DataFrame:
    """Number distinct ``key`` values inside each ``group`` in sorted order.

    The sort is range-partitioned over all tasks and checkpointed, so that the
    partition numbers it hands out stay fixed if an executor is lost; only
    (group, partition) counts are cumulated.
    """
    shared_dir(distinct_df.sparkSession)
    placed = distinct_df.select(group, key).sort(group, key).withColumn("pid", F.spark_partition_id()).checkpoint()
    before = (
        placed.groupBy(group, "pid")
        .agg(F.count("*").alias("n"))
        .withColumn(
            "offset",
            F.coalesce(
                F.sum("n").over(Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("n")
    )
    local = F.row_number().over(Window.partitionBy(group, "pid").orderBy(key))
    return (
        placed.withColumn("local", local)
        .join(before, [group, "pid"])
        .select(group, key, (F.col("offset") + F.col("local") - 1 + start).cast("int").alias(out))
    )


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of whole numbers ``value`` up to each row in ``order``, within ``by``.

    Rows are sorted by ranges of (by, order) and checkpointed, so that the ranges stay fixed if an executor is
    lost; a row's sum is that inside its range and the totals of the ranges before it. No task holds more than a
    range, however large a group is. ``by`` must not be null and, with ``order``, should tell rows apart.
    """
    shared_dir(df.sparkSession)
    sort = [*by, *order]
    placed = df.withColumn("_value", value.cast("long")).repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = placed.withColumn("_at", F.monotonically_increasing_id()).checkpoint().withColumn("_range", F.shiftright("_at", 33))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*by, "_range").agg(F.sum("_value").alias("_sum"))
    before = before.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = F.sum("_value").over(Window.partitionBy(*by, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    summed = placed.withColumn("_inside", inside).join(before, [*by, "_range"])
    return summed.withColumn(out, F.col("_inside") + F.col("_before")).select(*df.columns, out)


# --- places in an ordered list ------------------------------------------------------------


def sort_columns(order: Sequence[str]) -> list[Column]:
    """Sort order from names; a leading minus means descending. Nulls come first, in descending columns last."""
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]


def precedes(order: Sequence[str], key: Sequence, or_equal: bool = False) -> Column:
    """True for rows that come before ``key``, one value per column of ``order``."""
    out, equal = F.lit(False), F.lit(True)
    for name, value in zip(order, key, strict=True):
        down, c = name.startswith("-"), F.col(name.removeprefix("-"))
        if value is None:
            less = c.isNotNull() if down else F.lit(False)
        else:
            less = F.coalesce(c > F.lit(value), F.lit(False)) if down else F.coalesce(c < F.lit(value), F.lit(True))
        out, equal = out | equal & less, equal & c.eqNullSafe(F.lit(value))
    return out | equal if or_equal else out


def around_places(
    df: DataFrame, order: Sequence[str], start: int, stop: int, total: int | None = None, keys: DataFrame | None = None,
) -> tuple[DataFrame, int]:
    """The rows of a key range that holds the places ``start`` to ``stop`` (from 0, exclusive) of the ordered list, and
    how many rows come before it.

    A sample of a few thousand keys proposes a range, a count over all rows confirms it or asks for a wider one;
    this repeats inside the range until few rows are left. Keys may be numbers, decimals, texts and dates. ``df`` is
    made once for all these passes, which read its kept key columns, and once more for the rows of the range;
    ``keys`` are those columns where the caller keeps them already.
    """
    kept = [df.select(*_names(order)).persist(StorageLevel.MEMORY_AND_DISK)] if keys is None else []
    try:
        return _around(df, keys if keys is not None else kept[0], order, start, stop, total, kept)
    finally:
        for frame in kept:
            frame.unpersist()


def _names(order: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(c.removeprefix("-") for c in order))


def _around(df: DataFrame, rows: DataFrame, order: Sequence[str], start: int, stop: int, total: int | None, kept: list[DataFrame]) -> tuple[DataFrame, int]:
    names, before = _names(order), 0
    n = rows.count() if total is None else total
    if start >= n:
        return df.where(F.lit(False)), start
    out, spread = df, 4.0
    while n > _FINISH_ROWS and spread < 64:
        sample = rows.select(*names).sample(min(1.0, _SAMPLE / n), seed=n).orderBy(*sort_columns(order)).collect()
        margin = spread * math.sqrt(len(sample)) + 1
        first, last = math.floor(start / n * len(sample) - margin), math.ceil(min(stop, n) / n * len(sample) + margin)
        low = precedes(order, sample[first]) if first >= 0 else F.lit(False)
        high = precedes(order, sample[last], True) if last < len(sample) else F.lit(True)
        seen = rows.agg(F.count_if(low).alias("before"), F.count_if(~low & high).alias("inside")).first()
        if not seen["before"] <= start or seen["before"] + seen["inside"] < min(stop, n):
            spread *= 2
            continue
        if seen["inside"] > 0.8 * n:
            break  # rows that the keys do not tell apart
        inside = ~low & high
        rows, out, before, n = rows.where(inside).persist(StorageLevel.MEMORY_AND_DISK), out.where(inside), before + seen["before"], seen["inside"]
        kept.append(rows)
        start, stop = start - seen["before"], stop - seen["before"]
    return out, before
