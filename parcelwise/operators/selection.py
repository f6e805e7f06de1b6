"""Which orders to take under a budget: exact choice and greedy fill, for several budgets in the same passes.

Costs are few, scores many. Orders of one cost are a class, and only its best orders can be taken, so a choice is
a number for each class. A price per cost, at which a budget runs out, gives every class its greedy number and
bounds what any choice can gain; an order whose benefit is further from the price than that bound leaves open is
decided. What is undecided are a few orders of each class around its greedy number. The driver sees these, as
counts of equal orders, and merges the classes' concave gain curves by (max, +) convolution.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.operators.ranking import running_sum
from parcelwise.session import written

_BINS = 4096
_OCTAVE = 256  # steps for each doubling of the density
_ROWS = 100_000  # of kinds taken in part: up to so many, counted, are ranked by a plain window
_NEAREST = 64  # kinds of a class on each side of the price that the first look fetches
_SALTS = 64
_CARRIED = ("p_late", "upgrade_cost", "expected_penalty", "net_benefit", "risk_bucket")
_NONE = -(1 << 61)  # a cost change that no choice has


def wanted(budgets: Sequence) -> list[Decimal]:
    """The positive budgets of a comparison, a fixed short list, smallest first."""
    return sorted({Decimal(str(b)) for b in budgets if Decimal(str(b)) > 0})


def density(net: Column, cost: Column) -> Column:
    return net.cast("double") / F.greatest(cost, F.lit(1)).cast("double")


# --- prices ---------------------------------------------------------------------------


def border_prices(levels: DataFrame, budgets: Sequence[int], payable: Callable[[int], Column]) -> dict[int, tuple[float, int] | None]:
    """For each budget the density ``d`` at which it runs out, best first, and the cost of everything above it.

    None where the budget pays for all rows of ``levels`` (d, all_cost) that are ``payable`` under it. All budgets
    share their passes: each pass sums the cost per step of every open range and keeps the step that holds the
    border, so a range ends at a single density. Steps are equal ratios in the first pass, equal widths then.
    """
    out: dict[int, tuple[float, int] | None] = {b: None for b in budgets}
    ranges: dict[int, tuple[float, float, int] | None] = dict.fromkeys(range(len(budgets)))
    while ranges:
        steps = []
        for k, bounds in ranges.items():
            inside, step = payable(budgets[k]), F.floor(F.log2(F.greatest("d", F.lit(1e-300))) * _OCTAVE)
            if bounds:
                low, high, _ = bounds
                step = F.least(F.floor((F.col("d") - low) / (high - low) * _BINS), F.lit(_BINS - 1))
                inside = inside & F.col("d").between(low, high)
            steps.append(F.struct(F.lit(k).alias("k"), F.when(inside, step.cast("int")).alias("step")))
        placed = levels.select("d", "all_cost", F.explode(F.filter(F.array(*steps), lambda x: x["step"].isNotNull())).alias("at"))
        rows = placed.groupBy("at.k", "at.step").agg(F.sum("all_cost").alias("cost"), F.min("d").alias("low"), F.max("d").alias("high")).collect()
        for k, bounds in list(ranges.items()):
            above = bounds[2] if bounds else 0
            for row in sorted((r for r in rows if r["k"] == k), key=lambda r: -r["step"]):
                if above + int(row["cost"]) > budgets[k]:
                    ranges[k] = (row["low"], row["high"], above)
                    break
                above += int(row["cost"])
            if not ranges[k]:
                del ranges[k]  # the budget pays for all
            elif ranges[k][0] == ranges[k][1]:
                out[budgets[k]] = (ranges[k][0], ranges[k][2])
                del ranges[k]
    return out


# --- one budget, on the driver ----------------------------------------------------------


@dataclass
class CostClass:
    """Orders of one cost around the price: runs (benefit, number), nearest to the price first."""

    cost: int
    above: list[tuple[int, int]] = field(default_factory=list)  # worth more than the price
    below: list[tuple[int, int]] = field(default_factory=list)  # worth the price or less
    more_above: bool = False  # there are further ones than those listed
    more_below: bool = False
    taken: int = 0  # of the first run below, by the greedy choice


@dataclass
class Cut:
    """What a class gives: all orders worth more than ``over``, and ``take`` of the ``n`` that are worth just that."""

    cost: int
    over: int
    take: int = 0
    n: int = 0


def merge_curves(curves: Sequence[tuple[int, np.ndarray, np.ndarray]], room: int) -> tuple[int, list[int]]:
    """What the best change of the classes' numbers gains, and the changes, at a change of cost of ``room`` at most.

    A curve is (cost, losses, gains): what is lost with the first, second, ... order given up, and gained with
    each one added; both are concave from the class's present number. Of equal gains fewer orders win, then the
    lower cost, then the larger number for the first class, the second, and so on.
    """
    weight = 1 + sum(len(losses) + len(gains) for _, losses, gains in curves)  # of a benefit unit against one order
    down = sum(c * len(losses) for c, losses, _ in curves)
    low, high = -down, room + down
    after, tables = np.full(high - low + 1, _NONE, np.int64), []
    after[-low] = 0
    for cost, losses, gains in reversed(curves):
        value = np.concatenate([-np.cumsum(losses * weight - 1)[::-1], [0], np.cumsum(gains * weight - 1)]).astype(np.int64)
        best = np.full_like(after, _NONE)
        for k, v in zip(range(-len(losses), len(gains) + 1), value.tolist()):
            shift = k * cost
            if abs(shift) >= len(after):
                continue
            to, of = (slice(shift, None), slice(None, len(after) - shift)) if shift >= 0 else (slice(None, shift), slice(-shift, None))
            np.maximum(best[to], np.where(after[of] > _NONE, after[of] + v, _NONE), out=best[to])
        tables.append((cost, len(losses), value, after))
        after = best
    at = int(np.argmax(after[: room - low + 1]))  # fewer orders are in the value; the first is the least cost
    rest, numbers, gained = int(after[at]), [], 0
    for (cost, down_by, value, others), (_, losses, gains) in zip(reversed(tables), curves, strict=True):
        for k in range(len(gains), -down_by - 1, -1):
            source = at - k * cost
            if 0 <= source < len(others) and others[source] > _NONE and others[source] + int(value[k + down_by]) == rest:
                break
        numbers.append(k)
        gained += int(gains[:k].sum()) if k > 0 else -int(losses[:-k].sum()) if k else 0
        at, rest = source, int(others[source])
    return gained, numbers


def _items(runs: Sequence[tuple[int, int]], skip: int, most: int) -> np.ndarray:
    """Benefits of single orders of ``runs`` after the first ``skip``, ``most`` of them."""
    out: list[np.ndarray] = []
    for net, n in runs:
        n, skip = max(0, n - skip), max(0, skip - n)
        out.append(np.full(min(n, most), net, np.int64))
        most -= len(out[-1])
        if most <= 0:
            break
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def solve(classes: list[CostClass], price: Fraction, room: int) -> tuple[list[Cut], bool]:
    """The best number of each class, as cuts; False if the lists were too short to prove it.

    ``room`` is the budget left when all orders above the price are taken. The greedy choice adds orders worth the
    price while they fit. Some best choice changes no more than twice the largest cost (in units of the costs'
    greatest common divisor) of its orders, which bounds every list.
    """
    unit = math.gcd(*[c.cost for c in classes])
    reach = 2 * max(c.cost for c in classes) // unit
    p, q = price.numerator, price.denominator  # benefits are compared times q, so that all numbers are whole
    spare, full = room, True
    for c in sorted(classes, key=lambda c: -c.cost):
        at_price = bool(c.below) and c.below[0][0] * q == p * c.cost
        c.taken = min(c.below[0][1], spare // c.cost) if at_price and full else 0
        spare -= c.taken * c.cost
        full = full and (not at_price or c.taken == c.below[0][1])
    sides = []  # of each class: benefits lost with the orders given up, gained with those added
    for c in classes:
        first = np.full(min(c.taken, reach), c.below[0][0] if c.taken else 0, np.int64)
        sides.append((np.concatenate([first, _items(c.above, 0, reach)])[:reach], _items(c.below, c.taken, reach)))
    place = np.concatenate([np.full(len(items), 2 * k + side) for k, pair in enumerate(sides) for side, items in enumerate(pair)])
    far = np.concatenate([np.abs(items * q - p * c.cost) for c, pair in zip(classes, sides, strict=True) for items in pair])
    order = np.argsort(far, kind="stable")
    place, far, size = place[order], far[order], 32
    while True:
        size = min(size * 2, len(far))
        size = int(np.searchsorted(far, far[size - 1], side="right")) if size else 0
        used = np.bincount(place[:size], minlength=2 * len(classes)).reshape(-1, 2)
        chosen = [k for k in range(len(classes)) if used[k].any()]
        curves = [(classes[k].cost // unit, sides[k][0][: used[k, 0]], sides[k][1][: used[k, 1]]) for k in chosen]
        change, numbers = merge_curves(curves, spare // unit)
        gap = p * spare - change * q  # what the price leaves open: all orders above it, and the rest of the budget at the price
        if size >= len(far) or far[size] > gap:
            break
    proven = True
    for c, pair in zip(classes, sides, strict=True):
        for items, further, runs in zip(pair, (c.more_above, c.more_below), (c.above, c.below), strict=True):
            if further and len(items) < reach and abs(runs[-1][0] * q - p * c.cost) <= gap:
                proven = False
    moved = dict(zip(chosen, numbers, strict=True))
    return [_cut(c, price, moved.get(k, 0)) for k, c in enumerate(classes)], proven


def _cut(c: CostClass, price: Fraction, change: int) -> Cut:
    """The cut of a class whose number differs by ``change`` from the greedy one."""
    extra = c.taken + change
    if extra > 0:
        for net, n in c.below:
            if extra <= n:
                return Cut(c.cost, net, extra, n)
            extra -= n
    for net, n in c.above:
        if extra >= 0:
            break
        if -extra < n:
            return Cut(c.cost, net, n + extra, n)
        extra += n
        if extra == 0:
            return Cut(c.cost, net, 0, n)
    return Cut(c.cost, math.floor(price * c.cost))


# --- choice ---------------------------------------------------------------------------


def _offers(kinds: DataFrame, prices: dict[int, float]) -> DataFrame:
    """``kinds`` once per budget that can pay them: b, off (distance from the price), above."""
    each = F.array(*[
        F.struct(
            F.lit(b).alias("b"), F.abs(F.col("net") - F.lit(p) * F.col("cost")).alias("off"), (F.col("d") > p).alias("above"),
        )
        for b, p in prices.items()
    ])
    return kinds.withColumn("_b", F.explode(F.filter(each, lambda x: x["b"] >= F.col("cost")))).select("*", "_b.*").drop("_b")


def _nearest(kinds: DataFrame, prices: dict[int, float], open_: dict[int, float], number: int) -> list:
    """Of each budget, class and side the ``number`` kinds nearest to the price, if no further than the budget's ``open_``."""
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in open_.items() for x in pair]), F.col("b"))
    rows = _offers(kinds, prices).where(F.col("off") <= limit)
    if number > 1000:  # up to there Spark keeps the first of each task before it shuffles
        part = Window.partitionBy("b", "cost", "above", F.pmod(F.xxhash64("net"), F.lit(_SALTS))).orderBy("off")
        rows = rows.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= number)
    whole = Window.partitionBy("b", "cost", "above").orderBy("off")
    rows = rows.withColumn("_rn", F.row_number().over(whole)).where(F.col("_rn") <= number)
    return rows.select("b", "cost", "above", "net", "n", "d", "_rn").collect()


def choice_cuts(kinds: DataFrame, budgets: Sequence[int]) -> dict[int, tuple[float, list[Cut]] | None]:
    """For each budget (in cents) its price and the cuts of the classes near it, or None if it pays for all that it
    can pay. A class without a cut gives all orders whose density exceeds the price.

    ``kinds`` are (cost, net, n, d, all_cost) of orders with a cost, in cents and ten-thousandths.
    """
    found = border_prices(kinds, budgets, lambda b: F.col("cost") <= b)
    out: dict[int, tuple[float, list[Cut]] | None] = {b: None for b in budgets}
    prices = {b: p[0] for b, p in found.items() if p is not None}
    room = {b: b - found[b][1] for b in prices}
    # a bound of what the greedy choice can miss: the room times the price
    open_ = {b: room[b] * p * (1 + 1e-9) + 1 for b, p in prices.items()}
    number = _NEAREST
    while prices:
        classes: dict[int, dict[int, CostClass]] = {b: {} for b in prices}
        exact: dict[int, Fraction] = {}
        for row in sorted(_nearest(kinds, prices, open_, number), key=lambda r: r["_rn"]):
            c = classes[row["b"]].setdefault(row["cost"], CostClass(row["cost"]))
            (c.above if row["above"] else c.below).append((int(row["net"]), int(row["n"])))
            if row["d"] == prices[row["b"]]:
                exact.setdefault(row["b"], Fraction(int(row["net"]), row["cost"]))
            if row["_rn"] == number:
                c.more_above, c.more_below = c.more_above or row["above"], c.more_below or not row["above"]
        for b in list(prices):
            cuts, proven = solve([classes[b][c] for c in sorted(classes[b])], exact[b], room[b])
            if proven:
                out[b] = (prices.pop(b), cuts)
                del open_[b]
        number *= 8
    return out


def choose(cands: DataFrame, key: str, budgets: Sequence) -> DataFrame:
    """Best affordable set per budget, one row per budget and chosen order; exact for any number of candidates.

    Benefit is compared in ten-thousandths and cost in cents. Of several best sets the one with fewest orders
    is chosen, then the cheapest, then the one that takes most orders of the lowest cost, the next cost, and so on;
    within one cost and benefit the smallest keys. Orders without benefit or with a negative cost are left out.
    """
    pool = cands.select(key, *_CARRIED).where((F.col("net_benefit") > 0) & (F.col("upgrade_cost") >= 0))
    pool = pool.withColumns({"_cost": F.round(F.col("upgrade_cost") * 100).cast("long"), "_net": F.round(F.col("net_benefit") * 10_000).cast("long")})
    amounts = {int(b * 100): b for b in wanted(budgets)}
    if not amounts:
        return pool.limit(0).drop("_cost", "_net").withColumn("budget", F.lit(None).cast("decimal(18,2)"))
    pool = written(pool, "candidates")  # read for the kinds, for the choice and for the ranks within a kind
    kinds = pool.groupBy(F.col("_cost").alias("cost"), F.col("_net").alias("net")).agg(F.count("*").alias("n"))
    kinds = kinds.where((F.col("cost") > 0) & (F.col("net") > 0)).withColumns({"all_cost": F.col("cost") * F.col("n"), "d": density(F.col("net"), F.col("cost"))})
    kinds = kinds.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cuts = choice_cuts(kinds, list(amounts))
    finally:
        kinds.unpersist()
    by_cost: dict[int, list[tuple]] = {}  # a row per cost near a price, an entry per budget
    for b, found in cuts.items():
        for c in found[1] if found else ():
            by_cost.setdefault(c.cost, []).append((b, c.over, c.take, c.n))
    table = pool.sparkSession.createDataFrame(list(by_cost.items()), "_cost long, _cuts array<struct<b:long,over:long,take:long,n:long>>")
    marked = pool.join(F.broadcast(table), "_cost", "left").withColumn("_cuts", F.coalesce("_cuts", F.expr("array()")))
    net, d = F.col("_net"), density(F.col("_net"), F.col("_cost"))
    price = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(found[0] if found else -1.0).alias("price")) for b, found in cuts.items()])
    cut = F.filter("_cuts", lambda x: (net > x["over"]) | (net == x["over"]) & (x["take"] == x["n"]) & (x["n"] > 0))
    rest = F.filter(price, lambda x: (F.col("_cost") <= x["b"]) & (d > x["price"]) & ~F.exists("_cuts", lambda y: y["b"] == x["b"]))
    taken = F.when(F.col("_cost") == 0, F.transform(price, lambda x: x["b"])).otherwise(F.concat(F.transform(rest, lambda x: x["b"]), F.transform(cut, lambda x: x["b"])))
    out = marked.withColumn("_b", F.explode(taken)).drop("_cuts")
    parts = [n for found in by_cost.values() for *_, take, n in found if 0 < take < n]
    if parts:
        partly = marked.withColumn("_cut", F.explode(F.filter("_cuts", lambda x: (net == x["over"]) & (x["take"] > 0) & (x["take"] < x["n"]))))
        partly = partly.withColumns({"_b": F.col("_cut.b"), "_take": F.col("_cut.take")}).drop("_cuts", "_cut")
        if sum(parts) <= _ROWS:
            partly = partly.withColumn("_place", F.row_number().over(Window.partitionBy("_b", "_cost").orderBy(key)))
        else:
            partly = running_sum(partly, ["_b", "_cost"], [key], F.lit(1), "_place")
        out = out.unionByName(partly.where("_place <= _take").drop("_place", "_take"))
    named = F.element_at(F.create_map(*[x for b, amount in amounts.items() for x in (F.lit(b), F.lit(amount).cast("decimal(18,2)"))]), F.col("_b"))
    return out.withColumn("budget", named).drop("_b", "_cost", "_net")


def choose_greedy(cands: DataFrame, key: str, budgets: Sequence) -> DataFrame:
    """Fill by benefit per cost, best first, equal ones by key, until the next order is not affordable.

    Everything above the density at which a budget runs out is taken; the orders of that density are added in
    key order by a running sum that no single task forms.
    """
    rated = cands.select(key, *_CARRIED).where("upgrade_cost > 0").withColumns({
        "_d": F.try_divide(F.col("net_benefit").cast("double"), F.col("upgrade_cost").cast("double")),
        "_cents": F.round(F.col("upgrade_cost") * 100).cast("long"),
    })
    amounts = {int(b * 100): b for b in wanted(budgets)}
    if not amounts:
        return cands.select(key, *_CARRIED).limit(0).withColumn("budget", F.lit(None).cast("decimal(18,2)"))
    rated = written(rated, "candidates")
    levels = rated.groupBy(F.col("_d").alias("d")).agg(F.sum("_cents").alias("all_cost")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = border_prices(levels, list(amounts), lambda b: F.lit(True))
    finally:
        levels.unpersist()
    borders = F.array(*[
        F.struct(F.lit(amount).cast("decimal(18,2)").alias("budget"), F.lit(p and p[0]).cast("double").alias("border"), F.lit(b - p[1] if p else 0).cast("long").alias("rest"))
        for (b, amount), p in zip(amounts.items(), found.values(), strict=True)
    ])
    each = rated.withColumn("_b", F.explode(F.filter(borders, lambda x: x["border"].isNull() | (F.col("_d") >= x["border"]))))
    whole = each.where("_b.border is null or _d > _b.border").withColumn("budget", F.col("_b.budget"))
    tied = each.where("_d = _b.border").withColumns({"budget": F.col("_b.budget"), "_rest": F.col("_b.rest")}).drop("_b", "_d")
    if any(found.values()):
        tied = running_sum(tied, ["budget"], [key], F.col("_cents"), "_spent").where("_spent <= _rest")
        whole = whole.drop("_b", "_d").unionByName(tied.drop("_rest", "_spent"))
    return whole.select(key, *_CARRIED, "budget")
