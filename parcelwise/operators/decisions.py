"""Which orders to upgrade, what-if grids and rescue of losing orders."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.constants import (
    DEFAULT_MODE_COST, DEFAULT_ORDER_DATE, DEFAULT_PENALTY, DEFAULT_RISK_THRESHOLD, DEFAULT_UNIT_COST, DISCOUNT_GRID, LEVER_NUMBERS, LEVER_TEXTS,
    MODE_BASE_COST, MODE_GRID, ORDER_DATE, PROFIT_CATEGORICAL, PROFIT_NUMERIC, PROFIT_TARGET, SYNONYM_GROUPS,
)
from parcelwise.functions.scalars import display_id, ratio
from parcelwise.operators.codes import POSITION, Codes
from parcelwise.operators.money import (
    MONEY, complete_fields, dec, region_multiplier, with_net_benefit,
)
from parcelwise.operators.selection import choose, choose_greedy, wanted  # noqa: F401 - part of this module's functions


# --- candidates -------------------------------------------------------------------


def riskiest_item(df: DataFrame, key: str, ties: Sequence[str], codes: Codes | None = None) -> DataFrame:
    """One row per order: highest score, then the given tie columns.

    An aggregate rather than a window, so an order with very many items is
    reduced on the map side. With ``codes`` for ``p_late``, the ties and the texts it is a hash aggregate, and
    only the columns that are used later are carried.
    """
    if codes is not None:
        others = [c for c in df.columns if c != key]
        at = codes.position(df, ["-p_late", *ties], nulls_first=False)
        rows = codes.encode(df.withColumn(POSITION, at), others)
        return codes.decode(rows.groupBy(key).agg(*[F.min_by(F.col(c), F.col(POSITION)).alias(c) for c in others]))
    order = F.struct("p_late", *[(-F.col(t)).alias(f"t{i}") for i, t in enumerate(ties)])
    best = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("b"))
    return best.select(key, "b.*")


def candidates(df: DataFrame, threshold=DEFAULT_RISK_THRESHOLD) -> DataFrame:
    """Risky enough and worth more than they cost."""
    return with_net_benefit(df.where(F.col("p_late") >= dec(threshold))).where(F.col("net_benefit") > 0)


def top_candidates(df: DataFrame, key: str, limit: int) -> DataFrame:
    """A list of the best candidates, most net benefit first; a selection takes all of them instead."""
    return df.orderBy(F.desc("net_benefit"), key).limit(limit)


def prepare(
    df: DataFrame, key: str, ties: Sequence[str], penalty=DEFAULT_PENALTY, unit_cost=DEFAULT_UNIT_COST,
    threshold=DEFAULT_RISK_THRESHOLD, cost_basis: str = "auto", codes: Codes | None = None,
) -> DataFrame:
    """Completed, de-duplicated and filtered candidates."""
    full = complete_fields(df, penalty, unit_cost, cost_basis)
    return candidates(riskiest_item(full, key, ties, codes), threshold)


# --- chosen orders ------------------------------------------------------------------


def selection_totals(chosen: DataFrame, budgets: Sequence) -> DataFrame:
    """Cost, avoided penalty, saving and budget use; budgets without a choice show 0."""
    spark = chosen.sparkSession
    amounts = wanted(budgets)
    frame = spark.createDataFrame([(b,) for b in amounts], "budget decimal(18,2)")
    totals = chosen.groupBy("budget").agg(
        F.count("*").alias("selected_count"),
        F.sum(F.col("upgrade_cost").cast(MONEY)).alias("c"),
        F.sum(F.col("net_benefit").cast(MONEY)).alias("s"),
        F.sum(F.col("expected_penalty").cast(MONEY)).alias("a"),
    )
    zero = dec(0)
    return frame.join(totals, "budget", "left").select(
        F.col("budget").cast("double").alias("budget"),
        F.coalesce("selected_count", F.lit(0)).alias("selected_count"),
        F.round(F.coalesce("c", zero), 2).cast("double").alias("total_cost"),
        F.round(F.coalesce("s", zero), 2).cast("double").alias("expected_total_saving"),
        F.round(F.coalesce("a", zero), 2).cast("double").alias("expected_total_penalty_avoided"),
        F.round(F.coalesce("c", zero) * 100 / F.col("budget"), 2).cast("double").alias("budget_usage_pct"),
    )


def best_scenario(totals: DataFrame) -> DataFrame:
    """Highest saving, then most orders, then the smaller budget."""
    order = F.struct("expected_total_saving", "selected_count", (-F.col("budget")).alias("b"))
    return totals.agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")


def selection_report(chosen: DataFrame, key: str) -> DataFrame:
    """Rounded rows with decision and reason, best benefit first."""
    rounded = chosen.select(
        "budget", key, "risk_bucket",
        F.round("p_late", 4).cast("double").alias("p_late"),
        F.round("upgrade_cost", 2).cast("double").alias("upgrade_cost"),
        F.round("expected_penalty", 2).cast("double").alias("expected_penalty"),
        F.round("net_benefit", 2).cast("double").alias("net_benefit"),
        F.lit("Upgrade").alias("decision"),
        reason_text().alias("reason"),
    )
    return rounded.orderBy("budget", F.desc("net_benefit"), F.desc("p_late"), key)


def reason_text() -> Column:
    return F.concat(
        F.col("risk_bucket"), F.lit(" risk, p_late="),
        F.round("p_late", 2).cast("decimal(5,2)").cast("string"),
        F.lit(", net benefit USD $"), F.round("net_benefit", 0).cast("decimal(18,0)").cast("string"),
        F.lit(", within budget"),
    )


def enrich(chosen: DataFrame, mart: DataFrame, key: str) -> DataFrame:
    """Profit at risk, profit, segment and customer of the chosen orders.

    The few chosen rows are joined first and made unique afterwards, so a mart
    with repeated orders neither multiplies them nor has to be grouped as a whole.
    """
    extra = ["epar", "profit_actual", "customer_segment", "customer_id"]
    joined = chosen.join(mart.select(key, *extra), key, "left")
    first = F.min(F.struct("customer_id", "epar", "profit_actual", "customer_segment")).alias("m")
    return joined.groupBy(*chosen.columns).agg(first).select(*chosen.columns, "m.*")


def customer_rollup(enriched: DataFrame, top: int = 20) -> DataFrame:
    grouped = enriched.groupBy("customer_id_hash").agg(
        F.count("*").alias("orders"),
        F.round(F.sum("epar"), 2).cast("double").alias("epar"),
        F.round(F.sum("net_benefit"), 2).cast("double").alias("net_benefit"),
        F.round(F.sum("upgrade_cost"), 2).cast("double").alias("upgrade_cost"),
    )
    return (
        grouped.orderBy(F.desc("epar"), "customer_id_hash")
        .limit(top)
        .withColumn("customer", display_id(F.col("customer_id_hash"), "CUST-"))
    )


def executive_upgrade_summary(cands: DataFrame) -> DataFrame:
    """All worthwhile candidates taken: what budget they need and what they save."""
    zero = dec(0)

    def total(name: str) -> Column:
        return F.round(F.coalesce(F.sum(F.col(name).cast(MONEY)), zero), 2).cast("double")

    return cands.agg(
        F.count("*").alias("positive_roi_orders"),
        total("upgrade_cost").alias("recommended_budget"),
        total("net_benefit").alias("net_savings"),
        total("expected_penalty").alias("expected_penalty_avoided"),
    )


# --- grids ---------------------------------------------------------------------------


def grid_cells(modes: Sequence[str] = MODE_GRID, discounts: Sequence = DISCOUNT_GRID) -> list[tuple[int, str, Decimal]]:
    """Numbered (mode, discount) cells, discounts outermost, as a short fixed list."""
    modes = list(dict.fromkeys(modes))
    rates = list(dict.fromkeys(Decimal(str(d)) for d in discounts))
    if not modes or not rates:
        raise ValueError("a grid needs at least one mode and one discount")
    return [(i * len(modes) + j, m, d) for i, d in enumerate(rates) for j, m in enumerate(modes)]


def with_grid(items: DataFrame, cells: Sequence[tuple[int, str, Decimal]]) -> DataFrame:
    """Each item once per cell, carrying the cell's mode and discount."""
    cell = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("seq"), F.lit(m).alias("mode"), F.lit(d).cast("decimal(5,4)").alias("discount")
                )
                for i, m, d in cells
            ]
        )
    )
    return items.withColumn("cell", cell).withColumns(
        {"seq": F.col("cell.seq"), "shipping_mode": F.col("cell.mode"), "discount_rate": F.col("cell.discount")}
    ).drop("cell")


def lever_rows(df: DataFrame) -> DataFrame:
    """Sales that follow from price, quantity and discount."""
    sales = F.col("product_price").cast("decimal(12,4)") * F.col("quantity") * (1 - F.col("discount_rate"))
    return df.withColumn("sales", F.round(sales, 4).cast(MONEY))


def raw_profit_rows(levers: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of a raw order file as the profit model reads them, made from what-if levers.

    Sales follow from price, quantity and discount unless given; columns that mean the same get the same value;
    an order date that is not given is the default one. What no lever sets is NULL, for the fitted medians and
    the unknown category to fill.
    """
    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in levers.columns else F.lit(None).cast(kind)

    made = {raw: given(lever, "double") for lever, raw in LEVER_NUMBERS.items()}
    derived = made["Product Price"] * made["Order Item Quantity"] * (1 - F.coalesce(made["Order Item Discount Rate"], F.lit(0.0)))
    made["Sales"] = F.coalesce(given("sales", "double"), derived)
    for names in SYNONYM_GROUPS:
        made.update({c: made[names[0]] for c in names[1:]})
    texts = {raw: given(lever, "string") for lever, raw in LEVER_TEXTS.items()}
    columns = [made.get(c, F.lit(None).cast("double")).alias(c) for c in PROFIT_NUMERIC]
    columns += [texts.get(c, F.lit(None).cast("string")).alias(c) for c in PROFIT_CATEGORICAL]
    date = F.coalesce(given("order_date", "string"), F.lit(DEFAULT_ORDER_DATE)).alias(ORDER_DATE)
    return levers.select(*keep, *columns, date, F.lit(None).cast("double").alias(PROFIT_TARGET))


CellScore = Callable[[Column, Column], tuple[Column, Column]]
Scorer = Callable[[DataFrame, list[str], Sequence[tuple]], DataFrame]

_UNITS = 10_000  # profits and scores are summed in whole ten-thousandths


def _units(value: Column) -> Column:
    """A four-place amount in whole ten-thousandths; exact below 900 billion."""
    return F.round(value.cast("double") * _UNITS).cast("long")


def _cell_sums(cells: Sequence[tuple], scores: Sequence[tuple[Column, Column]]) -> list[Column]:
    """Per cell: summed profit, summed score and number of scores, as whole numbers.

    Expressions that several cells share are summed once.
    """
    out = []
    for (seq, *_), (profit, late) in zip(cells, scores, strict=True):
        out += [F.sum(_units(profit)).alias(f"_profit{seq}"), F.sum(_units(late)).alias(f"_late{seq}"), F.count(late).alias(f"_n{seq}")]
    return out


def _sums_of_expressions(items: DataFrame, key: Sequence[str], cells: Sequence[tuple], score: CellScore, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per order with the sums of every cell; an item is read once, whatever the number of cells."""
    scores = [score(F.lit(mode), F.lit(rate).cast("decimal(5,4)")) for _, mode, rate in cells]
    return items.groupBy(*key).agg(*_cell_sums(cells, scores), *extra)


def _sums_of_models(items: DataFrame, key: Sequence[str], cells: Sequence[tuple], scorer: Scorer) -> DataFrame:
    """The same for a scorer that adds every cell's ``_profit{seq}`` and ``_late{seq}`` to an item, such as trained models."""
    totals = [x for seq, *_ in cells for x in (F.sum(f"_profit{seq}").alias(f"_profit{seq}"), F.sum(f"_late{seq}").alias(f"_late{seq}"), F.count(f"_late{seq}").alias(f"_n{seq}"))]
    return scorer(items, [*key], cells).groupBy(*key).agg(*totals)


def with_cells(sums: DataFrame, cells: Sequence[tuple[int, str, Decimal]], penalty=DEFAULT_PENALTY) -> DataFrame:
    """``cells``, one array per order in grid order: profit, mean score, shipping cost of the cell's mode, and net,
    what is left of the profit. All are whole numbers, of ten-thousandths or (cost) of cents: see :func:`cell_columns`.

    ``sums`` has the order's ``_multiplier`` of the mode's cost besides the sums.
    """
    fine = int(max(Decimal(0), round(Decimal(str(penalty)), 4)) * _UNITS)
    made = []
    for seq, mode, _ in sorted(cells):
        base = int(MODE_BASE_COST.get(mode.strip(), DEFAULT_MODE_COST) * 100)
        late = f"((2 * _late{seq} + _n{seq}) div (2 * _n{seq}))"
        cost = f"(({base} * _factor + 50) div 100)"
        net = f"(_profit{seq} * {_UNITS} - {late} * {fine}L - {cost} * {100 * _UNITS}L)"
        rounded = f"(sign({net}) * ((abs({net}) + {_UNITS // 2}) div {_UNITS}))"
        made.append(f"named_struct('seq', {seq}, 'profit', _profit{seq}, 'late', {late}, 'cost', {cost}, 'net', cast({rounded} as long))")
    factor = F.round(F.col("_multiplier").cast("double") * 100).cast("long")
    out = sums.withColumn("_factor", factor).withColumn("cells", F.expr(f"array({', '.join(made)})"))
    return out.drop("_multiplier", "_factor", *[f"_{name}{seq}" for seq, *_ in cells for name in ("profit", "late", "n")])


def cell_columns(cell: Column, cells: Sequence[tuple[int, str, Decimal]]) -> list[Column]:
    """A cell's mode, discount and amounts under their names."""
    at = (cell["seq"] + 1).cast("int")
    ordered = sorted(cells)
    unit, cent = F.lit(Decimal("0.0001")), F.lit(Decimal("0.01"))

    def amount(name: str, scale: Column, kind: str) -> Column:
        return (cell[name].cast("decimal(18,0)") * scale).cast(kind)

    return [
        F.element_at(F.array(*[F.lit(m) for _, m, _ in ordered]), at).alias("shipping_mode"),
        F.element_at(F.array(*[F.lit(d).cast("decimal(5,4)") for *_, d in ordered]), at).alias("discount_rate"),
        amount("profit", unit, MONEY).alias("profit_pred"), amount("late", unit, "decimal(8,4)").alias("p_late"),
        amount("cost", cent, "decimal(12,2)").alias("shipping_cost"), amount("net", unit, MONEY).alias("expected_net"),
    ]


def best_cell(orders: DataFrame, keep: Sequence[str], cells=None) -> DataFrame:
    """Highest net per order, found inside the row; the first cell of the grid wins ties."""
    first = F.array_max(F.expr("transform(cells, c -> named_struct('net', c.net, 'first', -c.seq))"))
    best = orders.select(*keep, F.element_at("cells", (1 - first["first"]).cast("int")).alias("b"))
    best = best.select(*keep, *cell_columns(F.col("b"), cells or grid_cells()))
    return best.withColumn("decision", F.when(F.col("expected_net") > 0, "accept").otherwise("decline"))


def whatif(items: DataFrame, key: str, score: CellScore, cells=None, penalty=DEFAULT_PENALTY) -> DataFrame:
    """Every order with its ``cells``: net of each (mode, discount) of the grid.

    ``score`` gives an item's profit and late score as expressions of a mode and a discount. The sums of all
    cells are one aggregate row, so what is shuffled is one row per order and task, and an order that holds a
    large share of all items arrives as a few partial sums.
    """
    cells = cells or grid_cells()
    priced = items.withColumn("_multiplier", region_multiplier(F.col("order_region")))
    sums = _sums_of_expressions(priced, [key], cells, score, [F.max("_multiplier").alias("_multiplier")])
    return with_cells(sums, cells, penalty)


def heat_table(orders: DataFrame, modes: Sequence[str] = MODE_GRID, cells=None) -> DataFrame:
    """Mean net per cell scaled to 0..1, discounts down, modes across.

    The cells are summed as columns of one row, in two halves of whole numbers that stay exact, so no order is
    multiplied by the grid.
    """
    ordered, half = sorted(cells or grid_cells()), (1 << 32) - 1
    nets = [F.get(F.col("cells"), F.lit(i))["net"] for i in range(len(ordered))]
    halves = [c for i, net in enumerate(nets) for c in (F.sum(F.shiftright(net, 32)).alias(f"_high{i}"), F.sum(net.bitwiseAND(F.lit(half))).alias(f"_low{i}"))]
    whole, unit = F.lit(Decimal(1 << 32)), F.lit(Decimal("0.0001"))

    def total(i: int) -> Column:
        both = F.col(f"_high{i}").cast("decimal(20,0)") * whole + F.col(f"_low{i}").cast("decimal(20,0)")
        return (both.cast("decimal(24,0)") * unit).cast("decimal(28,4)")

    made = [
        F.struct(F.lit(rate).cast("decimal(5,4)").alias("discount_rate"), F.lit(mode).alias("shipping_mode"), total(i).alias("total"))
        for i, (_, mode, rate) in enumerate(ordered)
    ]
    sums = orders.agg(F.count("*").alias("_n"), *halves).where("_n > 0").select("_n", F.explode(F.array(*made)).alias("c")).select("_n", "c.*")
    mean = sums.groupBy("discount_rate", "shipping_mode").agg(
        F.round(F.sum("total").cast("decimal(28,4)") / F.sum("_n"), 4).cast(MONEY).alias("net")
    )
    # one row per grid cell is left, a fixed number
    every = Window.partitionBy(F.lit(1))
    span = F.max("net").over(every) - F.min("net").over(every)
    scaled = mean.withColumn(
        "heat",
        F.round(F.coalesce(F.try_divide((F.col("net") - F.min("net").over(every)).cast("double"), span.cast("double")), F.lit(0.0)), 4),
    )
    return scaled.groupBy("discount_rate").pivot("shipping_mode", list(modes)).agg(F.first("heat"))


def losing_orders(mart: DataFrame, key: str, penalty=DEFAULT_PENALTY, limit: int | None = None) -> DataFrame:
    """The orders that lose after penalty and shipping; ``limit`` asks for those that lose most, worst first."""
    net = F.col("profit_pred") - F.col("p_late") * dec(penalty) - F.col("upgrade_cost")
    losing = mart.withColumn("base_net", F.round(net, 4).cast(MONEY)).where(F.col("base_net") < 0)
    return losing.orderBy("base_net", key).limit(limit) if limit is not None else losing


def rescue(
    mart: DataFrame, items: DataFrame, key: str, score: CellScore | None = None, cells=None, penalty=DEFAULT_PENALTY,
    limit: int | None = None, scorer: Scorer | None = None,
) -> DataFrame:
    """Best mode and discount for each losing order, or for the ``limit`` worst.

    The losing orders are found once and travel with their items as grouping columns, so the items are joined,
    summed and decided in one pass. ``scorer`` takes the place of ``score`` where no expression of mode and discount
    tells the scores: it is given the joined items, the columns to keep and the cells, see :func:`_sums_of_models`.
    """
    lost = ["_net", "_mode", "_region", "_segment", "_multiplier"]
    losing = losing_orders(mart, key, penalty, limit).select(
        key, F.col("base_net").alias("_net"), F.col("shipping_mode").alias("_mode"), F.col("order_region").alias("_region"), F.col("customer_segment").alias("_segment"),
        region_multiplier(F.col("order_region")).alias("_multiplier"),
    )
    cells = cells or grid_cells()
    joined = items.join(losing, key)
    if scorer is None:
        sums = _sums_of_expressions(joined, [key, *lost], cells, score)
    else:
        sums = _sums_of_models(joined, [key, *lost], cells, scorer)
    best = best_cell(with_cells(sums, cells, penalty), [key, *lost[:-1]], cells)
    return best.select(
        key,
        F.col("_mode").alias("current_shipping"),
        F.col("_segment").alias("segment"),
        F.col("_region").alias("region"),
        F.round("_net", 2).cast("double").alias("base_net"),
        F.col("shipping_mode").alias("recommend_shipping"),
        F.col("discount_rate").cast("double").alias("recommend_discount"),
        F.round("expected_net", 2).cast("double").alias("rescued_net"),
        F.round(F.col("expected_net") - F.col("_net"), 2).cast("double").alias("improvement"),
        F.col("p_late").cast("double").alias("rescued_p_late"),
        F.round("profit_pred", 2).cast("double").alias("rescued_profit"),
        F.col("shipping_cost").cast("double").alias("rescued_shipping_cost"),
        "decision",
    )


def scope_record(mart: DataFrame, scope) -> DataFrame:
    """What a report rests on, with the row count."""
    return mart.agg(
        F.lit(scope.name).alias("scope"),
        F.count("*").alias("rows_orders"),
        F.lit(scope.profit_basis).alias("profit_basis"),
        F.lit(scope.profit_column).alias("profit_column"),
        F.lit(scope.delay_cost_basis).alias("delay_cost_basis"),
        F.lit(int(scope.labelled)).alias("has_ground_truth"),
        F.lit(int(scope.false_positive_available)).alias("false_positive_available"),
    )


def action_summary(report: DataFrame, budget, top: int = 5) -> DataFrame:
    """High-risk count among the best orders and the share of the budget used."""
    first = report.orderBy(F.desc("net_benefit"), F.desc("p_late")).limit(top)
    high = first.agg(F.count_if(F.col("risk_bucket") == "High").alias("high")).scalar()
    return report.agg(
        F.count("*").alias("selected_count"),
        ratio(F.sum(F.col("upgrade_cost").cast(MONEY)) * 100, dec(budget), 2).alias("budget_usage_pct"),
        F.round(F.sum(F.col("net_benefit").cast(MONEY)), 2).cast("double").alias("expected_total_saving"),
    ).withColumn("high_risk_in_sample", high)
