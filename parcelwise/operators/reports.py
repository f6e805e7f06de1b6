"""KPI rows, breakdowns, monthly series and lists."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.constants import (
    DEFAULT_PENALTY, DISCOUNT_BANDS, HEAT_BANDS, MAX_BATCHES, MIN_TREND_MONTHS,
)
from parcelwise.functions.scalars import display_id, month_key, ratio, search_token
from parcelwise.operators.money import HISTORY, MONEY, Scope, dec
from parcelwise.operators.ranking import around_places, at_or_before, cut_points, sort_columns


_ONE_PASS_ROWS = 10_000


def mean4(col: Column) -> Column:
    """Mean of decimals or 0/1 flags, rounded to four places."""
    return ratio(F.sum(col.cast("decimal(8,4)")), F.count(col), empty=None)


def money2(total: Column) -> Column:
    return F.round(total, 2).cast("double")


# --- predictions ---------------------------------------------------------------


def with_outcome(pred: DataFrame, threshold) -> DataFrame:
    """Predicted and actual lateness at a threshold and whether they agree."""
    predicted = (F.col("p_late") >= dec(threshold)).cast("int")
    out = pred.withColumn("predicted_late", predicted)
    if "true_label" not in pred.columns:
        return out.withColumns({"actual_late": F.lit(None).cast("int"), "is_correct": F.lit(None).cast("int")})
    actual = F.col("true_label").cast("int")
    return out.withColumns({"actual_late": actual, "is_correct": (actual == predicted).cast("int")})


def error_rows(pred: DataFrame, threshold) -> DataFrame:
    return with_outcome(pred, threshold).where(F.col("is_correct") == 0)


def filter_orders(
    pred: DataFrame, month: str | None = None, search: str | None = None, risk: str | None = None,
    shipping: str | None = None, region: str | None = None, threshold=None, error_only: bool = False,
    ts: str = "order_ts", id_col: str = "order_id_hash",
) -> DataFrame:
    """Order list filter; only the conditions given are applied."""
    out = with_outcome(pred, threshold if threshold is not None else Decimal("0.5"))
    if month:
        out = out.where(month_key(F.col(ts)) == month)
    token = search_token(search) if search else ""
    if token:
        out = out.where(F.lower(F.col(id_col).cast("string")).contains(token))
    for name, wanted in (("risk_bucket", risk), ("shipping_mode", shipping), ("order_region", region)):
        if wanted:
            out = out.where(F.col(name) == wanted)
    if threshold is not None:
        out = out.where(F.col("p_late") >= dec(threshold))
    return out.where(F.col("is_correct") == 0) if error_only else out


def page(df: DataFrame, order: Sequence[str], number: int, limit: int, total: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """One page of an ordered list with absolute row numbers; ``order`` are names, descending ones with a minus.

    Near the top, sorting stops at ``number*limit`` rows per task. A far page is looked up by its key range
    first, so that only rows around it are sorted. The numbering runs over the page alone.
    """
    number, limit = max(1, number), max(1, limit)
    start, before, by = (number - 1) * limit, 0, sort_columns(order)
    if start + limit > _ONE_PASS_ROWS:
        df, before = around_places(df, order, start, start + limit, total, keys)
    rows = df.orderBy(*by).offset(start - before).limit(limit)
    return rows.withColumn("row_number", F.row_number().over(Window.orderBy(*by)).cast("long") + start)


def clamped_page(df: DataFrame, order: Sequence[str], number: int, limit: int) -> DataFrame:
    """As :func:`page`; a page past the end becomes the last page.

    Near the top of the list one pass is enough: the rows up to the page tell by
    their number where the list ends. Far pages count the rows first.
    """
    number, limit = max(1, number), max(1, limit)
    if number * limit > _ONE_PASS_ROWS:
        keys = df.select(*dict.fromkeys(c.removeprefix("-") for c in order)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            total = keys.count()
            return page(df, order, min(number, max(1, -(-total // limit))), limit, total, keys)
        finally:
            keys.unpersist()
    head = df.orderBy(*sort_columns(order)).limit(number * limit)
    numbered = head.withColumns(
        {"row_number": F.row_number().over(Window.orderBy(*sort_columns(order))).cast("long"), "_last": F.count("*").over(Window.partitionBy(F.lit(1)))}
    )
    return numbered.where(F.col("row_number") > F.floor((F.col("_last") - 1) / limit) * limit).drop("_last")


def summary_by(pred: DataFrame, dimension: str) -> DataFrame:
    """Row count and mean score per value of a dimension."""
    return (
        pred.where(F.col(dimension).isNotNull())
        .groupBy(F.col(dimension).alias("label"))
        .agg(F.count("*").alias("count"), mean4(F.col("p_late")).alias("avg_p_late"))
        .orderBy(F.desc("count"), "label")
    )


def region_ranking(pred: DataFrame) -> DataFrame:
    return (
        pred.where(F.col("order_region").isNotNull())
        .groupBy("order_region")
        .agg(mean4(F.col("p_late")).alias("p_late"), F.count("p_late").alias("count"))
        .orderBy(F.desc("p_late"), "order_region")
    )


def combined_regions(pred: DataFrame, pattern: str) -> DataFrame:
    """Row-weighted mean over all regions matching a pattern, each weighed once."""
    return (
        pred.where(F.col("order_region").rlike(pattern))
        .agg(mean4(F.col("p_late")).alias("p_late"), F.count("p_late").alias("count"))
    )


def heat_band(mean: Column) -> Column:
    band = F.when(mean.isNull(), F.lit("none"))
    for floor, name in HEAT_BANDS:
        band = band.when(mean >= float(floor), F.lit(name))
    return band.otherwise(F.lit("calm"))


def resolve_region(df: DataFrame, names: DataFrame, codes: DataFrame) -> DataFrame:
    """Region by country name, else by country code.

    ``names(country, region)`` and ``codes(code, region)`` are reference tables;
    one row per key is kept, so the joins cannot multiply rows.
    """
    by_name = names.groupBy(F.col("country").alias("_n")).agg(F.min("region").alias("_r1"))
    by_code = codes.groupBy(F.col("code").alias("_c")).agg(F.min("region").alias("_r2"))
    return (
        df.join(by_name, df["country"] == F.col("_n"), "left")
        .join(by_code, (df["code"] == F.col("_c")) & (df["code"] != "-99"), "left")
        .withColumn("resolved_region", F.coalesce("_r1", "_r2"))
        .drop("_n", "_c", "_r1", "_r2")
    )


def available_months(df: DataFrame, ts: str = "order_ts") -> DataFrame:
    return df.where(F.col(ts).isNotNull()).select(month_key(F.col(ts)).alias("month")).distinct().orderBy("month")


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("x")).select("x.*").where("value is not null").distinct().orderBy("facet", "value")


def monthly_rates(pred: DataFrame, ts: str = "order_ts") -> DataFrame:
    """Predicted and actual late rate per month; rows without a date are left out."""
    return (
        pred.where(F.col(ts).isNotNull())
        .groupBy(month_key(F.col(ts)).alias("month"))
        .agg(
            mean4(F.col("p_late")).alias("avg_p_late"),
            mean4(F.col("true_label")).alias("actual_late_rate"),
            F.count("p_late").alias("total_orders"),
        )
        .orderBy("month")
    )


def monthly_counts(pred: DataFrame, threshold, ts: str = "order_ts") -> DataFrame:
    return (
        with_outcome(pred.where(F.col(ts).isNotNull()), threshold)
        .groupBy(month_key(F.col(ts)).alias("month"))
        .agg(
            F.sum("actual_late").alias("actual_late"),
            F.sum("predicted_late").alias("predicted_late"),
            F.count("actual_late").alias("total"),
        )
        .orderBy("month")
    )


def monthly_diagnosis(
    pred: DataFrame, tolerance=Decimal("0.05"), threshold=Decimal("0.5"), period: str | None = None
) -> DataFrame:
    """All months in one pass: means, their distance, wrong predictions."""
    key = F.col(period) if period else month_key(F.col("order_ts"))
    score = F.sum(F.col("p_late").cast("decimal(8,4)"))
    label = F.sum(F.col("true_label").cast("decimal(8,4)"))
    gap = F.try_divide(F.abs(score - label), F.count("*"))
    return (
        with_outcome(pred, threshold)
        .where(key.isNotNull())
        .groupBy(key.alias("month"))
        .agg(
            mean4(F.col("p_late")).alias("avg_p_late"),
            mean4(F.col("true_label")).alias("actual_late_rate"),
            F.round(gap, 4).cast("double").alias("error"),
            (gap > dec(tolerance)).cast("int").alias("error_exceeds_threshold"),
            F.count("*").alias("total_orders"),
            F.count_if(F.col("is_correct") == 0).alias("error_orders_count"),
        )
        .orderBy("month")
    )


def with_event_flags(monthly: DataFrame, flags: DataFrame) -> DataFrame:
    return monthly.join(flags, "month", "left")


def with_batches(df: DataFrame, keys: Sequence[str], batches: int = MAX_BATCHES) -> DataFrame:
    """Equal runs of rows in file order for tables without dates.

    Only the rows at the batch borders are looked up; every row is then placed
    by comparing its key with them.
    """
    def borders(n: int) -> list[int]:
        size = max(1, -(-n // min(batches, max(1, n))))
        return [size * i for i in range(1, batches) if size * i < n]

    after = F.lit(1)
    for cut in cut_points(df, keys, borders).values():
        after = after + (~at_or_before(keys, cut)).cast("int")
    return df.withColumn("batch", after)


# --- KPI rows ------------------------------------------------------------------


def executive_kpis(pred: DataFrame, threshold) -> DataFrame:
    risky = F.col("p_late") >= dec(threshold)
    share = F.try_divide(F.count_if(risky).cast("decimal(20,0)"), F.count("*"))
    return pred.agg(
        F.count("*").alias("total_orders"),
        F.count_if(risky).alias("at_risk_orders"),
        F.coalesce(F.round(share, 4).cast("double"), F.lit(0.0)).alias("at_risk_rate"),
        F.coalesce(F.round(1 - share, 4).cast("double"), F.lit(1.0)).alias("estimated_service_level"),
        money2(F.coalesce(F.sum(F.when(risky, F.col("expected_penalty").cast(MONEY))), dec(0))).alias(
            "expected_penalty_exposure"
        ),
    )


def top_breakdown(pred: DataFrame, dimension: str, threshold, n: int = 5) -> DataFrame:
    return (
        pred.where((F.col("p_late") >= dec(threshold)) & F.col(dimension).isNotNull())
        .groupBy(F.col(dimension).alias("label"))
        .agg(F.count("*").alias("count"), mean4(F.col("p_late")).alias("avg_p_late"))
        .orderBy(F.desc("count"), F.desc("avg_p_late"), "label")
        .limit(n)
    )


def _roi_aggregates(scope: Scope, penalty) -> dict[str, Column]:
    profit, net = scope.profit(), scope.net(penalty)
    false_positive = (profit > 0) & (net < 0) if scope.false_positive_available else F.lit(False)
    return {
        "rows_orders": F.count("*"),
        "book_profit": F.sum(profit),
        "net_of_service": F.sum(net),
        "epar": F.sum("epar"),
        "false_positive": F.count_if(false_positive),
        "profitable": F.count_if(profit > 0),
    }


def _roi_total_columns(scope: Scope, penalty) -> list[Column]:
    a = _roi_aggregates(scope, penalty)
    return [
        a["rows_orders"].alias("rows_orders"),
        money2(a["book_profit"]).alias("book_profit_total"),
        money2(a["net_of_service"]).alias("net_of_service_total"),
        money2(a["book_profit"] - a["net_of_service"]).alias("service_erosion_total"),
        a["false_positive"].alias("false_positive_value_orders"),
        a["profitable"].alias("profit_positive_orders"),
        ratio(a["false_positive"], a["profitable"]).alias("false_positive_value_pct"),
        money2(a["epar"]).alias("epar_total"),
    ]


def roi_totals(mart: DataFrame, penalty=DEFAULT_PENALTY, scope: Scope = HISTORY) -> DataFrame:
    """Book profit against profit after service cost."""
    return mart.agg(*_roi_total_columns(scope, penalty))


def roi_by(mart: DataFrame, dimension: str = "customer_segment", penalty=DEFAULT_PENALTY, scope: Scope = HISTORY) -> DataFrame:
    """The same per segment, worst first."""
    a = _roi_aggregates(scope, penalty)
    return (
        mart.where(F.col(dimension).isNotNull())
        .groupBy(F.col(dimension).alias("segment"))
        .agg(
            a["rows_orders"].alias("orders"),
            money2(a["book_profit"]).alias("book_profit"),
            money2(a["net_of_service"]).alias("net_of_service"),
            money2(a["epar"]).alias("epar"),
            a["false_positive"].alias("false_positive_value_orders"),
            a["profitable"].alias("profit_positive_orders"),
        )
        .orderBy("net_of_service", "segment")
    )


def decision_summary(mart: DataFrame, penalty=DEFAULT_PENALTY) -> DataFrame:
    """Totals of the mart and how much of the profit variance the prediction explains."""
    squares = F.sum(F.col("profit_resid") * F.col("profit_resid"))
    spread = F.sum(F.col("profit_actual") * F.col("profit_actual"))
    total = F.sum("profit_actual")
    n = F.count("*")
    variance = spread.cast("double") - total.cast("double") * total.cast("double") / n
    fit = 1 - F.try_divide(squares.cast("double"), variance)
    return mart.agg(*_roi_total_columns(HISTORY, penalty), F.round(fit, 4).alias("profit_r2"))


# --- facets, portfolio, lists --------------------------------------------------


def filter_decision(
    mart: DataFrame, segment: str | None = None, region: str | None = None, category: str | None = None,
    shipping: str | None = None, discount_band: str | None = None,
) -> DataFrame:
    out = mart
    wanted = {
        "customer_segment": segment, "order_region": region, "category_name": category, "shipping_mode": shipping,
    }
    for name, value in wanted.items():
        if value:
            out = out.where(F.col(name) == value)
    if discount_band:
        low, high = DISCOUNT_BANDS[discount_band]
        if low:
            out = out.where(F.col("discount_rate") >= dec(low))
        if high:
            out = out.where(F.col("discount_rate") < dec(high))
    return out


def discount_band(rate: Column) -> Column:
    return (
        F.when(rate < dec(DISCOUNT_BANDS["low"][1]), F.lit("low"))
        .when(rate < dec(DISCOUNT_BANDS["mid"][1]), F.lit("mid"))
        .when(rate.isNotNull(), F.lit("high"))
    )


def quadrant(value: Column, risk: Column) -> Column:
    good, risky = value >= 0, risk >= dec("0.5")
    return (
        F.when(good & risky, F.lit("high_profit_high_risk"))
        .when(~good & risky, F.lit("low_profit_high_risk"))
        .when(good & ~risky, F.lit("high_profit_low_risk"))
        .otherwise(F.lit("low_profit_low_risk"))
    )


def scatter_sample(df: DataFrame, id_col: str, seed: int = 42, max_points: int = 1500) -> DataFrame:
    """Repeatable sample for a chart: the rows with the smallest salted hash."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")), 256)).limit(max_points)


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Random rows of a table, the same ones in every run."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return df.orderBy(F.sha2(text, 256), *keys).limit(n)


def at_risk_list(mart: DataFrame, id_col: str, number: int = 1, limit: int = 50, scope: Scope = HISTORY) -> DataFrame:
    return clamped_page(mart, ["-epar", id_col], number, limit).select(
        "row_number",
        display_id(F.col(id_col)).alias("id"),
        money2(F.col("epar")).alias("epar"),
        money2(F.col(scope.profit_column)).alias("profit_actual"),
        F.col("p_late").cast("double").alias("p_late"),
        money2(F.col("net_of_service")).alias("net_of_service"),
        F.col("customer_segment").alias("segment"),
        F.col("order_region").alias("region"),
        "risk_bucket",
    )


def residual_list(pred: DataFrame, ties: Sequence[str], sort: str = "abs_residual", number: int = 1, limit: int = 25) -> DataFrame:
    """Profit predictions by largest residual, actual or predicted value."""
    clean = pred.dropna(subset=["actual_profit", "predicted_profit", "residual"]).withColumn(
        "abs_residual", F.abs("residual")
    )
    order_col = sort if sort in ("predicted_profit", "actual_profit") else "abs_residual"
    paged = page(clean, [f"-{order_col}", *ties], number, limit)
    return paged.withColumn("row_id", F.format_string("profit_test_%05d", F.col("row_number")))


# --- trends --------------------------------------------------------------------


def deterioration_series(mart: DataFrame, dimension: str, penalty=DEFAULT_PENALTY) -> DataFrame:
    """Monthly net and late rate per group, numbered inside the group."""
    monthly = (
        mart.where(F.col("order_ts").isNotNull() & F.col(dimension).isNotNull())
        .groupBy(F.col(dimension).alias("group"), month_key(F.col("order_ts")).alias("month"))
        .agg(
            F.sum(HISTORY.net(penalty)).alias("net_of_service"),
            mean4(F.col("true_label")).alias("late_rate"),
            F.count("*").alias("orders"),
        )
    )
    # at most one row per calendar month and group reaches this window
    return monthly.withColumn("month_index", F.row_number().over(Window.partitionBy("group").orderBy("month")) - 1)


def deterioration_trend(series: DataFrame) -> DataFrame:
    """Slope per month, last value and next-month forecast; short series are left out."""
    y, x = F.col("net_of_service").cast("double"), F.col("month_index").cast("double")
    n = F.count("*")
    slope, intercept = F.regr_slope(y, x), F.regr_intercept(y, x)
    return (
        series.groupBy("group")
        .agg(
            n.alias("months"),
            F.round(slope, 2).alias("trend_slope"),
            money2(F.max_by("net_of_service", "month")).alias("last_net_of_service"),
            F.round(intercept + slope * n, 2).alias("forecast_next"),
        )
        .where(F.col("months") >= MIN_TREND_MONTHS)
        .orderBy("trend_slope", "group")
    )


def dense_series(series: DataFrame) -> DataFrame:
    """Every group on the union of all months, gaps as NULL."""
    months = series.agg(F.array_sort(F.collect_set("month")).alias("m")).scalar()
    frame = series.select("group").distinct().select("group", F.explode(months).alias("month"))
    return frame.join(series, ["group", "month"], "left").select("group", "month", "net_of_service")
