"""Window operators over ordered series: rolling, forward, crossing, filling, ranking.

All functions take and return DataFrames or columns and run inside Catalyst.
`by` names the columns of a series (symbol, market, ...): windows are
partitioned by them, so series spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(by: Sequence[str], order: Sequence[str | Column]):
    """The window of a series."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return w.orderBy(*order)


def day_no(d: str | Column) -> Column:
    """Days since 1970-01-01: RANGE frames over it are calendar days."""
    return F.unix_date(F.col(d) if isinstance(d, str) else d)


def rolling(value: Column, n: int, w, agg=F.sum) -> Column:
    """Over the last n rows with the present one; shorter at the start."""
    return agg(value).over(w.rowsBetween(-(n - 1), 0))


def rolling_full(value: Column, n: int, w, agg=F.sum) -> Column:
    """As `rolling`, null until there are n values."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))


def trailing(value: Column, n: int, w, agg=F.avg) -> Column:
    """Over the n rows before the present one."""
    return agg(value).over(w.rowsBetween(-n, -1))


def trailing_full(value: Column, n: int, w, agg=F.avg) -> Column:
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))


def expanding_quantile(value: Column, q: float, w, least: int) -> Column:
    """Linear quantile of all values before the present row, null below `least` of them."""
    frame = w.rowsBetween(Window.unboundedPreceding, -1)
    return F.when(F.count(value).over(frame) >= least, F.percentile(value, q).over(frame))


def crosses_up(value: Column, w) -> Column:
    """At or below zero on the row before, above zero now; false on the first row."""
    return F.coalesce((F.lag(value).over(w) <= 0) & (value > 0), F.lit(False))


def enters(flag: Column, w) -> Column:
    """True now and not true on the row before (the first row counts as entering)."""
    flag = F.coalesce(flag, F.lit(False))
    return flag & ~F.coalesce(F.lag(flag).over(w), F.lit(False))


def forward_range(value: Column, days: int, order: Column, by: Sequence[str], agg=F.max) -> Column:
    """Over the calendar days (t, t + days]; null where none is observed."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return agg(value).over(w.orderBy(order).rangeBetween(1, days))


def forward_full(value: Column, rows: int, w, agg=F.max) -> Column:
    """Over the next `rows` rows, null where there are fewer."""
    frame = w.rowsBetween(1, rows)
    return F.when(F.count(value).over(frame) == rows, agg(value).over(frame))


def trailing_median(value: Column, n: int, w) -> tuple[Column, Column, Column]:
    """Median of the n rows before the present one, the median distance from it, and how many values there are."""
    frame = w.rowsBetween(-n, -1)
    past, middle = F.collect_list(value).over(frame), F.percentile(value, 0.5).over(frame)
    gaps = F.array_sort(F.transform(past, lambda v: F.abs(v - middle)))
    size = F.size(gaps)
    half = F.floor((size + 1) / 2).cast("int")
    mad = F.when(size > 0, (F.element_at(gaps, half) + F.element_at(gaps, F.floor(size / 2).cast("int") + 1)) / 2)
    return middle, mad, size


def refractory(df: DataFrame, by: Sequence[str], day: str, gap: int) -> DataFrame:
    """Greedy de-clustering: an event is kept if the last kept one of its series is at least `gap` days back.

    A fold over each series' sorted distinct event days, as the state is the
    last kept day; the arrays hold event days only.
    """
    days = df.groupBy(*by).agg(F.array_sort(F.collect_set(day_no(day))).alias("_days"))
    kept = F.aggregate(
        "_days",
        F.array().cast("array<int>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return days.select(*by, F.explode(kept).alias("_day")).select(*by, F.date_from_unix_date("_day").alias(day))


def spine(df: DataFrame, by: Sequence[str], day: str, bounds: DataFrame | None = None) -> DataFrame:
    """Every calendar day from the first to the last of each series."""
    ends = (bounds or df).groupBy(*by).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return ends.select(*by, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias(day))


def months(df: DataFrame, by: Sequence[str], start: str, end: str, month: str = "month") -> DataFrame:
    """Every calendar month, as its first day, from that of start to that of end."""
    first = lambda c: F.to_date(F.date_trunc("month", c))
    return df.select(*by, F.explode(F.sequence(first(start), first(end), F.expr("interval 1 month"))).alias(month))


def aligned(df: DataFrame, by: Sequence[str], ts: str, seconds: int, late: int) -> DataFrame:
    """The first row of each slot of the clock, at most `late` seconds after its start; slots without one are skipped."""
    at = F.unix_micros(ts)
    slot = F.floor(at / (seconds * 1_000_000)) * seconds
    first = df.withColumn("slot", F.timestamp_seconds(slot)).withColumn("_late", at - slot * 1_000_000)
    kept = first.where(F.col("_late") <= late * 1_000_000)
    return kept.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "slot").orderBy("_late"))).where("_k = 1").drop("_k", "_late")


def filled(df: DataFrame, by: Sequence[str], day: str, value: str, limit: int | None = None) -> DataFrame:
    """One row for each calendar day, the last value carried on for at most `limit` days, days without one dropped."""
    w = series(by, [day])
    frame = w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    full = spine(df, by, day).join(df.select(*by, day, value), [*by, day], "left")
    return full.withColumn(value, F.last(value, ignorenulls=True).over(frame)).where(F.col(value).isNotNull())


def last_per_day(ticks: DataFrame, by: Sequence[str], ts: str, value: str, tie: str, day: str = "d") -> DataFrame:
    """The last value of each day, ties at one time by the larger `tie`."""
    return ticks.groupBy(*by, F.to_date(ts).alias(day)).agg(F.max_by(value, F.struct(ts, tie)).alias(value))


def simple_return(value: Column, w, lag: int = 1) -> Column:
    return F.try_divide(value, F.lag(value, lag).over(w)) - 1


def log_return(value: Column, w, lag: int = 1) -> Column:
    return F.ln(value) - F.ln(F.lag(value, lag).over(w))


def excursions(value: Column, rows: int, w) -> tuple[Column, Column]:
    """Largest fall and rise in log terms over the next rows, at least 0; null where the window is not whole."""
    x = F.ln(value)
    low, high = forward_full(x, rows, w, F.min), forward_full(x, rows, w, F.max)
    zero = F.lit(0.0)
    return F.when(low.isNotNull(), F.greatest(zero, x - low)), F.when(high.isNotNull(), F.greatest(zero, high - x))


def equity(ret: Column, w) -> Column:
    """Cumulative product of 1 + ret; a loss of everything stays at 0."""
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    gone = F.max(F.when(ret <= -1, 1).otherwise(0)).over(so_far)
    grown = F.exp(F.sum(F.when(ret > -1, F.ln(1 + ret)).otherwise(0.0)).over(so_far))
    return F.when(gone == 1, 0.0).otherwise(grown)


def drawdown(value: Column, w) -> Column:
    """Value against its largest so far, minus 1."""
    return value / F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; `order` must be total."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def average_rank(value: Column, by: Sequence[str]) -> Column:
    """Ranks with ties averaged."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over((Window.partitionBy(*by, value) if by else Window.partitionBy(value))) - 1) / 2
