"""Signal tests: events of a series, what followed, and how often that happens anyway."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames


def grid(df: DataFrame, **values: Sequence) -> DataFrame:
    """df times the product of parameter values (literal arrays, exploded in place)."""
    for name, v in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(x) for x in v])))
    return df


def rolling_crossings(flows: DataFrame, windows: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Days on which the rolling sum of `flow` over n rows turns positive: by, d, n, val."""
    w = frames.series(by, ["d"])
    sums = F.array(*[F.struct(F.lit(n).alias("n"), frames.rolling(F.col("flow"), n, w).alias("val")) for n in windows])
    long = flows.withColumn("s", sums).withColumn("s", F.explode("s")).select(*by, "d", "s.n", "s.val")
    return long.withColumn("fired", frames.crosses_up(F.col("val"), frames.series([*by, "n"], ["d"]))).where("fired").drop("fired")


def forward_extremes(price: DataFrame, horizons: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """by, d, close, h, px_max, px_min over the h calendar days after d, from one sort of each series."""
    no = frames.day_no("d")
    cells = F.array(
        *[F.struct(F.lit(h).alias("h"), frames.forward_range(F.col("close"), h, no, by).alias("px_max"), frames.forward_range(F.col("close"), h, no, by, F.min).alias("px_min")) for h in horizons]
    )
    return price.withColumn("c", cells).withColumn("c", F.explode("c")).select(*by, "d", "close", "c.*")


def hit_rates(rows: DataFrame, cells: Sequence[str], hit) -> DataFrame:
    """Number, hits and hit share of each cell, over rows whose window has some observation."""
    out = rows.where("px_max is not null").groupBy(*cells).agg(F.count(F.lit(1)).alias("n_obs"), F.count_if(hit).alias("hits"))
    return out.withColumn("rate", F.round(F.col("hits") / F.col("n_obs"), 6))


def rise():
    """The window's largest value lies t or more above the close."""
    return F.col("px_max") / F.col("close") - 1 >= F.col("t")


def fall():
    """The window's smallest value lies t or more below the close."""
    return F.col("px_min") / F.col("close") - 1 <= -F.col("t")


def judged(outcomes: DataFrame, size: float) -> DataFrame:
    """outcomes(close, px_min, px_max, ...) with fell and rose: 1 where the window went `size` below or above the close."""
    return outcomes.withColumn("fell", (F.col("px_min") / F.col("close") - 1 <= -size).cast("int")).withColumn("rose", (F.col("px_max") / F.col("close") - 1 >= size).cast("int"))


def era_matched(events: DataFrame, outcomes: DataFrame, base: DataFrame, keys: Sequence[str], cells: Sequence[str], eras: Sequence[str]) -> DataFrame:
    """Hits of events against what the base rates of their eras lead one to expect, for falls and rises.

    events and outcomes(fell, rose) meet on keys; base(fell, rose) gives its
    means by eras; one row for each of cells.
    """
    rates = base.groupBy(*eras).agg(F.avg("fell").alias("p_fell"), F.avg("rose").alias("p_rose"))
    got = events.join(outcomes, list(keys)).join(rates, list(eras)).groupBy(*cells)
    got = got.agg(F.count(F.lit(1)).alias("n_obs"), *(F.sum(c).alias(c) for c in ("fell", "rose", "p_fell", "p_rose")))
    n, out = F.col("n_obs"), [*cells, "n_obs"]
    for c in ("fell", "rose"):
        p = F.col(f"p_{c}") / n
        z = F.when((p > 0) & (p < 1), binomial_z(F.col(c), n, p))
        out += [F.col(c).alias(f"{c}_hits"), F.round(F.col(f"p_{c}"), 6).alias(f"{c}_expected"), F.round(100 * (F.col(c) / n - p), 4).alias(f"{c}_edge_pp"), F.round(z, 6).alias(f"{c}_z")]
    return got.select(*out)


def binomial_z(hits, n, p):
    """How many standard deviations `hits` of n lie above a chance of p."""
    return F.try_divide(hits - n * p, F.sqrt(n * p * (1 - p)))


def trailing_drop(levels: DataFrame, windows: Sequence[int], by: Sequence[str], drop) -> DataFrame:
    """Days on which a level lies `drop` or more below the mean of the n rows before."""
    w = frames.series(by, ["d"])
    cells = F.array(*[F.struct(F.lit(n).alias("n"), frames.trailing(F.col("level"), n, w).alias("mean")) for n in windows])
    return levels.withColumn("c", cells).withColumn("c", F.explode("c")).where(F.col("level") <= F.col("c.mean") - drop).select(*by, "d", "level", "c.n", "c.mean")


def persistent(levels: DataFrame, by: Sequence[str], below) -> DataFrame:
    """Days on which the level is under `below` for the third row in a row."""
    w = frames.series(by, ["d"])
    return levels.withColumn("ok", (F.col("level") < below) & (F.lag("level").over(w) < below) & (F.lag("level", 2).over(w) < below)).where("ok").drop("ok")


def overlap(a: DataFrame, b: DataFrame, days: int) -> DataFrame:
    """Counts of a's days that are also b's, and that have one of b's within +-days (semi-joins on exploded days)."""
    near = b.select(F.explode(F.sequence(F.date_sub("d", days), F.date_add("d", days), F.expr("interval 1 day"))).alias("d")).distinct()
    flags = a.select("d").distinct().join(b.select("d", F.lit(1).alias("same")).distinct(), "d", "left").join(near.withColumn("near", F.lit(1)), "d", "left")
    return flags.agg(F.count(F.lit(1)).alias("fires"), F.count("same").alias("same_day"), F.count("near").alias("within_band"))
