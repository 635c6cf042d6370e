"""Volatility corridors as DataFrames: volatility, bands from the past only, coverage and comparison of models.

All steps are windows and aggregates over rows (symbol, d); windows are
partitioned by symbol (and horizon, model), and a group is one daily history,
up to some 10,000 rows, as the closed form of the decaying sum raises the decay
to that power.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames

DECAY, SEED, WARMUP = 0.94, 30, 365
LEVELS = (0.50, 0.80, 0.90)
METHODS = ("gauss_ewma", "fhs", "raw_emp")
#: Standard normal quantiles of the upper ends of central intervals (fixed values).
Z_UPPER = {0.50: 0.6744897501960817, 0.80: 1.2815515655446004, 0.90: 1.6448536269514722, 0.95: 1.959963984540054}
REGIMES = ("calm", "mid", "storm")


def volatility(prices: DataFrame) -> DataFrame:
    """symbol, d, i (row from 0), x (log price), r (log return) and sig (decaying volatility known at the close).

    sig squared is the exponentially weighted mean of squared returns that
    starts from the variance of the first SEED returns; null up to there.
    """
    w = frames.series(["symbol"], ["d"])
    rows = prices.select("symbol", "d", F.ln("close").alias("x"), (F.row_number().over(w) - 1).alias("i"))
    rows = rows.withColumn("r", F.col("x") - F.lag("x").over(w))
    age, r = F.col("i") - SEED, F.col("r")
    start = F.var_pop(F.when(F.col("i").between(1, SEED), r)).over(Window.partitionBy("symbol"))
    added = F.sum(F.when(age > 0, r * r * F.pow(F.lit(DECAY), -age))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("sig", F.when(age > 0, F.sqrt(F.pow(F.lit(DECAY), age) * (start + (1 - DECAY) * added))))


def windows(vol: DataFrame, h: int) -> DataFrame:
    """vol with h, out (log move over the next h rows) and low, high (smallest and largest move on the way); null where rows are missing."""
    w = frames.series(["symbol"], ["i"])
    x = F.col("x")
    low, high = (frames.forward_full(x, h, w, f) - x for f in (F.min, F.max))
    return vol.select("*", F.lit(h).alias("h"), (F.lead("x", h).over(w) - x).alias("out"), low.alias("low"), high.alias("high"))


def _ends(levels: Sequence[float]) -> list[float]:
    return [(1 - v) / 2 for v in levels] + [(1 + v) / 2 for v in levels]


def _by_level(rows: DataFrame, levels: Sequence[float], lo, hi) -> DataFrame:
    """One row for each level, with lo and hi."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("level"), lo(j).alias("lo"), hi(j).alias("hi")) for j, v in enumerate(levels))))
    return rows.withColumn("_b", each).select("*", "_b.level", "_b.lo", "_b.hi").drop("_b")


def past_quantiles(rows: DataFrame, values: dict[str, Column], h: int, qs: Sequence[float], least: int) -> DataFrame:
    """rows(symbol, i, ...) with an array of linear quantiles for each of the named values, over the rows up to i - h; null below `least` values.

    A growing sorted sample has no window function of its own (an exact
    percentile sorts the whole frame anew at each row), so each series'
    values go through pandas' expanding quantiles.
    """
    names = list(values)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        out = {"symbol": pdf["symbol"], "i": pdf["i"]}
        for n in names:
            past = pdf[n].astype(float).shift(h)
            past = past.where(np.isfinite(past)).expanding(min_periods=max(1, least))
            each = np.stack([past.quantile(q).to_numpy() for q in qs], axis=1)
            out[n] = [None if np.isnan(x[0]) else x for x in each]
        return pd.DataFrame(out)

    kind = "symbol string, i int, " + ", ".join(f"{n} array<double>" for n in names)
    got = rows.select("symbol", "i", *(c.alias(n) for n, c in values.items())).groupBy("symbol").applyInPandas(run, kind)
    return rows.join(got, ["symbol", "i"])


def scaled_bands(rows: DataFrame, h: int, levels: Sequence[float], scale: Column, least: int = WARMUP) -> DataFrame:
    """Filtered historical simulation: quantiles of past moves over their scale, times the present scale."""
    n = len(levels)
    rows = past_quantiles(rows, {"_q": F.col("out") / scale}, h, _ends(levels), least)
    return _by_level(rows, levels, lambda j: F.col("_q")[j] * scale, lambda j: F.col("_q")[n + j] * scale).drop("_q")


def bands(vol: DataFrame, h: int, levels: Sequence[float] = LEVELS, methods: Sequence[str] = METHODS) -> DataFrame:
    """Rows of `windows` for each method and level, with lo and hi; null before WARMUP complete windows."""
    rows, out = windows(vol, h), None
    spread = F.col("sig") * F.sqrt(F.lit(float(h)))
    for m in methods:
        if m == "gauss_ewma":
            one = _by_level(rows, levels, lambda j: spread * -Z_UPPER[levels[j]], lambda j: spread * Z_UPPER[levels[j]])
        else:
            one = scaled_bands(rows, h, levels, spread if m == "fhs" else F.lit(1.0))
        one = one.withColumn("method", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def past_rank(vol: DataFrame) -> DataFrame:
    """vol with rank: the share of the volatilities up to the row, itself included, that are strictly smaller."""
    w = frames.series(["symbol"], ["i"]).rowsBetween(Window.unboundedPreceding, 0)
    seen = vol.withColumn("_seen", F.when(F.col("sig").isNotNull(), F.collect_list("sig").over(w)))
    return seen.withColumn("rank", F.size(F.filter("_seen", lambda s: s < F.col("sig"))) / F.size("_seen")).withColumn("rank", F.when(F.col("sig").isNotNull(), F.col("rank"))).drop("_seen")


def third(share: Column) -> Column:
    """0, 1 or 2: the third of [0, 1) that a share lies in."""
    return F.least(F.lit(2), F.floor(share * 3).cast("int"))


def conditional_bands(vol: DataFrame, h: int, levels: Sequence[float], least: int = WARMUP) -> DataFrame:
    """As fhs, from past windows that began in the present third of the past rank; from all where those are fewer than `least`."""
    rows = windows(past_rank(vol), h).withColumn("kind", third(F.col("rank")))
    spread, n = F.col("sig") * F.sqrt(F.lit(float(h))), len(levels)
    z = F.col("out") / spread
    pools = {f"_q{k}": F.when(F.col("kind") == k, z) for k in range(3)}
    rows = past_quantiles(rows, {**pools, "_q": z}, h, _ends(levels), least)
    own = F.coalesce(*(F.when(F.col("kind") == k, F.col(f"_q{k}")) for k in range(3)))
    rows = rows.withColumn("_q", F.coalesce(own, "_q")).drop(*pools)
    return _by_level(rows, levels, lambda j: F.col("_q")[j] * spread, lambda j: F.col("_q")[n + j] * spread).drop("_q")


def tercile(by: Sequence[str]) -> Column:
    """calm, mid or storm by terciles of sig among the rows of a group."""
    cut = F.percentile("sig", F.array(F.lit(1 / 3), F.lit(2 / 3))).over(Window.partitionBy(*by))
    return F.when(F.col("sig") <= cut[0], "calm").when(F.col("sig") <= cut[1], "mid").otherwise("storm")


def apart(by: Sequence[str]) -> Column:
    """Whether a row begins a window that overlaps none before it, counted from the group's first row."""
    return (F.col("i") - F.min("i").over(Window.partitionBy(*by))) % F.col("h") == 0


def upper_tail(s: Column, steps: int = 1000) -> Column:
    """The complementary error function for s >= 0, by Simpson's rule."""
    at = lambda k: F.exp(-F.pow(s * k / steps, F.lit(2.0)))
    weight = lambda k: F.when((k == 0) | (k == steps), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda a, k: a + weight(k) * at(k)) * s / (3.0 * steps)
    return F.greatest(F.lit(0.0), 1 - area * 1.1283791670955126)


def kupiec(n: Column, x: Column, p: Column) -> Column:
    """P-value of the proportion-of-failures test for x breaches of n at rate p; null without observations."""
    like = lambda q: F.when(n > x, (n - x) * F.ln(1 - q)).otherwise(0.0) + F.when(x > 0, x * F.ln(q)).otherwise(0.0)
    ratio = F.greatest(F.lit(0.0), 2 * (like(x / n) - like(p)))
    return F.when(n > 0, upper_tail(F.least(F.lit(6.0), F.sqrt(ratio / 2))))


def mcnemar(b: Column, c: Column) -> Column:
    """One-sided exact p-value: the chance of b or more of b + c at even odds."""
    n = (b + c).cast("double")
    first = F.pow(F.lit(2.0), -n)
    start = F.struct(first.alias("term"), F.when(b == 0, first).otherwise(0.0).alias("total"))

    def step(acc, k):
        term = acc["term"] * (n - k + 1) / k
        return F.struct(term.alias("term"), (acc["total"] + F.when(k >= b, term).otherwise(0.0)).alias("total"))

    return F.when(n == 0, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), (b + c).cast("int"))), start, step)["total"])


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def coverage(bands_: DataFrame, by: Sequence[str]) -> DataFrame:
    """How often moves stayed inside their bands, over rows with both: by group (symbol, method, h, level or some of these).

    n_all, cov_all, below, above; n_no, breaches_no and kupiec_p over windows
    that do not overlap; width_pct, touch (bands left on the way), and the
    coverage by tercile of volatility.
    """
    rows = bands_.where("lo is not null and out is not null and sig is not null")
    rows = rows.withColumn("kind", tercile(by)).withColumn("apart", apart(by)).withColumn("below", F.col("out") < F.col("lo")).withColumn("above", F.col("out") > F.col("hi"))
    hit = ~F.col("below") & ~F.col("above")
    got = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_all"), share(hit).alias("cov_all"), share(F.col("below")).alias("below"), share(F.col("above")).alias("above"),
        F.count_if("apart").alias("n_no"), F.count_if(F.col("apart") & ~hit).alias("breaches_no"), (F.avg(F.exp("hi") - F.exp("lo")) * 100).alias("width_pct"),
        share((F.col("low") < F.col("lo")) | (F.col("high") > F.col("hi"))).alias("touch"), *(F.avg(F.when(F.col("kind") == k, hit.cast("double"))).alias(f"cov_{k}") for k in REGIMES),
    )
    return got.withColumn("kupiec_p", kupiec(F.col("n_no"), F.col("breaches_no"), 1 - F.col("level")))


def paired(vol: DataFrame, h: int, levels: Sequence[float], one: Column, two: Column) -> DataFrame:
    """Bands of two models on the same days from pools that begin on the same day: lo_1, hi_1, lo_2, hi_2 by level.

    one and two are scales over h rows. Days count from WARMUP + h rows after
    the first on which both scales are known.
    """
    both = F.when(one.isNotNull() & two.isNotNull(), one), F.when(one.isNotNull() & two.isNotNull(), two)
    rows = windows(vol, h).withColumn("scale_1", both[0]).withColumn("scale_2", both[1])
    rows = rows.withColumn("_from", F.min(F.when(F.col("scale_1").isNotNull(), F.col("i"))).over(Window.partitionBy("symbol")))
    sides = [scaled_bands(rows, h, levels, F.col(f"scale_{m}")).withColumnsRenamed({"lo": f"lo_{m}", "hi": f"hi_{m}"}) for m in (1, 2)]
    keys = ["symbol", "i", "level"]
    got = sides[0].join(sides[1].select(*keys, "lo_2", "hi_2"), keys)
    return got.where((F.col("i") >= F.col("_from") + WARMUP + h) & F.col("lo_1").isNotNull() & F.col("lo_2").isNotNull() & F.col("out").isNotNull()).drop("_from")


def judged(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """pairs with kind (tercile), apart, hit_1 and hit_2."""
    rows = pairs.withColumn("kind", tercile(by)).withColumn("apart", apart(by))
    for m in (1, 2):
        rows = rows.withColumn(f"hit_{m}", F.col("out").between(F.col(f"lo_{m}"), F.col(f"hi_{m}")))
    return rows


def compare(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two models over `judged` rows: coverage, conditional error, gain on calm days and the exact test on calm days apart."""
    target = F.first("level")
    cond = {(m, k): F.avg(F.when(F.col("kind") == k, F.col(f"hit_{m}").cast("double"))) for m in (1, 2) for k in REGIMES}
    off = {x: F.abs(v - target) for x, v in cond.items()}
    error = lambda m: sum((off[m, k] for k in REGIMES[1:]), off[m, "calm"]) / 3
    calm = F.col("apart") & (F.col("kind") == "calm")
    got = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *(share(F.col(f"hit_{m}")).alias(f"cov_{m}") for m in (1, 2)), *(error(m).alias(f"cce_{m}") for m in (1, 2)), (off[1, "calm"] - off[2, "calm"]).alias("d_calm"),
        F.count_if("apart").alias("n_no"), *(F.count_if(F.col("apart") & ~F.col(f"hit_{m}")).alias(f"x_{m}") for m in (1, 2)),
        F.count_if(calm & F.col("hit_2") & ~F.col("hit_1")).alias("won"), F.count_if(calm & F.col("hit_1") & ~F.col("hit_2")).alias("lost"),
    )
    return got.withColumn("mcnemar_p", mcnemar(F.col("won"), F.col("lost"))).withColumn("kupiec_2", kupiec(F.col("n_no"), F.col("x_2"), 1 - F.col("level")))


def adopted(compared: DataFrame, by: Sequence[str], level: float, threshold: float) -> DataFrame:
    """The decision rule: at `level` the calm gain beats the threshold and the conditional error falls, and the second model passes its test at every level."""
    at = F.col("level") == level
    gain, fell = F.max(F.when(at, F.col("d_calm"))), F.max(F.when(at, F.col("cce_2") < F.col("cce_1")))
    passed = F.min(F.col("kupiec_2") > 0.05)
    return compared.groupBy(*by).agg(gain.alias("d_calm"), (gain > threshold).alias("calm_gain"), fell.alias("error_fell"), passed.alias("calibrated"), ((gain > threshold) & fell & passed).alias("adopted"))


def rich_split(rows: DataFrame, ratio: Column, by: Sequence[str]) -> DataFrame:
    """Breaches of the first model on calm days, above and not above the median of a ratio among those days."""
    calm = rows.where("kind = 'calm'").withColumn("ratio", ratio)
    calm = calm.withColumn("rich", F.col("ratio") > F.percentile("ratio", 0.5).over(Window.partitionBy(*by)))
    return calm.groupBy(*by, "rich").agg(F.count(F.lit(1)).alias("n"), share(~F.col("hit_1")).alias("breach"), F.count_if("apart").alias("n_no"))


def trailing_level(vol: DataFrame, days: int = WARMUP) -> DataFrame:
    """vol with level_now: the mean squared return of the last `days` rows, null until there are as many."""
    w = frames.series(["symbol"], ["i"])
    return vol.withColumn("level_now", frames.rolling_full(F.col("r") * F.col("r"), days, w, F.avg))


def reverting(vol: DataFrame, a: float, b: float) -> DataFrame:
    """vol with v: next-day variance that moves by a with squared returns, keeps b of itself and is drawn to level_now.

    A fold over each series' array, as every value rests on the one before;
    it starts at the first level_now.
    """
    known = vol.where("level_now is not null").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("i", "level_now", "r"))).alias("s"))
    start = F.array(F.struct(F.col("s")[0]["i"].alias("i"), F.col("s")[0]["level_now"].alias("v")))

    def step(acc, e):
        last = F.element_at(acc, -1)["v"]
        return F.concat(acc, F.array(F.struct(e["i"].alias("i"), ((1 - a - b) * e["level_now"] + a * e["r"] * e["r"] + b * last).alias("v"))))

    made = known.select("symbol", F.explode(F.aggregate(F.slice("s", 2, F.greatest(F.lit(1), F.size("s") - 1)), start, step)).alias("e")).select("symbol", "e.i", "e.v")
    return vol.join(made, ["symbol", "i"], "left")


def reverting_scale(a: float, b: float, h: int) -> Column:
    """Volatility over h days from v and level_now."""
    keep = a + b
    return F.sqrt(h * F.col("level_now") + (F.col("v") - F.col("level_now")) * ((1 - keep**h) / (1 - keep)))


def logged(known: DataFrame, made: DataFrame, keys: Sequence[str], last: Column, catch_up: int) -> DataFrame:
    """The forecast log after one cycle: write-once, forward only.

    made has a forecast for every day up to the cycle's last close, `last`
    rows long. A symbol without a log starts with the last of them; otherwise
    those of the latest `catch_up` rows that are missing are added, never any
    before its first logged day.
    """
    since = known.groupBy("symbol").agg(F.min("d").alias("_first"))
    open_ = made.join(since, "symbol", "left").where(F.when(F.col("_first").isNull(), F.col("i") == last).otherwise((F.col("i") > last - catch_up) & (F.col("d") >= F.col("_first"))))
    return known.unionByName(open_.select(*known.columns).join(known.select(*keys), list(keys), "left_anti"))
