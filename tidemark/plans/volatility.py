"""Volatility corridors over the daily price."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import corridors as C
from ..operators import frames
from ..operators import volatility as V
from . import inputs
from .registry import query


def _series(spark, sf):
    """symbol, d, close of two series: the price, and one smoothed over five days."""
    px = inputs.price(spark, sf)
    w = frames.series([], ["d"])
    calm = px.select(F.lit("calm").alias("symbol"), "d", F.avg("close").over(w.rowsBetween(-4, 0)).alias("close"))
    return px.select(F.lit("base").alias("symbol"), "d", "close").unionByName(calm)


SERIES = f"SELECT 'base' AS symbol, d, close FROM ({inputs.PRICE}) UNION ALL SELECT 'calm', d, avg(close) OVER (ORDER BY d ROWS 4 PRECEDING) FROM ({inputs.PRICE})"


def _coins(spark, sf):
    """symbol, d, close of the first three of the names."""
    return inputs.lines(spark, sf).where("symbol <= 'line3'")


COINS = f"SELECT * FROM ({inputs.LINES}) WHERE symbol <= 'line3'"


def _implied(spark, sf):
    """d, iv: the spread of a day's unit prices over their mean, in the role of a yearly implied volatility."""
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return inputs.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg((F.stddev_samp(p) / F.avg(p)).alias("iv"))


IMPLIED = "SELECT l_shipdate::DATE AS d, stddev_samp(l_extendedprice / l_quantity) / avg(l_extendedprice / l_quantity) AS iv FROM lineitem GROUP BY 1"


def _vol(source=SERIES):
    """CTEs up to vol(symbol, d, i, x, r, sig)."""
    return f"""s0 AS ({source}), s1 AS (SELECT symbol, d, ln(close) AS x, row_number() OVER o - 1 AS i, ln(close) - lag(ln(close)) OVER o AS r FROM s0 WINDOW o AS (PARTITION BY symbol ORDER BY d)),
 s2 AS (SELECT *, var_pop(CASE WHEN i BETWEEN 1 AND 30 THEN r END) OVER (PARTITION BY symbol) AS v0, sum(CASE WHEN i > 30 THEN r * r * pow(0.94::DOUBLE, 30 - i) END) OVER (PARTITION BY symbol ORDER BY i) AS q FROM s1),
 vol AS (SELECT symbol, d, i, x, r, CASE WHEN i > 30 THEN sqrt(pow(0.94::DOUBLE, i - 30) * (v0 + 0.06::DOUBLE * q)) END AS sig FROM s2)"""


def _win(h, source="vol"):
    """Rows of source with their moves over the next h rows."""
    return f"""SELECT *, {h} AS h, lead(x, {h}) OVER (PARTITION BY symbol ORDER BY i) - x AS out, CASE WHEN count(x) OVER f = {h} THEN min(x) OVER f END - x AS low, CASE WHEN count(x) OVER f = {h} THEN max(x) OVER f END - x AS high
  FROM {source} WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"""


def _frame(h):
    return f"(PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND {h} PRECEDING)"


def _banded(rows, h, scale, levels, least=365):
    """lo and hi of scaled past moves, a select for each level."""
    return " UNION ALL ".join(
        f"""SELECT * EXCLUDE (z, n, ql, qh), {v}::DOUBLE AS level, CASE WHEN n >= {least} THEN ql * {scale} END AS lo, CASE WHEN n >= {least} THEN qh * {scale} END AS hi
  FROM (SELECT *, count(z) OVER f AS n, quantile_cont(z, {a!r}::DOUBLE) OVER f AS ql, quantile_cont(z, {b!r}::DOUBLE) OVER f AS qh FROM (SELECT *, out / {scale} AS z FROM ({rows})) WINDOW f AS {_frame(h)})"""
        for v, a, b in ((v, (1 - v) / 2, (1 + v) / 2) for v in levels)
    )


def _bands(h, levels, methods=C.METHODS):
    """As corridors.bands."""
    out = []
    for m in methods:
        if m == "gauss_ewma":
            one = " UNION ALL ".join(f"SELECT *, {v}::DOUBLE AS level, sig * sqrt({h}::DOUBLE) * -{C.Z_UPPER[v]!r}::DOUBLE AS lo, sig * sqrt({h}::DOUBLE) * {C.Z_UPPER[v]!r}::DOUBLE AS hi FROM ({_win(h)})" for v in levels)
        else:
            one = _banded(_win(h), h, f"(sig * sqrt({h}::DOUBLE))" if m == "fhs" else "1.0::DOUBLE", levels)
        out.append(f"SELECT *, '{m}' AS method FROM ({one})")
    return " UNION ALL ".join(out)


def _tercile(by):
    return f"""CASE WHEN sig <= quantile_cont(sig, {1 / 3!r}::DOUBLE) OVER (PARTITION BY {by}) THEN 'calm' WHEN sig <= quantile_cont(sig, {2 / 3!r}::DOUBLE) OVER (PARTITION BY {by}) THEN 'mid' ELSE 'storm' END"""


def _tail(s):
    return f"greatest(0.0, 1 - 1.1283791670955126::DOUBLE * {s} / 3000 * list_sum(list_transform(range(1001), lambda k: (CASE WHEN k IN (0, 1000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow({s} * k / 1000, 2)))))"


def _kupiec(n, x, p):
    like = lambda q: f"(CASE WHEN {n} > {x} THEN ({n} - {x}) * ln(1 - {q}) ELSE 0 END + CASE WHEN {x} > 0 THEN {x} * ln({q}) ELSE 0 END)"
    return f"CASE WHEN {n} > 0 THEN (SELECT {_tail('sq')} FROM (SELECT least(6.0::DOUBLE, sqrt(greatest(0.0::DOUBLE, 2 * ({like(f'({x}::DOUBLE / {n})')} - {like(p)})) / 2)) AS sq)) END"


def _mcnemar(b, c):
    n = f"({b} + {c})"
    return f"CASE WHEN {n} = 0 THEN 1.0 ELSE list_sum(list_transform(range({b}, {n} + 1), lambda k: exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) - {n} * ln(2.0::DOUBLE)))) END"


def _coverage(bands_, by):
    keys = ", ".join(by)
    return f"""SELECT {keys}, n_all, round(cov_all, 8) AS cov_all, round(below, 8) AS below, round(above, 8) AS above, n_no, breaches_no, round({_kupiec('n_no', 'breaches_no', '(1 - level)')}, 6) AS kupiec_p,
  round(width_pct, 8) AS width_pct, round(touch, 8) AS touch, round(cov_calm, 8) AS cov_calm, round(cov_mid, 8) AS cov_mid, round(cov_storm, 8) AS cov_storm FROM (SELECT {keys}, count(*) AS n_all, avg(hit::INT) AS cov_all, avg((out < lo)::INT) AS below,
  avg((out > hi)::INT) AS above, count(*) FILTER (apart) AS n_no, count(*) FILTER (apart AND NOT hit) AS breaches_no, avg(exp(hi) - exp(lo)) * 100 AS width_pct, avg((low < lo OR high > hi)::INT) AS touch,
  avg(hit::INT) FILTER (kind = 'calm') AS cov_calm, avg(hit::INT) FILTER (kind = 'mid') AS cov_mid, avg(hit::INT) FILTER (kind = 'storm') AS cov_storm
  FROM (SELECT *, out >= lo AND out <= hi AS hit, {_tercile(keys)} AS kind, (i - min(i) OVER (PARTITION BY {keys})) % h = 0 AS apart FROM ({bands_}) WHERE lo IS NOT NULL AND out IS NOT NULL AND sig IS NOT NULL) GROUP BY {keys})"""


def _rounded(df, *keys, k=8):
    """df with its doubles rounded, but keys."""
    return df.select(*(F.round(c, k).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes))


@query(f"""WITH RECURSIVE {_vol()}, e AS (SELECT symbol, 30::BIGINT AS i, var_pop(r) AS v FROM s1 WHERE i BETWEEN 1 AND 30 GROUP BY 1
 UNION ALL SELECT e.symbol, s1.i, 0.94::DOUBLE * e.v + 0.06::DOUBLE * s1.r * s1.r FROM e JOIN s1 ON s1.symbol = e.symbol AND s1.i = e.i + 1)
 SELECT symbol, d, round(sqrt(v), 8) AS sig FROM e JOIN s1 USING (symbol, i) WHERE i > 30""")
def ewma_vol(spark, sf):
    """Decaying volatility at every close."""
    return C.volatility(_series(spark, sf)).where("sig is not null").select("symbol", "d", F.round("sig", 8).alias("sig"))


@query(f"""WITH {_vol()} SELECT symbol, method, d, round(lo, 8) AS lo, round(hi, 8) AS hi FROM ({_bands(14, (0.90,))}) WHERE lo IS NOT NULL""")
def fhs_band(spark, sf):
    """Fourteen-day bands at 90 percent by three methods."""
    return C.bands(C.volatility(_series(spark, sf)), 14, (0.90,)).where("lo is not null").select("symbol", "method", "d", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"))


_HORIZONS = (7, 14, 30)
_KEYS = ["symbol", "method", "h", "level"]


def _all_bands(spark, sf, levels=C.LEVELS):
    vol = C.volatility(_series(spark, sf))
    out = C.bands(vol, _HORIZONS[0], levels)
    for h in _HORIZONS[1:]:
        out = out.unionByName(C.bands(vol, h, levels))
    return out


_ALL_BANDS = " UNION ALL ".join(f"({_bands(h, C.LEVELS)})" for h in _HORIZONS)


@query(f"WITH {_vol()} {_coverage(_ALL_BANDS, _KEYS)}")
def coverage_kupiec(spark, sf):
    """Coverage of the bands by method, horizon and level."""
    got = C.coverage(_all_bands(spark, sf), _KEYS)
    return _rounded(got.withColumn("kupiec_p", F.round("kupiec_p", 6)), "level")


@query(f"""WITH {_vol()}, b AS ({_ALL_BANDS}) SELECT symbol, method, h, level, d, round((exp(lo) - 1) * 100, 6) AS down_pct, round((exp(hi) - 1) * 100, 6) AS up_pct FROM b WHERE i = (SELECT max(i) FROM b AS c WHERE c.symbol = b.symbol)""")
def current_band(spark, sf):
    """The bands at the last close, in percent of it, by method, horizon and level."""
    rows = _all_bands(spark, sf).withColumn("last", F.max("i").over(Window.partitionBy("symbol"))).where("i = last")
    percent = lambda c: F.round((F.exp(c) - 1) * 100, 6)
    return rows.select("symbol", "method", "h", "level", "d", percent("lo").alias("down_pct"), percent("hi").alias("up_pct"))


@query(f"""WITH p AS ({inputs.PRICE}), w AS (SELECT d, ln(close) AS x, count(*) OVER f AS n, min(ln(close)) OVER f AS lo, max(ln(close)) OVER f AS hi, lead(ln(close), 14) OVER (ORDER BY d) AS e FROM p WINDOW f AS (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING))
 SELECT d, round(CASE WHEN n = 14 THEN greatest(0.0, x - lo) END, 8) AS dip, round(CASE WHEN n = 14 THEN greatest(0.0, hi - x) END, 8) AS run, round(e - x, 8) AS ret FROM w""")
def excursions(spark, sf):
    """Largest fall and rise within the next fourteen rows, and the move at their end."""
    w = frames.series([], ["d"])
    dip, run = frames.excursions(F.col("close"), 14, w)
    ret = F.lead(F.ln("close"), 14).over(w) - F.ln("close")
    return inputs.price(spark, sf).select("d", F.round(dip, 8).alias("dip"), F.round(run, 8).alias("run"), F.round(ret, 8).alias("ret"))


_RANK = "(SELECT count(*) FILTER (b.sig < vol.sig)::DOUBLE / count(b.sig) FROM vol AS b WHERE b.symbol = vol.symbol AND b.i <= vol.i AND b.sig IS NOT NULL)"
_KINDS = ("fall", "rise", "dip", "run")


def _sizes(rows):
    """Falls, rises, dips and runs of windows, at least 0."""
    zero = F.lit(0.0)
    return dict(zip(_KINDS, (F.greatest(zero, -F.col("out")), F.greatest(zero, F.col("out")), F.greatest(zero, -F.col("low")), F.greatest(zero, F.col("high"))), strict=True))


_SIZES = dict(zip(_KINDS, ("greatest(0.0, -out)", "greatest(0.0, out)", "greatest(0.0, -low)", "greatest(0.0, high)"), strict=True))


@query(f"""WITH {_vol()}, last AS (SELECT symbol, sig AS now, {_RANK} AS rank FROM vol WHERE i = (SELECT max(i) FROM vol AS b WHERE b.symbol = vol.symbol)),
 m AS ({" UNION ALL ".join(f"SELECT symbol, h, '{k}' AS kind, {x} / (sig * sqrt(h::DOUBLE)) AS z, out FROM ({_win(h)})" for h in _HORIZONS for k, x in _SIZES.items())})
 SELECT symbol, h, kind, round(quantile_cont(z, 0.5::DOUBLE) * any_value(now) * sqrt(h::DOUBLE), 8) AS q50, round(quantile_cont(z, 0.8::DOUBLE) * any_value(now) * sqrt(h::DOUBLE), 8) AS q80, round(quantile_cont(z, 0.95::DOUBLE) * any_value(now) * sqrt(h::DOUBLE), 8) AS q95,
  round(avg((out > 0)::INT), 8) AS up_share, round(any_value(rank), 8) AS sig_rank, CASE least(2, floor(any_value(rank) * 3)) WHEN 0 THEN 'calm' WHEN 1 THEN 'mid' ELSE 'storm' END AS regime
 FROM m JOIN last USING (symbol) WHERE z IS NOT NULL AND out IS NOT NULL GROUP BY 1, 2, 3""")
def move_profile(spark, sf):
    """Falls, rises, dips and runs that past windows of the same scaled size had, at the last close, with its regime."""
    vol = C.volatility(_series(spark, sf))
    last = C.past_rank(vol).groupBy("symbol").agg(F.max_by("sig", "i").alias("now"), F.max_by("rank", "i").alias("sig_rank"))
    rows = None
    for h in _HORIZONS:
        w = C.windows(vol, h).where("sig is not null and out is not null")
        kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), (x / (F.col("sig") * F.sqrt(F.lit(float(h))))).alias("z")) for k, x in _sizes(w).items())))
        w = w.select("symbol", "h", "out", kinds.alias("k")).select("symbol", "h", "out", "k.kind", "k.z")
        rows = w if rows is None else rows.unionByName(w)
    got = rows.groupBy("symbol", "h", "kind").agg(F.percentile("z", F.array(F.lit(0.5), F.lit(0.8), F.lit(0.95))).alias("q"), C.share(F.col("out") > 0).alias("up_share")).join(last, "symbol")
    size = lambda j: F.round(F.col("q")[j] * F.col("now") * F.sqrt(F.col("h").cast("double")), 8)
    regime = F.element_at(F.array(*(F.lit(k) for k in C.REGIMES)), C.third(F.col("sig_rank")) + 1)
    return got.select("symbol", "h", "kind", size(0).alias("q50"), size(1).alias("q80"), size(2).alias("q95"), F.round("up_share", 8).alias("up_share"), F.round("sig_rank", 8).alias("sig_rank"), regime.alias("regime"))


@query(f"""WITH {_vol()}, w AS (SELECT *, greatest(0.0, -low) / (sig * sqrt(14::DOUBLE)) AS dip FROM ({_win(14)})), q AS (SELECT *, count(dip) OVER f AS n, quantile_cont(dip, 0.8::DOUBLE) OVER f AS cut FROM (SELECT * REPLACE (CASE WHEN low IS NULL THEN NULL ELSE dip END AS dip) FROM w) WINDOW f AS {_frame(14)}),
 k AS (SELECT *, {_tercile("symbol")} AS regime FROM q WHERE n >= 365 AND dip IS NOT NULL) SELECT symbol, regime, count(*) AS n, round(avg((dip > cut)::INT), 8) AS exceeded FROM k GROUP BY 1, 2""")
def move_backtest(spark, sf):
    """How often dips went beyond their expanding 80 percent quantile, by regime."""
    rows = C.windows(C.volatility(_series(spark, sf)), 14)
    rows = rows.withColumn("dip", F.when(F.col("low").isNotNull(), F.greatest(F.lit(0.0), -F.col("low")) / (F.col("sig") * F.sqrt(F.lit(14.0)))))
    rows = C.past_quantiles(rows, {"cut": F.col("dip")}, 14, (0.8,), C.WARMUP).where("cut is not null and dip is not null").withColumn("cut", F.col("cut")[0])
    return rows.withColumn("regime", C.tercile(["symbol"])).groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"), F.round(C.share(F.col("dip") > F.col("cut")), 8).alias("exceeded"))


@query()
def garch_fit(spark, sf):
    """Variance that reverts to its trailing level, fitted by likelihood over a grid on the first 60 percent of the days; its fourteen-day volatility at the last close."""
    names = ["symbol", "fit_days", "a", "b", "level_vol", "vol_14"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        r, level = pdf["r"].to_numpy(float), pdf["level_now"].to_numpy(float)
        end = int(len(r) * 0.6)
        fit = V.fit_reverting(r, level, end)
        if fit is None:
            return pd.DataFrame(columns=names)
        a, b = fit
        v = V.reverting_variance(r, level, a, b)[-1]
        return pd.DataFrame([(pdf["symbol"].iloc[0], end, round(a, 4), round(b, 4), round(math.sqrt(level[-1]), 8), round(math.sqrt(V.term_variance(v, a, b, level[-1], 14)), 8))], columns=names)

    rows = C.trailing_level(C.volatility(_series(spark, sf))).select("symbol", "i", "r", "level_now")
    return rows.groupBy("symbol").applyInPandas(one, "symbol string, fit_days long, a double, b double, level_vol double, vol_14 double")


_A, _B, _TEST = 0.10, 0.85, (0.80, 0.90, 0.95)
_PAIRED = ["symbol", "h", "level"]


def _paired_sql(rows, h, levels):
    """As corridors.paired; rows has scale_1 and scale_2."""
    base = f"SELECT * REPLACE (CASE WHEN scale_2 IS NOT NULL THEN scale_1 END AS scale_1, CASE WHEN scale_1 IS NOT NULL THEN scale_2 END AS scale_2) FROM ({rows})"
    base = f"SELECT *, min(CASE WHEN scale_1 IS NOT NULL THEN i END) OVER (PARTITION BY symbol) AS since FROM ({base})"
    one, two = (_banded(base, h, f"scale_{m}", levels) for m in (1, 2))
    return f"""SELECT a.* EXCLUDE (lo, hi), a.lo AS lo_1, a.hi AS hi_1, b.lo AS lo_2, b.hi AS hi_2 FROM ({one}) AS a JOIN ({two}) AS b USING (symbol, i, level)
  WHERE a.i >= a.since + 365 + {h} AND a.lo IS NOT NULL AND b.lo IS NOT NULL AND a.out IS NOT NULL"""


def _judged_sql(rows, by):
    return f"SELECT *, {_tercile(by)} AS kind, (i - min(i) OVER (PARTITION BY {by})) % h = 0 AS apart, out BETWEEN lo_1 AND hi_1 AS hit_1, out BETWEEN lo_2 AND hi_2 AS hit_2 FROM ({rows})"


def _compare_sql(rows, by):
    cond = lambda m, k: f"abs(avg(hit_{m}::INT) FILTER (kind = '{k}') - any_value(level))"
    error = lambda m: "(" + " + ".join(cond(m, k) for k in C.REGIMES) + ") / 3"
    return f"""SELECT *, {_mcnemar('won', 'lost')} AS mcnemar_p, {_kupiec('n_no', 'x_2', '(1 - level)')} AS kupiec_2 FROM (SELECT {by}, count(*) AS n, avg(hit_1::INT) AS cov_1, avg(hit_2::INT) AS cov_2, {error(1)} AS cce_1, {error(2)} AS cce_2, {cond(1, 'calm')} - {cond(2, 'calm')} AS d_calm,
  count(*) FILTER (apart) AS n_no, count(*) FILTER (apart AND NOT hit_1) AS x_1, count(*) FILTER (apart AND NOT hit_2) AS x_2, count(*) FILTER (apart AND kind = 'calm' AND hit_2 AND NOT hit_1) AS won, count(*) FILTER (apart AND kind = 'calm' AND hit_1 AND NOT hit_2) AS lost FROM ({rows}) GROUP BY {by})"""


_COMPARED = "round(cov_1, 8) AS cov_1, round(cov_2, 8) AS cov_2, round(cce_1, 8) AS cce_1, round(cce_2, 8) AS cce_2, round(d_calm, 8) AS d_calm, n_no, x_1, x_2, won, lost, round(mcnemar_p, 6) AS mcnemar_p, round(kupiec_2, 6) AS kupiec_2"


def _compared(df):
    return _rounded(df.withColumn("mcnemar_p", F.round("mcnemar_p", 6)).withColumn("kupiec_2", F.round("kupiec_2", 6)), "level")


_REVERTING = f"""{_vol()}, lev AS (SELECT *, CASE WHEN count(r) OVER f = 365 THEN avg(r * r) OVER f END AS level_now FROM vol WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS 364 PRECEDING)),
 rv AS (SELECT symbol, i, level_now AS v FROM lev WHERE i = (SELECT min(i) FROM lev AS b WHERE b.symbol = lev.symbol AND b.level_now IS NOT NULL)
 UNION ALL SELECT lev.symbol, lev.i, {1 - _A - _B!r}::DOUBLE * lev.level_now + {_A}::DOUBLE * lev.r * lev.r + {_B}::DOUBLE * rv.v FROM rv JOIN lev ON lev.symbol = rv.symbol AND lev.i = rv.i + 1)"""


def _reverting_rows(h):
    keep = _A + _B
    scale = f"sqrt({h} * level_now + (v - level_now) * {(1 - keep**h) / (1 - keep)!r}::DOUBLE)"
    return f"SELECT *, sig * sqrt({h}::DOUBLE) AS scale_1, {scale} AS scale_2 FROM ({_win(h, '(SELECT lev.*, rv.v FROM lev LEFT JOIN rv USING (symbol, i))')})"


def _both(spark, sf):
    """Plain and reverting volatility on common days, judged, for two horizons."""
    vol = C.reverting(C.trailing_level(C.volatility(_series(spark, sf))), _A, _B)
    each = [C.paired(vol, h, _TEST, F.col("sig") * F.sqrt(F.lit(float(h))), C.reverting_scale(_A, _B, h)) for h in (7, 14)]
    return C.judged(each[0].unionByName(each[1]), _PAIRED)


_BOTH = " UNION ALL ".join(f"({_paired_sql(_reverting_rows(h), h, _TEST)})" for h in (7, 14))


@query(f"WITH RECURSIVE {_REVERTING} SELECT symbol, h, level, n, {_COMPARED} FROM ({_compare_sql(_judged_sql(_BOTH, 'symbol, h, level'), 'symbol, h, level')})")
def corridor_compare(spark, sf):
    """Decaying against reverting volatility: coverage, conditional error, calm gain, exact test and proportion test, by horizon and level."""
    return _compared(C.compare(_both(spark, sf), _PAIRED))


@query(f"""WITH RECURSIVE {_REVERTING}, c AS ({_compare_sql(_judged_sql(_BOTH, 'symbol, h, level'), 'symbol, h, level')})
 SELECT symbol, h, round(d, 8) AS d_calm, d > 0.0412 AS calm_gain, fell AS error_fell, ok AS calibrated, d > 0.0412 AND fell AND ok AS adopted
 FROM (SELECT symbol, h, max(CASE WHEN level = 0.9::DOUBLE THEN d_calm END) AS d, bool_or(level = 0.9::DOUBLE AND cce_2 < cce_1) AS fell, bool_and(kupiec_2 > 0.05) AS ok FROM c GROUP BY 1, 2)""")
def corridor_verdict(spark, sf):
    """Whether the reverting model is adopted by the decision rule."""
    return _rounded(C.adopted(C.compare(_both(spark, sf), _PAIRED), ["symbol", "h"], 0.90, 0.0412))


_COND = f"""{_vol()}, k0 AS (SELECT *, least(2, floor({_RANK} * 3)) AS pool FROM vol WHERE sig IS NOT NULL), k1 AS (SELECT vol.*, k0.pool FROM vol LEFT JOIN k0 USING (symbol, i)),
 k2 AS (SELECT *, out / (sig * sqrt(14::DOUBLE)) AS z FROM ({_win(14, 'k1')}))"""


def _conditional(levels):
    own = lambda f: "CASE pool " + " ".join(f"WHEN {k} THEN {f(f'(CASE WHEN pool = {k} THEN z END)')}" for k in range(3)) + " END"
    quant = lambda q: f"CASE WHEN {own(lambda z: f'count{z} OVER f')} >= 365 THEN {own(lambda z: f'quantile_cont({z}, {q!r}::DOUBLE) OVER f')} WHEN count(z) OVER f >= 365 THEN quantile_cont(z, {q!r}::DOUBLE) OVER f END * sig * sqrt(14::DOUBLE)"
    return " UNION ALL ".join(f"SELECT *, {v}::DOUBLE AS level, {quant((1 - v) / 2)} AS lo, {quant((1 + v) / 2)} AS hi FROM k2 WINDOW f AS {_frame(14)}" for v in levels)


@query(f"WITH {_COND} {_coverage(_conditional((0.90,)), ['symbol', 'h', 'level'])}")
def regime_conditional(spark, sf):
    """Regime-conditional bands: coverage at fourteen days."""
    got = C.coverage(C.conditional_bands(C.volatility(_series(spark, sf)), 14, (0.90,)), _PAIRED)
    return _rounded(got.withColumn("kupiec_p", F.round("kupiec_p", 6)), "level")


_POOL = f"""{_COND.replace(SERIES, COINS)}, c1 AS ({_conditional(_TEST)}), v1 AS ({_banded(_win(14), 14, '(sig * sqrt(14::DOUBLE))', _TEST)}),
 pool AS ({_judged_sql('SELECT v1.* EXCLUDE (lo, hi), v1.lo AS lo_1, v1.hi AS hi_1, c1.lo AS lo_2, c1.hi AS hi_2 FROM v1 JOIN c1 USING (symbol, i, level) WHERE v1.lo IS NOT NULL AND c1.lo IS NOT NULL AND v1.out IS NOT NULL', 'symbol, h, level')})"""


def _pooled(spark, sf):
    """Plain and regime-conditional bands of several coins on common days, each coin judged by its own regimes."""
    vol = C.volatility(_coins(spark, sf))
    keys = ["symbol", "i", "level"]
    one = C.scaled_bands(C.windows(vol, 14), 14, _TEST, F.col("sig") * F.sqrt(F.lit(14.0))).withColumnsRenamed({"lo": "lo_1", "hi": "hi_1"})
    two = C.conditional_bands(vol, 14, _TEST).select(*keys, F.col("lo").alias("lo_2"), F.col("hi").alias("hi_2"))
    both = one.join(two, keys).where("lo_1 is not null and lo_2 is not null and out is not null")
    return C.judged(both, _PAIRED)


@query(f"WITH {_POOL} SELECT h, level, n, {_COMPARED} FROM ({_compare_sql('SELECT * FROM pool', 'h, level')})")
def pooled_corridor(spark, sf):
    """Plain against regime-conditional bands over the days of all coins together."""
    return _compared(C.compare(_pooled(spark, sf), ["h", "level"]))


@query(f"WITH {_POOL} SELECT d, count(*) AS calm, count(*) FILTER (hit_1) AS hits_1, count(*) FILTER (hit_2) AS hits_2 FROM pool WHERE level = 0.9::DOUBLE AND kind = 'calm' GROUP BY 1")
def pooled_days(spark, sf):
    """Calm coin-days and hits of both models by calendar day: what the joint bootstrap draws from."""
    calm = _pooled(spark, sf).where("level = 0.9D and kind = 'calm'")
    return calm.groupBy("d").agg(F.count(F.lit(1)).alias("calm"), F.count_if("hit_1").alias("hits_1"), F.count_if("hit_2").alias("hits_2"))


@query()
def pooled_bootstrap(spark, sf):
    """Lower bound of the pooled calm gain by moving blocks of calendar days, drawn for all coins together."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        day = (pd.to_datetime(pdf["d"]) - pd.to_datetime(pdf["d"].iloc[0])).dt.days.to_numpy()
        sums = np.zeros((3, int(day[-1]) + 1))
        sums[:, day] = pdf[["calm", "hits_1", "hits_2"]].to_numpy(float).T
        gains = V.joint_gain(sums, 60, 500, 0.90)
        return pd.DataFrame([(int(sums[0].sum()), round(float(np.quantile(gains, 0.05)), 8), round(float(np.median(gains)), 8))], columns=["n", "lower", "median"])

    return pooled_days(spark, sf).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(one, "n long, lower double, median double")


_IV_ROWS = f"SELECT *, sig * sqrt(14::DOUBLE) AS scale_1, iv * sqrt(14 / 365::DOUBLE) AS scale_2 FROM ({_win(14, '(SELECT vol.*, iv FROM vol LEFT JOIN (' + IMPLIED + ') USING (d))')})"
_IV = _judged_sql(_paired_sql(_IV_ROWS, 14, _TEST), "symbol, h, level")


def _implied_pairs(spark, sf):
    """Plain volatility against an implied one scaled to the horizon, judged."""
    vol = C.volatility(_series(spark, sf)).join(_implied(spark, sf), "d", "left")
    return C.judged(C.paired(vol, 14, _TEST, F.col("sig") * F.sqrt(F.lit(14.0)), F.col("iv") * F.sqrt(F.lit(14 / 365))), _PAIRED)


@query(f"WITH {_vol()} SELECT symbol, h, level, n, {_COMPARED} FROM ({_compare_sql(_IV, 'symbol, h, level')})")
def iv_corridor(spark, sf):
    """Bands scaled by an implied volatility against plain ones."""
    return _compared(C.compare(_implied_pairs(spark, sf), _PAIRED))


@query(f"""WITH {_vol()}, c AS (SELECT *, iv / sqrt(365::DOUBLE) / sig AS ratio FROM ({_IV}) WHERE level = 0.9::DOUBLE AND kind = 'calm')
 SELECT symbol, rich, count(*) AS n, round(avg((NOT hit_1)::INT), 8) AS breach, count(*) FILTER (apart) AS n_no FROM (SELECT *, ratio > median(ratio) OVER (PARTITION BY symbol) AS rich FROM c) GROUP BY 1, 2""")
def iv_rich_split(spark, sf):
    """Breaches of plain bands on calm days with a high and a low implied volatility for the realised one."""
    return _rounded(C.rich_split(_implied_pairs(spark, sf).where("level = 0.9D"), F.col("iv") / F.sqrt(F.lit(365.0)) / F.col("sig"), ["symbol"]))


@query(f"""WITH {_vol()}, f AS (SELECT *, {_tercile("symbol, method")} AS regime FROM ({_bands(7, (0.80,))}) WHERE lo IS NOT NULL AND sig IS NOT NULL)
 SELECT symbol, method AS model, regime, count(*) AS forecasts, count(out) AS scored, round(avg((out BETWEEN lo AND hi)::INT), 8) AS hit, round(avg((low < lo)::INT) FILTER (out IS NOT NULL), 8) AS dip, round(avg((high > hi)::INT) FILTER (out IS NOT NULL), 8) AS run FROM f GROUP BY 1, 2, 3""")
def forward_log_score(spark, sf):
    """Daily forecasts of three models, scored once their windows close, by model and regime."""
    rows = C.bands(C.volatility(_series(spark, sf)), 7, (0.80,)).where("lo is not null and sig is not null").withColumn("regime", C.tercile(["symbol", "method"]))
    done = lambda flag: F.round(F.avg(F.when(F.col("out").isNotNull(), flag.cast("double"))), 8)
    return rows.groupBy("symbol", F.col("method").alias("model"), "regime").agg(
        F.count(F.lit(1)).alias("forecasts"), F.count("out").alias("scored"), done(F.col("out").between(F.col("lo"), F.col("hi"))).alias("hit"), done(F.col("low") < F.col("lo")).alias("dip"), done(F.col("high") > F.col("hi")).alias("run")
    )


_THIN = """t0 AS (SELECT l_shipdate::DATE AS d, count(*)::DOUBLE AS depth, avg(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1),
 t1 AS (SELECT *, pow(ln(close) - ln(lag(close) OVER (ORDER BY d)), 2) AS r2, list(depth) OVER (ORDER BY d ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS past FROM t0),
 t2 AS (SELECT *, list_aggregate(past, 'median') AS med FROM t1), t3 AS (SELECT *, list_aggregate(list_transform(past, lambda v: abs(v - med)), 'median') AS mad, CASE WHEN count(r2) OVER p = 7 THEN avg(r2) OVER p END AS now, CASE WHEN count(r2) OVER n = 7 THEN avg(r2) OVER n END AS later
  FROM t2 WINDOW p AS (ORDER BY d ROWS 6 PRECEDING), n AS (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)),
 thin AS (SELECT d, -(depth - med) / (1.4826::DOUBLE * mad) AS z, ln(later / now) AS surprise, now FROM t3 WHERE len(past) >= 60 AND mad > 0 AND now > 0 AND later > 0)"""


def _thinness(spark, sf):
    """d, z (how thin a day's count is for the last 90 days), surprise (log of the variance to come over that of late) and now."""
    day = inputs.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count(F.lit(1)).cast("double").alias("depth"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    w = frames.series([], ["d"])
    med, mad, n = frames.trailing_median(F.col("depth"), 90, w)
    r2 = F.pow(frames.log_return(F.col("close"), w), F.lit(2.0))
    rows = day.select("d", "depth", med.alias("med"), mad.alias("mad"), n.alias("n"), r2.alias("r2"))
    rows = rows.select("*", frames.rolling_full(F.col("r2"), 7, w, F.avg).alias("now"), frames.forward_full(F.col("r2"), 7, w, F.avg).alias("later")).where("n >= 60 and mad > 0 and now > 0 and later > 0")
    return rows.select("d", (-(F.col("depth") - F.col("med")) / (1.4826 * F.col("mad"))).alias("z"), F.ln(F.col("later") / F.col("now")).alias("surprise"), "now")


@query(f"WITH {_THIN} SELECT d, round(z, 8) AS z, round(surprise, 8) AS surprise FROM thin")
def depth_thinness(spark, sf):
    """How thin each day was by median and median deviation of the 90 days before, and the variance to come."""
    return _rounded(_thinness(spark, sf).select("d", "z", "surprise"))


def _rank_sql(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


@query(f"""WITH {_THIN}, g AS (SELECT 'all' AS part, * FROM thin UNION ALL SELECT 'calm', * FROM thin WHERE now <= (SELECT median(now) FROM thin)),
 k AS (SELECT part, {", ".join(f"rank() OVER (PARTITION BY part ORDER BY {c}) + (count(*) OVER (PARTITION BY part, {c}) - 1) / 2 AS {n}" for c, n in (("z", "a"), ("surprise", "b"), ("now", "c")))} FROM g), m AS (SELECT part, count(*) AS n, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM k GROUP BY 1)
 SELECT part, n, round(ab, 8) AS rho, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 8) AS partial FROM m""")
def depth_thinness_spearman(spark, sf):
    """Thinness against volatility to come: rank correlation, and with volatility of late held fixed; all days and the calm half."""
    rows = _thinness(spark, sf)
    cut = rows.agg(F.percentile("now", 0.5).alias("cut"))
    rows = rows.crossJoin(F.broadcast(cut)).select(F.explode(F.when(F.col("now") <= F.col("cut"), F.array(F.lit("all"), F.lit("calm"))).otherwise(F.array(F.lit("all")))).alias("part"), "z", "surprise", "now")
    ranks = rows.select("part", *(frames.average_rank(F.col(c), ["part"]).alias(n) for c, n in (("z", "a"), ("surprise", "b"), ("now", "c"))))
    m = ranks.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("ab"), F.corr("a", "c").alias("ac"), F.corr("b", "c").alias("bc"))
    held = (F.col("ab") - F.col("ac") * F.col("bc")) / F.sqrt((1 - F.col("ac") * F.col("ac")) * (1 - F.col("bc") * F.col("bc")))
    return m.select("part", "n", F.round("ab", 8).alias("rho"), F.round(held, 8).alias("partial"))


@query()
def depth_thinness_bootstrap(spark, sf):
    """Interval of the rank correlation by moving blocks of thirty days."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        draws = V.block_spearman(pdf["z"].to_numpy(), pdf["surprise"].to_numpy(), 30, 100)
        return pd.DataFrame([(len(pdf), round(float(np.quantile(draws, 0.05)), 8), round(float(np.quantile(draws, 0.95)), 8))], columns=["n", "lo", "hi"])

    return _thinness(spark, sf).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(one, "n long, lo double, hi double")


_ATM = """o AS (SELECT p_size * 2 + 2 AS days, p_retailprice AS strike, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS otype, (p_partkey % 50 + 30)::DOUBLE AS iv FROM part),
 best AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY days, otype ORDER BY abs(strike - 1400), strike, iv) = 1), atm AS (SELECT days, avg(iv) / 100 AS iv FROM best GROUP BY 1)"""


@query(f"""WITH {_ATM}, t AS (SELECT unnest([7, 14, 30, 60, 120]) AS term), b AS (SELECT term, max(days) FILTER (days <= term) AS lo, min(days) FILTER (days >= term) AS hi FROM t, atm GROUP BY 1)
 SELECT term, round(CASE WHEN lo IS NULL THEN h.iv WHEN hi IS NULL OR lo = hi THEN l.iv ELSE sqrt((l.iv * l.iv * lo + (h.iv * h.iv * hi - l.iv * l.iv * lo) * (term - lo) / (hi - lo)::DOUBLE) / term) END, 8) AS iv
 FROM b LEFT JOIN atm AS l ON l.days = lo LEFT JOIN atm AS h ON h.days = hi""")
def atm_term_structure(spark, sf):
    """Implied volatility at fixed terms from parts as listed options: nearest strike of each expiry, call and put averaged, linear in total variance."""
    p = inputs.table(spark, sf, "part").select(
        (F.col("p_size") * 2 + 2).alias("days"), (F.col("p_retailprice")).alias("strike"), F.when(F.col("p_partkey") % 2 == 0, "C").otherwise("P").alias("otype"), (F.col("p_partkey") % 50 + 30).cast("double").alias("iv")
    )
    best = frames.top_k(p.withColumn("gap", F.abs(F.col("strike") - 1400)), ["days", "otype"], [F.col("gap"), F.col("strike"), F.col("iv")], 1)
    return V.term_structure(best.groupBy("days").agg(F.avg("iv").alias("iv")), (7, 14, 30, 60, 120)).select("term", F.round("iv", 8).alias("iv"))
