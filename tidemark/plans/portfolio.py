"""Portfolio queries over the daily panel of event types."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import frames
from ..operators import portfolio as P
from . import inputs
from .registry import query

COST = 0.001


def _w():
    return frames.series(["symbol"], ["d"])


@query(f"""WITH p AS ({inputs.DAILY}), r AS (SELECT *, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY d) - 1 AS gain FROM p),
 k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY gain DESC, symbol) AS rank FROM r WHERE gain > 0) SELECT d, symbol, rank, round(gain, 6) AS gain FROM k WHERE rank <= 2""")
def momentum_topk(spark, sf):
    """The two names with the largest five-day rise of each day."""
    r = inputs.daily_close(spark, sf).withColumn("gain", F.try_divide("close", F.lag("close", 5).over(_w())) - 1).where("gain > 0")
    rank = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("gain"), "symbol"))
    return r.withColumn("rank", rank).where("rank <= 2").select("d", "symbol", "rank", F.round("gain", 6).alias("gain"))


@query(f"""WITH p AS ({inputs.DAILY}), r AS (SELECT d, avg(x) AS ret FROM (SELECT d, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS x FROM p) WHERE x IS NOT NULL GROUP BY 1 HAVING count(*) = 5)
 SELECT d, round(ret, 6) AS ret, round(exp(sum(ln(1 + ret)) OVER (ORDER BY d)), 6) AS equity FROM r""")
def hold_benchmarks(spark, sf):
    """Equal weight in all names, days on which all have a return."""
    r = inputs.daily_close(spark, sf).withColumn("x", frames.simple_return(F.col("close"), _w())).where("x is not null").groupBy("d").agg(F.avg("x").alias("ret"), F.count(F.lit(1)).alias("n")).where("n = 5")
    return r.select("d", F.round("ret", 6).alias("ret"), F.round(frames.equity(F.col("ret"), frames.series([], ["d"])), 6).alias("equity"))


@query(f"""WITH p AS ({inputs.DAILY}), x AS (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS dd, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS ret FROM p)
 SELECT symbol, count(*) AS days, round(min(dd), 6) AS max_dd, round(stddev_samp(ret) * sqrt(365), 6) AS vol, round(last(close ORDER BY d) / first(close ORDER BY d), 6) AS final FROM x GROUP BY 1""")
def drawdown_metrics(spark, sf):
    """Deepest drawdown, volatility and growth of each name."""
    x = inputs.daily_close(spark, sf).withColumn("dd", frames.drawdown(F.col("close"), _w())).withColumn("ret", frames.simple_return(F.col("close"), _w()))
    return x.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"), F.round(F.min("dd"), 6).alias("max_dd"), F.round(F.stddev_samp("ret") * F.sqrt(F.lit(365.0)), 6).alias("vol"), F.round(F.max_by("close", "d") / F.min_by("close", "d"), 6).alias("final")
    )


def _grid(**values):
    return [dict(zip(values, x, strict=True)) for x in itertools.product(*values.values())]


def _named(df, cells, keys, also=()):
    """Metrics with the parameters of their cells."""
    named = P.cells_of(df.sparkSession.range(1), cells).drop("id")
    return df.join(F.broadcast(named), "cell").select(*keys, *[F.round(c, 6).alias(c) for c in (*P.METRICS, *also)], *(["days"] if not also else []))


def _values(cells, keys):
    """The cells as a table in SQL."""
    rows = ", ".join("(" + ", ".join([str(i), *(f"{c[k]}::DOUBLE" if isinstance(c[k], float) else str(c[k]) for k in keys)]) + ")" for i, c in enumerate(cells))
    return f"(SELECT * FROM (VALUES {rows}) AS v(cell, {', '.join(keys)}))"


def _px_sql(daily):
    return f"""c0 AS ({daily}), dd AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS j FROM (SELECT DISTINCT d FROM c0)), ej AS (SELECT max(j) AS end_j FROM dd),
 g0 AS (SELECT symbol, d, j, end_j, close, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY j) AS held FROM dd CROSS JOIN ej CROSS JOIN (SELECT DISTINCT symbol FROM c0) AS sy LEFT JOIN c0 USING (symbol, d)),
 px AS (SELECT *, held / lag(held) OVER (PARTITION BY symbol ORDER BY j) - 1 AS ret, max(CASE WHEN close IS NOT NULL THEN j END) OVER (PARTITION BY symbol) AS last_j FROM g0)"""


def _curve_sql(cells, loss="NULL", flags=None):
    """CTEs up to cv(cell, j, d, equity, ret, turnover); cells has n, k, h and cost."""
    survives = "TRUE" if loss == "NULL" else "last_j = end_j OR last_j >= least(i + h, end_j)"
    ret = "ret" if loss == "NULL" else f"CASE WHEN last_j < end_j AND j = last_j + 1 THEN -{loss} ELSE ret END"
    stays = "" if loss == "NULL" else "AND (last_j = end_j OR j <= last_j + 1)"
    flag, recover = ("flags.flag", "recover") if flags else ("FALSE", "0")
    return f"""pk AS (SELECT * FROM (SELECT c.*, px.j AS i, px.symbol, px.last_j, px.end_j, row_number() OVER (PARTITION BY cell, px.j ORDER BY px.close / b.close DESC, px.symbol) AS place
  FROM px JOIN {cells} AS c ON px.j >= c.n AND (px.j - c.n) % c.h = 0 AND px.j < px.end_j JOIN px AS b ON b.symbol = px.symbol AND b.j = px.j - c.n WHERE px.close / b.close - 1 > 0) WHERE place <= k),
 bs AS (SELECT cell, i, list(symbol) AS names, coalesce(list(symbol) FILTER ({survives}), []) AS kept FROM pk GROUP BY 1, 2),
 dy AS (SELECT c.*, dd.j, dd.d, CASE WHEN dd.j > n THEN n + h * ((dd.j - 1 - n) // h) END AS i FROM dd JOIN {cells} AS c ON dd.j >= c.n),
 hd AS (SELECT cell, i, j, avg({ret}) AS gain FROM (SELECT pk.* EXCLUDE (last_j, end_j), px.j, px.ret, px.last_j, px.end_j FROM pk JOIN px ON px.symbol = pk.symbol AND px.j > pk.i AND px.j <= pk.i + pk.h) WHERE TRUE {stays} GROUP BY ALL),
 r0 AS (SELECT dy.*, coalesce(names, []) AS names, coalesce(kept, []) AS kept, coalesce(gain, 0) AS gain, coalesce({flag}, FALSE) AND dy.i IS NOT NULL AS flag FROM dy LEFT JOIN hd USING (cell, i, j) LEFT JOIN bs USING (cell, i) {"LEFT JOIN flags USING (cell, j)" if flags else ""}),
 r1 AS (SELECT *, coalesce(max(CASE WHEN flag THEN j + {recover} END) OVER (PARTITION BY cell ORDER BY j) >= j, FALSE) AS cash FROM r0),
 r2 AS (SELECT *, sum(step) OVER (PARTITION BY cell, i ORDER BY j) AS run FROM (SELECT *, CASE WHEN cash <> lag(cash) OVER (PARTITION BY cell, i ORDER BY j) THEN 1 ELSE 0 END AS step FROM r1)),
 r3 AS (SELECT *, cash AND bool_or(flag) OVER (PARTITION BY cell, i, run ORDER BY j) AS sold FROM r2), r4 AS (SELECT *, coalesce(lag(sold) OVER (PARTITION BY cell, i ORDER BY j), FALSE) AS was FROM r3),
 r5 AS (SELECT *, CASE WHEN len(names) > 0 AND ((flag AND NOT was) OR (NOT cash AND was)) THEN cost ELSE 0 END AS lost, CASE WHEN cash THEN 0 ELSE gain END AS g, coalesce(lag(CASE WHEN sold THEN [] ELSE kept END) OVER (PARTITION BY cell ORDER BY j), []) AS prior FROM r4),
 r6 AS (SELECT *, CASE WHEN j = i + 1 THEN (len(names) + len(prior) - 2 * len(list_intersect(names, prior))) / (2.0 * k) ELSE 0 END AS turnover FROM r5),
 cv AS (SELECT cell, j, d, CASE WHEN i IS NULL THEN 0 ELSE g END AS ret, turnover, product(CASE WHEN i IS NULL THEN 1 ELSE (1 - turnover * cost) * (1 - lost) * (1 + g) END) OVER (PARTITION BY cell ORDER BY j) AS equity FROM r6)"""


def _metrics_sql(curve, more="", keys=""):
    """Rounded metrics by cell."""
    return f"""SELECT cell, round(final, 6) AS final, round(cagr, 6) AS cagr, round(vol, 6) AS vol, round(CASE WHEN vol > 0 THEN cagr / vol END, 6) AS ret_vol, round(max_dd, 6) AS max_dd, days {keys} FROM (SELECT cell, final, days, vol, max_dd {keys}, CASE WHEN final > 0 THEN pow(final, 1 / years) - 1 ELSE -1 END AS cagr
  FROM (SELECT cell, last(equity ORDER BY j) AS final, greatest(max(d) - min(d), 1) / 365.0::DOUBLE AS years, stddev_samp(mv) * sqrt(365.0::DOUBLE) AS vol, min(dn) AS max_dd, count(*) AS days {more}
  FROM (SELECT *, equity / lag(equity) OVER (PARTITION BY cell ORDER BY j) - 1 AS mv, equity / max(equity) OVER (PARTITION BY cell ORDER BY j) - 1 AS dn FROM ({curve})) GROUP BY cell))"""


_ROTATION = _grid(n=[7, 14, 30, 60], k=[1, 2, 3], h=[7, 14, 30], cost=[COST])


@query(f"WITH {_px_sql(inputs.LINES)}, {_curve_sql(_values(_ROTATION, ['n', 'k', 'h', 'cost']))} SELECT n, k, h, m.* EXCLUDE (cell) FROM ({_metrics_sql('SELECT * FROM cv')}) AS m JOIN {_values(_ROTATION, ['n', 'k', 'h', 'cost'])} USING (cell)")
def momentum_grid(spark, sf):
    """Momentum rotation for every window, basket size and holding time."""
    px = P.panel(inputs.lines(spark, sf))
    return _named(P.metrics(P.curve(px, _ROTATION)), _ROTATION, ["n", "k", "h"])


@query(f"""WITH {_px_sql(inputs.LINES)}, {_curve_sql(_values(_ROTATION, ['n', 'k', 'h', 'cost']))}, m AS ({_metrics_sql('SELECT * FROM cv')}),
 hold AS (SELECT symbol, last(close ORDER BY j) / first(close ORDER BY j) AS final FROM px WHERE close IS NOT NULL GROUP BY 1), best AS (SELECT max(final) AS single, avg(final) AS equal FROM hold)
 SELECT count(*) AS cells, count(*) FILTER (final > equal) AS beat_equal, count(*) FILTER (final > single) AS beat_best, CASE WHEN count(*) FILTER (final > equal) >= 0.6 * count(*) THEN 'broad' WHEN count(*) FILTER (final > equal) < 0.25 * count(*) THEN 'none' ELSE 'mixed' END AS verdict FROM m, best""")
def momentum_verdict(spark, sf):
    """How many cells of the rotation end above holding all names, and above the best one."""
    px = P.panel(inputs.lines(spark, sf))
    final = P.metrics(P.curve(px, _ROTATION)).select(F.round("final", 6).alias("final"))
    hold = px.where("close is not null").groupBy("symbol").agg((F.max_by("close", "j") / F.min_by("close", "j")).alias("final")).agg(F.max("final").alias("single"), F.avg("final").alias("equal"))
    got = final.join(F.broadcast(hold)).agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("final") > F.col("equal")).alias("beat_equal"), F.count_if(F.col("final") > F.col("single")).alias("beat_best"))  # one row
    share = F.col("beat_equal") / F.col("cells")
    return got.withColumn("verdict", F.when(share >= 0.6, "broad").when(share < 0.25, "none").otherwise("mixed"))


def _ragged(spark, sf):
    """The panel with two names that stop."""
    last = F.when(F.col("symbol") == "line2", F.lit("1998-01-15")).when(F.col("symbol") == "line5", F.lit("1999-07-02")).cast("date")
    return inputs.lines(spark, sf).where(F.coalesce(F.col("d") <= last, F.lit(True)))


_RAGGED = f"SELECT * FROM ({inputs.LINES}) WHERE d <= CASE symbol WHEN 'line2' THEN DATE '1998-01-15' WHEN 'line5' THEN DATE '1999-07-02' ELSE DATE '9999-01-01' END"
_LOSSES = _grid(loss=[0.0, 0.5, 1.0], n=[30], k=[2], h=[7], cost=[COST])


@query(f"WITH {_px_sql(_RAGGED)}, {_curve_sql(_values(_LOSSES, ['loss', 'n', 'k', 'h', 'cost']), 'loss')} SELECT loss, m.* EXCLUDE (cell) FROM ({_metrics_sql('SELECT * FROM cv')}) AS m JOIN {_values(_LOSSES, ['loss', 'n', 'k', 'h', 'cost'])} USING (cell)")
def survivorship_equity(spark, sf):
    """Rotation with a name that is delisted, at several losses."""
    return _named(P.metrics(P.curve(P.panel(_ragged(spark, sf)), _LOSSES)), _LOSSES, ["loss"])


_SIZES = _grid(k=[1, 2, 3], n=[30], h=[7], cost=[COST])


@query(f"""WITH {_px_sql(_RAGGED)}, {_curve_sql(_values(_SIZES, ['k', 'n', 'h', 'cost']))} SELECT pk.k, a.d, pk.symbol, b.d AS last_day FROM pk JOIN dd AS a ON a.j = pk.i JOIN dd AS b ON b.j = pk.last_j
 WHERE pk.last_j < pk.end_j AND NOT EXISTS (SELECT 1 FROM pk AS q WHERE q.cell = pk.cell AND q.symbol = pk.symbol AND q.i = pk.i - pk.h)""")
def doomed_entries(spark, sf):
    """Days on which the rotation buys a name that later stops."""
    px = P.panel(_ragged(spark, sf))
    day = px.select("j", "d").distinct()
    got = P.doomed(px, _SIZES).join(day.withColumnRenamed("j", "i"), "i").join(day.select(F.col("j").alias("last_j"), F.col("d").alias("last_day")), "last_j")
    return got.select((F.col("cell") + 1).alias("k"), "d", "symbol", "last_day")


_TARGETS = _grid(target=[0.2, 0.3, 0.5], lookback=[7, 10, 14], most=[1.0, 1.5], cost=[COST], lend=[0.04], borrow=[0.08])
_ONE = _grid(n=[30], k=[2], h=[7], cost=[COST])
_TARGET_KEYS = ["target", "lookback", "most", "cost", "lend", "borrow"]


@query(f"""WITH {_px_sql(inputs.LINES)}, {_curve_sql(_values(_ONE, ['n', 'k', 'h', 'cost']))}, e0 AS (SELECT t.*, cv.* EXCLUDE (cell, equity) FROM cv, {_values(_TARGETS, _TARGET_KEYS)} AS t),
 e1 AS (SELECT *, count(ret) OVER w AS m, row_number() OVER (PARTITION BY cell ORDER BY j) AS nth, list(ret) OVER w AS past FROM e0 WINDOW w AS (PARTITION BY cell ORDER BY j ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
 e2 AS (SELECT *, CASE WHEN m >= lookback THEN list_aggregate(past[-lookback:], 'stddev_samp') * sqrt(365::DOUBLE) END AS known FROM e1),
 e3 AS (SELECT *, CASE WHEN known > 0 THEN least(target / known, most) WHEN known = 0 THEN most ELSE 0 END AS exposure FROM e2),
 e4 AS (SELECT *, ret * exposure + greatest(1 - exposure, 0) * lend / 365 - greatest(exposure - 1, 0) * borrow / 365 - (turnover * exposure + coalesce(abs(exposure - lag(exposure) OVER (PARTITION BY cell ORDER BY j)), 0)) * cost AS day FROM e3),
 e5 AS (SELECT cell, j, d, exposure, product(1 + day) OVER (PARTITION BY cell ORDER BY j) AS equity FROM e4)
 SELECT target, lookback, most, m.* EXCLUDE (cell, days, avg_exposure), round(avg_exposure, 6) AS avg_exposure FROM ({_metrics_sql('SELECT * FROM e5', ', avg(exposure) AS avg_exposure', ', avg_exposure')}) AS m JOIN {_values(_TARGETS, _TARGET_KEYS)} USING (cell)""")
def vol_target(spark, sf):
    """Volatility targeting over the rotation, by target, window and largest exposure."""
    base = P.curve(P.panel(inputs.lines(spark, sf)), _ONE)
    return _named(P.metrics(P.vol_target(base, _TARGETS), F.avg("exposure").alias("avg_exposure")), _TARGETS, ["target", "lookback", "most"], ("avg_exposure",))


_BREAKS = _grid(v=[5, 7], m=[1.5, 2.0, 2.5], dd=[0.1, 0.2, 0.3], recover=[0, 3, 14], n=[30], k=[2], h=[7], cost=[COST])
_BREAK_KEYS = ["v", "m", "dd", "recover", "n", "k", "h", "cost"]


@query(f"""WITH {_px_sql(inputs.LINES)}, mk AS (SELECT j, close, close / lag(close) OVER (ORDER BY j) - 1 AS r FROM px WHERE symbol = 'line1' AND close IS NOT NULL),
 sd AS (SELECT j, list(r) OVER (ORDER BY j ROWS 11 PRECEDING) AS past, count(r) OVER (ORDER BY j ROWS 11 PRECEDING) AS c12, stddev_samp(r) OVER (ORDER BY j ROWS 11 PRECEDING) AS s12, count(r) OVER (ORDER BY j ROWS 4 PRECEDING) AS c5, stddev_samp(r) OVER (ORDER BY j ROWS 4 PRECEDING) AS s5,
  count(r) OVER (ORDER BY j ROWS 6 PRECEDING) AS c7, stddev_samp(r) OVER (ORDER BY j ROWS 6 PRECEDING) AS s7, count(*) OVER (ORDER BY j ROWS 9 PRECEDING) AS c10, close / max(close) OVER (ORDER BY j ROWS 9 PRECEDING) - 1 AS below FROM mk),
 up AS (SELECT c.cell, j, coalesce(CASE WHEN v = 5 AND c5 = 5 THEN s5 WHEN v = 7 AND c7 = 7 THEN s7 END > m * CASE WHEN c12 = 12 THEN s12 END, FALSE) OR coalesce(CASE WHEN c10 = 10 THEN below END < -dd, FALSE) AS up FROM sd, {_values(_BREAKS, _BREAK_KEYS)} AS c),
 flags AS (SELECT cell, j, lag(up, 1, FALSE) OVER (PARTITION BY cell ORDER BY j) AS flag FROM up), {_curve_sql(_values(_BREAKS, _BREAK_KEYS), 'NULL', True)}
 SELECT v, m, dd, recover, mm.* EXCLUDE (cell, days), (SELECT round(avg(flag::INT), 6) FROM flags WHERE flags.cell = mm.cell AND j >= 5) AS defensive FROM ({_metrics_sql('SELECT * FROM cv')}) AS mm JOIN {_values(_BREAKS, _BREAK_KEYS)} USING (cell)""")
def breaker_overlay(spark, sf):
    """The rotation with a defensive breaker."""
    px = P.panel(inputs.lines(spark, sf))
    flags = P.breaker_flags(px, "line1", _BREAKS, 10, 12)
    share = flags.where("j >= 5").groupBy("cell").agg(F.avg(F.col("flag").cast("int")).alias("defensive"))
    return _named(P.metrics(P.curve(px, _BREAKS, flags)).join(share, "cell"), _BREAKS, ["v", "m", "dd", "recover"], ("defensive",))
