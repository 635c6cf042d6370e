"""Signal against base rate: flows, levels, eras, overlaps, elasticities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import corridors, frames, signals
from . import inputs
from .registry import query

WINDOWS, HORIZONS, LEVELS = (7, 14, 30), (7, 14, 21, 30), (0.05, 0.10, 0.15)

_SWEEP = f"""f AS ({inputs.FLOWS}), px AS ({inputs.PRICE}),
 s AS (SELECT d, 7 AS n, sum(flow) OVER (ORDER BY d ROWS 6 PRECEDING) AS val FROM f
  UNION ALL SELECT d, 14, sum(flow) OVER (ORDER BY d ROWS 13 PRECEDING) FROM f
  UNION ALL SELECT d, 30, sum(flow) OVER (ORDER BY d ROWS 29 PRECEDING) FROM f),
 c AS (SELECT *, lag(val) OVER (PARTITION BY n ORDER BY d) AS prev FROM s),
 fires AS (SELECT d, n FROM c WHERE prev <= 0 AND val > 0),
 g AS (SELECT h, t FROM (VALUES (7),(14),(21),(30)) a(h), (VALUES (0.05::DOUBLE),(0.10::DOUBLE),(0.15::DOUBLE)) b(t)),
 ev AS (SELECT fires.n, g.h, g.t, px.close, (SELECT max(q.close) FROM px q WHERE q.d > px.d AND q.d <= px.d + g.h) AS px_max
  FROM fires JOIN px USING (d) CROSS JOIN g),
 sweep AS (SELECT n, h, t, count(*) AS n_obs, count(*) FILTER (WHERE px_max / close - 1 >= t) AS hits,
  round(count(*) FILTER (WHERE px_max / close - 1 >= t) / count(*), 6) AS rate FROM ev WHERE px_max IS NOT NULL GROUP BY ALL)"""

_BASE = """span AS (SELECT min(d) AS lo, max(d) AS hi FROM f), cl AS (SELECT px.* FROM px, span WHERE px.d BETWEEN lo AND hi),
 bv AS (SELECT g.h, g.t, cl.close, (SELECT max(q.close) FROM cl q WHERE q.d > cl.d AND q.d <= cl.d + g.h) AS px_max FROM cl CROSS JOIN g),
 base AS (SELECT h, t, count(*) AS n_obs, count(*) FILTER (WHERE px_max / close - 1 >= t) AS hits,
  round(count(*) FILTER (WHERE px_max / close - 1 >= t) / count(*), 6) AS rate FROM bv WHERE px_max IS NOT NULL GROUP BY ALL)"""


def _sweep(spark, sf):
    ahead = signals.forward_extremes(inputs.price(spark, sf), HORIZONS)
    fires = signals.rolling_crossings(inputs.flows(spark, sf), WINDOWS).select("d", "n")
    return signals.hit_rates(signals.grid(fires.join(ahead, "d"), t=LEVELS), ["n", "h", "t"], signals.rise())


def _base(spark, sf):
    span = inputs.flows(spark, sf).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    clipped = inputs.price(spark, sf).join(F.broadcast(span), F.col("d").between(F.col("lo"), F.col("hi"))).select("d", "close")  # one row
    return signals.hit_rates(signals.grid(signals.forward_extremes(clipped, HORIZONS), t=LEVELS), ["h", "t"], signals.rise())


@query(f"WITH {_SWEEP} SELECT * FROM sweep")
def flow_crossover_sweep(spark, sf):
    """Rolling flow turns positive: share of cases with a rise of t within h days."""
    return _sweep(spark, sf)


@query(f"WITH {_SWEEP}, {_BASE} SELECT * FROM base")
def flow_base_rate(spark, sf):
    """The same share over all days of the flows' span."""
    return _base(spark, sf)


@query(f"""WITH {_SWEEP}, {_BASE} SELECT n, h, t, s.n_obs, s.rate, b.rate AS base_rate, round(100 * (s.rate - b.rate), 4) AS edge_pp
 FROM sweep s JOIN base b USING (h, t)""")
def flow_edge_table(spark, sf):
    """Signal against base rate in percentage points."""
    base = _base(spark, sf).select("h", "t", F.col("rate").alias("base_rate"))
    return _sweep(spark, sf).join(base, ["h", "t"]).select("n", "h", "t", "n_obs", "rate", "base_rate", F.round(100 * (F.col("rate") - F.col("base_rate")), 4).alias("edge_pp"))


@query(f"""WITH {_SWEEP}, v AS (SELECT px.d, round(c.val / 1e6, 4) AS flow_m,
  (SELECT max(q.close) FROM px q WHERE q.d > px.d AND q.d <= px.d + 14) / px.close - 1 AS gain,
  (SELECT min(q.close) FROM px q WHERE q.d > px.d AND q.d <= px.d + 14) / px.close - 1 AS draw
  FROM c JOIN px USING (d) WHERE c.n = 7 AND prev <= 0 AND val > 0)
 SELECT d, flow_m, round(gain, 6) AS gain_14d, round(draw, 6) AS draw_14d,
  CASE WHEN gain IS NULL THEN 'OPEN' WHEN gain >= 0.05 THEN 'HIT' ELSE 'FALSE POSITIVE' END AS verdict FROM v""")
def flow_verdicts(spark, sf):
    """Every crossing of the 7-row flow with what the next 14 days brought."""
    ahead = signals.forward_extremes(inputs.price(spark, sf), (14,))
    gain, draw = F.col("px_max") / F.col("close") - 1, F.col("px_min") / F.col("close") - 1
    fires = signals.rolling_crossings(inputs.flows(spark, sf), (7,))
    verdict = F.when(gain.isNull(), "OPEN").when(gain >= 0.05, "HIT").otherwise("FALSE POSITIVE")
    return fires.join(ahead, "d").select("d", F.round(F.col("val") / 1e6, 4).alias("flow_m"), F.round(gain, 6).alias("gain_14d"), F.round(draw, 6).alias("draw_14d"), verdict.alias("verdict"))


_LEVEL = "SELECT event_type AS symbol, ts::DATE AS d, avg(value) AS level FROM events GROUP BY 1, 2"


def _levels(spark, sf):
    return inputs.ticks(spark, sf).groupBy("symbol", F.to_date("ts").alias("d")).agg(F.avg("close").alias("level"))


_DROP = f"""l AS ({_LEVEL}), px AS ({inputs.DAILY}),
 m AS (SELECT *, 3 AS n, avg(level) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean FROM l
  UNION ALL SELECT *, 7, avg(level) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) FROM l),
 fires AS (SELECT symbol, d, n FROM m WHERE level <= mean - 5),
 g AS (SELECT h, t FROM (VALUES (3),(7)) a(h), (VALUES (0.05::DOUBLE),(0.10::DOUBLE)) b(t)),
 w AS (SELECT px.*, g.h, g.t, (SELECT min(q.close) FROM px q WHERE q.symbol = px.symbol AND q.d > px.d AND q.d <= px.d + g.h) AS px_min FROM px CROSS JOIN g)"""


def _ahead(spark, sf):
    return signals.grid(signals.forward_extremes(inputs.daily_close(spark, sf), (3, 7), ["symbol"]), t=(0.05, 0.10))


@query(f"""WITH {_DROP} SELECT n, h, t, count(*) AS n_obs, count(*) FILTER (WHERE px_min / close - 1 <= -t) AS hits,
 round(count(*) FILTER (WHERE px_min / close - 1 <= -t) / count(*), 6) AS rate FROM fires JOIN w USING (symbol, d) WHERE px_min IS NOT NULL GROUP BY ALL""")
def trailing_mean_drop(spark, sf):
    """A level 5 below its trailing mean: share of falls of t within h days."""
    fires = signals.trailing_drop(_levels(spark, sf), (3, 7), ["symbol"], 5).select("symbol", "d", "n")
    return signals.hit_rates(fires.join(_ahead(spark, sf), ["symbol", "d"]), ["n", "h", "t"], signals.fall())


@query(f"""WITH l AS ({_LEVEL}), k AS (SELECT *, lag(level) OVER w AS a, lag(level, 2) OVER w AS b FROM l WINDOW w AS (PARTITION BY symbol ORDER BY d))
 SELECT symbol, d, round(level, 6) AS level FROM k WHERE level < 50 AND a < 50 AND b < 50""")
def level_persistence(spark, sf):
    """Days on which a level is under 50 for the third observed day running."""
    return signals.persistent(_levels(spark, sf), ["symbol"], 50).select("symbol", "d", F.round("level", 6).alias("level"))


_ERA = "CASE WHEN d < DATE '2024-01-11' THEN 'early' WHEN d < DATE '2024-01-21' THEN 'middle' ELSE 'late' END"


def _era():
    return F.when(F.col("d") < F.lit("2024-01-11").cast("date"), "early").when(F.col("d") < F.lit("2024-01-21").cast("date"), "middle").otherwise("late")


@query(f"""WITH {_DROP} SELECT {_ERA} AS era, h, t, count(*) AS n_obs, count(*) FILTER (WHERE px_min / close - 1 <= -t) AS hits,
 round(count(*) FILTER (WHERE px_min / close - 1 <= -t) / count(*), 6) AS rate FROM w WHERE px_min IS NOT NULL GROUP BY ALL""")
def drawdown_by_era(spark, sf):
    """Base rate of falls by era, horizon and level."""
    return signals.hit_rates(_ahead(spark, sf).withColumn("era", _era()), ["era", "h", "t"], signals.fall())


@query(f"""WITH {_DROP}, sig AS (SELECT {_ERA} AS era, n, h, t, count(*) AS n_obs, count(*) FILTER (WHERE px_min / close - 1 <= -t) AS hits
  FROM fires JOIN w USING (symbol, d) WHERE px_min IS NOT NULL GROUP BY ALL),
 base AS (SELECT {_ERA} AS era, h, t, count(*) FILTER (WHERE px_min / close - 1 <= -t) / count(*) AS p FROM w WHERE px_min IS NOT NULL GROUP BY ALL)
 SELECT era, n, h, t, n_obs, hits, round(100 * (hits / n_obs - p), 4) AS edge_pp,
  CASE WHEN p > 0 AND p < 1 THEN round((hits - n_obs * p) / sqrt(n_obs * p * (1 - p)), 6) END AS z FROM sig JOIN base USING (era, h, t)""")
def era_edge(spark, sf):
    """Edge over the era's own base rate, with its binomial z."""
    ahead = _ahead(spark, sf).withColumn("era", _era())
    fires = signals.trailing_drop(_levels(spark, sf), (3, 7), ["symbol"], 5).select("symbol", "d", "n")
    sig = signals.hit_rates(fires.join(ahead, ["symbol", "d"]), ["era", "n", "h", "t"], signals.fall())
    base = signals.hit_rates(ahead, ["era", "h", "t"], signals.fall()).select("era", "h", "t", (F.col("hits") / F.col("n_obs")).alias("p"))
    z = F.when((F.col("p") > 0) & (F.col("p") < 1), F.round(signals.binomial_z(F.col("hits"), F.col("n_obs"), F.col("p")), 6))
    return sig.join(base, ["era", "h", "t"]).select("era", "n", "h", "t", "n_obs", "hits", F.round(100 * (F.col("hits") / F.col("n_obs") - F.col("p")), 4).alias("edge_pp"), z.alias("z"))


@query(f"""WITH {_DROP}, a AS (SELECT DISTINCT d FROM fires WHERE symbol = 'click'), b AS (SELECT DISTINCT d FROM fires WHERE symbol = 'view')
 SELECT count(*) AS fires, count(*) FILTER (WHERE d IN (SELECT d FROM b)) AS same_day,
  count(*) FILTER (WHERE EXISTS (SELECT 1 FROM b WHERE b.d BETWEEN a.d - 2 AND a.d + 2)) AS within_band FROM a""")
def fire_overlap_band(spark, sf):
    """How many of one symbol's fires another shares, on the day and within two days."""
    fires = signals.trailing_drop(_levels(spark, sf), (3, 7), ["symbol"], 5)
    return signals.overlap(fires.where("symbol = 'click'"), fires.where("symbol = 'view'"), 2)


_HOUR = f"""h AS ({inputs.HOURLY}), k AS (SELECT symbol, timestamp, close, volume, 100 * (close / nullif(lag(close) OVER w, 0) - 1) AS px_pct,
  100.0 * (volume - lag(volume) OVER w) / nullif(lag(volume) OVER w, 0) AS oi_pct FROM h WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
 b AS (SELECT *, CASE WHEN px_pct <= -50 THEN 'sharp down' WHEN px_pct < 0 THEN 'down' WHEN px_pct < 50 THEN 'up' ELSE 'sharp up' END AS bucket
  FROM k WHERE px_pct IS NOT NULL)"""


def _hours(spark, sf):
    w = frames.series(["symbol"], ["timestamp"])
    prev = F.lag("volume").over(w)
    k = inputs.hourly(spark, sf).select(
        "symbol", "timestamp", "close", "volume", (100 * (F.try_divide("close", F.lag("close").over(w)) - 1)).alias("px_pct"), F.try_divide(100.0 * (F.col("volume") - prev), prev).alias("oi_pct")
    )
    bucket = F.when(F.col("px_pct") <= -50, "sharp down").when(F.col("px_pct") < 0, "down").when(F.col("px_pct") < 50, "up").otherwise("sharp up")
    return k.where("px_pct is not null").withColumn("bucket", bucket)


@query(f"""WITH {_HOUR} SELECT bucket, count(*) AS hours, round(avg(px_pct), 4) AS px_pct, round(avg(oi_pct), 4) AS oi_pct,
 round(avg(oi_pct) / nullif(avg(px_pct), 0), 4) AS elasticity FROM b GROUP BY 1""")
def hourly_elasticity(spark, sf):
    """Change of open volume for each percent of price, by size of the hour's move."""
    px, oi = F.avg("px_pct"), F.avg("oi_pct")
    return _hours(spark, sf).groupBy("bucket").agg(F.count(F.lit(1)).alias("hours"), F.round(px, 4).alias("px_pct"), F.round(oi, 4).alias("oi_pct"), F.round(F.try_divide(oi, px), 4).alias("elasticity"))


@query(f"WITH {_HOUR} SELECT symbol, timestamp, round(px_pct, 4) AS px_pct FROM b ORDER BY abs(b.px_pct) DESC, symbol, timestamp LIMIT 12")
def extreme_hours(spark, sf):
    """The twelve hours with the largest moves."""
    return _hours(spark, sf).orderBy(F.abs("px_pct").desc(), "symbol", "timestamp").limit(12).select("symbol", "timestamp", F.round("px_pct", 4).alias("px_pct"))


@query(f"""WITH {_HOUR}, p AS (SELECT l_returnflag AS side, l_linenumber AS pct, avg(l_extendedprice) AS depth, count(*) AS n, stddev(l_extendedprice) AS spread
  FROM lineitem GROUP BY 1, 2)
 SELECT side, pct, n, round(depth / 1e6, 6) AS depth_m, round(spread / 1e6, 6) AS spread_m, round(100 * depth / sum(depth) OVER (PARTITION BY side), 4) AS share FROM p""")
def depth_by_regime(spark, sf):
    """Mean depth by side and distance, with its share of the side."""
    p = inputs.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("side"), F.col("l_linenumber").alias("pct")).agg(
        F.avg("l_extendedprice").alias("depth"), F.count(F.lit(1)).alias("n"), F.stddev("l_extendedprice").alias("spread")
    )
    share = 100 * F.col("depth") / F.sum("depth").over(frames.Window.partitionBy("side"))
    return p.select("side", "pct", "n", F.round(F.col("depth") / 1e6, 6).alias("depth_m"), F.round(F.col("spread") / 1e6, 6).alias("spread_m"), F.round(share, 4).alias("share"))


@query(f"""WITH f AS ({inputs.FLOWS}), px AS ({inputs.PRICE}), o AS (SELECT o_orderdate::DATE AS d, sum(o_totalprice) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent,
  sum(o_totalprice) FILTER (WHERE o_orderpriority NOT LIKE '1%') AS other FROM orders GROUP BY 1)
 SELECT px.d, round(px.close, 4) AS close, round(100 * (px.close / lag(px.close) OVER (ORDER BY px.d) - 1), 4) AS ret_pct, round(f.flow / 1e6, 4) AS flow_m,
  round(sum(f.flow) OVER (ORDER BY px.d ROWS 4 PRECEDING) / 1e6, 4) AS flow5_m, round(o.urgent, 2) AS urgent, round(o.other, 2) AS other
 FROM px LEFT JOIN f USING (d) LEFT JOIN o USING (d)""")
def lead_lag_daily(spark, sf):
    """Price, flow and split order value side by side for each day with a price."""
    w = frames.series([], ["d"])
    urgent = F.col("o_orderpriority").like("1%")
    o = inputs.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum(F.when(urgent, F.col("o_totalprice"))).alias("urgent"), F.sum(F.when(~urgent, F.col("o_totalprice"))).alias("other"))
    both = inputs.price(spark, sf).join(inputs.flows(spark, sf), "d", "left").join(o, "d", "left")
    return both.select(
        "d", F.round("close", 4).alias("close"), F.round(100 * frames.simple_return(F.col("close"), w), 4).alias("ret_pct"), F.round(F.col("flow") / 1e6, 4).alias("flow_m"),
        F.round(frames.rolling(F.col("flow"), 5, w) / 1e6, 4).alias("flow5_m"), F.round("urgent", 2).alias("urgent"), F.round("other", 2).alias("other"),
    )


def _ratio(spark, sf):
    """symbol, d, close, ratio of purchases to the rest, and its mean over 3 observed days."""
    t = inputs.ticks(spark, sf)
    day = t.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.sum(F.when(F.col("user_id") % 2 == 0, F.col("close"))).alias("buy"), F.sum("close").alias("vol"), F.max_by("close", F.struct("ts", "event_id")).alias("close"))
    ratio = F.when(F.col("vol") - F.col("buy") > 0, F.try_divide(F.col("buy"), F.col("vol") - F.col("buy")))
    return day.withColumn("ratio", ratio).withColumn("ma", frames.rolling_full(F.col("ratio"), 3, frames.series(["symbol"], ["d"]), F.avg))


_RATIO = """t0 AS (SELECT event_type AS symbol, ts::DATE AS d, sum(value) FILTER (user_id % 2 = 0) AS buy, sum(value) AS vol, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2),
 r0 AS (SELECT *, CASE WHEN vol - buy > 0 THEN buy / (vol - buy) END AS ratio FROM t0)"""
_LATE = "CASE WHEN d < DATE '2024-01-11' THEN 'early' WHEN d < DATE '2024-01-21' THEN 'middle' ELSE 'late' END"


def _ratio_events(windows, levels):
    """Entries of the mean ratio below each level, de-clustered by five days, in SQL."""
    means = " UNION ALL ".join(f"SELECT symbol, d, {n} AS n, CASE WHEN count(ratio) OVER (PARTITION BY symbol ORDER BY d ROWS {n - 1} PRECEDING) = {n} THEN avg(ratio) OVER (PARTITION BY symbol ORDER BY d ROWS {n - 1} PRECEDING) END AS ma FROM r0" for n in windows)
    return f"""m AS ({means}), b AS (SELECT m.*, lv.level, coalesce(ma < lv.level, FALSE) AS below FROM m, (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in levels)}]) AS level) AS lv),
 en AS (SELECT symbol, n, level, d FROM (SELECT *, lag(below, 1, FALSE) OVER (PARTITION BY symbol, n, level ORDER BY d) AS was FROM b) WHERE below AND NOT was),
 ev AS (SELECT symbol, n, level, min(d) AS d FROM en GROUP BY ALL UNION ALL SELECT symbol, n, level, d FROM (SELECT en.*, row_number() OVER (PARTITION BY en.symbol, en.n, en.level ORDER BY en.d) AS k
  FROM ev JOIN en ON en.symbol = ev.symbol AND en.n = ev.n AND en.level = ev.level AND en.d >= ev.d + 5) WHERE k = 1)"""


@query(f"WITH RECURSIVE {_RATIO}, {_ratio_events((3,), (0.95,))} SELECT symbol, d, round(ma, 6) AS ma FROM ev JOIN m USING (symbol, n, d)")
def ratio_crossings_refractory(spark, sf):
    """Entries of the mean ratio below 0.95, at least 5 days apart within a symbol."""
    r = _ratio(spark, sf)
    events = r.withColumn("enter", frames.enters(F.col("ma") < 0.95, frames.series(["symbol"], ["d"]))).where("enter")
    return frames.refractory(events, ["symbol"], "d", 5).join(r, ["symbol", "d"]).select("symbol", "d", F.round("ma", 6).alias("ma"))


_FULL = "SELECT symbol, d, close, {h} AS h, CASE WHEN count(*) OVER f = {h} THEN min(close) OVER f END AS px_min, CASE WHEN count(*) OVER f = {h} THEN max(close) OVER f END AS px_max FROM r0 WINDOW f AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
_EDGES = ", ".join(
    f"sum({c}) AS {c}_hits, round(sum(p_{c}), 6) AS {c}_expected, round(100 * (sum({c}) / count(*) - sum(p_{c}) / count(*)), 4) AS {c}_edge_pp, "
    f"round(CASE WHEN sum(p_{c}) > 0 AND sum(p_{c}) < count(*) THEN (sum({c}) - sum(p_{c})) / sqrt(sum(p_{c}) * (1 - sum(p_{c}) / count(*))) END, 6) AS {c}_z"
    for c in ("fell", "rose")
)
_JUDGED = "SELECT *, (px_min / close - 1 <= -{m})::INT AS fell, (px_max / close - 1 >= {m})::INT AS rose FROM ({rows}) WHERE px_min IS NOT NULL"


@query(f"""WITH RECURSIVE {_RATIO}, {_ratio_events((3,), (0.95,))}, o AS (SELECT *, {_LATE} AS era FROM ({_JUDGED.format(m=0.5, rows=_FULL.format(h=5))})), p AS (SELECT era, avg(fell) AS p FROM o GROUP BY 1)
 SELECT era, count(*) AS n_obs, sum(fell) AS hits, round(count(*) * p, 6) AS expected, round(100 * (sum(fell) / count(*) - p), 4) AS edge_pp, round(CASE WHEN p > 0 AND p < 1 THEN (sum(fell) - count(*) * p) / sqrt(count(*) * p * (1 - p)) END, 6) AS z
 FROM ev JOIN o USING (symbol, d) JOIN p USING (era) GROUP BY era, p""")
def era_matched_binomial(spark, sf):
    """Hits of those entries against what their eras' base rates lead one to expect."""
    r = _ratio(spark, sf)
    w = frames.series(["symbol"], ["d"])
    out = r.withColumn("low", frames.forward_full(F.col("close"), 5, w, F.min)).withColumn("era", _era()).where("low is not null").withColumn("hit", (F.col("low") / F.col("close") - 1 <= -0.5).cast("int"))
    base = out.groupBy("era").agg(F.avg("hit").alias("p"))
    events = r.withColumn("enter", frames.enters(F.col("ma") < 0.95, w)).where("enter")
    cells = frames.refractory(events, ["symbol"], "d", 5).join(out, ["symbol", "d"]).join(base, "era").groupBy("era").agg(F.count(F.lit(1)).alias("n_obs"), F.sum("hit").alias("hits"), F.first("p").alias("p"))
    z = F.when((F.col("p") > 0) & (F.col("p") < 1), F.round(signals.binomial_z(F.col("hits"), F.col("n_obs"), F.col("p")), 6))
    return cells.select("era", "n_obs", "hits", F.round(F.col("n_obs") * F.col("p"), 6).alias("expected"), F.round(100 * (F.col("hits") / F.col("n_obs") - F.col("p")), 4).alias("edge_pp"), z.alias("z"))


_MEANS, _BELOW, _AHEAD = (2, 3, 5, 7), (0.90, 0.95, 1.00), (3, 5)


@query(f"""WITH RECURSIVE {_RATIO}, {_ratio_events(_MEANS, _BELOW)}, o AS (SELECT *, {_LATE} AS era FROM ({_JUDGED.format(m=0.5, rows=" UNION ALL ".join(f"({_FULL.format(h=h)})" for h in _AHEAD))})),
 p AS (SELECT symbol, era, h, avg(fell) AS p_fell, avg(rose) AS p_rose FROM o GROUP BY ALL)
 SELECT symbol, n, level, h, count(*) AS n_obs, {_EDGES} FROM ev JOIN o USING (symbol, d) JOIN p USING (symbol, era, h) GROUP BY ALL""")
def ratio_grid(spark, sf):
    """Entries of the mean ratio below a level, for every symbol, mean, level and horizon: falls and rises against their eras' rates."""
    r, w = _ratio(spark, sf), frames.series(["symbol"], ["d"])
    means = F.array(*(F.struct(F.lit(n).alias("n"), frames.rolling_full(F.col("ratio"), n, w, F.avg).alias("mean")) for n in _MEANS))
    rows = signals.grid(r.select("symbol", "d", means.alias("m")).select("symbol", "d", F.explode("m").alias("m")).select("symbol", "d", "m.*"), level=_BELOW)
    cell = ["symbol", "n", "level"]
    entered = rows.withColumn("enter", frames.enters(F.col("mean") < F.col("level"), frames.series(cell, ["d"]))).where("enter")
    full = F.array(*(F.struct(F.lit(h).alias("h"), frames.forward_full(F.col("close"), h, w, F.min).alias("px_min"), frames.forward_full(F.col("close"), h, w).alias("px_max")) for h in _AHEAD))
    ahead = r.select("symbol", "d", "close", full.alias("f")).select("symbol", "d", "close", F.explode("f").alias("f")).select("symbol", "d", "close", "f.*").where("px_min is not null")
    ahead = signals.judged(ahead, 0.5).withColumn("era", _era())
    return signals.era_matched(frames.refractory(entered, cell, "d", 5), ahead, ahead, ["symbol", "d"], [*cell, "h"], ["symbol", "era", "h"])


_SUMS, _TAILS, _AFTER, _FALL = (3, 5, 10), (0.05, 0.10, 0.20), (7, 14, 30), 0.05


def _year_era():
    return F.when(F.col("d") < F.lit("1998-01-01").cast("date"), "first").otherwise("second")


_OUTFLOW = f"""f AS ({inputs.FLOWS}), px AS ({inputs.PRICE}), s AS ({" UNION ALL ".join(f"SELECT d, {n} AS n, CASE WHEN count(*) OVER (ORDER BY d ROWS {n - 1} PRECEDING) = {n} THEN sum(flow) OVER (ORDER BY d ROWS {n - 1} PRECEDING) END AS s FROM f" for n in _SUMS)}),
 q AS ({" UNION ALL ".join(f"SELECT d, n, {q}::DOUBLE AS q, s, CASE WHEN count(s) OVER w >= 60 THEN quantile_cont(s, {q}::DOUBLE) OVER w END AS thr FROM s WINDOW w AS (PARTITION BY n ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for q in _TAILS)}),
 en AS (SELECT n, q, d FROM (SELECT *, lag(below, 1, FALSE) OVER (PARTITION BY n, q ORDER BY d) AS was FROM (SELECT *, coalesce(s < thr, FALSE) AS below FROM q)) WHERE below AND NOT was),
 ev AS (SELECT n, q, min(d) AS d FROM en GROUP BY ALL UNION ALL SELECT n, q, d FROM (SELECT en.*, row_number() OVER (PARTITION BY en.n, en.q ORDER BY en.d) AS k FROM ev JOIN en ON en.n = ev.n AND en.q = ev.q AND en.d >= ev.d + 14) WHERE k = 1),
 fr AS (SELECT n, q, min(d) AS since FROM q WHERE thr IS NOT NULL GROUP BY ALL), hs AS (SELECT unnest({list(_AFTER)}) AS h),
 o AS (SELECT px.d AS entry, hs.h, close, (SELECT min(b.close) FROM px AS b WHERE b.d > px.d AND b.d <= px.d + hs.h) AS px_min, (SELECT max(b.close) FROM px AS b WHERE b.d > px.d AND b.d <= px.d + hs.h) AS px_max FROM px, hs WHERE px.d + hs.h <= (SELECT max(d) FROM px)),
 j AS ({_JUDGED.format(m=_FALL, rows="SELECT * FROM o")}), p AS (SELECT n, q, h, CASE WHEN entry < DATE '1998-01-01' THEN 'first' ELSE 'second' END AS era, avg(fell) AS p_fell, avg(rose) AS p_rose FROM j, fr WHERE entry >= since GROUP BY ALL),
 ee AS (SELECT *, CASE WHEN d < DATE '1998-01-01' THEN 'first' ELSE 'second' END AS era, (SELECT min(px.d) FROM px WHERE px.d >= ev.d + 1) AS entry FROM ev)"""


@query(f"WITH RECURSIVE {_OUTFLOW} SELECT n, q, h, count(*) AS n_obs, {_EDGES} FROM ee JOIN j USING (entry) JOIN p USING (n, q, h, era) GROUP BY ALL")
def outflow_grid(spark, sf):
    """Rolling flows under a percentile of their own past, entered on the next day with a price: falls and rises against their eras' rates, over a grid."""
    flow, px, w = inputs.flows(spark, sf), inputs.price(spark, sf), frames.series([], ["d"])
    sums = F.array(*(F.struct(F.lit(n).alias("n"), frames.rolling_full(F.col("flow"), n, w).alias("s")) for n in _SUMS))
    rows = flow.select("d", (F.row_number().over(w) - 1).alias("i"), sums.alias("s")).select("d", "i", F.explode("s").alias("s")).select("d", "i", "s.n", "s.s")
    rows = corridors.past_quantiles(rows.withColumn("symbol", F.col("n").cast("string")), {"thr": F.col("s")}, 1, _TAILS, 60)
    rows = rows.select("d", "n", "s", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col("thr")[j].alias("thr")) for j, q in enumerate(_TAILS)))).alias("t")).select("d", "n", "s", "t.*")
    cell = ["n", "q"]
    entered = rows.withColumn("enter", frames.enters(F.col("s") < F.col("thr"), frames.series(cell, ["d"]))).where("enter")
    events = frames.refractory(entered, cell, "d", 14).withColumn("era", _year_era())
    # The first day with a price from the next day on: prices and events in one order, looked at from behind.
    days = px.select("d", F.col("d").alias("entry")).unionByName(events.select(F.date_add("d", 1).alias("d"), F.lit(None).cast("date").alias("entry"))).groupBy("d").agg(F.max("entry").alias("entry"))
    following = frames.series([], ["d"]).rowsBetween(0, Window.unboundedFollowing)
    days = days.select(F.date_sub("d", 1).alias("d"), F.first("entry", ignorenulls=True).over(following).alias("entry"))
    ahead = signals.forward_extremes(px, _AFTER).join(F.broadcast(px.agg(F.max("d").alias("end"))), F.expr("date_add(d, h) <= end")).where("px_min is not null")  # one row
    ahead = signals.judged(ahead, _FALL).withColumn("era", _year_era())
    since = rows.where("thr is not null").groupBy(*cell).agg(F.min("d").alias("since"))
    base = ahead.join(F.broadcast(since), F.col("d") >= F.col("since"))  # one row for each cell
    outcomes = ahead.select(F.col("d").alias("entry"), "h", "fell", "rose")
    return signals.era_matched(events.join(days, "d"), outcomes, base, ["entry"], [*cell, "h"], [*cell, "h", "era"])


@query(f"""WITH f AS ({inputs.FLOWS}), s AS (SELECT d, CASE WHEN count(*) OVER w5 = 5 THEN sum(flow) OVER w5 END AS s FROM f WINDOW w5 AS (ORDER BY d ROWS 4 PRECEDING)),
 q AS (SELECT d, s, CASE WHEN count(s) OVER p >= 60 THEN quantile_cont(s, 0.1) OVER p END AS thr FROM s
  WINDOW p AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 e AS (SELECT *, coalesce(s < thr, FALSE) AS below FROM q)
 SELECT d, round(s / 1e6, 4) AS flow5_m, round(thr / 1e6, 4) AS threshold_m FROM (SELECT *, coalesce(lag(below) OVER (ORDER BY d), FALSE) AS was FROM e) WHERE below AND NOT was""")
def expanding_threshold_events(spark, sf):
    """Days on which the 5-row flow falls under the tenth percentile of its own past."""
    w = frames.series([], ["d"])
    s = inputs.flows(spark, sf).select("d", frames.rolling_full(F.col("flow"), 5, w).alias("s"))
    q = s.withColumn("thr", frames.expanding_quantile(F.col("s"), 0.1, w, 60))
    return q.withColumn("enter", frames.enters(F.col("s") < F.col("thr"), w)).where("enter").select("d", F.round(F.col("s") / 1e6, 4).alias("flow5_m"), F.round(F.col("thr") / 1e6, 4).alias("threshold_m"))
