"""Order-book queries: lineitem rows as price levels, shipping days as snapshots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import book as B
from . import inputs
from .registry import query

WIDTH = 50.0
_LEVELS = """lv AS (SELECT date_trunc('month', l_shipdate)::DATE AS snap, CASE WHEN l_returnflag = 'A' THEN 'ask' ELSE 'bid' END AS side, l_extendedprice / l_quantity AS price, l_quantity AS qty FROM lineitem),
 g AS (SELECT snap, side, floor(price / 50.0 + 1e-9)::BIGINT AS k, sum(price * qty) AS usd, count(*) AS levels FROM lv GROUP BY ALL),
 mid AS (SELECT snap, quantile_cont(price, 0.5) AS mid FROM lv GROUP BY 1),
 dd AS (SELECT g.*, mid, 100 * CASE WHEN side = 'bid' THEN (mid - (k + 1) * 50.0) / mid ELSE (k * 50.0 - mid) / mid END AS dist FROM g JOIN mid USING (snap)),
 base AS (SELECT snap, side, quantile_cont(usd, 0.5) AS base FROM dd WHERE dist BETWEEN 0.05 AND 60 AND usd > 0 GROUP BY ALL HAVING count(*) >= 3)"""


def _levels(spark, sf):
    t = inputs.table(spark, sf, "lineitem")
    return t.select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("snap"), F.when(F.col("l_returnflag") == "A", "ask").otherwise("bid").alias("side"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"))


def _cells(spark, sf):
    lv = _levels(spark, sf)
    mids = lv.groupBy("snap").agg(F.percentile("price", 0.5).alias("mid"))
    return B.distances(B.grid(lv, WIDTH), mids, WIDTH)


@query(f"WITH {_LEVELS} SELECT snap, side, k, levels, round(usd, 4) AS usd FROM g")
def grid_buckets(spark, sf):
    """Value by month, side and price bucket."""
    return B.grid(_levels(spark, sf), WIDTH).select("snap", "side", "k", "levels", F.round("usd", 4).alias("usd"))


@query(f"WITH {_LEVELS} SELECT snap, side, k, round(usd, 4) AS usd, round(dist, 6) AS dist, round(base, 4) AS base FROM dd JOIN base USING (snap, side) WHERE dist BETWEEN 0.05 AND 60 AND usd >= 1.5 * base")
def wall_candidates(spark, sf):
    """Buckets of one and a half times the side's median and more, within 60 percent of the mid."""
    cells = _cells(spark, sf)
    band = cells.where(F.col("dist").between(0.05, 60) & (F.col("usd") > 0)).groupBy("snap", "side").agg(F.percentile("usd", 0.5).alias("base"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    wall = cells.join(band, ["snap", "side"]).where(F.col("dist").between(0.05, 60) & (F.col("usd") >= 1.5 * F.col("base")))
    return wall.select("snap", "side", "k", F.round("usd", 4).alias("usd"), F.round("dist", 6).alias("dist"), F.round("base", 4).alias("base"))


_WALLS = f"""{_LEVELS}, md AS (SELECT snap, side, quantile_cont(usd, 0.5) AS mb, min(k) AS least, max(k) AS most FROM g GROUP BY 1, 2),
 px AS (SELECT snap, quantile_cont(price, 0.1) AS lo, quantile_cont(price, 0.9) AS hi FROM lv GROUP BY 1),
 sn AS (SELECT snap, datediff('day', DATE '1990-01-01', snap) AS t, row_number() OVER (ORDER BY snap) AS i, coalesce(datediff('day', lag(snap) OVER (ORDER BY snap), snap) > 93, FALSE) AS hole FROM px),
 wk AS (SELECT DISTINCT g.side, g.k FROM g JOIN md USING (snap, side) WHERE usd >= 2 * mb),
 dense AS (SELECT wk.side, wk.k, i, t, hole, coalesce(usd, CASE WHEN (wk.side = 'bid' AND wk.k >= least) OR (wk.side = 'ask' AND wk.k <= most) THEN 0.0 END) AS usd, coalesce(usd >= 2 * mb, FALSE) AS wall
  FROM wk CROSS JOIN sn LEFT JOIN md ON md.snap = sn.snap AND md.side = wk.side LEFT JOIN g ON g.snap = sn.snap AND g.side = wk.side AND g.k = wk.k),
 st AS (SELECT side, k, 0::BIGINT AS i, FALSE AS op, NULL::BIGINT AS first_t, NULL::BIGINT AS last_t, NULL::BIGINT AS absent_t, []::BIGINT[] AS seen, NULL::DOUBLE AS peak, 0 AS missed, NULL::VARCHAR AS ended, NULL::BIGINT AS e_first, NULL::BIGINT AS e_last, NULL::BIGINT AS e_absent, []::BIGINT[] AS e_seen, NULL::DOUBLE AS e_peak FROM wk
  UNION ALL SELECT side, k, i, CASE WHEN stays THEN TRUE ELSE wall END, CASE WHEN stays THEN first_t WHEN wall THEN t END, CASE WHEN stays AND NOT miss THEN t WHEN stays THEN last_t WHEN wall THEN t END,
   CASE WHEN stays AND miss THEN coalesce(absent_t, t) END, CASE WHEN stays AND NOT miss THEN list_append(seen, t) WHEN stays THEN seen ELSE [t] END, CASE WHEN stays THEN greatest(peak, usd) WHEN wall THEN usd END, CASE WHEN stays AND miss THEN missed + 1 ELSE 0 END,
   how, first_t, last_t, CASE WHEN how = 'GONE' THEN coalesce(absent_t, t) ELSE absent_t END, seen, peak
  FROM (SELECT *, op AND how IS NULL AS stays FROM (SELECT s.side, s.k, d.i, d.t, d.usd, d.wall, s.op, s.first_t, s.last_t, s.absent_t, s.seen, s.peak, s.missed, coalesce(d.usd < 0.5 * s.peak, FALSE) AS miss,
   CASE WHEN NOT s.op THEN NULL WHEN d.hole OR d.usd IS NULL THEN 'CENSORED' WHEN d.usd < 0.5 * s.peak AND s.missed = 1 THEN 'GONE' END AS how FROM st s JOIN dense d ON d.side = s.side AND d.k = s.k AND d.i = s.i + 1))),
 ep AS (SELECT side, k, e_first AS first_t, e_last AS last_t, e_absent AS absent_t, e_seen AS seen, e_peak AS peak, ended FROM st WHERE ended IS NOT NULL
  UNION ALL SELECT side, k, first_t, last_t, absent_t, seen, peak, 'ACTIVE' FROM st WHERE op AND i = (SELECT max(i) FROM sn)),
 gt AS (SELECT g.*, t FROM g JOIN sn USING (snap)),
 mv AS (SELECT DISTINCT ep.side, ep.k, ep.first_t, TRUE AS moved FROM ep JOIN gt n ON n.side = ep.side AND n.t = ep.absent_t AND n.k <> ep.k AND abs(n.k - ep.k) <= 3 LEFT JOIN gt w ON w.side = ep.side AND w.t = ep.last_t AND w.k = n.k WHERE ep.ended = 'GONE' AND n.usd >= 0.5 * peak AND coalesce(w.usd, 0) < 0.5 * peak),
 aw AS (SELECT ep.*, moved, snap, CASE WHEN ep.side = 'bid' THEN lo < (ep.k + 1) * 50.0 ELSE hi >= ep.k * 50.0 END AS reached FROM ep LEFT JOIN mv USING (side, k, first_t) LEFT JOIN sn ON sn.t = ep.absent_t LEFT JOIN px USING (snap)),
 ft AS (SELECT *, CASE WHEN ended <> 'GONE' THEN ended WHEN reached IS NULL THEN 'CENSORED' WHEN reached THEN 'REACHED' WHEN moved THEN 'MOVED' ELSE 'PULLED' END AS fate FROM aw)"""


def _day(snap):
    return F.datediff(snap, F.lit("1990-01-01").cast("date")).cast("long").alias("t")


def _walls(spark, sf):
    """Cells with their walls, price ranges and episodes; months are snapshots."""
    lv = _levels(spark, sf)
    cells = B.grid(lv, WIDTH)
    base = cells.groupBy("snap", "side").agg(F.percentile("usd", 0.5).alias("base"))
    cells = cells.join(base, ["snap", "side"]).select(F.lit("all").alias("symbol"), "side", "k", _day("snap"), "usd", (F.col("usd") >= 2 * F.col("base")).alias("is_wall"))
    prices = lv.groupBy("snap").agg(F.percentile("price", 0.1).alias("lo"), F.percentile("price", 0.9).alias("hi"), F.percentile("price", 0.5).alias("mid"))
    return cells, prices.select(F.lit("all").alias("symbol"), _day("snap"), "lo", "hi", "mid", (F.month("snap") != 6).alias("clean")), B.episodes(cells, 31)


def _fates(spark, sf):
    cells, prices, found = _walls(spark, sf)
    return B.photo_fates(found, cells, prices, WIDTH), prices


@query(f"WITH RECURSIVE {_WALLS} SELECT 'all' AS symbol, side, k, first_t, last_t, len(seen) AS seen, round(peak, 4) AS peak FROM ep")
def wall_episodes(spark, sf):
    """Walls followed from month to month."""
    return _walls(spark, sf)[2].select("symbol", "side", "k", "first_t", "last_t", F.size("seen").cast("long").alias("seen"), F.round("peak", 4).alias("peak"))


@query(f"WITH RECURSIVE {_WALLS} SELECT side, k, first_t, absent_t, fate FROM ft")
def wall_fates(spark, sf):
    """What became of each wall."""
    return _fates(spark, sf)[0].select("side", "k", "first_t", "absent_t", "fate")


@query(f"""WITH RECURSIVE {_WALLS} SELECT 'all' AS symbol, side, count(*) AS episodes, sum(len(seen))::BIGINT AS exposure, {', '.join(f"count(*) FILTER (WHERE fate = '{f.upper()}') AS {f}" for f in ('reached', 'moved', 'pulled', 'censored', 'active'))},
 round(avg(len(seen)), 8) AS mean_seen, round(count(*) FILTER (WHERE fate = 'PULLED') / sum(len(seen)), 8) AS pull_rate FROM ft GROUP BY side""")
def wall_hazard(spark, sf):
    """Fates by side and pulls for each month seen."""
    return B.hazard(_fates(spark, sf)[0]).withColumn("pull_rate", F.round("pull_rate", 8)).withColumn("mean_seen", F.round("mean_seen", 8))


@query(f"""WITH RECURSIVE {_WALLS}, x AS (SELECT side, k, last_t, fate, unnest(seen) AS t FROM ft),
 y AS (SELECT floor(100 * CASE WHEN side = 'bid' THEN mid - (k + 1) * 50.0 ELSE k * 50.0 - mid END / mid / 10)::BIGINT AS band, x.t = last_t AND fate = 'PULLED' AS pull FROM x JOIN sn ON sn.t = x.t JOIN mid USING (snap))
 SELECT 'all' AS symbol, band, count(*) AS exposure, count(*) FILTER (WHERE pull) AS pulls, round(count(*) FILTER (WHERE pull) / count(*), 8) AS rate FROM y GROUP BY band""")
def wall_distance_hazard(spark, sf):
    """Pulls for each month seen, by distance from the mid."""
    done, prices = _fates(spark, sf)
    return B.distance_hazard(done, prices.select("symbol", "t", "mid"), WIDTH, 10.0).withColumn("rate", F.round("rate", 8))


_FLOWED = """fl AS (SELECT side, floor(price / 50.0 + 1e-9)::BIGINT AS k, datediff('day', DATE '1990-01-01', snap) AS absent_t, coalesce(sum(price * qty) FILTER (WHERE qty % 2 = 0), 0) AS tr, coalesce(sum(price * qty) FILTER (WHERE qty % 3 = 0), 0) AS rm FROM lv GROUP BY ALL),
 ff AS (SELECT aw.*, tr, rm, ended = 'GONE' AND month(snap) <> 6 AND coalesce(rm, 0) > 0 AS judged FROM aw LEFT JOIN fl USING (side, k, absent_t))"""


@query(f"""WITH RECURSIVE {_WALLS}, {_FLOWED} SELECT side, k, first_t, CASE WHEN ended <> 'GONE' THEN ended WHEN NOT judged THEN 'CENSORED' WHEN least(tr, rm) >= 0.5 * rm THEN 'FILLED' WHEN moved THEN 'MOVED' ELSE 'CANCELLED' END AS fate,
 round(CASE WHEN judged THEN least(tr, rm) END, 4) AS traded, round(CASE WHEN judged THEN greatest(0, rm - tr) END, 4) AS cancelled, round(CASE WHEN judged THEN greatest(0, tr - rm) END, 4) AS excess, CASE WHEN judged THEN coalesce(reached, FALSE) END AS reached FROM ff""")
def wall_flow_fates(spark, sf):
    """What became of each wall by traded and removed value."""
    cells, prices, found = _walls(spark, sf)
    part = lambda n: F.coalesce(F.sum(F.when(F.col("qty") % n == 0, F.col("price") * F.col("qty"))), F.lit(0.0))
    flows = _levels(spark, sf).groupBy(F.col("side"), B.bucket(F.col("price"), F.lit(WIDTH)).alias("k"), _day("snap")).agg(part(2).alias("traded"), part(3).alias("removed"))
    done = B.flow_fates(found, cells.join(flows, ["side", "k", "t"], "left"), prices, WIDTH)
    return done.select("side", "k", "first_t", "fate", *[F.round(c, 4).alias(c) for c in ("traded", "cancelled", "excess")], "reached")


def _depth(spark, sf):
    e = inputs.table(spark, sf, "events").where("event_id % 5 <> 2")
    return e.select(
        F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts"), (F.col("event_id") % 5 - 2).cast("int").alias("pct"), F.col("value").alias("depth"), (F.col("value") * (100 + F.col("event_id") % 13)).alias("notional"), F.lit(105.0).alias("ref"), "event_id"
    )


@query("""WITH q AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, (event_id % 5 - 2)::INT AS pct, max(value) AS depth, max(value * (100 + event_id % 13)) AS notional FROM events WHERE event_id % 5 <> 2 GROUP BY 1, 2, 3),
 m AS (SELECT *, coalesce(depth < lag(depth) OVER w OR notional < lag(notional) OVER w, FALSE) OR coalesce(abs(notional / nullif(depth, 0) / 105.0 - 1) > 0.1, TRUE) AS wrong FROM q WINDOW w AS (PARTITION BY symbol, ts, sign(pct) ORDER BY abs(pct))),
 b AS (SELECT *, max(wrong) OVER (PARTITION BY symbol, ts) AS bad FROM m)
 SELECT symbol, ts AS slot, pct, round(avg(notional) FILTER (WHERE NOT bad), 6) AS mean_notional, round(min(notional) FILTER (WHERE NOT bad), 6) AS min_notional, count(*) FILTER (WHERE NOT bad) AS good, count(*) FILTER (WHERE bad) AS bad FROM b GROUP BY 1, 2, 3""")
def depth_quality_15m(spark, sf):
    """Depth by band and quarter hour, with good and bad snapshots."""
    q = _depth(spark, sf).groupBy("symbol", "ts", "pct", "ref").agg(F.max("depth").alias("depth"), F.max("notional").alias("notional")).withColumn("ts", F.col("ts").cast("timestamp"))
    d = B.depth_quality(q)
    return d.select("symbol", "slot", "pct", F.round("mean_notional", 6).alias("mean_notional"), F.round("min_notional", 6).alias("min_notional"), "good", "bad")


_FLOW = """c AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'bid' ELSE 'ask' END AS side, user_id % 20 AS k, ts::DATE AS col, last(value ORDER BY ts, event_id) AS rest,
  sum(value) FILTER (WHERE event_type IN ('click', 'error')) AS added, sum(value) FILTER (WHERE event_type IN ('purchase')) AS traded, sum(value) FILTER (WHERE event_type IN ('view', 'signup')) AS removed FROM events GROUP BY ALL),
 p AS (SELECT side, k, col, rest, coalesce(added, 0) AS added, coalesce(traded, 0) AS traded, coalesce(removed, 0) AS removed FROM c)"""


def _panel(spark, sf):
    e = inputs.table(spark, sf, "events")
    part = lambda *t: F.coalesce(F.sum(F.when(F.col("event_type").isin(*t), F.col("value"))), F.lit(0.0))
    return e.groupBy(F.when(F.col("event_type").isin("click", "view"), "bid").otherwise("ask").alias("side"), (F.col("user_id") % 20).alias("k"), F.to_date("ts").alias("col")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("rest"), part("click", "error").alias("added"), part("purchase").alias("traded"), part("view", "signup").alias("removed")
    )


@query(f"""WITH {_FLOW} SELECT side, k, col, round(rest, 6) AS rest, round(quantile_cont(CASE WHEN rest > 0 THEN rest END, 0.5) OVER (PARTITION BY side, col ORDER BY k RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS local_median,
 round(greatest(0.0, removed - added - traded), 6) AS pulled, round(lag(rest) OVER (PARTITION BY side, k ORDER BY col), 6) AS was FROM p""")
def heatmap_panel(spark, sf):
    """Panel cells with local medians and pulled value."""
    h = B.heatmap(_panel(spark, sf))
    return h.select("side", "k", "col", *[F.round(c, 6).alias(c) for c in ("rest", "local_median", "pulled", "was")])


@query(f"""WITH {_LEVELS}, t AS (SELECT snap, side, x.pct, sum(usd) FILTER (WHERE dist <= x.pct) AS depth, max(dist) >= x.pct AS complete FROM dd, (VALUES (5), (10), (25), (50)) x(pct) GROUP BY snap, side, x.pct)
 SELECT snap, side, pct, round(depth, 4) AS depth, complete FROM t""")
def depth_totals(spark, sf):
    """Depth within bands of the mid, and whether the book reaches that far."""
    c = _cells(spark, sf).withColumn("pct", F.explode(F.array(*map(F.lit, (5, 10, 25, 50)))))
    d = c.groupBy("snap", "side", "pct").agg(F.sum(F.when(F.col("dist") <= F.col("pct"), F.col("usd"))).alias("depth"), (F.max("dist") >= F.first("pct")).alias("complete"))
    return d.select("snap", "side", "pct", F.round("depth", 4).alias("depth"), "complete")


@query(f"""WITH {_LEVELS}, s AS (SELECT a.snap, a.side, a.k, a.usd, quantile_cont(b.usd, 0.5) AS base FROM g a JOIN g b ON a.snap = b.snap AND a.side = b.side AND b.k <> a.k AND abs(b.k - a.k) <= 10 WHERE a.usd > 0 GROUP BY ALL HAVING count(*) >= 5)
 SELECT snap, side, count(*) AS standouts, round(max(usd / base), 6) AS most FROM s WHERE usd >= 1.5 * base GROUP BY 1, 2""")
def census(spark, sf):
    """Buckets that stand out from their neighbours, by month and side."""
    s = B.standouts(B.grid(_levels(spark, sf), WIDTH), 1.5)
    return s.groupBy("snap", "side").agg(F.count(F.lit(1)).alias("standouts"), F.round(F.max(F.col("usd") / F.col("base")), 6).alias("most"))


@query(f"""WITH {_LEVELS}, b AS (SELECT snap, side, floor(dist / 5)::BIGINT AS band, sum(usd) AS usd FROM dd WHERE dist >= 0.05 GROUP BY ALL),
 c AS (SELECT *, sum(usd) OVER (PARTITION BY snap, side ORDER BY band) AS depth, row_number() OVER (PARTITION BY snap, side ORDER BY usd DESC, band) AS rank FROM b)
 SELECT snap, side, band, rank, round(usd, 4) AS usd, round(depth, 4) AS depth FROM c WHERE rank <= 3""")
def distance_walls(spark, sf):
    """The three heaviest distance bands of each side, with the depth up to them."""
    b = _cells(spark, sf).where("dist >= 0.05").groupBy("snap", "side", F.floor(F.col("dist") / 5).alias("band")).agg(F.sum("usd").alias("usd"))
    w = Window.partitionBy("snap", "side")
    c = b.withColumn("depth", F.sum("usd").over(w.orderBy("band"))).withColumn("rank", F.row_number().over(w.orderBy(F.desc("usd"), "band")))
    return c.where("rank <= 3").select("snap", "side", "band", "rank", F.round("usd", 4).alias("usd"), F.round("depth", 4).alias("depth"))


@query("""WITH d AS (SELECT ts::DATE AS d, avg(value) FILTER (WHERE event_type = 'click') AS oi, avg(value) FILTER (WHERE event_type = 'view') AS funding FROM events GROUP BY 1),
 o AS (SELECT ts::DATE AS d, sum(value) FILTER (WHERE event_type = 'purchase') AS bid_1, sum(value) FILTER (WHERE event_type = 'error') AS ask_1 FROM events GROUP BY 1)
 SELECT d, round(oi, 6) AS oi, round(funding, 6) AS funding, round(bid_1, 6) AS bid_depth, round(ask_1, 6) AS ask_depth, round(bid_1 / nullif(ask_1, 0), 6) AS imbalance FROM d LEFT JOIN o USING (d)""")
def breakout_view(spark, sf):
    """Derivatives and depth side by side, each aggregated before the join."""
    e = inputs.table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    one = lambda agg, t: agg(F.when(F.col("event_type") == t, F.col("value")))
    d = e.groupBy("d").agg(one(F.avg, "click").alias("oi"), one(F.avg, "view").alias("funding"))
    o = e.groupBy("d").agg(one(F.sum, "purchase").alias("b"), one(F.sum, "error").alias("a"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return d.join(o, "d", "left").select("d", r("oi", "oi"), r("funding", "funding"), r("b", "bid_depth"), r("a", "ask_depth"), r(F.try_divide("b", "a"), "imbalance"))


@query("""WITH a AS (SELECT date_trunc('minute', ts) AS m, sum(value) AS x FROM events WHERE event_type IN ('click', 'view') GROUP BY 1), b AS (SELECT date_trunc('minute', ts + INTERVAL 30 SECOND) - INTERVAL 1 MINUTE AS m, sum(value) AS y FROM events WHERE event_type = 'purchase' GROUP BY 1)
 SELECT count(*) AS minutes, count(*) FILTER (WHERE x / y >= 0.8) AS good, round(count(*) FILTER (WHERE x / y >= 0.8) / nullif(count(*), 0), 6) AS share, count(*) FILTER (WHERE x / y >= 0.8) / nullif(count(*), 0) >= 0.8 AS passed FROM a JOIN b USING (m) WHERE y > 0""")
def stream_gate(spark, sf):
    """Share of minutes in which one feed holds at least 0.8 of the other's depth, minutes aligned half a minute on."""
    e = inputs.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    a = e.where("event_type in ('click', 'view')").groupBy(F.date_trunc("minute", "ts").alias("m")).agg(F.sum("value").alias("x"))
    late = F.timestamp_micros(F.unix_micros(F.date_trunc("minute", F.timestamp_micros(F.unix_micros("ts") + 30_000_000))) - 60_000_000)
    b = e.where("event_type = 'purchase'").groupBy(late.alias("m")).agg(F.sum("value").alias("y")).where("y > 0")
    good = F.count_if(F.col("x") / F.col("y") >= 0.8)
    n = F.count(F.lit(1))
    return a.join(b, "m").agg(n.alias("minutes"), good.alias("good"), F.round(F.try_divide(good, n), 6).alias("share"), (F.try_divide(good, n) >= 0.8).alias("passed"))


def _events(spark, sf):
    """Change events of two markets made from lineitem: a snapshot, then one event for each order, with a hole here and there; rows of an event as they are stored."""
    t = inputs.table(spark, sf, "lineitem")
    u = F.col("l_orderkey")
    return t.select(
        F.when(F.col("l_linestatus") == "F", "one").otherwise("two").alias("market"), (u * 5).cast("double").alias("ts"), F.when(u % 400 == 0, "snapshot").otherwise("diff").alias("kind"), (u - 1).alias("u1"), u.alias("u2"), F.lit(None).cast("long").alias("pu"),
        F.when(F.col("l_linenumber") % 2 == 0, "b").otherwise("a").alias("side"), F.when(F.col("l_linenumber") % 2 == 0, 1000 - F.col("l_quantity")).otherwise(1001 + F.col("l_quantity")).alias("price"), (F.col("l_linenumber") % 4).cast("double").alias("qty"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )


@query()
def stream_book_minutes(spark, sf):
    """Books put together from change events, by minute, side and bucket."""
    m = B.reconstruct(_events(spark, sf), 10.0, ("file", "row"))
    return m.select("market", "minute", "side", "k", *[F.round(c, 6).alias(c) for c in ("rest", "added", "removed", "traded", "synced")])
