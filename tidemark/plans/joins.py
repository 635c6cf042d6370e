"""As-of joins, labels, outcomes, priors and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, frames, outcomes
from . import inputs
from .registry import query


@query(inputs.DAILY)
def last_close_per_day(spark, sf):
    """Last tick of each symbol and day."""
    return frames.last_per_day(inputs.ticks(spark, sf), ["symbol"], "ts", "close", "event_id")


@query(f"""WITH p AS ({inputs.DAILY}), b AS (SELECT symbol, min(d) AS lo, max(d) AS hi FROM p GROUP BY 1),
 s AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS d FROM b)
 SELECT symbol, d, c AS close FROM (SELECT s.symbol, s.d, last_value(p.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY s.d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS c
  FROM s LEFT JOIN p USING (symbol, d)) WHERE c IS NOT NULL""")
def daily_panel(spark, sf):
    """A calendar of closes, gaps filled for at most three days."""
    return frames.filled(inputs.daily_close(spark, sf), ["symbol"], "d", "close", 3)


def _marks(spark, sf):
    """Rows that look up prices: purchases look at the clicks' hourly candles half an hour later."""
    t = inputs.ticks(spark, sf).where("symbol = 'purchase'")
    return t.select("event_id", F.lit("click").alias("symbol"), F.timestamp_micros(F.unix_micros("ts") + 1_800_000_000).alias("at"))


def _candles(spark, sf):
    return inputs.hourly(spark, sf).select("symbol", F.col("timestamp").alias("ts"), "close")


_MARKS = f"""m AS (SELECT event_id, 'click' AS symbol, ts + INTERVAL 30 MINUTE AS mark FROM events WHERE event_type = 'purchase'),
 c AS (SELECT symbol, timestamp AS ts, close FROM ({inputs.HOURLY}))"""


@query(f"""WITH {_MARKS}, j AS (SELECT event_id, close, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(mark)), epoch_us(ts), close) AS k
  FROM m JOIN c USING (symbol) WHERE ts BETWEEN mark - INTERVAL 90 MINUTE AND mark + INTERVAL 90 MINUTE)
 SELECT m.event_id, m.mark, j.close FROM m LEFT JOIN j ON j.event_id = m.event_id AND k = 1""")
def asof_nearest(spark, sf):
    """Nearest hourly close within 90 minutes."""
    return asof.nearest(_marks(spark, sf), _candles(spark, sf), ["symbol"], "event_id", "at", "ts", "close", 5400).select("event_id", F.col("at").alias("mark"), "close")


@query(f"""WITH {_MARKS}, n AS (SELECT event_id, close, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(mark)), epoch_us(ts), close) AS k
  FROM m JOIN c USING (symbol) WHERE ts BETWEEN mark - INTERVAL 10 MINUTE AND mark + INTERVAL 10 MINUTE),
 f AS (SELECT event_id, close, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS k FROM m JOIN c USING (symbol) WHERE ts >= mark AND ts <= mark + INTERVAL 5760 MINUTE)
 SELECT m.event_id, coalesce(n.close, f.close) AS close FROM m LEFT JOIN n ON n.event_id = m.event_id AND n.k = 1 LEFT JOIN f ON f.event_id = m.event_id AND f.k = 1""")
def asof_rollforward(spark, sf):
    """Nearest within ten minutes, else the next candle within four days."""
    return asof.roll_forward(_marks(spark, sf), _candles(spark, sf), ["symbol"], "event_id", "at", "ts", "close", 600, 5760 * 60).select("event_id", "close")


@query(f"""WITH {_MARKS}, e AS (SELECT event_id, first(close ORDER BY ts) AS close FROM m JOIN c USING (symbol) WHERE ts >= mark - INTERVAL 4 HOUR AND ts < mark GROUP BY 1)
 SELECT m.event_id, e.close FROM m LEFT JOIN e USING (event_id)""")
def asof_earliest(spark, sf):
    """First candle of the four hours before."""
    return asof.earliest(_marks(spark, sf), _candles(spark, sf), ["symbol"], "event_id", "at", "ts", "close", 4 * 3600).select("event_id", "close")


@query(f"""WITH {_MARKS}, e AS (SELECT event_id, last(close ORDER BY ts) AS close FROM m JOIN c USING (symbol) WHERE ts >= mark - INTERVAL 1 DAY AND ts <= mark GROUP BY 1)
 SELECT m.event_id, e.close FROM m LEFT JOIN e USING (event_id)""")
def asof_backward(spark, sf):
    """Last candle at or before, at most a day back."""
    return asof.backward(_marks(spark, sf), _candles(spark, sf), ["symbol"], "event_id", "at", "ts", "close", 86400).select("event_id", "close")


@query(f"""WITH px AS ({inputs.PRICE}), f AS ({inputs.FLOWS}) SELECT f.d, min(px.d) AS close_day, first(px.close ORDER BY px.d) AS close
 FROM f LEFT JOIN px ON px.d BETWEEN f.d AND f.d + 6 GROUP BY 1""")
def next_trading_day(spark, sf):
    """First day with a price in the week from each flow's day."""
    f = inputs.flows(spark, sf).select("d", F.col("d").alias("row"))
    px = inputs.price(spark, sf).withColumnRenamed("d", "day")
    return asof.next_day(f.withColumn("k", F.lit(1)), px.withColumn("k", F.lit(1)), ["k"], "row", "d", "day", "close").select("d", "close_day", "close")


_EV = """ev AS (SELECT event_id AS trigger_id, ts AS fired, user_id % 3 AS grp FROM events WHERE event_type = 'signup')"""


def _events(spark, sf):
    t = inputs.ticks(spark, sf).where("symbol = 'signup'")
    return t.select(F.col("event_id").alias("trigger_id"), F.col("ts").alias("trigger_fired_at"), (F.col("user_id") % 3).alias("grp"))


_SCHED = f"""{_EV}, s AS (SELECT trigger_id, fired, grp, asset, hm, fired + to_minutes(hm) AS target FROM ev, (VALUES ('click'), ('view')) a(asset), (VALUES (60), (240), (1440)) h(hm))"""


@query(f"WITH {_SCHED} SELECT trigger_id, asset, hm AS horizon_minutes, fired AS trigger_fired_at, target AS target_at FROM s")
def outcome_schedule(spark, sf):
    """Every signup watched on two assets over three horizons."""
    return outcomes.schedule(_events(spark, sf), ["click", "view"]).select("trigger_id", "asset", "horizon_minutes", "trigger_fired_at", "target_at")


def _near(alias, at):
    return f"""{alias} AS (SELECT trigger_id, asset, hm, close FROM (SELECT s.trigger_id, s.asset, s.hm, c.close,
  row_number() OVER (PARTITION BY s.trigger_id, s.asset, s.hm ORDER BY abs(epoch_us(c.ts) - epoch_us({at})), epoch_us(c.ts), c.close) AS k
  FROM s JOIN c ON c.symbol = s.asset AND c.ts BETWEEN {at} - INTERVAL 90 MINUTE AND {at} + INTERVAL 90 MINUTE) WHERE k = 1)"""


_RES = f"""{_SCHED}, c AS (SELECT symbol, timestamp AS ts, close FROM ({inputs.HOURLY})), {_near('pf', 's.fired')}, {_near('pt', 's.target')}, {_near('pb', '(s.fired - to_minutes(s.hm))')},
 x AS (SELECT s.*, pf.close AS f, pt.close AS t, pb.close AS b, s.target <= TIMESTAMP '2024-01-25' AS due FROM s LEFT JOIN pf USING (trigger_id, asset, hm)
  LEFT JOIN pt USING (trigger_id, asset, hm) LEFT JOIN pb USING (trigger_id, asset, hm)),
 r AS (SELECT *, due AND f > 0 AND t IS NOT NULL AS ok FROM x),
 o AS (SELECT trigger_id, grp, asset, hm, fired, CASE WHEN ok THEN 'completed' ELSE 'pending' END AS status, CASE WHEN ok THEN 100 * (t / f - 1) END AS ret,
  CASE WHEN ok AND b > 0 THEN 100 * (f / b - 1) END AS base, CASE WHEN due AND ok IS NOT TRUE THEN 1 ELSE 0 END AS attempts FROM r)"""


def _resolved(spark, sf):
    plan = outcomes.schedule(_events(spark, sf), ["click", "view"]).withColumn("attempts", F.lit(0))
    px = _candles(spark, sf).withColumnRenamed("symbol", "asset")
    return outcomes.resolve(plan, px, F.lit("2024-01-25").cast("timestamp"))


@query(f"WITH {_RES} SELECT trigger_id, asset, hm AS horizon_minutes, status, attempts, round(ret, 6) AS return_pct FROM o")
def outcome_resolve(spark, sf):
    """Outcomes due by 2024-01-25 with their returns."""
    return _resolved(spark, sf).select("trigger_id", "asset", "horizon_minutes", "status", "attempts", F.round("return_pct", 6).alias("return_pct"))


@query(f"WITH {_RES} SELECT trigger_id, asset, hm AS horizon_minutes, round(base, 6) AS baseline_pct, round(ret - base, 6) AS excess_return_pct FROM o WHERE status = 'completed'")
def detrended_returns(spark, sf):
    """Returns less the move over the same time before."""
    r = _resolved(spark, sf).where("status = 'completed'")
    return r.select("trigger_id", "asset", "horizon_minutes", F.round("baseline_pct", 6).alias("baseline_pct"), F.round("excess_return_pct", 6).alias("excess_return_pct"))


@query(f"""WITH {_RES} SELECT grp, asset, hm AS horizon_minutes, count(*) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS std,
 round(quantile_cont(ret, 0.25), 6) AS p25, round(quantile_cont(ret, 0.5), 6) AS p50, round(quantile_cont(ret, 0.75), 6) AS p75
 FROM o WHERE ret IS NOT NULL AND fired < TIMESTAMP '2024-01-20' GROUP BY ALL HAVING count(*) >= 5""")
def priors_by_cell(spark, sf):
    """Distribution of returns by group, asset and horizon, fired before 2024-01-20."""
    cells = outcomes.priors(_resolved(spark, sf), ["grp", "asset", "horizon_minutes"], before=F.lit("2024-01-20").cast("timestamp"))
    return cells.select("grp", "asset", "horizon_minutes", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p25", "p50", "p75")])


@query(f"""WITH {_RES}, v AS (SELECT *, row_number() OVER (ORDER BY fired, trigger_id, asset, hm) AS i, count(*) OVER () AS n FROM o WHERE ret IS NOT NULL),
 tr AS (SELECT grp, asset, hm, avg(ret) AS pm, count(*) AS n_train FROM v WHERE i <= floor(n * 0.8) GROUP BY ALL HAVING count(*) >= 5)
 SELECT grp, asset, hm AS horizon_minutes, n_train, count(*) AS n_test, round(avg(CASE WHEN abs(pm) >= 1e-9 THEN (sign(ret) = sign(pm))::INT END), 6) AS sign_agreement,
  round(avg(abs(ret - pm)), 6) AS mae, round(avg(ret), 6) AS test_mean FROM v JOIN tr USING (grp, asset, hm) WHERE i > floor(n * 0.8) GROUP BY ALL""")
def calibration_cells(spark, sf):
    """Priors of the first four fifths held against the rest."""
    done = _resolved(spark, sf).where("return_pct is not null")
    c = outcomes.calibrate(done, ["grp", "asset", "horizon_minutes"], "trigger_fired_at", ["trigger_id", "asset", "horizon_minutes"])
    return c.select("grp", "asset", "horizon_minutes", "n_train", "n_test", *[F.round(x, 6).alias(x) for x in ("sign_agreement", "mae", "test_mean")])


_HL = f"h AS (SELECT headline_id, published_at FROM ({inputs.HEADLINES})), k AS (SELECT * FROM ({inputs.HOURLY}) WHERE symbol = 'view')"


def _labelled(spark, sf, hours):
    h = inputs.headlines(spark, sf).select("headline_id", "published_at", F.lit("view").alias("symbol"))
    return outcomes.moves_ahead(h, inputs.hourly(spark, sf), ["symbol"], "headline_id", "published_at", hours)


@query(f"""WITH {_HL}, b AS (SELECT headline_id, close AS base FROM (SELECT headline_id, close, row_number() OVER (PARTITION BY headline_id ORDER BY abs(epoch_us(timestamp) - epoch_us(published_at)), epoch_us(timestamp), close) AS r
  FROM h JOIN k ON timestamp BETWEEN published_at - INTERVAL 1 HOUR AND published_at + INTERVAL 1 HOUR) WHERE r = 1),
 w AS (SELECT headline_id, base, max(high) FILTER (WHERE timestamp <= published_at + INTERVAL 4 HOUR) AS h4, min(low) FILTER (WHERE timestamp <= published_at + INTERVAL 4 HOUR) AS l4, max(high) AS h48, min(low) AS l48
  FROM h LEFT JOIN b USING (headline_id) LEFT JOIN k ON timestamp > published_at AND timestamp <= published_at + INTERVAL 48 HOUR GROUP BY ALL),
 m AS (SELECT headline_id, CASE WHEN 100 * (h4 / base - 1) >= -100 * (l4 / base - 1) THEN 100 * (h4 / base - 1) ELSE 100 * (l4 / base - 1) END AS m4,
  CASE WHEN 100 * (h48 / base - 1) >= -100 * (l48 / base - 1) THEN 100 * (h48 / base - 1) ELSE 100 * (l48 / base - 1) END AS m48 FROM w)
 SELECT headline_id, round(m4, 6) AS move_4h, round(m48, 6) AS move_48h, CASE WHEN abs(m48) >= 5 THEN 'high' WHEN abs(m48) >= 2 THEN 'medium' WHEN abs(m48) >= 0.5 THEN 'low' ELSE 'noise' END AS impact_level,
  CASE WHEN m48 > 0 THEN 'up' WHEN m48 < 0 THEN 'down' END AS impact_direction FROM m""")
def label_moves_v1(spark, sf):
    """Larger of rise and fall after every headline, and its size class."""
    m = _labelled(spark, sf, (4, 48))
    way = F.when(F.col("move_48h") > 0, "up").when(F.col("move_48h") < 0, "down")
    return m.select("headline_id", F.round("move_4h", 6).alias("move_4h"), F.round("move_48h", 6).alias("move_48h"), outcomes.impact_level(F.col("move_48h")).alias("impact_level"), way.alias("impact_direction"))


@query(f"""WITH {_HL}, n AS (SELECT headline_id, close AS base FROM (SELECT headline_id, close, row_number() OVER (PARTITION BY headline_id ORDER BY abs(epoch_us(timestamp) - epoch_us(published_at)), epoch_us(timestamp), close) AS r
  FROM h JOIN k ON timestamp BETWEEN published_at - INTERVAL 1 HOUR AND published_at + INTERVAL 1 HOUR) WHERE r = 1),
 e AS (SELECT headline_id, first(close ORDER BY timestamp) AS early FROM h JOIN k ON timestamp >= published_at - INTERVAL 4 HOUR AND timestamp < published_at GROUP BY 1),
 l AS (SELECT headline_id, last(close ORDER BY timestamp) AS late FROM h JOIN k ON timestamp <= published_at + INTERVAL 4 HOUR AND timestamp > published_at - INTERVAL 0 HOUR GROUP BY 1)
 SELECT headline_id, round(100 * (base / early - 1), 6) AS pre_move_4h, round(100 * (late / base - 1), 6) AS post_move_4h, round(100 * (late / base - 1) - 100 * (base / early - 1), 6) AS incremental_move_4h
 FROM h LEFT JOIN n USING (headline_id) LEFT JOIN e USING (headline_id) LEFT JOIN l USING (headline_id)""")
def label_incremental_v2(spark, sf):
    """Move of the four hours after a headline less that of the four before."""
    h = inputs.headlines(spark, sf).select("headline_id", "published_at", F.lit("view").alias("symbol"))
    k = inputs.hourly(spark, sf)
    n = asof.nearest(h, k, ["symbol"], "headline_id", "published_at", "timestamp", "close", 3600).withColumnRenamed("close", "base")
    e = asof.earliest(n, k, ["symbol"], "headline_id", "published_at", "timestamp", "close", 4 * 3600).withColumnRenamed("close", "early")
    late = asof.candidates(e.select("headline_id", "symbol", "published_at"), k, ["symbol"], "published_at", "timestamp", 0, 4 * 3600).where("_gap > 0").groupBy("headline_id").agg(F.max_by("_r.close", "_r.timestamp").alias("late"))
    pre, post = 100 * (F.col("base") / F.col("early") - 1), 100 * (F.col("late") / F.col("base") - 1)
    return e.join(late, "headline_id", "left").select("headline_id", F.round(pre, 6).alias("pre_move_4h"), F.round(post, 6).alias("post_move_4h"), F.round(post - pre, 6).alias("incremental_move_4h"))


@query("""WITH l AS (SELECT doc_id AS label_id, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 37)::INT) AS published_at,
  CASE WHEN n_chars >= 8000 THEN 'high' WHEN n_chars >= 2500 THEN 'medium' ELSE 'low' END AS lvl, doc_id % 2 = 0 AS causal FROM documents),
 c AS (SELECT *, lvl IN ('high', 'medium') AS hot, count(*) FILTER (WHERE lvl IN ('high', 'medium')) OVER (PARTITION BY published_at::DATE) AS n,
  row_number() OVER (PARTITION BY published_at::DATE, lvl IN ('high', 'medium') AND causal ORDER BY published_at, label_id) AS r FROM l)
 SELECT label_id, CASE WHEN hot AND n > 5 AND NOT (causal AND r <= 3) THEN 'during_event' ELSE lvl END AS impact_level FROM c""")
def hot_day_demotion(spark, sf):
    """On crowded days only the first three causal labels keep their level."""
    d = inputs.table(spark, sf, "documents")
    level = F.when(F.col("n_chars") >= 8000, "high").when(F.col("n_chars") >= 2500, "medium").otherwise("low")
    labels = d.select(F.col("doc_id").alias("label_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 37 * 60).alias("published_at"), level.alias("impact_level"), (F.col("doc_id") % 2 == 0).alias("is_causal_capable"))
    return outcomes.demote_hot_days(labels).select("label_id", "impact_level")


@query("""WITH a AS (SELECT DISTINCT doc_id FROM labels) SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a)""")
def anti_unprocessed(spark, sf):
    """Documents without a label yet."""
    return inputs.table(spark, sf, "documents").select("doc_id", "source").join(inputs.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT doc_id, n_chars FROM documents WHERE (n_chars, doc_id) > (500, 100) ORDER BY n_chars, doc_id LIMIT 25""")
def keyset_page(spark, sf):
    """The next page after (500, 100) in order of size and id."""
    d = inputs.table(spark, sf, "documents")
    after = (F.col("n_chars") > 500) | ((F.col("n_chars") == 500) & (F.col("doc_id") > 100))
    return d.where(after).orderBy("n_chars", "doc_id").limit(25).select("doc_id", "n_chars")
