"""Sources with their guards, keyed writes, calendars and scorers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import scorers
from ..functions import text as T
from ..operators import corridors as C
from ..operators import frames, outcomes, signals
from ..sources import archives, upsert
from . import inputs, volatility
from .registry import query


@query("""SELECT o_orderstatus AS status, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH))::DATE AS month
 FROM (SELECT o_orderstatus, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1)""")
def month_range(spark, sf):
    """The months that orders of each status span."""
    o = inputs.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    return frames.months(o, ["status"], "lo", "hi")


@query("""SELECT event_id, json_merge_patch(props, CASE WHEN event_id % 2 = 0 THEN '{"k":-1,"seen":' || user_id || '}' ELSE '{"seen":' || user_id || '}' END)::VARCHAR AS props FROM events""")
def json_merged(spark, sf):
    """Properties merged with newer ones, which win."""
    e = inputs.table(spark, sf, "events")
    newer = F.when(F.col("event_id") % 2 == 0, F.format_string('{"k":-1,"seen":%d}', "user_id")).otherwise(F.format_string('{"seen":%d}', "user_id"))
    return e.select("event_id", T.json_merge(F.col("props"), newer).alias("props"))


@query("""SELECT o_custkey AS custkey, count(*) AS mentions, max(o_orderdate) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS first_seen FROM orders GROUP BY 1""")
def conflict_increment(spark, sf):
    """Customers counted once in a table, and counted on by a batch of newer orders."""
    o = inputs.table(spark, sf, "orders")
    old, cut = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), F.col("o_custkey").alias("custkey")
    known = o.where(old).groupBy(cut).agg(F.count(F.lit(1)).alias("mentions"), F.max("o_orderdate").alias("first_seen"))
    return upsert.incremented(known, o.where(~old).select(cut), ["custkey"], "mentions")


_HOLES = f"SELECT symbol, d, CASE WHEN dayofyear(d) % 5 <> 0 THEN close END AS close FROM ({inputs.DAILY})"


@query(f"""SELECT symbol, d, close, round(close / last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 8) AS daily_return FROM ({_HOLES})""")
def previous_close_returns(spark, sf):
    """Daily returns against the last close that is there."""
    rows = inputs.daily_close(spark, sf).withColumn("close", F.when(F.dayofyear("d") % 5 != 0, F.col("close")))
    return archives.daily_returns(rows, ["symbol"], "d", "close").withColumn("daily_return", F.round("daily_return", 8))


@query("""WITH p AS (SELECT event_type AS symbol, event_id, CASE WHEN event_id // 100 = 7 THEN 8 WHEN event_id // 100 = 8 THEN 7 ELSE event_id // 100 END AS page, ts, value FROM events), l AS (SELECT symbol, page, max(ts) AS last FROM p GROUP BY ALL),
 s AS (SELECT symbol, min(page) AS stop FROM (SELECT *, max(last) OVER (PARTITION BY symbol ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM l) WHERE last <= seen GROUP BY 1)
 SELECT symbol, page, count(*) AS n, round(avg(value), 6) AS mean FROM p LEFT JOIN s USING (symbol) WHERE stop IS NULL OR page < stop GROUP BY ALL""")
def funding_pages(spark, sf):
    """Pages of a feed up to the first that brings nothing later (here pages 7 and 8 have changed places)."""
    no = F.floor(F.col("event_id") / 100)
    page = F.when(no == 7, 8).when(no == 8, 7).otherwise(no).cast("long")
    rows = inputs.ticks(spark, sf).select("symbol", page.alias("page"), "ts", "close")
    return archives.progressing(rows, ["symbol"], "page", "ts").groupBy("symbol", "page").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("close"), 6).alias("mean"))


@query("""WITH d AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, max(value) * 100 AS iv FROM events WHERE ts < TIMESTAMP '2024-01-29' GROUP BY ALL) SELECT symbol, ts, round(CASE WHEN (SELECT median(iv) FROM d) > 1.5 THEN iv / 100 ELSE iv END, 8) AS iv FROM d""")
def volatility_history(spark, sf):
    """A volatility history from overlapping pages: one row an hour, without the unfinished day, percent recognised."""
    rows = inputs.ticks(spark, sf).select("symbol", F.date_trunc("hour", "ts").alias("ts"), (F.col("close") * 100).alias("iv"))
    return archives.continued(rows, ["symbol"], "ts", "iv", F.lit("2024-01-29 12:00:00").cast("timestamp")).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("iv", 8).alias("iv"))


@query("""WITH p AS (SELECT c_nationkey AS listing, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS page, count(*) OVER (PARTITION BY c_nationkey) AS n, c_custkey FROM customer),
 q AS (SELECT *, NOT (page = n - 1 AND listing % 4 <> 0) AS truncated FROM p WHERE NOT (listing % 3 = 0 AND page = 1))
 SELECT listing, page, c_custkey FROM q WHERE listing IN (SELECT listing FROM q GROUP BY 1 HAVING min(page) = 0 AND max(page) = count(*) - 1 AND count(*) FILTER (NOT truncated) = 1)""")
def complete_listings(spark, sf):
    """Pages of listings that were read to their end; some lack a page, some were cut off."""
    from pyspark.sql import Window

    w = Window.partitionBy("listing")
    p = inputs.table(spark, sf, "customer").select(F.col("c_nationkey").alias("listing"), "c_custkey")
    p = p.withColumn("page", F.row_number().over(w.orderBy("c_custkey")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    q = p.withColumn("truncated", ~((F.col("page") == F.col("n") - 1) & (F.col("listing") % 4 != 0))).where(~((F.col("listing") % 3 == 0) & (F.col("page") == 1)))
    return archives.complete_listings(q).select("listing", "page", "c_custkey")


@query("""SELECT event_type AS symbol, slot, event_id FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS slot, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 5 MINUTE, ts) ORDER BY ts) AS k FROM events WHERE epoch_us(ts) - epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) <= 90000000) WHERE k = 1""")
def census_schedule(spark, sf):
    """The snapshot that serves each five minutes of the clock: the first, if it is not over 90 seconds late."""
    rows = frames.aligned(inputs.ticks(spark, sf), ["symbol"], "ts", 300, 90)
    return rows.select("symbol", F.col("slot").cast("timestamp_ntz").alias("slot"), "event_id")


_TWO = f"""px AS (SELECT * FROM ({inputs.LINES}) WHERE symbol <= 'line2'), fund AS (SELECT 'line' || l_linenumber AS symbol, l_shipdate::DATE AS d, avg(l_discount) AS fr FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL),
 fires AS (SELECT symbol, d FROM (SELECT *, avg(fr) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS b7 FROM fund) WHERE fr <= b7 - 0.02),
 o AS (SELECT symbol, d, CASE WHEN d < DATE '1997-01-01' THEN 'first' WHEN d < DATE '1999-07-01' THEN 'middle' ELSE 'last' END AS era, (low / close - 1 <= -0.1)::INT AS hit FROM (SELECT *, (SELECT min(b.close) FROM px AS b WHERE b.symbol = px.symbol AND b.d > px.d AND b.d <= px.d + 14) AS low FROM px) WHERE low IS NOT NULL)"""


@query(f"""WITH {_TWO} SELECT o.symbol, era, count(f.d) AS n_fired, sum(hit) FILTER (f.d IS NOT NULL) AS n_hit, round(100 * avg(hit) FILTER (f.d IS NOT NULL), 4) AS signal_pct, round(100 * avg(hit), 4) AS base_pct
 FROM o LEFT JOIN fires AS f ON f.symbol = o.symbol AND f.d = o.d GROUP BY ALL""")
def two_asset_cell(spark, sf):
    """One signal on two assets, by era: falls of a tenth within 14 days after it, and after any day."""
    px = inputs.lines(spark, sf).where("symbol <= 'line2'")
    level = inputs.table(spark, sf, "lineitem").where("l_linenumber <= 2").groupBy(F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("d")).agg(F.avg("l_discount").alias("level"))
    fires = signals.trailing_drop(level, (7,), ["symbol"], 0.02).select("symbol", "d", F.lit(True).alias("fired"))
    era = F.when(F.col("d") < F.lit("1997-01-01").cast("date"), "first").when(F.col("d") < F.lit("1999-07-01").cast("date"), "middle").otherwise("last")
    rows = signals.judged(signals.forward_extremes(px, (14,), ["symbol"]).where("px_min is not null"), 0.1).withColumn("era", era).join(fires, ["symbol", "d"], "left")
    hit = F.when(F.col("fired"), F.col("fell"))
    return rows.groupBy("symbol", "era").agg(F.count("fired").alias("n_fired"), F.sum(hit).alias("n_hit"), F.round(100 * F.avg(hit), 4).alias("signal_pct"), F.round(100 * F.avg("fell"), 4).alias("base_pct"))


@query("""WITH u AS (SELECT o_orderpriority AS signature, o_orderstatus AS asset, o_totalprice / 1e5 AS r, o_orderdate AS ts FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderpriority, o_orderstatus, -o_totalprice / 1e5, o_orderdate FROM orders WHERE o_orderkey % 2 = 1)
 SELECT signature, asset, count(*) AS n, round(avg(r), 8) AS mean, round(stddev_samp(r), 8) AS std, round(quantile_cont(r, 0.25), 8) AS p25, round(quantile_cont(r, 0.5), 8) AS p50, round(quantile_cont(r, 0.75), 8) AS p75 FROM u WHERE ts < TIMESTAMP '2000-01-01' GROUP BY ALL HAVING count(*) >= 5""")
def priors_of_two_schemas(spark, sf):
    """Priors over live and replayed outcomes together, from before a time; the second table lacks a column."""
    o = inputs.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("signature"), F.col("o_orderstatus").alias("asset"), (F.col("o_totalprice") / 1e5).alias("return_pct"), F.col("o_orderdate").alias("trigger_fired_at"))
    live, replayed = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1").withColumn("return_pct", -F.col("return_pct")).drop("o_orderkey")
    both = live.unionByName(replayed, allowMissingColumns=True)
    got = outcomes.priors(both, ["signature", "asset"], before=F.lit("2000-01-01").cast("timestamp_ntz"))
    return got.select("signature", "asset", "n", *(F.round(c, 8).alias(c) for c in ("mean", "std", "p25", "p50", "p75")))


_LOG_DAYS = ("2001-01-10", "2001-01-13", "2001-01-13", "2001-02-20")


@query(f"""WITH {volatility._vol()}, b AS (SELECT symbol, d, i, lo, hi, out, low, high FROM ({volatility._bands(7, (0.80,), ("fhs",))}) WHERE lo IS NOT NULL),
 e AS (SELECT symbol, {", ".join(f"max(i) FILTER (d <= DATE '{x}') AS e{n}" for n, x in enumerate(_LOG_DAYS))} FROM b GROUP BY 1)
 SELECT symbol, d, round(lo, 8) AS lo, round(hi, 8) AS hi, out IS NOT NULL AS scored, out BETWEEN lo AND hi AS hit, low < lo AS dip, high > hi AS run FROM b JOIN e USING (symbol) WHERE i = e0 OR (i > e1 - 7 AND i <= e1 AND i >= e0) OR (i > e3 - 7 AND i <= e3)""")
def corridor_log(spark, sf):
    """A forecast log after four cycles (one of them run twice, one after a long stop), and how its forecasts ended."""
    rows = C.bands(C.volatility(volatility._series(spark, sf)), 7, (0.80,), ("fhs",)).where("lo is not null")
    log = rows.select("symbol", "d", "lo", "hi").limit(0)
    for day in _LOG_DAYS:
        seen = rows.where(F.col("d") <= F.lit(day).cast("date")).withColumn("end", F.max("i").over(frames.series(["symbol"], ["symbol"])))
        log = C.logged(log, seen, ["symbol", "d"], F.col("end"), 7)
    ended = rows.select("symbol", "d", "out", "low", "high")
    flag = lambda c: F.when(F.col("out").isNotNull(), c)
    got = log.join(ended, ["symbol", "d"], "left")
    return got.select("symbol", "d", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"), F.col("out").isNotNull().alias("scored"), flag(F.col("out").between(F.col("lo"), F.col("hi"))).alias("hit"), flag(F.col("low") < F.col("lo")).alias("dip"), flag(F.col("high") > F.col("hi")).alias("run"))


_FORMS = {}
for _w in reversed(sorted({w for _, _, lemmas, nouns in V.VERBS.values() for w in f"{lemmas} {nouns}".split()})):
    for _f in (_w, f"{_w}s", f"{_w}ed", f"{_w}d", f"{_w}ing", f"{_w[:-1]}ing" if _w.endswith("e") else _w):
        _FORMS[_f] = _w
_SUBJECTS, _OBJECTS = ("iran", "the fed", "sec", "russia"), ("talks", "the strait", "new sanctions", "bitcoin funds")
_SPOKEN = ("attacks", "did not sign", "halted", "reopening", "met", "never banned", "eases", "zzz")


def _pick_sql(words, n):
    return "(['" + "', '".join(words) + f"'])[{n} % {len(words)} + 1]"


@query(f"""WITH t AS (SELECT event_id, {_pick_sql(_SUBJECTS, 'user_id')} || ' ' || {_pick_sql(_SPOKEN, 'event_id')} || ' ' || {_pick_sql(_OBJECTS, '(event_id // 8)')} AS title FROM events),
 w AS (SELECT event_id, title, string_split(title, ' ') AS w FROM t), f AS (SELECT v.form AS form, v.lemma AS lemma FROM (SELECT unnest([{", ".join(f"{{'form': '{f}', 'lemma': '{w}'}}" for f, w in sorted(_FORMS.items()))}]) AS v)),
 x AS (SELECT event_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w), h AS (SELECT event_id, min(i) AS i, arg_min(lemma, i) AS lemma FROM x JOIN f ON word = form GROUP BY 1)
 SELECT w.event_id, title, lemma, coalesce(len(list_intersect(w[greatest(i - 2, 1):i], [{", ".join(f"'{n}'" for n in T.NEGATIONS)}])) > 0, FALSE) AS negated FROM w LEFT JOIN h USING (event_id)""")
def verb_extract(spark, sf):
    """The first listed verb of a headline and whether it is negated."""
    e = inputs.table(spark, sf, "events")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    title = F.concat_ws(" ", pick(_SUBJECTS, F.col("user_id")), pick(_SPOKEN, F.col("event_id")), pick(_OBJECTS, F.floor(F.col("event_id") / 8)))
    return e.select("event_id", title.alias("title"), T.first_verb(title).alias("v")).select("event_id", "title", "v.lemma", "v.negated")


@query()
def direction_backfill(spark, sf):
    """Directions for rows that have none, by the first verb; rows that have one keep it."""
    rows = verb_extract(spark, sf).withColumn("known", F.when(F.col("event_id") % 3 == 0, F.lit("neutral")))
    found = T.direction(T.verb_category(F.col("lemma")), F.col("negated"))
    return rows.select("event_id", F.coalesce("known", found).alias("direction"), F.col("known").isNull().alias("filled"))


@query()
def rule_scores(spark, sf):
    """Categories and impact of headlines by the default scorer, which loads once for each worker."""
    rows = inputs.headlines(spark, sf).select("headline_id", "title")
    return scorers.scored(rows, "title").groupBy("category", "impact").agg(F.count(F.lit(1)).alias("n"), F.min("headline_id").alias("first_id"))
