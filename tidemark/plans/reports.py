"""Volume, novelty and drift reports, set operations and write semantics as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import upsert
from . import inputs
from .registry import query


@query("""SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, min(doc_id) AS first_id, max(doc_id) AS last_id, count(DISTINCT lang) AS langs,
 count(*) FILTER (WHERE lang = 'en') AS english, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM documents GROUP BY 1 HAVING count(*) > 1""")
def report_volume(spark, sf):
    """Documents by source: counts, shares, languages."""
    d = inputs.table(spark, sf, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
        F.countDistinct("lang").alias("langs"), F.count_if(F.col("lang") == "en").alias("english"),
    )
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row a source
    return d.withColumn("share", F.round(100.0 * F.col("n") / total, 4)).where("n > 1")


@query("""SELECT hour(ts) AS hour, ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2""")
def report_hourly(spark, sf):
    """Events by day and hour."""
    return inputs.table(spark, sf, "events").groupBy(F.hour("ts").alias("hour"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("""SELECT CASE WHEN value >= 90 THEN '0.9+' WHEN value >= 70 THEN '0.7-0.9' WHEN value >= 50 THEN '0.5-0.7' ELSE '<0.5' END AS bucket, event_type, count(*) AS n,
 round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def report_confidence(spark, sf):
    """Values by confidence bucket and type."""
    v = F.col("value")
    bucket = F.when(v >= 90, "0.9+").when(v >= 70, "0.7-0.9").when(v >= 50, "0.5-0.7").otherwise("<0.5")
    return inputs.table(spark, sf, "events").groupBy(bucket.alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""SELECT d.source, count(*) AS n, count(l.doc_id) AS labelled, sum(coalesce(l.quality, 0))::BIGINT AS good, round(avg(l.toxic), 6) AS toxic_share FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def report_sources(spark, sf):
    """Productivity of sources: labelled, good and toxic documents."""
    d, lab = inputs.table(spark, sf, "documents").select("doc_id", "source"), inputs.table(spark, sf, "labels")
    j = d.join(lab.withColumn("has", F.lit(1)), "doc_id", "left")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("labelled"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"), F.round(F.avg("toxic"), 6).alias("toxic_share"))


@query("""WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 AS novel, quality FROM documents LEFT JOIN labels USING (doc_id))
 SELECT lang, count(*) AS n, count(*) FILTER (WHERE novel) AS novel_n, count(*) FILTER (WHERE quality = 1 AND NOT novel) AS good_repeats, round(100.0 * (1 - count(*) FILTER (WHERE novel) / count(*)), 4) AS noise_reduction FROM k GROUP BY 1""")
def report_novelty(spark, sf):
    """First appearances against repeats by language."""
    d = inputs.table(spark, sf, "documents").withColumn("h", F.md5(F.col("text").cast("binary")))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    k = d.join(first, "h").withColumn("novel", F.col("doc_id") == F.col("first_id")).join(inputs.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    n = F.count(F.lit(1))
    return k.groupBy("lang").agg(n.alias("n"), F.count_if("novel").alias("novel_n"), F.count_if((F.col("quality") == 1) & ~F.col("novel")).alias("good_repeats"), F.round(100.0 * (1 - F.count_if("novel") / n), 4).alias("noise_reduction"))


_DRIFT = "SELECT event_type AS cat, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}' GROUP BY 1"


@query(f"""WITH a AS ({_DRIFT.format(a='2024-01-01', b='2024-01-15')}), b AS ({_DRIFT.format(a='2024-01-15', b='2024-01-31')})
 SELECT coalesce(a.cat, b.cat) AS category, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after, round(100 * (coalesce(b.share, 0) - coalesce(a.share, 0)), 4) AS delta_pp,
  abs(coalesce(b.share, 0) - coalesce(a.share, 0)) >= 0.01 AS flagged FROM a FULL JOIN b ON a.cat = b.cat""")
def drift_monitor(spark, sf):
    """Shares of categories in two periods, their change, and a flag at one point."""
    e = inputs.table(spark, sf, "events")

    def shares(lo, hi, name):
        x = e.where((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz"))).groupBy(F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        return x.withColumn(f"share_{name}", F.col(f"n_{name}") / F.sum(f"n_{name}").over(Window.partitionBy(F.lit(0))))

    j = shares("2024-01-01", "2024-01-15", "before").join(shares("2024-01-15", "2024-01-31", "after"), "category", "full").na.fill(0)
    change = F.col("share_after") - F.col("share_before")
    return j.select("category", "n_before", "n_after", F.round(100 * change, 4).alias("delta_pp"), (F.abs(change) >= 0.01).alias("flagged"))


_OLD = "SELECT doc_id AS k, n_chars AS v, 0 AS version FROM documents WHERE lang <> 'de'"
_NEW = "SELECT doc_id AS k, n_chars + 1 AS v, 1 AS version FROM documents WHERE lang <> 'en'"


def _versions(spark, sf):
    d = inputs.table(spark, sf, "documents")
    old = d.where("lang <> 'de'").select(F.col("doc_id").alias("k"), F.col("n_chars").alias("v"), F.lit(0).alias("version"))
    new = d.where("lang <> 'en'").select(F.col("doc_id").alias("k"), (F.col("n_chars") + 1).alias("v"), F.lit(1).alias("version"))
    return old, new


@query(f"SELECT * FROM ({_NEW}) UNION ALL SELECT * FROM ({_OLD}) o WHERE k NOT IN (SELECT k FROM ({_NEW}))")
def upsert_latest(spark, sf):
    """The later version of each key."""
    old, new = _versions(spark, sf)
    return upsert.replace(old, new, ["k"], "version")


@query(f"SELECT * FROM ({_OLD}) UNION ALL SELECT * FROM ({_NEW}) n WHERE k NOT IN (SELECT k FROM ({_OLD}))")
def insert_ignore(spark, sf):
    """Known keys keep their row, new ones are added."""
    old, new = _versions(spark, sf)
    return upsert.ignore(old, new, ["k"])


@query("""WITH a AS (SELECT c_nationkey AS k, list_sort(list(DISTINCT c_mktsegment)) AS s FROM customer GROUP BY 1), b AS (SELECT n_nationkey AS k, ['BUILDING', 'MACHINERY', 'NONE'] AS s FROM nation)
 SELECT k, array_to_string(list_sort(list_distinct(list_concat(a.s, b.s))), ',') AS union_, array_to_string(list_sort(list_intersect(a.s, b.s)), ',') AS both_,
  array_to_string(list_sort(list_filter(a.s, lambda x: NOT list_contains(b.s, x))), ',') AS only_a FROM a JOIN b USING (k)""")
def array_sets(spark, sf):
    """Union, intersection and difference of tag arrays."""
    a = inputs.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_set("c_mktsegment").alias("s"))
    b = inputs.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    t = F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("NONE"))
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return a.join(b, "k").select("k", join(F.array_union("s", t)).alias("union_"), join(F.array_intersect("s", t)).alias("both_"), join(F.array_except("s", t)).alias("only_a"))


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders_, round(sum(o_totalprice), 2) AS total
 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def dimension_join(spark, sf):
    """Star join: orders by nation and region."""
    t = lambda n: inputs.table(spark, sf, n)
    by = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    geo = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t("customer").join(by, "c_custkey", "left").join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders_"), F.round(F.sum("total"), 2).alias("total"))


@query("""SELECT d, (sum(v) FILTER (WHERE t = 'click'))::BIGINT AS click, (sum(v) FILTER (WHERE t = 'view'))::BIGINT AS view_, (sum(v) FILTER (WHERE t = 'error'))::BIGINT AS error_
 FROM (SELECT ts::DATE AS d, event_type AS t, 1 AS v FROM events) GROUP BY 1""")
def pivot_counts(spark, sf):
    """Events of three types side by side for each day."""
    e = inputs.table(spark, sf, "events").groupBy(F.to_date("ts").alias("d")).pivot("event_type", ["click", "view", "error"]).agg(F.count(F.lit(1)))
    return e.select("d", "click", F.col("view").alias("view_"), F.col("error").alias("error_"))


@query("""WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n, event_type FROM events)
 SELECT event_type, n, mid, p90, round(top5, 8) AS top5_share, round(p95, 8) AS p95_exclusive FROM (
  SELECT event_type, count(*) AS n, list(value ORDER BY value)[count(*) // 2 + 1] AS mid, list(value ORDER BY value)[(floor(count(*) * 0.9))::BIGINT + 1] AS p90,
   list_sum(list(value ORDER BY value)[(floor(count(*) * 0.95))::BIGINT + 1:]) / sum(value) AS top5,
   list(value ORDER BY value)[(floor((count(*) + 1) * 0.95))::BIGINT] + ((count(*) + 1) * 0.95 - floor((count(*) + 1) * 0.95))
    * (list(value ORDER BY value)[(floor((count(*) + 1) * 0.95))::BIGINT + 1] - list(value ORDER BY value)[(floor((count(*) + 1) * 0.95))::BIGINT]) AS p95
  FROM events GROUP BY 1)""")
def index_percentiles(spark, sf):
    """Upper median, index percentile, share of the top twentieth and exclusive 95th percentile, by ranks (no group is gathered in an array)."""
    w = Window.partitionBy("event_type")
    e = inputs.table(spark, sf, "events").select("event_type", "value", F.row_number().over(w.orderBy("value")).alias("i"))
    e = e.withColumn("n", F.count(F.lit(1)).over(w))
    n, i, v = F.col("n"), F.col("i"), F.col("value")
    pos = (n + 1) * F.lit(0.95)
    at = lambda k: F.max(F.when(i == k, v))
    low, high = at(F.floor(pos)), at(F.floor(pos) + 1)
    return e.groupBy("event_type").agg(
        F.max("n").alias("n"), at(F.floor(n / 2) + 1).alias("mid"), at(F.floor(n * 0.9) + 1).alias("p90"),
        F.round(F.sum(F.when(i > F.floor(n * 0.95), v)) / F.sum("value"), 8).alias("top5_share"),
        F.round(low + F.max(pos - F.floor(pos)) * (high - low), 8).alias("p95_exclusive"),
    )
