"""Training splits, review queues, routed schedules, spliced histories, calibrated noise."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import narratives, outcomes, training
from ..sources import sinks
from . import inputs
from .narratives import _feed
from .registry import query


@query("""WITH d AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM documents JOIN labels USING (doc_id)),
 s AS (SELECT quality, CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * (0.7 + 0.15)) THEN 'val' ELSE 'test' END AS split FROM d) SELECT split, quality, count(*) AS n FROM s GROUP BY 1, 2""")
def training_split(spark, sf):
    """Labelled documents in time order, cut at 70 and 85 percent."""
    d = inputs.headlines(spark, sf).join(inputs.table(spark, sf, "labels").withColumnRenamed("doc_id", "headline_id"), "headline_id")
    return training.walk_forward(d, "published_at", ["headline_id"]).groupBy("split", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT lang, n, round(1.0::DOUBLE / n / (sum(1.0::DOUBLE / n) OVER () + 6 - count(*) OVER ()) * 6, 8) AS weight FROM n""")
def class_weights(spark, sf):
    """Inverse-frequency weights of languages, of six possible."""
    return training.class_weights(inputs.table(spark, sf, "documents"), "lang", 6).withColumn("weight", F.round("weight", 8))


@query("""SELECT doc_id, lang, n_chars FROM documents ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, abs(n_chars - 1500) DESC, doc_id LIMIT 30""")
def review_queue(spark, sf):
    """The first thirty documents to look at."""
    order = training.review_order({"de": 0, "fr": 1}, "lang", F.col("n_chars") - 1500)
    return inputs.table(spark, sf, "documents").orderBy(*order, "doc_id").limit(30).select("doc_id", "lang", "n_chars")


_ROUTE = " ".join(f"WHEN '{c}' THEN {list(a)!r}::VARCHAR[]" for c, a in V.ROUTES.items())


@query(f"""WITH e AS (SELECT event_id AS trigger_id, ts, (['geopolitical', 'macro', 'opinion', 'other'])[event_id % 4 + 1] AS category FROM events WHERE event_type = 'signup'),
 a AS (SELECT trigger_id, ts, category, unnest(CASE category {_ROUTE} ELSE [] END) AS asset FROM e) SELECT category, asset, h AS horizon_minutes, count(*) AS n, max(ts + to_minutes(h)) AS last_target FROM a, (VALUES (60), (240), (1440)) x(h) GROUP BY ALL""")
def routed_schedule(spark, sf):
    """Outcomes scheduled on the assets of each category; unknown categories get none."""
    e = inputs.table(spark, sf, "events").where("event_type = 'signup'")
    cat = F.element_at(F.array(*map(F.lit, ("geopolitical", "macro", "opinion", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = e.select(F.col("event_id").alias("trigger_id"), F.col("ts").cast("timestamp").alias("trigger_fired_at"), cat.alias("category"))
    s = outcomes.schedule(rows, [], routes=V.ROUTES)
    return s.groupBy("category", "asset", "horizon_minutes").agg(F.count(F.lit(1)).alias("n"), F.max("target_at").alias("last_target"))


@query(f"""WITH p AS ({inputs.PRICE}), a AS (SELECT d, close, 'archive' AS source FROM p WHERE d < DATE '1998-01-01'), n AS (SELECT d, close * 1.01 AS close, 'newer' AS source FROM p WHERE d >= DATE '1997-06-01')
 SELECT d, source, round(close, 6) AS close FROM (SELECT * FROM a UNION ALL SELECT * FROM n WHERE d > (SELECT max(d) FROM a))""")
def spliced_history(spark, sf):
    """An archived price carried on by a newer source."""
    p = inputs.price(spark, sf)
    old = p.where(F.col("d") < F.lit("1998-01-01").cast("date")).withColumn("source", F.lit("archive"))
    new = p.where(F.col("d") >= F.lit("1997-06-01").cast("date")).withColumn("close", F.col("close") * 1.01).withColumn("source", F.lit("newer"))
    return training.spliced(old, new, [], "d").select("d", "source", F.round("close", 6).alias("close"))


@query()
def replay_report(spark, sf):
    """What a replay of the feed made: headlines, novel ones, directions and states by category."""
    m = narratives.mentions(_feed(spark, sf))
    return m.groupBy("category").agg(
        F.count(F.lit(1)).alias("headlines"), F.count_if("is_novel").alias("novel"), F.countDistinct("trigger_id").alias("triggers"), F.count_if(F.col("direction") == "escalation").alias("escalation"),
        F.round(F.percentile("similarity", 0.5), 6).alias("median_similarity"), F.round(100.0 * (1 - F.count_if("is_novel") / F.count(F.lit(1))), 4).alias("suppressed_pct"),
    )


@query()
def noise_band(spark, sf):
    """Edges that crossings of pure noise show: mean and deviation over sixty seeded histories, each a group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seed = int(pdf["seed"].iloc[0])
        rng = np.random.default_rng(seed)
        flow, px = rng.normal(size=600), np.exp(np.cumsum(rng.normal(0, 0.02, 600)))
        s = pd.Series(flow).rolling(5).sum()
        low = (s < s.expanding(60).quantile(0.1).shift(1)).to_numpy()
        enter = np.flatnonzero(low[1:] & ~low[:-1]) + 1
        ahead = np.array([px[t + 1 : t + 15].min() / px[t] - 1 <= -0.05 if t + 15 <= len(px) else np.nan for t in range(len(px))], float)
        hit = ahead[enter][~np.isnan(ahead[enter])]
        return pd.DataFrame([(seed, len(hit), 100 * (float(hit.mean()) - float(np.nanmean(ahead))) if len(hit) else None)], columns=["seed", "n", "edge_pp"])

    runs = spark.range(60).withColumnRenamed("id", "seed").groupBy("seed").applyInPandas(one, "seed long, n long, edge_pp double")
    return runs.agg(F.count("edge_pp").alias("runs"), F.sum("n").alias("events"), F.round(F.avg("edge_pp"), 6).alias("mean_edge"), F.round(F.stddev_pop("edge_pp"), 6).alias("std_edge"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf):
    """A table written as CSV with a header and read back."""
    path = f"{inputs.shared(spark)}/csv-{uuid.uuid4().hex}"
    t = inputs.table(spark, sf, "nation")
    sinks.csv(t, path)
    return spark.read.schema(t.schema).option("header", True).csv(path)
