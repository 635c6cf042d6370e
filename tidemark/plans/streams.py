"""Streaming queries: the same operators over file streams, drained to a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import narratives
from ..streaming import feeds
from . import inputs
from .narratives import _feed
from .registry import query


def _place(spark) -> str:
    """A new folder among the shared ones."""
    return f"{inputs.shared(spark)}/stream-{uuid.uuid4().hex}"


@query()
def stream_headlines(spark, sf):
    """Trigger mentions of a stream of headline files (equal to the batch fold over the same order)."""
    at = _place(spark)
    feed = _feed(spark, sf).where("category <> 'opinion'")
    feed.coalesce(1).sortWithinPartitions("published_at", "headline_id").write.option("maxRecordsPerFile", 1_000_000).parquet(f"{at}/in")
    rows = feeds.mentions(feeds.folder(spark, f"{at}/in", feed.schema))
    feeds.drained(rows, f"{at}/out", f"{at}/state")
    m = spark.read.schema(rows.schema).parquet(f"{at}/out")
    return m.select("headline_id", "trigger_id", "signature", "is_novel", F.round("similarity", 6).alias("similarity"), "state", "mention_count")


@query("""WITH m AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS minute, count(*) AS n, sum(value) AS volume, max(value) AS high, min(value) AS low FROM events GROUP BY 1, 2)
 SELECT symbol, minute, n, round(volume, 6) AS volume, high, low FROM m WHERE minute + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 2 MINUTE FROM events)""")
def stream_minutes(spark, sf):
    """One-minute bars of a stream of ticks, those the watermark has closed."""
    at = _place(spark)
    t = inputs.ticks(spark, sf)
    t.write.parquet(f"{at}/in")
    bars = feeds.minutes(feeds.folder(spark, f"{at}/in", t.schema, 1000))
    feeds.drained(bars, f"{at}/out", f"{at}/state")
    return spark.read.schema(bars.schema).parquet(f"{at}/out").select("symbol", "minute", "n", F.round("volume", 6).alias("volume"), "high", "low")


def batch_mentions(spark, sf):
    """The batch form of `stream_headlines`, for tests."""
    return narratives.mentions(_feed(spark, sf))
