"""Structured Streaming: headlines to mentions, ticks to minutes, alerts to sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import narratives


def folder(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def fresh(headlines: DataFrame, title: str, at: str, late: str = "30 days") -> DataFrame:
    """One of each title hash within the watermark."""
    return headlines.withColumn("title_hash", T.title_hash(F.col(title))).withWatermark(at, late).dropDuplicatesWithinWatermark(["title_hash"])


def mentions(headlines: DataFrame) -> DataFrame:
    """Trigger mentions of a stream of headlines."""
    return narratives.stream_mentions(headlines)


def minutes(ticks: DataFrame, at: str = "ts", late: str = "2 minutes") -> DataFrame:
    """Tumbling one-minute bars of a stream of ticks, closed by the watermark."""
    w = F.window(at, "1 minute")
    return ticks.withWatermark(at, late).groupBy("symbol", w).agg(
        F.count(F.lit(1)).alias("n"), F.sum("close").alias("volume"), F.max("close").alias("high"), F.min("close").alias("low")
    ).select("symbol", F.col("window.start").alias("minute"), "n", "volume", "high", "low")


def silent(ticks: DataFrame, at: str, seconds: int = 120) -> DataFrame:
    """Sessions of each symbol that a silence of more than `seconds` has ended."""
    s = F.session_window(at, f"{seconds} seconds")
    return ticks.withWatermark(at, "2 minutes").groupBy("symbol", s).agg(F.count(F.lit(1)).alias("n")).select("symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def publish(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Runs all input there is through write(batch, number); the checkpoint makes each batch count once for consumers that key by its number."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def drained(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Appends everything a stream has to a Parquet folder and waits."""
    rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
