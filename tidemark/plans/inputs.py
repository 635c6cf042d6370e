"""The driver's tables in the roles of the domain, as DataFrames and as SQL.

events: ticks of a symbol (event_type); orders: signed daily flows; lineitem:
a daily price; documents: headlines, published one minute apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one machine may do with its warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir") + "/shared"
    return path.rstrip("/")


def ticks(spark, sf_dir) -> DataFrame:
    """symbol, ts, close, event_id, user_id."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("close"), "event_id", "user_id")


TICKS = "SELECT event_type AS symbol, ts, value AS close, event_id, user_id FROM events"


def daily_close(spark, sf_dir) -> DataFrame:
    """symbol, d, close: the last tick of each day."""
    t = ticks(spark, sf_dir)
    return t.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.max_by("close", F.struct("ts", "event_id")).alias("close"))


DAILY = "SELECT event_type AS symbol, ts::DATE AS d, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2"


def hourly(spark, sf_dir) -> DataFrame:
    """symbol, timestamp, open, high, low, close, volume by hour."""
    t = ticks(spark, sf_dir)
    key = F.struct("ts", "event_id")
    return t.groupBy("symbol", F.date_trunc("hour", "ts").alias("timestamp")).agg(
        F.min_by("close", key).alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", key).alias("close"), F.count(F.lit(1)).alias("volume")
    )


HOURLY = """SELECT event_type AS symbol, date_trunc('hour', ts) AS timestamp, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
  min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2"""


def flows(spark, sf_dir) -> DataFrame:
    """d, flow: order value by day, finished orders counted in, open ones out."""
    o = table(spark, sf_dir, "orders")
    sign = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", -1.0).otherwise(0.0)
    return o.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum(F.col("o_totalprice") * sign).alias("flow"))


FLOWS = "SELECT o_orderdate::DATE AS d, sum(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END) AS flow FROM orders GROUP BY 1"


def price(spark, sf_dir) -> DataFrame:
    """d, close: the mean unit price of a day's shipments, averaged over 30 days with shipments."""
    day = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    w = Window.partitionBy(F.lit(0)).orderBy("d").rowsBetween(-29, 0)
    return day.select("d", F.avg("p").over(w).alias("close"))


PRICE = """SELECT d, avg(p) OVER (ORDER BY d ROWS 29 PRECEDING) AS close
  FROM (SELECT l_shipdate::DATE AS d, avg(l_extendedprice / l_quantity) AS p FROM lineitem GROUP BY 1)"""


def lines(spark, sf_dir) -> DataFrame:
    """symbol, d, close of seven names, one for each line of an order: as `price`, of that line's shipments."""
    name = F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("symbol")
    day = table(spark, sf_dir, "lineitem").groupBy(name, F.to_date("l_shipdate").alias("d")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    return day.select("symbol", "d", F.avg("p").over(Window.partitionBy("symbol").orderBy("d").rowsBetween(-29, 0)).alias("close"))


LINES = """SELECT symbol, d, avg(p) OVER (PARTITION BY symbol ORDER BY d ROWS 29 PRECEDING) AS close
  FROM (SELECT 'line' || l_linenumber AS symbol, l_shipdate::DATE AS d, avg(l_extendedprice / l_quantity) AS p FROM lineitem GROUP BY 1, 2)"""


def headlines(spark, sf_dir) -> DataFrame:
    """headline_id, title (the whole text), lang, source, published_at."""
    d = table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    return d.select(F.col("doc_id").alias("headline_id"), F.col("text").alias("title"), "lang", "source", at.alias("published_at"))


HEADLINES = "SELECT doc_id AS headline_id, text AS title, lang, source, TIMESTAMP '2024-01-01' + to_minutes(doc_id::INT) AS published_at FROM documents"
