"""Readers for archived feeds: fetched files in, typed rows out. Fetching itself stays outside Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V

KLINE = "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, trades long, taker_buy_base double, taker_buy_quote double, ignored string"
DEPTH = "timestamp string, percentage double, depth double, notional double"


def epoch(raw: Column) -> Column:
    """A time in micro- or milliseconds since 1970, told apart by size."""
    return F.when(raw > 100_000_000_000_000, F.timestamp_micros(raw)).otherwise(F.timestamp_millis(raw))


def klines(spark: SparkSession, path: str, symbol: str | Column) -> DataFrame:
    """Candles from CSV files with or without a header line: symbol, ts, open ... taker_buy_quote."""
    rows = spark.read.schema(KLINE).option("mode", "PERMISSIVE").csv(path).where("open_time is not null and close is not null")
    name = F.lit(symbol) if isinstance(symbol, str) else symbol
    return rows.select(name.alias("symbol"), epoch(F.col("open_time")).alias("ts"), "open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base", "taker_buy_quote")


def checked_takers(rows: DataFrame, most: float = 0.01) -> DataFrame:
    """rows, or an error when they run if more than a hundredth have taker volume outside the volume (columns swapped)."""
    odd = ~F.col("taker_buy_base").between(F.lit(0.0), 1.0001 * F.col("volume"))
    share = rows.agg((F.count_if(odd) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("_odd"))
    guarded = rows.join(F.broadcast(share))  # one row
    return guarded.where(F.when(F.col("_odd") <= most, F.lit(True)).otherwise(F.raise_error(F.lit("taker volume lies outside the volume")).cast("boolean"))).drop("_odd")


def book_depth(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """symbol, ts, pct, depth, notional; fractional and zero bands are left out, two time formats are read."""
    rows = spark.read.schema(DEPTH).csv(path, header=True)
    ts = F.coalesce(F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss")), epoch(F.expr("try_cast(timestamp as bigint)")))
    whole = (F.col("percentage") == F.floor("percentage")) & (F.col("percentage") != 0)
    return rows.where(whole).select(F.lit(symbol).alias("symbol"), ts.alias("ts"), F.col("percentage").cast("short").alias("pct"), "depth", "notional").where("ts is not null")


def gkg(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Tab-separated news records whose address, names or organisations match: ts, url, tone, title. Short rows give nulls."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    hit = F.lower(F.concat_ws(" ", at(4), at(23), at(13))).rlike(pattern)
    ts = F.try_to_timestamp(F.substring(at(1), 1, 14), F.lit("yyyyMMddHHmmss"))
    return parts.where(hit).select(ts.alias("ts"), at(4).alias("url"), F.expr("try_cast(split(get(c, 15), ',')[0] as double)").alias("tone"))


def feed_entries(rows: DataFrame, as_of: Column, max_days: int = 7) -> DataFrame:
    """Feed entries with a title of ten characters or more, not older than a week, at the first date that can be read."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "^[A-Za-z]{3}, ", ""), "(GMT|UTC|Z)$", "+0000")
    dates = [x for c in ("published", "updated") for x in (F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(bare(c), F.lit("d MMM yyyy HH:mm:ss Z")))]
    at = F.coalesce(*dates, as_of)
    return rows.withColumn("published_at", at).where((F.char_length(F.trim("title")) >= 10) & (F.col("published_at") >= as_of - F.make_dt_interval(F.lit(max_days))))


def data_island(html: Column, schema: str) -> Column:
    """The JSON that a page carries in its __NEXT_DATA__ script."""
    return F.from_json(F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), schema)


def objects(text: str) -> Iterator[dict]:
    """Complete objects of a JSON array whose end may be missing."""
    decoder, at = json.JSONDecoder(), text.find("[") + 1
    while (at := text.find("{", at)) >= 0:
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            return
        yield value


def salvaged(responses: DataFrame, column: str) -> DataFrame:
    """One row, `object` as JSON text, for every complete object of truncated array responses."""

    def run(batches):
        for pdf in batches:
            pdf = pdf.assign(object=[[json.dumps(o) for o in objects(t or "")] for t in pdf[column]])
            yield pdf[["object"]].explode("object").dropna()

    return responses.select(column).mapInPandas(run, "object string")


def query_batches(keywords: Sequence[str], longest: int) -> list[str]:
    """OR-queries of quoted keywords, each of at most `longest` characters; one keyword may be longer."""
    out: list[str] = []
    for k in keywords:
        term = f'"{k}"' if " " in k else k
        if out and len(out[-1]) + 4 + len(term) <= longest:
            out[-1] += f" OR {term}"
        else:
            out.append(term)
    return out


def slots(spark: SparkSession, start: str, end: str, minutes: int = 15) -> DataFrame:
    """Archive times from start to end."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval {minutes} minutes"))).alias("slot"))


def tradeable(rows: DataFrame, symbol: str, quote: str) -> DataFrame:
    """Symbols of plain letters and digits in this quote, without leveraged tokens, stable coins and tokenised stocks."""
    s = F.col(symbol)
    base = F.substring(s, 1, F.char_length(s) - len(quote))
    ok = s.rlike("^[A-Za-z0-9]+$") & s.endswith(quote) & (F.char_length(s) > len(quote)) & ~base.isin(*V.STABLE_BASES)
    for tail in V.LEVERAGED_SUFFIXES:
        ok = ok & ~s.endswith(tail)
    stock = base.endswith("B") & ~base.isin(*V.B_CRYPTO) & base.rlike("^[A-Z]{2,5}B$")
    return rows.where(ok & ~stock)


def option_name(name: Column) -> Column:
    """Struct(asset, expiry, strike, otype) of a name like ETH-21JUN26-2200-C."""
    p = F.split(name, "-")
    return F.struct(p[0].alias("asset"), F.to_date(F.initcap(p[1]), "dMMMyy").alias("expiry"), p[2].cast("double").alias("strike"), p[3].alias("otype"))


def scaled_iv(rows: DataFrame, column: str) -> DataFrame:
    """Volatilities as fractions: percent units are recognised by a median above 1.5."""
    mid = rows.agg(F.percentile(column, 0.5).alias("_mid"))
    return rows.join(F.broadcast(mid)).withColumn(column, F.when(F.col("_mid") > 1.5, F.col(column) / 100).otherwise(F.col(column))).drop("_mid")  # one row


def progressing(pages: DataFrame, by: Sequence[str], page: str, ts: str) -> DataFrame:
    """Rows of pages read forwards, up to the first page that brings no later time than all before it: from there a source repeats itself."""
    last = pages.groupBy(*by, page).agg(F.max(ts).alias("_last"))
    w = Window.partitionBy(*by).orderBy(page)
    before = F.max("_last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    stuck = last.withColumn("_stuck", F.coalesce(F.col("_last") <= before, F.lit(False)))
    first = stuck.where("_stuck").groupBy(*by).agg(F.min(page).alias("_end"))
    return pages.join(first, list(by), "left").where(F.col("_end").isNull() | (F.col(page) < F.col("_end"))).drop("_end")


def continued(rows: DataFrame, by: Sequence[str], ts: str, value: str, as_of: Column) -> DataFrame:
    """A daily volatility history read backwards in overlapping pages: one row a time, the unfinished day left out, levels as fractions."""
    done = rows.where(F.to_date(ts) < F.to_date(as_of)).groupBy(*by, ts).agg(F.max(value).alias(value))
    return scaled_iv(done, value)


def complete_listings(pages: DataFrame, listing: str = "listing", page: str = "page", more: str = "truncated") -> DataFrame:
    """Pages of listings that were read to their end: numbered from 0 without gaps, and only the last not truncated."""
    own = pages.groupBy(listing).agg(F.countDistinct(page).alias("n"), F.min(page).alias("lo"), F.max(page).alias("hi"), F.max_by(more, page).alias("open"), F.count_if(~F.col(more)).alias("ends"))
    whole = own.where("lo = 0 and hi = n - 1 and not open and ends = 1").select(listing)
    return pages.join(whole, listing, "left_semi")


def daily_returns(rows: DataFrame, by: Sequence[str], day: str, close: str) -> DataFrame:
    """rows with daily_return: each close against the last one before it that is not null; null where there is none."""
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("daily_return", F.try_divide(F.col(close), F.last(close, ignorenulls=True).over(w)) - 1)


def with_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """df with missing columns added as nulls of their type, in the wanted order."""
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()])
