"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone, by the
public jump consistent hash (Lamping and Veach, 2014); there is no table of
ring points, and with one more shard a row either stays or goes to the new one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .exchange import parts
from .words import mix

SHARDS = 40


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard 0 to n - 1 of each 64-bit key: the last jump target below n."""
    key = keys.astype(np.uint64)
    shard, target = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = target[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        target[live] = ((shard[live] + 1) * (2147483648.0 / draw)).astype(np.int64)
        live = live[target[live] < n]
    return shard


def _jumps(counts):
    def run(batches):
        for b in batches:
            key = mix(b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
            names = [*b.schema.names, *(f"shard_{n}" for n in counts)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(jump(key, n).astype(np.int32)) for n in counts)], names=names)

    return run


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The shard of every row of docs(doc_id, text).

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law
    ("key"), shard, slot (0, 1, ... within a shard without gaps) and
    grown_shard, the shard with one more of them. Null texts count no bytes
    and have the checksum of the empty text. Rows with the same doc_id share
    a shard; a null doc_id is keyed as 0. Slots go by bucket of the doc_id's
    hash, then doc_id, size and checksum; rows equal in all of these take
    consecutive slots. Other columns are ignored; an empty table gives an
    empty result.

    Slots need no sort of a whole shard: rows are numbered inside buckets of
    a shard and counts of the buckets, of which there are a fixed number to a
    shard, give each bucket's first slot.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    kind = f"doc_id long, size long, text_crc32 long, shard_{shards} int, shard_{shards + 1} int"
    rows = cols.mapInArrow(_jumps((shards, shards + 1)), kind).withColumnsRenamed({f"shard_{shards}": "shard", f"shard_{shards + 1}": "grown_shard"})
    buckets = max(1, parts(spark) * 4 // shards + 1)
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")
    rows = rows.select("*", bucket)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_jumps((shards,)), f"doc_id long, shard_{shards} int")
    counts = ids.select(F.col(f"shard_{shards}").alias("shard"), bucket).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32"))
    numbered = rows.withColumn("inner", inner)
    small = F.broadcast(before)  # shards * buckets rows: bounded by the number of shuffle partitions, not by the data
    return numbered.join(small, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("inner") - 1 + F.col("before")).alias("slot"), "grown_shard"
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """docs as Parquet in one folder for each shard, shard=0 and so on.

    A column of docs that is itself named shard is kept as shard_before.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`").alias("shard_before" if c == "shard" else c) for c in docs.columns)).alias("row"))
    kind = StructType([*plain.schema.fields, StructField(f"shard_{shards}", IntegerType())])
    rows = plain.mapInArrow(_jumps((shards,)), kind).withColumnRenamed(f"shard_{shards}", "shard_no")
    rows.select("row.*", F.col("shard_no").alias("shard")).write.partitionBy("shard").parquet(path)
