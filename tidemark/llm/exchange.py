"""Moving compact binary blocks between tasks, and tables that outlive executors."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import trim

BLOCK = "part int, block binary"
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.binary())])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a session of one machine (master local) keeps its
    tables beside its warehouse; on a cluster that would be no shared folder,
    so the setting is asked for.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext.getCheckpointDir()
        path = os.path.dirname(known.rstrip("/")) if known else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by `stored` that nothing reads any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        fs, inner = pafs.FileSystem.from_uri(folder)
        fs.delete_dir(inner)


def plain_scan(df: DataFrame) -> bool:
    """Whether df is read from files through projections and filters only, so that every scan has the same partitions."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.deterministic() and plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return plan.nodeName().startswith("LogicalRelation") or plan.nodeName().startswith("Relation")


def parts(spark: SparkSession, units: int = 0, each: int = 1) -> int:
    """Parts to deal to: the session's shuffle partitions, or more where a part would get over `each` of the units."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units // each))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, counted over all rows."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def hot_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined (left outer) with right, which has each key once; a key may hold any share of left.

    Keys that hold more than a quarter of an even part of left, of which there
    can be no more than four times the number of parts, are joined by
    broadcast, the others by a shuffle; left should be a stored table.
    """
    sizes = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    seen = sizes.agg(F.sum("rows").alias("total"), F.max("rows").alias("most")).first()
    level = max(1000, (seen["total"] or 0) // (4 * parts(left.sparkSession)))
    hot = [r[key] for r in sizes.where(F.col("rows") > level).select(key).collect()] if (seen["most"] or 0) > level else []  # at most four keys a part
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    rest = left.where(~is_hot).join(right.where(~is_hot), key, "left")
    return rest.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, "left"))


def dealt(df: DataFrame, n: int) -> DataFrame:
    """Rows moved to the partition that their column `part` names, without hashing it."""
    return df.repartitionById(n, F.col("part"))


def blocks(ids: np.ndarray, n: int, pack) -> pa.RecordBatch:
    """One row for each part that occurs in ids (0 to n - 1); pack(rows) gives its bytes."""
    order = np.argsort(ids, kind="stable")
    cuts = np.searchsorted(ids[order], np.arange(n + 1))
    used = np.flatnonzero(np.diff(cuts))
    rows = [pack(order[cuts[i] : cuts[i + 1]]) for i in used]
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(rows, pa.binary())], schema=_ARROW)


def read_blocks(batches, kind: np.dtype) -> np.ndarray:
    """All records of a partition's blocks as one structured array."""
    trim()
    found = [np.frombuffer(b, kind) for batch in batches for b in (x.as_buffer() for x in batch.column("block")) if len(b)]
    return np.concatenate(found) if found else np.zeros(0, kind)


def spread(h: np.ndarray, n: int) -> np.ndarray:
    """Part 0 to n - 1 of a 64-bit hash, from its high bits."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


class HotKeys:
    """Keys with a large share of all records, and into how many parts each is dealt."""

    def __init__(self, keys: list[int], salts: list[int]):
        order = np.argsort(np.array(keys, np.int64).view(np.uint64))
        self.keys, self.salts = np.array(keys, np.int64).view(np.uint64)[order], np.array(salts, np.uint64)[order]

    def of(self, key: np.ndarray) -> np.ndarray:
        """Parts of each key: 0 for those that are not hot."""
        if not len(self.keys):
            return np.zeros(len(key), np.uint64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.salts[at], 0).astype(np.uint64)


def small_ids(df: DataFrame, column: str, limit: int = 1 << 18) -> tuple[DataFrame, bool]:
    """The distinct values of a column as a stored table, and whether there are few enough to broadcast."""
    ids = stored(df.select(column).distinct(), "ids")
    return ids, ids.count() <= limit


def keep_ids(df: DataFrame, key: Column | str, ids: DataFrame, few: bool, column: str) -> DataFrame:
    """Rows of df whose key is among ids; ids is broadcast only where its counted size allows."""
    right = F.broadcast(ids) if few else ids
    return df.join(right, F.col(key) == ids[column] if isinstance(key, str) else key == ids[column], "left_semi")
