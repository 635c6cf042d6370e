"""Write semantics of keyed tables, as DataFrames over immutable files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ignore(known: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert, ignoring conflicts: known rows stay, rows with new keys are added, one for each key."""
    return known.unionByName(rows.dropDuplicates(list(keys)).join(known.select(*keys), list(keys), "left_anti").select(*known.columns))


def replace(known: DataFrame, rows: DataFrame, keys: Sequence[str], recency: str) -> DataFrame:
    """Upsert: of all rows with a key, that with the largest recency (ties: the new table's)."""
    both = known.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    rest = [c for c in known.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(recency, "_new")).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*known.columns)


def incremented(known: DataFrame, rows: DataFrame, keys: Sequence[str], counter: str) -> DataFrame:
    """Upsert whose conflicts count: a key's counter grows by its number of new rows; new keys start at theirs."""
    new = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast(known.schema[counter].dataType).alias("_add"))
    both = known.withColumn("_add", F.lit(0).cast(known.schema[counter].dataType)).unionByName(new.withColumn(counter, F.lit(0).cast(known.schema[counter].dataType)), allowMissingColumns=True)
    rest = [c for c in known.columns if c not in (*keys, counter)]
    return both.groupBy(*keys).agg(F.sum(F.col(counter) + F.col("_add")).alias(counter), *(F.max(c).alias(c) for c in rest)).select(*known.columns)


def counted(known: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many of rows an insert would add and how many it would skip."""
    new = rows.dropDuplicates(list(keys)).join(known.select(*keys).distinct(), list(keys), "left_anti").agg(F.count(F.lit(1)).alias("inserted"))
    return rows.agg(F.count(F.lit(1)).alias("total")).crossJoin(new).select("inserted", (F.col("total") - F.col("inserted")).alias("skipped"))  # one row each


def retained(rows: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows not older than a number of days."""
    return rows.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def unconsumed(alerts: DataFrame, limit: int, order: str = "id") -> DataFrame:
    """The oldest alerts no consumer has taken yet: a page for catching up."""
    return alerts.where(F.col("consumed_at").isNull()).orderBy(order).limit(limit)


def acknowledged(alerts: DataFrame, taken: DataFrame, consumer: str, at: Column, key: str = "id") -> DataFrame:
    """Alerts with consumed_at and acked_by set for those taken."""
    marked = taken.select(key, F.lit(True).alias("_taken")).distinct()
    hit = F.col("_taken") & F.col("consumed_at").isNull()
    out = alerts.join(marked, key, "left")
    return out.withColumn("acked_by", F.when(hit, F.lit(consumer)).otherwise(F.col("acked_by"))).withColumn("consumed_at", F.when(hit, at).otherwise(F.col("consumed_at"))).drop("_taken")


def remapped(rows: DataFrame, ids: DataFrame, column: str, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """Rows whose id is re-pointed by a map, exact repeats dropped."""
    out = rows.join(ids.select(F.col(old).alias("_old"), F.col(new).alias("_new")), F.col(column) == F.col("_old"), "left")
    return out.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new").dropDuplicates()
