"""Training sets: walk-forward splits, class weights, review order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def walk_forward(rows: DataFrame, ts: str, ties: Sequence[str], train: float = 0.7, validate: float = 0.15) -> DataFrame:
    """rows with `split`: the first int(n * train) in order are train, up to int(n * (train + validate)) val, the rest test.

    Places come from counts by hour and the place inside the hour.
    """
    hourly = rows.withColumn("_hour", F.date_trunc("hour", ts))
    counts = hourly.groupBy("_hour").agg(F.count(F.lit(1)).alias("_n"))
    so_far = F.sum("_n").over(Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, 0))
    before = counts.select("_hour", (so_far - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    i = F.row_number().over(Window.partitionBy("_hour").orderBy(ts, *ties)) + F.col("_before")
    split = F.when(i <= F.floor(F.col("_all") * train), "train").when(i <= F.floor(F.col("_all") * (train + validate)), "val").otherwise("test")
    return hourly.join(before, "_hour").withColumn("split", split).drop("_hour", "_before", "_all")


def class_weights(rows: DataFrame, label: str, classes: int) -> DataFrame:
    """Inverse counts of the classes, scaled to sum to their number; `classes` may count some that are absent, taken as one row each."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row a class
    total = F.sum(1 / F.col("n")).over(every) + (classes - F.count(F.lit(1)).over(every))
    return n.withColumn("weight", 1 / F.col("n") / total * classes)


def review_order(rank: dict[str, int], category: str, size: Column) -> list[Column]:
    """Order of a review queue: category rank, then the largest moves."""
    place = F.lit(len(rank))
    for name, r in rank.items():
        place = F.when(F.col(category) == name, r).otherwise(place)
    return [place, F.abs(size).desc()]


def spliced(archive: DataFrame, newer: DataFrame, by: Sequence[str], day: str) -> DataFrame:
    """An archive continued by the rows of a newer source after its last day; series the archive lacks come whole."""
    last = archive.groupBy(*by).agg(F.max(day).alias("_last"))
    after = newer.join(last, list(by), "left") if by else newer.join(F.broadcast(last))  # one row
    return archive.unionByName(after.where(F.col("_last").isNull() | (F.col(day) > F.col("_last"))).select(*archive.columns))
