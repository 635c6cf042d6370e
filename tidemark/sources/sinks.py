"""Where results go: files in common formats, and batches of a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame




def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Parquet, in one folder for each value of `by`; folders of other values stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def inserting(known: Callable[[], DataFrame], path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends the rows whose keys `known` does not hold: run again, it adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        old = known()
        new = batch.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
        new.write.mode("append").parquet(path)

    return write


