"""The bounded, deterministic sample on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 3, 1


def held_out(column: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 3 is 1: never learned from. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def labelled(rows: DataFrame, label: str, per_label: int) -> list:
    """About per_label rows of each label among rows(doc_id, text, label), learning folds only.

    The share of each label that is drawn follows from its count; rows are
    chosen by a hash of doc_id. Only the chosen rows reach the driver: at
    most per_label, four standard deviations above it at the very worst, for
    each label. Returns (text, label, share of the label in all rows).
    """
    usable = rows.where(~held_out()).where(F.col(label).isNotNull() & F.col("text").isNotNull())
    counts = {r[label]: r["count"] for r in usable.groupBy(label).count().collect()}
    total = sum(counts.values())
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    wanted = F.lit(False)
    for value, n in counts.items():
        wanted = wanted | ((F.col(label) == F.lit(value)) & (draw < F.lit(min(1 << 30, (per_label << 30) // n))))
    got = usable.where(wanted).select("doc_id", "text", label).collect() if counts else []
    got.sort(key=lambda r: (r["doc_id"], str(r[label]), r["text"]))
    return [(r["text"], r[label], counts[r[label]] / total) for r in got]
