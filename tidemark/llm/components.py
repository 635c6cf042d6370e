"""Connected components of a link table, without a graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """Root of every node that has a link to another.

    links: columns u and v, any order, repeats allowed; nulls and self links
    are ignored. Returns node, root with root the smallest node reachable;
    nodes without links are absent. An empty table gives an empty one.

    Every round keeps each node's smallest neighbour, hangs its other
    neighbours on that one and halves the paths, so the number of rounds
    grows with the logarithm of the longest path. Sums by node combine before
    they are shuffled, and a node that many point to is only ever the probe
    side of a join, which adaptive execution splits where it is skewed. A
    round's table goes once the next one is written.
    """
    up = links.where("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("p")).distinct()
    up = stored(up, "links")
    while True:
        low = up.groupBy("v").agg(F.min("p").alias("m"), F.count(F.lit(1)).alias("n"))
        hung = up.join(low, "v").select(
            F.explode(
                F.when(F.col("p") == F.col("m"), F.array(F.struct("v", F.col("m").alias("p")))).otherwise(F.array(F.struct(F.col("p").alias("v"), F.col("m").alias("p"))))
            ).alias("e")
        ).select("e.v", "e.p")
        above = low.select(F.col("v").alias("p"), F.col("m").alias("q"))
        nxt = hung.join(above, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")).groupBy("v", "p").agg(F.max("moved").alias("moved"))
        nxt = stored(nxt, "links")
        dropped(up)
        state = nxt.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("nodes"), F.sum(F.col("moved").cast("long")).alias("moved")).first()
        up = nxt.select("v", "p")
        if not state["n"] or (state["n"] == state["nodes"] and not state["moved"]):
            break
    return up.select(F.col("v").alias("node"), F.col("p").alias("root")).unionByName(up.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct())
