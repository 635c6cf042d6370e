"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one kept for each group.

Vectors are scaled to length 1; equal ones (after scaling, per label) are one
class with a count, so exact copies cost one row. For each label, centres are
fitted by spherical k-means on a bounded sample (SAMPLE vectors of that label);
their number follows the number of classes, so a cell has about CELL of them at
any size of the table. Where that would take more than MAX_CENTRES centres,
cells are split again in the same way, each by centres fitted on a sample of its
own, in as many levels as it takes. Every class is put into its PROBE nearest
cells (NEXT_PROBE of each cell on later levels), and all pairs of a cell with
cosine >= THRESHOLD are found, in blocks: a cell is cut into blocks of
BLOCK_ROWS and each pair of blocks is a task group of its own, so a cell with a
third of all rows is spread over many tasks and no task holds more than two
blocks. A pair that meets in several cells counts in the first cell that both
share. Blocks send counts and a spanning forest of their links, not the pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import hot_join, stored

THRESHOLD = 0.93
SAMPLE, CELL, PROBE, NEXT_PROBE, BLOCK_ROWS, ROUNDS, GROUP = 4096, 512, 3, 2, 1024, 6, 4096
MAX_CENTRES = 1024


def _units(batches):
    """vec_id, label, class key and unit vector of the vectors that can link."""
    for b in batches:
        ids, labels, keys, units = [], [], [], []
        for i, label, v in zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(), b.column("embedding").to_pylist(), strict=True):
            unit = None
            if i is not None and label is not None and v and None not in v:
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    x = x / np.abs(x).max()
                    unit = x / np.sqrt((x * x).sum())
            ids.append(i)
            labels.append(label)
            units.append(None if unit is None else unit.tobytes())
            keys.append(None if unit is None else int.from_bytes(hashlib.blake2b(unit.tobytes() + str(label).encode(), digest_size=8).digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(keys, pa.int64()), pa.array(units, pa.binary())], names=["vec_id", "label", "class", "unit"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres: farthest-first from the first vector, then mean directions."""
    centres = [x[0]]
    near = x @ x[0]
    for _ in range(1, min(k, len(x))):
        i = int(np.argmin(near))
        centres.append(x[i])
        near = np.maximum(near, x @ x[i])
    c = np.stack(centres)
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Centres of one cell (of a label and dimension) from its sample; k is their number."""
    first = pdf.iloc[0]
    x = np.stack([np.frombuffer(u) for u in pdf["unit"]])
    return pd.DataFrame([(first["label"], first["dim"], first["cell"], spherical_kmeans(x, int(first["k"])).tobytes())], columns=["label", "dim", "cell", "centres"])


_PLACED = pa.schema([("class", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("unit", pa.binary()), ("copies", pa.int64()), ("cells", pa.list_(pa.int64()))])


def _assign(probe, most):
    def run(classes: pa.Table, centres: pa.Table) -> pa.Table:
        """The nearest cells of every class of a group of a cell, nearest first."""
        if not classes.num_rows:
            return _PLACED.empty_table()
        units, cells = classes.column("unit").to_pylist(), []
        dim, base = len(units[0]) // 8, classes.column("cell")[0].as_py() * most
        c = np.frombuffer(centres.column("centres")[0].as_py()).reshape(-1, dim) if centres.num_rows else np.zeros((1, dim))
        for lo in range(0, len(units), 2048):
            x = np.stack([np.frombuffer(u) for u in units[lo : lo + 2048]])
            cells += (base + np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probe]).tolist()
        return pa.table([*(classes.column(f.name).cast(f.type) for f in list(_PLACED)[:-1]), pa.array(cells, pa.list_(pa.int64()))], schema=_PLACED)

    return run


def _placed(classes: DataFrame) -> DataFrame:
    """class, label, dim, unit, copies and cells of all classes: level after level until a cell has about CELL of them."""
    cell, own = ["label", "dim", "cell"], ["class", "label", "dim", "unit", "copies"]
    total = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("classes"))
    levels = total.select("label", "dim", F.greatest(F.lit(1), F.ceil(F.log(F.col("classes") / CELL) / float(np.log(MAX_CENTRES)) - 1e-9)).cast("int").alias("levels"))
    levels = stored(levels, "levels")
    deepest = levels.agg(F.max("levels").alias("n")).first()["n"] or 1
    now = classes.select(*own, F.lit(0).cast("long").alias("cell"))
    done = None
    for level in range(1, deepest + 1):
        now = now.join(levels, ["label", "dim"])
        left = F.col("levels") - (level - 1)
        sizes = now.groupBy(*cell, "levels").agg(F.count(F.lit(1)).alias("n"))
        k = F.least(F.lit(MAX_CENTRES), F.greatest(F.lit(1), F.ceil(F.pow(F.col("n") / CELL, 1 / left) - 1e-9))).cast("int")
        sizes = stored(sizes.select(*cell, "n", k.alias("k"), F.ceil(F.col("n") / GROUP).cast("int").alias("salts")), "sizes")
        drawn = now.join(sizes, cell).where(F.pmod(F.xxhash64("class", F.lit(level)), F.lit(1 << 20)) * F.col("n") < F.lit(SAMPLE << 20))
        centres = drawn.select(*cell, "unit", "k").groupBy(*cell).applyInPandas(_fit, "label long, dim int, cell long, centres binary")
        # The classes of a cell meet its centres in groups of about GROUP rows, so the centres travel once for each group.
        rows = now.join(sizes, cell).withColumn("salt", F.pmod(F.xxhash64("class", F.lit(3)), F.col("salts")).cast("int")).select(*own, "cell", "salt")
        nets = centres.join(sizes, cell).select(*cell, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "centres")
        keys = [*cell, "salt"]
        probe = PROBE if level == 1 else NEXT_PROBE
        kind = "class long, label long, dim int, unit binary, copies long, cells array<long>"
        placed = stored(rows.groupBy(*keys).cogroup(nets.groupBy(*keys)).applyInArrow(_assign(probe, MAX_CENTRES), kind), "cells")
        if deepest == 1:
            return placed
        placed = placed.join(levels, ["label", "dim"])
        ready = placed.where(F.col("levels") == level).select(*own, "cells")
        done = ready if done is None else done.unionByName(ready)
        now = placed.where(F.col("levels") > level).select(*own, F.explode("cells").alias("cell"))
    # A class of a label with several levels has come in parts, one for each cell of the level before.
    each = done.groupBy("class").agg(*(F.first(c).alias(c) for c in own[1:]), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cells")))).alias("cells"))
    return stored(each, "cells")


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def _compare(threshold):
    def run(table: pa.Table) -> pa.Table:
        """One pair of blocks of a cell: counts as (class, class, n), forest links as (u, v, 0)."""
        side = table.column("side").to_numpy()
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        cell = table.column("cell")[0].as_py()
        key, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
        x = np.stack([np.frombuffer(u) for u in table.column("unit").to_pylist()])
        lists = table.column("cells").to_pylist()
        cells = np.full((len(x), max(map(len, lists))), -1, np.int64)
        for i, c in enumerate(lists):
            cells[i, : len(c)] = c
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        count = np.zeros(len(x), np.int64)
        forest, links = _Forest(), []
        for lo in range(0, len(left), 256):
            rows = left[lo : lo + 256]
            hit = x[rows] @ x[right].T >= threshold
            if same:
                hit &= rows[:, None] < right[None, :]
            i, j = np.nonzero(hit)
            i, j = rows[i], right[j]
            if len(i):  # only in the smallest cell that both are in
                both = (cells[i][:, :, None] == cells[j][:, None, :]) & (cells[i][:, :, None] >= 0)
                least = np.where(both.any(axis=2), cells[i], np.iinfo(np.int64).max).min(axis=1)
                i, j = i[least == cell], j[least == cell]
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                for a, b in zip(key[i].tolist(), key[j].tolist(), strict=True):
                    if forest.join(a, b):
                        links.append((a, b))
        some = np.flatnonzero(count)
        u = np.r_[key[some], np.array([a for a, _ in links], np.int64)]
        v = np.r_[key[some], np.array([b for _, b in links], np.int64)]
        n = np.r_[count[some], np.zeros(len(links), np.int64)]
        return pa.table([pa.array(u), pa.array(v), pa.array(n)], schema=_FOUND)

    return run


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Near-duplicate groups of vectors(vec_id, embedding, label).

    Returns one row for each vector: vec_id, n_links (other vectors with the
    same label whose cosine, in double precision, was found to reach the
    threshold), component_id (smallest vec_id reachable by links, itself
    included) and kept (vec_id = component_id). Vectors that are null, empty,
    zero or hold nulls or non-finite components, and those without a label or
    vec_id, link with nothing; vectors of different lengths do not link.
    Repeated rows are vectors of their own. Other columns are ignored; an
    empty table gives an empty result.
    """
    cols = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    units = stored(cols.mapInArrow(_units, "vec_id long, label long, class long, unit binary"), "units")
    classes = units.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    classes = stored(classes.withColumn("dim", F.expr("cast(octet_length(unit) / 8 as int)")), "classes")

    placed = _placed(classes)
    member = placed.select("class", "label", "dim", "copies", "unit", "cells", F.explode("cells").alias("cell"))
    cell = ["label", "dim", "cell"]
    sized = member.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    member = member.join(sized, cell).withColumn("own", F.pmod(F.xxhash64("class", F.lit(7)), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("a"), F.greatest(o, F.col("own")).alias("b"), F.when(F.col("own") <= o, 0).otherwise(1).alias("side")))
    dealt = member.select("class", "copies", "unit", "cells", *cell, F.explode(pair).alias("p")).select("class", "copies", "unit", "cells", *cell, "p.a", "p.b", "p.side")
    found = stored(dealt.groupBy(*cell, "a", "b").applyInArrow(_compare(threshold), "u long, v long, n long"), "found")

    roots = components(found.where("n = 0").select("u", "v"))
    low = roots.join(classes.select(F.col("class").alias("node"), "low"), "node").groupBy("root").agg(F.min("low").alias("component"))
    named = roots.join(low, "root").select(F.col("node").alias("class"), "component")
    links = found.where("n > 0").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("links"))
    every = classes.select("class", "low", "copies").join(links, "class", "left").join(named, "class", "left")
    every = stored(every.select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "low").alias("component_id")), "classes")
    out = hot_join(units.select("vec_id", "class"), every, "class")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
