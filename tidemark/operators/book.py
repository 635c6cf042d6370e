"""Order books: grids, walls and their fates, depth quality, heatmaps, census, reconstruction."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9
WALL_TIMES, KEEP, MISSES, MOVED_BY = 5.0, 0.5, 2, 3
TOUCH_PCT, WALL_MAX_PCT, BAND_MAX_PCT = 0.05, 2.0, 5.0


def bucket(price: Column, width: Column) -> Column:
    """Grid number of a price; 2400.0 / 2.0 is 1200, never 1199."""
    return F.floor(price / width + EPS)


def grid(levels: DataFrame, width: float) -> DataFrame:
    """Value by snapshot, side and grid bucket; levels(snap, side, price, qty)."""
    b = levels.withColumn("k", bucket(F.col("price"), F.lit(width)))
    return b.groupBy("snap", "side", "k").agg(F.sum(F.col("price") * F.col("qty")).alias("usd"), F.count(F.lit(1)).alias("levels"))


def distances(cells: DataFrame, mids: DataFrame, width: float) -> DataFrame:
    """cells with the distance from the mid, in percent, of the bucket's near edge."""
    near = F.when(F.col("side") == "bid", (F.col("mid") - (F.col("k") + 1) * width) / F.col("mid")).otherwise((F.col("k") * width - F.col("mid")) / F.col("mid"))
    return cells.join(mids, "snap").withColumn("dist", near * 100)


def wall_candidates(cells: DataFrame, min_usd: float = 0.0) -> DataFrame:
    """Buckets of at least WALL_TIMES the side's median over its band, if the band has three or more."""
    band = cells.where(F.col("dist").between(TOUCH_PCT, BAND_MAX_PCT) & (F.col("usd") > 0))
    base = band.groupBy("snap", "side").agg(F.percentile("usd", 0.5).alias("base"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    wall = F.col("dist").between(TOUCH_PCT, WALL_MAX_PCT) & (F.col("usd") >= WALL_TIMES * F.col("base")) & (F.col("usd") >= min_usd)
    return cells.join(base.select("snap", "side", "base"), ["snap", "side"]).where(wall)


EPISODES = "symbol string, side string, k long, first_t long, last_t long, absent_t long, seen array<long>, first_usd double, peak double, ended string"


def followed(rows) -> list[dict]:
    """Wall episodes of one bucket from its (t, hole, usd or None where not observed, is_wall) in time order."""
    out, now = [], None
    for t, hole, usd, wall in rows:
        if now is not None:
            how = None
            if hole or usd is None:
                how = "CENSORED"
            elif usd >= KEEP * now["peak"]:
                now.update(last_t=t, absent_t=None, peak=max(now["peak"], usd), seen=[*now["seen"], t], missed=0)
            else:
                now.update(missed=now["missed"] + 1, absent_t=t if now["absent_t"] is None else now["absent_t"])
                how = "GONE" if now["missed"] == MISSES else None
            if how:
                out.append({**now, "ended": how})
                now = None
        if now is None and wall:
            now = {"first_t": t, "last_t": t, "absent_t": None, "seen": [t], "first_usd": usd, "peak": usd, "missed": 0}
    return out + ([{**now, "ended": "ACTIVE"}] if now else [])


def episodes(cells: DataFrame, interval: int, gap: float = 3.0) -> DataFrame:
    """Wall episodes of each bucket and how they ended.

    cells(symbol, side, k, t, usd, is_wall): every bucket of every snapshot.
    An episode starts at a wall, lasts while the bucket holds half of its
    running peak, and is GONE at the second miss in a row; `absent_t` is the
    first miss. A bucket deeper than the side's last one is not observed,
    which censors it, as does a hole in the snapshots of more than `gap`
    intervals; what is open at the end is ACTIVE. The running peak makes this
    a fold; a group is one bucket, with its own snapshots and the two after
    each, since nothing is open beyond those.
    """
    key = ["symbol", "side", "k"]
    order = Window.partitionBy("symbol").orderBy("t")
    times = cells.select("symbol", "t").distinct().withColumn("i", F.row_number().over(order)).withColumn("hole", F.coalesce(F.col("t") - F.lag("t").over(order) > gap * interval, F.lit(False)))
    far = cells.groupBy("symbol", "side", "t").agg(F.min("k").alias("least"), F.max("k").alias("most"))
    walls = cells.where("is_wall").select(*key).distinct()
    due = cells.join(walls, key, "left_semi").join(times.select("symbol", "t", "i"), ["symbol", "t"]).select(*key, F.explode(F.sequence("i", F.col("i") + MISSES)).alias("i")).distinct()
    rows = due.join(times, ["symbol", "i"]).join(far, ["symbol", "side", "t"], "left").join(cells.select(*key, "t", "usd", "is_wall"), [*key, "t"], "left")
    inside = F.when(F.col("side") == "bid", F.col("k") >= F.col("least")).otherwise(F.col("k") <= F.col("most"))
    rows = rows.select(*key, "t", "hole", F.coalesce("usd", F.when(inside, 0.0)).alias("usd"), F.coalesce("is_wall", F.lit(False)).alias("is_wall"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        usd = [None if x != x else x for x in pdf["usd"]]
        frame = pd.DataFrame(followed(zip(pdf["t"].tolist(), pdf["hole"], usd, pdf["is_wall"], strict=True)), columns=[c.split(" ")[0] for c in EPISODES.split(", ")])
        frame["absent_t"] = frame["absent_t"].astype("Int64")
        return frame.assign(**{c: pdf[c].iloc[0] for c in key})

    return rows.groupBy(*key).applyInPandas(run, EPISODES)


def _moved(found: DataFrame, cells: DataFrame) -> DataFrame:
    """Keys of episodes of which a bucket within three newly holds half the peak at the first miss."""
    one = ["symbol", "side", "k", "first_t"]
    gone = found.where("ended = 'GONE'").withColumn("near", F.explode(F.array(*[F.col("k") + j for j in range(-MOVED_BY, MOVED_BY + 1) if j])))
    at = lambda t, name: cells.select("symbol", "side", F.col("k").alias("near"), F.col("t").alias(t), F.col("usd").alias(name))
    both = gone.join(at("absent_t", "now_usd"), ["symbol", "side", "near", "absent_t"]).join(at("last_t", "was_usd"), ["symbol", "side", "near", "last_t"], "left")
    level = KEEP * F.col("peak")
    return both.where((F.col("now_usd") >= level) & (F.coalesce("was_usd", F.lit(0.0)) < level)).select(*one).distinct().withColumn("moved", F.lit(True))


def _reached(width: float) -> Column:
    return F.when(F.col("side") == "bid", F.col("lo") < (F.col("k") + 1) * width).otherwise(F.col("hi") >= F.col("k") * width)


def photo_fates(found: DataFrame, cells: DataFrame, prices: DataFrame, width: float) -> DataFrame:
    """Episodes with their fate from prices alone; prices(symbol, t, lo, hi) traded since the snapshot before t.

    REACHED if price traded in the bucket up to the first miss, which follows
    the last sight directly; else MOVED or PULLED. CENSORED without prices.
    """
    p = prices.select("symbol", F.col("t").alias("absent_t"), "lo", "hi")
    all_ = found.join(p, ["symbol", "absent_t"], "left").join(_moved(found, cells), ["symbol", "side", "k", "first_t"], "left")
    reached = _reached(width)
    fate = F.when(F.col("ended") != "GONE", F.col("ended")).when(reached.isNull(), "CENSORED").when(reached, "REACHED").when(F.col("moved"), "MOVED").otherwise("PULLED")
    return all_.withColumn("fate", fate).drop("lo", "hi", "moved")


def flow_fates(found: DataFrame, cells: DataFrame, prices: DataFrame, width: float) -> DataFrame:
    """Episodes with their fate from flows: cells also hold traded and removed value since the snapshot before, prices also `clean`.

    FILLED if trades explain half of what was removed, else MOVED or
    CANCELLED; CENSORED if the stretch was not clean or nothing was removed.
    `excess` is traded value beyond the removed.
    """
    p = prices.select("symbol", F.col("t").alias("absent_t"), "lo", "hi", "clean")
    f = cells.select("symbol", "side", "k", F.col("t").alias("absent_t"), F.col("traded").alias("_t"), F.col("removed").alias("_r"))
    all_ = found.join(p, ["symbol", "absent_t"], "left").join(f, ["symbol", "side", "k", "absent_t"], "left").join(_moved(found, cells), ["symbol", "side", "k", "first_t"], "left")
    judged = (F.col("ended") == "GONE") & F.coalesce("clean", F.lit(False)) & (F.coalesce("_r", F.lit(0.0)) > 0)
    traded = F.least("_t", "_r")
    fate = F.when(F.col("ended") != "GONE", F.col("ended")).when(~judged, "CENSORED").when(traded >= 0.5 * F.col("_r"), "FILLED").when(F.col("moved"), "MOVED").otherwise("CANCELLED")
    zero = F.lit(0.0)
    return all_.withColumn("fate", fate).withColumns({
        "traded": F.when(judged, traded), "cancelled": F.when(judged, F.greatest(zero, F.col("_r") - F.col("_t"))), "excess": F.when(judged, F.greatest(zero, F.col("_t") - F.col("_r"))), "reached": F.when(judged, F.coalesce(_reached(width), F.lit(False))),
    }).drop("lo", "hi", "clean", "moved", "_t", "_r")


def hazard(done: DataFrame) -> DataFrame:
    """Share of ended episodes by fate, and pulls for each snapshot seen."""
    return done.groupBy("symbol", "side").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum(F.size("seen")).alias("exposure"), *[F.count_if(F.col("fate") == f).alias(f.lower()) for f in ("REACHED", "MOVED", "PULLED", "CENSORED", "ACTIVE")], F.avg(F.size("seen")).alias("mean_seen")
    ).withColumn("pull_rate", F.try_divide("pulled", "exposure"))


def distance_hazard(done: DataFrame, mids: DataFrame, width: float, step: float) -> DataFrame:
    """Snapshots seen and pulls by distance from the mid, in bands of `step` percent; a pull counts where the wall was seen last. mids(symbol, t, mid)."""
    seen = done.select("symbol", "side", "k", "last_t", "fate", F.explode("seen").alias("t")).join(mids, ["symbol", "t"])
    near = F.when(F.col("side") == "bid", F.col("mid") - (F.col("k") + 1) * width).otherwise(F.col("k") * width - F.col("mid")) / F.col("mid") * 100
    pull = (F.col("t") == F.col("last_t")) & (F.col("fate") == "PULLED")
    return seen.groupBy("symbol", F.floor(near / step).alias("band")).agg(F.count(F.lit(1)).alias("exposure"), F.count_if(pull).alias("pulls")).withColumn("rate", F.col("pulls") / F.col("exposure"))


def depth_quality(rows: DataFrame, limit: float = 0.10) -> DataFrame:
    """15-minute mean and least notional by band, with good and bad snapshots; rows(symbol, ts, pct, depth, notional, ref).

    A snapshot is bad if depth does not grow with distance on a side, or the
    price its notional implies is more than `limit` off the reference.
    """
    side = F.signum("pct")
    w = Window.partitionBy("symbol", "ts", side).orderBy(F.abs("pct"))
    off = F.abs(F.try_divide("notional", "depth") / F.col("ref") - 1) > limit
    wrong = F.coalesce((F.col("depth") < F.lag("depth").over(w)) | (F.col("notional") < F.lag("notional").over(w)), F.lit(False)) | F.coalesce(off, F.lit(True))
    marked = rows.withColumn("_wrong", wrong)
    marked = marked.withColumn("_bad", F.max("_wrong").over(Window.partitionBy("symbol", "ts")))
    slot = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 900) * 900)
    good = F.when(~F.col("_bad"), F.col("notional"))
    return marked.groupBy("symbol", slot.alias("slot"), "pct").agg(F.avg(good).alias("mean_notional"), F.min(good).alias("min_notional"), F.count_if(~F.col("_bad")).alias("good"), F.count_if("_bad").alias("bad"))


def heatmap(cells: DataFrame, around: int = 10) -> DataFrame:
    """Panel cells with the median of their occupied neighbours, and what was pulled since the last column.

    cells(side, k, col, rest, added, traded, removed): rest is the value at a
    column's end, flows are summed inside it.
    """
    near = Window.partitionBy("side", "col").orderBy("k").rangeBetween(-around, around)
    past = Window.partitionBy("side", "k").orderBy("col")
    pulled = F.greatest(F.lit(0.0), F.col("removed") - F.col("added") - F.col("traded"))
    return cells.withColumn("local_median", F.percentile(F.when(F.col("rest") > 0, F.col("rest")), 0.5).over(near)).withColumn("pulled", pulled).withColumn("was", F.lag("rest").over(past))


def standouts(cells: DataFrame, times: float, around: int = 10, least: int = 5) -> DataFrame:
    """Occupied buckets of at least `times` the median of their occupied neighbours, themselves left out; at least `least` neighbours."""
    own = cells.where("usd > 0")
    other = own.select("snap", "side", F.col("k").alias("k2"), F.col("usd").alias("usd2"))
    spread = other.withColumn("k", F.explode(F.sequence(F.col("k2") - around, F.col("k2") + around))).where("k <> k2")
    base = spread.groupBy("snap", "side", "k").agg(F.percentile("usd2", 0.5).alias("base"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return own.join(base, ["snap", "side", "k"]).where(F.col("usd") >= times * F.col("base"))


def cumulative_depth(cells: DataFrame) -> DataFrame:
    """Depth summed outwards from the touch."""
    order = F.when(F.col("side") == "bid", -F.col("k")).otherwise(F.col("k"))
    return cells.withColumn("depth", F.sum("usd").over(Window.partitionBy("snap", "side").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


class BookSync:
    """One market's book from a snapshot and its change events.

    Spot events carry first and last update numbers (U, u) and must join on;
    futures events name their predecessor (pu). A hole, or a book whose best
    prices cross, drops the book until the next snapshot. Quantities are
    absolute, 0 deletes a level. Flows are kept by price bucket: growth as
    added, shrinking as removed, trades against the side that made them.
    """

    def __init__(self, futures: bool, width: float = 1.0):
        self.futures, self.width = futures, width
        self.levels: dict[str, dict[float, float]] = {"b": {}, "a": {}}
        self.uid: int | None = None
        self.synced = self.fresh = False
        self.flows: dict[tuple[str, int, str], float] = {}

    def snapshot(self, uid: int, bids: list, asks: list) -> None:
        self.levels = {"b": {p: q for p, q in bids if q > 0}, "a": {p: q for p, q in asks if q > 0}}
        self.uid, self.synced, self.fresh = uid, True, True

    def lost(self) -> None:
        self.synced, self.uid = False, None

    def apply(self, first: int, last: int, bids: list, asks: list, before: int | None = None) -> str:
        """stale, gap, crossed or ok."""
        if not self.synced:
            return "gap"
        if last < self.uid or (last <= self.uid and not self.futures):
            return "stale"
        if self.fresh:
            joins = first <= self.uid + (0 if self.futures else 1) <= last + (0 if self.futures else 1)
        else:
            joins = before == self.uid if self.futures else first <= self.uid + 1
        if not joins:
            self.lost()
            return "gap"
        for side, changes in (("b", bids), ("a", asks)):
            book = self.levels[side]
            for p, q in changes:
                step = q - book.get(p, 0.0)
                if step:
                    key = (side, int(p / self.width + EPS), "added" if step > 0 else "removed")
                    self.flows[key] = self.flows.get(key, 0.0) + abs(step) * p
                if q > 0:
                    book[p] = q
                else:
                    book.pop(p, None)
        self.uid, self.fresh = last, False
        if self.levels["b"] and self.levels["a"] and max(self.levels["b"]) >= min(self.levels["a"]):
            self.lost()
            return "crossed"
        return "ok"

    def trade(self, price: float, qty: float, buyer_is_maker: bool) -> None:
        if self.synced:
            key = ("b" if buyer_is_maker else "a", int(price / self.width + EPS), "traded")
            self.flows[key] = self.flows.get(key, 0.0) + price * qty

    def flush(self) -> tuple[dict, dict]:
        """Resting value by side and bucket now, and the flows since the last flush."""
        rest: dict[tuple[str, int], float] = {}
        for side, book in self.levels.items():
            for p, q in book.items():
                key = (side, int(p / self.width + EPS))
                rest[key] = rest.get(key, 0.0) + p * q
        flows, self.flows = self.flows, {}
        return (rest if self.synced else {}), flows


def _minutes(rows: Iterable[tuple], book: BookSync) -> Iterator[tuple]:
    """Minutes of rows(ts, kind, u2, u1, pu, side, price, qty) in order, each given as soon as it is over."""
    minute, ok, seen = None, 0, 0

    def ended() -> Iterator[tuple]:
        rest, flows = book.flush()
        for (side, k), usd in sorted(rest.items()):
            yield (minute, side, k, usd, *[flows.get((side, k, f), 0.0) for f in ("added", "removed", "traded")], ok / max(seen, 1))

    for (ts, kind, u2), group in itertools.groupby(rows, key=lambda r: r[:3]):
        m = int(ts) // 60
        if minute is not None and m != minute:
            yield from ended()
            ok = seen = 0
        minute = m
        sides: dict[str, list] = {"b": [], "a": []}
        first = None
        for r in group:
            first = first or r
            sides[r[5]].append((float(r[6]), float(r[7])))
        if kind == "snapshot":
            book.snapshot(int(u2), sides["b"], sides["a"])
        elif kind == "trade":
            for s, x in sides.items():
                for p, q in x:
                    book.trade(p, q, s == "b")
        else:
            u1, pu = first[3], first[4]
            book.apply(int(u1), int(u2), sides["b"], sides["a"], None if pu is None or pu != pu else int(pu))
        seen += 1
        ok += book.synced
    if minute is not None:
        yield from ended()


ROW = ("ts", "kind", "u2", "u1", "pu", "side", "price", "qty")


def minute_flows(rows: pd.DataFrame, book: BookSync | None = None, width: float = 1.0) -> tuple[list[tuple], BookSync]:
    """Minutes of one market: rows(ts in seconds, kind, u1, u2, pu, side, price, qty) in order; one change event is all rows of one u2."""
    book = book or BookSync(False, width)
    ordered = rows.sort_values(["ts", "u2"], kind="stable")
    return list(_minutes(zip(*[ordered[c].tolist() for c in ROW], strict=True), book)), book


MINUTES = "market string, minute long, side string, k long, rest double, added double, removed double, traded double, synced double"
#: Minutes of a block, in which a market's book is cut once at most; rows given out at once.
BLOCK, OUT_ROWS = 60, 10_000


def _values(column: pa.Array) -> list:
    """Null numbers are NaN, so that each differs from every other; a column without any value stays null."""
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return [float("nan") if x is None else x for x in column.to_pylist()]


def _stretches(width: float):
    """Folds rows(market, cut, *ROW) sorted by market, cut and order, one stretch after the other; only the book is held."""
    names = [c.split(" ")[0] for c in MINUTES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.float64()] * 5]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def minutes() -> Iterator[tuple]:
            rows = (r for b in batches for r in zip(*[_values(b.column(c)) for c in ("market", "cut", *ROW)], strict=True))
            for (market, cut), group in itertools.groupby(rows, key=lambda r: r[:2]):
                for m in _minutes((r[2:] for r in group), BookSync(False, width)):
                    if m[0] != cut:
                        yield (market, *m)

        found = minutes()
        while part := list(itertools.islice(found, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), kinds, strict=True)], names=names)

    return run


def reconstruct(events: DataFrame, width: float = 1.0, order: tuple[str, ...] = ()) -> DataFrame:
    """Minute flows of every market from events(market, *ROW).

    Events go by ts and u2, rows of one event by the columns `order`, then by
    their values. A snapshot replaces the whole book, so a market is cut at
    the last minute with a snapshot of each block: a stretch starts from an
    empty book with that minute, whose rows it is given besides the stretch
    before, and gives out the minutes after it up to the next cut. Rows
    before a market's first block with a snapshot have no book and give
    nothing, rows without a time have no minute.
    """
    timed = events.select("market", *ROW, *order).withColumn("_minute", F.floor(F.col("ts").cast("long") / 60)).withColumn("_block", F.floor(F.col("_minute") / BLOCK))
    blocks = timed.groupBy("market", "_block").agg(F.max(F.when(F.col("kind") == "snapshot", F.col("_minute"))).alias("_own"))
    past = Window.partitionBy("market").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_past", F.last("_own", ignorenulls=True).over(past)).where("_own is not null or _past is not null")
    b = blocks.select(F.col("market").alias("_market"), F.col("_block").alias("_of"), "_own", "_past")
    rows = timed.join(b, F.col("market").eqNullSafe(F.col("_market")) & (F.col("_block") == F.col("_of")))
    before = F.coalesce("_past", F.lit(-(2**63)))
    cuts = F.when(F.col("_minute") > F.col("_own"), F.array("_own")).when(F.col("_minute") == F.col("_own"), F.array(before, "_own")).otherwise(F.array(before))
    dealt = rows.select("market", F.explode(cuts).alias("cut"), *ROW, *order).repartition("market", "cut")
    last = [F.asc_nulls_last(c) for c in ("ts", "u2", *order, "kind", "side", "price", "qty", "u1", "pu")]
    return dealt.sortWithinPartitions("market", "cut", *last).select("market", "cut", *ROW).mapInArrow(_stretches(width), MINUTES)


def book_check(ours: DataFrame, snapshot: DataFrame, uid: int) -> DataFrame:
    """Levels that differ from a snapshot taken at `uid`; levels changed later are left out. ours(side, price, qty, level_u)."""
    both = ours.alias("o").join(snapshot.alias("s"), ["side", "price"], "full")
    return both.where((F.coalesce("o.level_u", F.lit(0)) <= uid) & (F.coalesce("o.qty", F.lit(0.0)) != F.coalesce("s.qty", F.lit(0.0)))).select("side", "price", F.col("o.qty").alias("qty"), F.col("s.qty").alias("snapshot_qty"))
