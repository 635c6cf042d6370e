"""Portfolio backtests: momentum rotation, delisting, volatility targeting, a defensive breaker.

A rotation holds the k names that rose most over n days, chosen anew every h
days. Days, names and parameter cells are rows: baskets are ranks, turnover is a
difference of arrays, and equity is a cumulative product, so nothing is walked
day by day. The defensive state of the breaker follows from windows over its
flags too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames

YEAR = 365.0
METRICS = ("final", "cagr", "vol", "ret_vol", "max_dd")


def panel(closes: DataFrame) -> DataFrame:
    """closes(symbol, d, close) on all days of any name, numbered: symbol, d, j, close, ret, last_j, end_j.

    ret carries the last close on, so it is 0 on days without one and after a
    name's end, and null before its second close; last_j is the day of its last
    close, end_j the panel's.
    """
    days = closes.select("d").distinct().withColumn("j", F.row_number().over(frames.series([], ["d"])) - 1)
    full = days.join(F.broadcast(days.agg(F.max("j").alias("end_j")))).crossJoin(closes.select("symbol").distinct())  # one row; names of a panel
    w = frames.series(["symbol"], ["j"])
    rows = full.join(closes.select("symbol", "d", "close"), ["symbol", "d"], "left")
    held = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("held", held).withColumn("ret", F.try_divide("held", F.lag("held").over(w)) - 1)
    last = F.max(F.when(F.col("close").isNotNull(), F.col("j"))).over(Window.partitionBy("symbol"))
    return rows.select("symbol", "d", "j", "close", "ret", last.alias("last_j"), "end_j")


def cells_of(df: DataFrame, cells: Sequence[dict]) -> DataFrame:
    """df times the parameter cells (literals, exploded in place); `cell` numbers them."""
    return each(df.withColumn("_c", F.array(*(F.struct(F.lit(i).alias("cell"), *(F.lit(v).alias(k) for k, v in c.items())) for i, c in enumerate(cells)))), "_c")


def each(df: DataFrame, column: str) -> DataFrame:
    """One row for each struct of an array column, its fields as columns."""
    return df.withColumn(column, F.explode(column)).select(*(c for c in df.columns if c != column), f"{column}.*")


def picks(px: DataFrame, cells: Sequence[dict]) -> DataFrame:
    """The names of every basket: cell, n, k, h, i (the day it is chosen), symbol, last_j, end_j; cells have n, k and h.

    Among names with a rise over n days, the k largest; ties by name.
    """
    w = frames.series(["symbol"], ["j"])
    spans = sorted({c["n"] for c in cells})
    gains = F.array(*(F.struct(F.lit(n).alias("span"), (F.try_divide("close", F.lag("close", n).over(w)) - 1).alias("gain")) for n in spans))
    rising = each(px.select("symbol", F.col("j").alias("i"), "last_j", "end_j", gains.alias("_g")), "_g").where("gain > 0")
    ranked = rising.withColumn("place", F.row_number().over(Window.partitionBy("span", "i").orderBy(F.desc("gain"), "symbol")))
    return cells_of(ranked, cells).where("span = n and i >= n and (i - n) % h = 0 and i < end_j and place <= k").drop("span", "gain", "place")


def curve(px: DataFrame, cells: Sequence[dict], flags: DataFrame | None = None) -> DataFrame:
    """Equity of the rotation by day, for cells with n, k, h, cost and, if wanted, loss or recover.

    cell, j, d, equity, ret, turnover from day n on, where equity is 1. loss: a
    name whose closes end before the panel does loses this share on the next
    day and is held no more. recover, with flags(cell, j, flag): no position on
    flagged days and the `recover` days after them, each way at the cost of one
    trade.
    """
    first = cells[0]
    chosen = picks(px, cells)
    alive = F.lit(True) if "loss" not in first else (F.col("last_j") == F.col("end_j")) | (F.col("last_j") >= F.least(F.col("i") + F.col("h"), F.col("end_j")))
    baskets = chosen.groupBy("cell", "i").agg(F.collect_set("symbol").alias("names"), F.collect_set(F.when(alive, F.col("symbol"))).alias("left"))

    days = cells_of(px.select("j", "d", "end_j").distinct(), cells).where("j >= n")
    start = F.col("n") + F.col("h") * F.floor((F.col("j") - 1 - F.col("n")) / F.col("h")).cast("int")
    days = days.withColumn("i", F.when(F.col("j") > F.col("n"), start))

    held = chosen.withColumn("o", F.explode(F.expr("sequence(1, h)"))).withColumn("j", F.col("i") + F.col("o")).where("j <= end_j")
    held = held.join(px.select("symbol", "j", "ret"), ["symbol", "j"])
    if "loss" in first:
        gone = F.col("j") - F.when(F.col("last_j") < F.col("end_j"), F.col("last_j"))
        held = held.where(F.coalesce(gone <= 1, F.lit(True))).withColumn("ret", F.when(gone == 1, -F.col("loss")).otherwise(F.col("ret")))
    gained = held.groupBy("cell", "i", "j").agg(F.avg("ret").alias("gain"))

    empty = F.array().cast("array<string>")
    rows = days.join(gained, ["cell", "i", "j"], "left").join(baskets, ["cell", "i"], "left")
    rows = rows.withColumn("names", F.coalesce("names", empty)).withColumn("left", F.coalesce("left", empty)).withColumn("gain", F.coalesce("gain", F.lit(0.0))).withColumn("lost", F.lit(0.0))
    if "recover" in first:
        rows = _defended(rows.join(flags, ["cell", "j"], "left"))
    w = frames.series(["cell"], ["j"])
    before = F.coalesce(F.lag("left").over(w), empty)
    traded = (F.size(F.array_except("names", before)) + F.size(F.array_except(before, "names"))) / (2.0 * F.col("k"))
    rows = rows.withColumn("turnover", F.when(F.col("j") == F.col("i") + 1, traded).otherwise(0.0))
    day = (1 - F.col("turnover") * F.col("cost")) * (1 - F.col("lost")) * (1 + F.col("gain"))
    grown = frames.equity(F.when(F.col("i").isNull(), 0.0).otherwise(day - 1), w)
    return rows.select("cell", "j", "d", grown.alias("equity"), F.when(F.col("i").isNull(), 0.0).otherwise(F.col("gain")).alias("ret"), "turnover")


def _defended(rows: DataFrame) -> DataFrame:
    """Days of a rotation under flags: in cash, gains are 0, and positions left or taken up again cost one trade (lost)."""
    flag = F.coalesce("flag", F.lit(False))
    rows = rows.withColumn("flag", F.when(F.col("i").isNotNull(), flag).otherwise(False))
    # The last flagged day keeps the position closed for `recover` more.
    until = F.max(F.when(F.col("flag"), F.col("j") + F.col("recover"))).over(frames.series(["cell"], ["j"]).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("cash", F.coalesce(until >= F.col("j"), F.lit(False)))
    period = frames.series(["cell", "i"], ["j"])
    rows = rows.withColumn("run", F.sum(F.when(F.col("cash") != F.lag("cash").over(period), 1).otherwise(0)).over(period))
    # A period opens with its basket, even in cash; a flagged day empties it until the run of cash days ends.
    sold = F.col("cash") & F.max("flag").over(frames.series(["cell", "i", "run"], ["j"]).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("sold", sold).withColumn("was_sold", F.coalesce(F.lag("sold").over(period), F.lit(False)))
    some = F.size("names") > 0
    trades = (F.col("flag") & some & ~F.col("was_sold")) | (~F.col("cash") & some & F.col("was_sold"))
    rows = rows.withColumn("lost", F.when(trades, F.col("cost")).otherwise(0.0)).withColumn("gain", F.when(F.col("cash"), 0.0).otherwise(F.col("gain")))
    return rows.withColumn("left", F.when(F.col("sold"), F.array().cast("array<string>")).otherwise(F.col("left")))


def breaker_flags(px: DataFrame, symbol: str, cells: Sequence[dict], high: int = 20, long: int = 30) -> DataFrame:
    """cell, j, flag: on the day before, the market's volatility over v days was above m times that over `long`, or it stood dd or more below its recent high.

    cells have v, m and dd; null where a window is not whole.
    """
    w = frames.series(["symbol"], ["j"])
    market = px.where(F.col("symbol") == symbol).where("close is not null")
    close = F.col("close")
    market = market.withColumn("r", frames.simple_return(close, w))
    deviation = lambda n: frames.rolling_full(F.col("r"), n, w, F.stddev_samp)
    spans = sorted({c["v"] for c in cells})
    short = F.array(*(F.struct(F.lit(v).alias("span"), deviation(v).alias("short")) for v in spans))
    market = market.select("symbol", "j", deviation(long).alias("usual"), (close / frames.rolling_full(close, high, w, F.max) - 1).alias("below"), short.alias("_s"))
    market = cells_of(each(market, "_s"), cells).where("span = v")
    up = F.coalesce(F.col("short") > F.col("m") * F.col("usual"), F.lit(False)) | F.coalesce(F.col("below") < -F.col("dd"), F.lit(False))
    return market.select("cell", "j", F.coalesce(F.lag(up).over(frames.series(["cell"], ["j"])), F.lit(False)).alias("flag"))


def metrics(equity: DataFrame, *more: Column) -> DataFrame:
    """By cell: final value, yearly growth, yearly volatility, their ratio, deepest drawdown, days; and more aggregates."""
    w = frames.series(["cell"], ["j"])
    rows = equity.withColumn("_move", frames.simple_return(F.col("equity"), w)).withColumn("_down", frames.drawdown(F.col("equity"), w))
    final, years = F.max_by("equity", "j"), F.greatest(F.datediff(F.max("d"), F.min("d")), F.lit(1)) / YEAR
    cagr, vol = F.when(final > 0, F.pow(final, 1 / years) - 1).otherwise(-1.0), F.stddev_samp("_move") * F.sqrt(F.lit(YEAR))
    got = rows.groupBy("cell").agg(final.alias("final"), cagr.alias("cagr"), vol.alias("vol"), F.min("_down").alias("max_dd"), F.count(F.lit(1)).alias("days"), *more)
    return got.withColumn("ret_vol", F.when(F.col("vol") > 0, F.col("cagr") / F.col("vol")))


def vol_target(base: DataFrame, cells: Sequence[dict]) -> DataFrame:
    """The returns of a curve scaled to a volatility known the day before, with trading costs and carry: cell, j, d, equity, exposure.

    cells have target, lookback, most, cost, lend and borrow; base is the curve
    of one cell.
    """
    plain = frames.series([], ["j"])
    spans = sorted({c["lookback"] for c in cells})
    known = F.array(*(F.struct(F.lit(n).alias("span"), (frames.trailing_full(F.col("ret"), n, plain, F.stddev_samp) * F.sqrt(F.lit(YEAR))).alias("known")) for n in spans))
    rows = cells_of(each(base.select("j", "d", "ret", "turnover", known.alias("_s")), "_s"), cells).where("span = lookback")
    exposure = F.when(F.col("known") > 0, F.least(F.col("target") / F.col("known"), F.col("most"))).when(F.col("known") == 0, F.col("most")).otherwise(0.0)
    w = frames.series(["cell"], ["j"])
    rows = rows.withColumn("exposure", exposure)
    moved = F.coalesce(F.abs(F.col("exposure") - F.lag("exposure").over(w)), F.lit(0.0))
    spent = (F.col("turnover") * F.col("exposure") + moved) * F.col("cost")
    zero = F.lit(0.0)
    carry = F.greatest(1 - F.col("exposure"), zero) * F.col("lend") / YEAR - F.greatest(F.col("exposure") - 1, zero) * F.col("borrow") / YEAR
    rows = rows.withColumn("_day", F.col("ret") * F.col("exposure") + carry - spent)
    return rows.select("cell", "j", "d", frames.equity(F.col("_day"), w).alias("equity"), "exposure")


def doomed(px: DataFrame, cells: Sequence[dict]) -> DataFrame:
    """Entries into names whose closes end before the panel does: cell, i, symbol, last_j."""
    rows = picks(px, cells)
    before = rows.select("cell", "symbol", (F.col("i") + F.col("h")).alias("i"))  # held from the basket before
    return rows.where("last_j < end_j").join(before, ["cell", "symbol", "i"], "left_anti").select("cell", "i", "symbol", "last_j")
