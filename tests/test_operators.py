"""Operators on hand-made inputs, against plain Python where the result depends on order."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import book as B
from tidemark.operators import frames, narratives, outcomes, topics
from tidemark.operators import corridors as C
from tidemark.operators import portfolio as P
from tidemark.operators import volatility as V
from tidemark.sources import archives, upsert

DAY = dt.date(2024, 1, 1)


def days(*n):
    return [DAY + dt.timedelta(days=i) for i in n]


def closes(spark, values):
    return spark.createDataFrame([("x", d, float(v)) for d, v in zip(days(*range(len(values))), values, strict=True)], "symbol string, d date, close double")


def test_excursions_hand_example(spark):
    dip, run = frames.excursions(F.col("close"), 2, frames.series(["symbol"], ["d"]))
    got = [tuple(r) for r in closes(spark, [100, 90, 120, 110]).select("d", dip, run).orderBy("d").collect()]
    assert got[0][1] == pytest.approx(math.log(100 / 90)) and got[0][2] == pytest.approx(math.log(1.2))
    assert got[1][1] == 0 and got[1][2] == pytest.approx(math.log(120 / 90))
    assert got[2][1] is None and got[3][2] is None


def test_forward_window(spark):
    w = frames.series(["symbol"], ["d"])
    df = closes(spark, [100, 50, 100, 100]).select("d", frames.forward_full(F.col("close"), 2, w, F.min).alias("lo"), frames.forward_full(F.col("close"), 2, w).alias("hi")).orderBy("d").collect()
    assert df[0]["lo"] / 100 - 1 == -0.5 and df[1]["hi"] / 50 - 1 == 1.0 and df[2]["hi"] is None


def test_refractory_against_python(spark):
    assert [r.d for r in frames.refractory(spark.createDataFrame([("a", d) for d in days(1, 2, 4, 27)], "s string, d date"), ["s"], "d", 14).orderBy("d").collect()] == days(1, 27)
    rng = random.Random(1)
    rows = [(s, DAY + dt.timedelta(days=rng.randrange(300))) for s in "abc" for _ in range(60)]
    want = set()
    for s in "abc":
        last = None
        for d in sorted({d for x, d in rows if x == s}):
            if last is None or (d - last).days >= 5:
                want.add((s, d))
                last = d
    assert {tuple(r) for r in frames.refractory(spark.createDataFrame(rows, "s string, d date"), ["s"], "d", 5).collect()} == want


def test_filled_limit(spark):
    rows = [("a", d, 1.0 * i) for i, d in enumerate(days(0, 2, 7))]
    got = {r.d: r.v for r in frames.filled(spark.createDataFrame(rows, "s string, d date, v double"), ["s"], "d", "v", 3).collect()}
    assert got == {days(0)[0]: 0.0, days(1)[0]: 0.0, days(2)[0]: 1.0, days(3)[0]: 1.0, days(4)[0]: 1.0, days(5)[0]: 1.0, days(7)[0]: 2.0}


def priced(spark, *paths):
    rows = [(chr(97 + n), d, float(x)) for n, p in enumerate(paths) for d, x in zip(days(*range(len(p))), p, strict=True)]
    return C.volatility(spark.createDataFrame(rows, "symbol string, d date, close double"))


def walk(seed, n):
    return np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n)))


def test_volatility_against_recurrence(spark):
    p = walk(2, 120)
    got = [r.sig for r in priced(spark, p).orderBy("i").collect()]
    r, want = np.diff(np.log(p)), [None] * 31
    v = float(np.var(r[:30]))
    for x in r[30:]:
        v = 0.94 * v + 0.06 * x * x
        want.append(math.sqrt(v))
    assert got[:31] == want[:31] and got[31:] == pytest.approx(want[31:])


def test_no_lookahead(spark):
    """Changing values after a day leaves results up to that day as they were."""
    p = walk(0, 700)
    q = p.copy()
    q[600:] *= 3
    for make in (lambda v: C.bands(v, 7, (0.8,)), lambda v: C.conditional_bands(v, 7, (0.8,), 100).withColumn("method", F.lit("c"))):
        a, b = ({(r["method"], r["i"]): (r["lo"], r["hi"]) for r in make(priced(spark, x)).where("i < 600").collect()} for x in (p, q))
        assert a == b and sum(x[0] is not None for x in a.values()) > 200


def test_bands_against_numpy(spark):
    p, h = walk(1, 450), 7
    rows = {r["i"]: r for r in C.bands(priced(spark, p), h, (0.8,), ("fhs",)).collect()}
    out = {t: math.log(p[t + h] / p[t]) for t in range(len(p) - h)}
    for t in (420, 449):
        past = [out[s] / (rows[s]["sig"] * math.sqrt(h)) for s in range(31, t - h + 1)]
        assert (rows[t]["lo"], rows[t]["hi"]) == pytest.approx(tuple(np.quantile(past, [0.1, 0.9]) * rows[t]["sig"] * math.sqrt(h)))
    assert rows[31 + 365 + h - 2]["lo"] is None and rows[31 + 365 + h - 1]["lo"] is not None


def test_conditional_pools_against_numpy(spark):
    p, h, least = walk(5, 400), 5, 40
    rows = sorted(C.conditional_bands(priced(spark, p), h, (0.5,), least).collect(), key=lambda r: r["i"])
    sig = {r["i"]: r["sig"] for r in rows if r["sig"] is not None}
    kind = {t: min(2, int(3 * np.mean([sig[s] < sig[t] for s in sig if s <= t]))) for t in sig}
    z = {s: math.log(p[s + h] / p[s]) / (sig[s] * math.sqrt(h)) for s in sig if s + h < len(p)}
    for t in range(31, 400, 23):
        every = [z[s] for s in z if s <= t - h]
        own = [z[s] for s in z if s <= t - h and kind[s] == kind[t]]
        pool = own if len(own) >= least else every
        if len(every) < least:
            assert rows[t]["lo"] is None
        else:
            assert (rows[t]["lo"], rows[t]["hi"]) == pytest.approx(tuple(np.quantile(pool, [0.25, 0.75]) * sig[t] * math.sqrt(h)))


def test_statistics(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    k = lambda n, x, p: value(C.kupiec(F.lit(n), F.lit(x), F.lit(p)))
    assert k(100, 10, 0.10) == pytest.approx(1.0) and k(100, 25, 0.10) < 0.001 and k(0, 0, 0.1) is None and k(50, 0, 0.1) == pytest.approx(math.erfc(math.sqrt(-50 * math.log(0.9))))
    for s in (0.0, 0.3, 1.1, 2.7):
        assert value(C.upper_tail(F.lit(s))) == pytest.approx(math.erfc(s), abs=1e-9)
    for b, c in ((0, 0), (5, 0), (0, 4), (7, 3)):
        want = sum(math.comb(b + c, j) for j in range(b, b + c + 1)) / 2 ** (b + c)
        assert value(C.mcnemar(F.lit(b), F.lit(c))) == pytest.approx(want)
    assert V.spearman(np.array([1, 2, 2, 3.0]), np.array([1, 2, 2, 3.0])) == pytest.approx(1.0)
    got = {r.term: r.iv for r in V.term_structure(spark.createDataFrame([(10, 50.0), (40, 60.0)], "days int, iv double"), (5, 10, 25, 90)).collect()}
    assert got[5] == 0.5 and got[10] == 0.5 and got[90] == 0.6 and got[25] == pytest.approx(math.sqrt((0.25 * 10 + (0.36 * 40 - 0.25 * 10) / 2) / 25))


def test_reverting_variance(spark):
    """The fold over arrays equals the plain recurrence, and the fit prefers the pair that made the data."""
    vol = C.reverting(C.trailing_level(priced(spark, walk(7, 500)), 100), 0.1, 0.85)
    rows = vol.orderBy("i").collect()
    r, level = (np.array([x[c] if x[c] is not None else np.nan for x in rows], float) for c in ("r", "level_now"))
    assert np.allclose(V.reverting_variance(r, level, 0.1, 0.85), [x["v"] if x["v"] is not None else np.nan for x in rows], equal_nan=True)
    assert np.allclose(V.reverting_variance(r, level, [0.1, 0.2], [0.85, 0.7])[:, 0], V.reverting_variance(r, level, 0.1, 0.85), equal_nan=True)
    rng, x, v = np.random.default_rng(0), [], 1e-4
    for _ in range(3000):
        x.append(math.sqrt(v) * rng.normal())
        v = 0.05 * 1e-4 + 0.15 * x[-1] ** 2 + 0.80 * v
    a, b = V.fit_reverting(np.array(x), np.full(3000, 1e-4), 2999)
    assert a == pytest.approx(0.15, abs=0.06) and b == pytest.approx(0.80, abs=0.08)
    assert V.fit_reverting(np.array(x[:50]), np.full(50, 1e-4), 49) is None
    assert V.term_variance(2.0, 0.1, 0.8, 1.0, 1) == pytest.approx(2.0) and V.term_variance(2.0, 0.1, 0.8, 1.0, 400) == pytest.approx(410, rel=1e-3)


def test_blocks():
    at = V.block_rows(100, 30, 5, 1)
    assert at.shape == (5, 100) and all((np.diff(x)[np.arange(99) % 30 != 29] == 1).all() for x in at)
    sums = np.array([[2.0, 0.0, 1.0], [1.0, 0.0, 1.0], [2.0, 0.0, 1.0]])
    assert V.joint_gain(sums, 3, 4, 0.9) == pytest.approx([abs(2 / 3 - 0.9) - 0.1] * 4)


def test_priors_need_five(spark):
    rows = [("a", "btc", float(x)) for x in (1, 2, 3, 4, 5)] + [(None, "btc", 1.0)] * 4
    got = outcomes.priors(spark.createDataFrame(rows, "k string, asset string, return_pct double"), ["k", "asset"]).collect()
    assert len(got) == 1 and got[0]["n"] == 5 and got[0]["mean"] == 3 and got[0]["std"] == pytest.approx(1.5811, abs=1e-4) and got[0]["p50"] == 3


def test_demotion_at_five_and_six(spark):
    def run(n):
        rows = [(i, dt.datetime(2024, 1, 1, i), "high", i % 2 == 0) for i in range(n)]
        got = outcomes.demote_hot_days(spark.createDataFrame(rows, "label_id long, published_at timestamp, impact_level string, is_causal_capable boolean"))
        return {r.label_id for r in got.collect() if r.impact_level == "during_event"}

    assert run(5) == set() and run(6) == {1, 3, 5} and run(8) == {1, 3, 5, 6, 7}


def test_outcome_attempts(spark):
    at = dt.datetime(2024, 1, 1)
    plan = outcomes.schedule(spark.createDataFrame([("t", at)], "trigger_id string, trigger_fired_at timestamp"), ["a"], [60]).withColumn("attempts", F.lit(4))
    none = spark.createDataFrame([], "asset string, ts timestamp, close double")
    got = outcomes.resolve(plan, none, F.lit("2024-02-01").cast("timestamp")).first()
    assert got["status"] == "unavailable" and got["attempts"] == 5
    got = outcomes.resolve(plan, none, F.lit("2023-02-01").cast("timestamp")).first()
    assert got["status"] == "pending" and got["attempts"] == 4


def texts(spark, *titles):
    return spark.createDataFrame([(t,) for t in titles], "t string")


def test_text_functions(spark):
    r = texts(spark, "US strikes Iran near the Strait of Hormuz 2024").select(T.anchors(F.col("t")).alias("a"), T.keywords(F.col("t")).alias("k"), T.actor_pairs(T.anchors(F.col("t"))).alias("p")).first()
    assert r["a"] == ["hormuz", "iran", "usa"] and r["k"] == ["hormuz", "iran", "near", "strait", "strikes", "usa"] and r["p"] == ["hormuz+iran", "hormuz+usa", "iran+usa"]
    assert texts(spark, "iran-hormuz-de-escalation").select(T.signature_root(F.col("t"))).first()[0] == "iran-hormuz"
    assert texts(spark, "SEC sues Binance over bitcoin ETH").select(T.tickers(F.col("t"))).first()[0] == ["BTC", "ETH"]
    assert texts(spark, "nothing").select(T.tickers(F.col("t"))).first()[0] is None
    assert texts(spark, "12").select(T.story_hash(F.col("t"))).first()[0] == __import__("hashlib").sha1(b"12").hexdigest()[:16]
    got = [r[0] for r in texts(spark, "Fed signals rate cut", "Exchange hacked, funds stolen", "hello").select(T.category(F.col("t"))["category"]).collect()]
    assert got == ["macro", "exchange_event", "uncategorized"]


def headline(spark, rows):
    return spark.createDataFrame(rows, "headline_id long, title string, category string, direction string, verb_category string, published_at timestamp")


def test_triggers_match_split_and_archive(spark):
    at = dt.datetime(2024, 1, 1)
    h = lambda i, t, d, day: (i, t, "geopolitical", d, None, at + dt.timedelta(days=day))
    rows = [h(1, "iran war near hormuz", "escalation", 0), h(2, "iran war hormuz again", None, 1), h(3, "iran war hormuz", "de-escalation", 2), h(4, "quiet", None, 2), h(5, "iran war near hormuz", "escalation", 40)]
    got = {r.headline_id: r for r in narratives.mentions(headline(spark, rows)).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert got[1].is_novel and not got[2].is_novel and got[2].trigger_id == got[1].trigger_id
    assert got[3].is_novel and got[3].signature.endswith("-de-escalation")
    assert got[5].is_novel and got[5].trigger_id == got[1].trigger_id and got[5].mention_count == 3


def test_consolidation(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, "iran war hormuz alpha", "geopolitical", "escalation", None, at), (2, "iran war hormuz alpha", "geopolitical", "de-escalation", None, at + dt.timedelta(hours=1)), (3, "china tariff beta gamma", "geopolitical", None, None, at)]
    table = narratives.triggers(headline(spark, rows))
    ids = narratives.consolidation(table)
    assert ids.count() == 1
    assert sorted(r.mention_count for r in narratives.merged(table, ids).collect()) == [1, 2]


def test_stream_equals_batch(spark):
    from tidemark.plans import registry, streams

    sf = "/root/testdata/sf0.001"
    batch = {(r.headline_id, r.trigger_id, r.is_novel) for r in streams.batch_mentions(spark, sf).collect()}
    stream = {(r.headline_id, r.trigger_id, r.is_novel) for r in registry.queries()["stream_headlines"](spark, sf).collect()}
    assert stream == batch


def test_ladder(spark):
    df = spark.createDataFrame([(4.0, 5, 4, 1.0, 3.6, None), (0.0, 1, 0, 1.0, 2.5, -0.2), (0.0, 1, 0, 1.0, 2.5, None), (3.0, 5, 4, 1.0, None, None), (0.0, 1, 0, 1.0, None, None)], "z double, n long, t long, m double, r double, d double")
    got = [r[0] for r in df.select(topics.ladder(F.col("z"), F.col("n"), F.col("t"), F.col("m"), F.col("r"), F.col("d"))["severity"]).collect()]
    assert got == ["hot", "warm", "watch", "watch", None]


def paneled(spark, table):
    rows = [(s, d, float(x)) for s, xs in table.items() for d, x in zip(days(*range(len(xs))), xs, strict=True) if x is not None]
    return P.panel(spark.createDataFrame(rows, "symbol string, d date, close double"))


def plain_rotation(table, n, k, h, cost, loss=None, flags=None, recover=0):
    """The rotation walked day by day."""
    names, size = sorted(table), len(next(iter(table.values())))
    last = {s: max(j for j in range(size) if table[s][j] is not None) for s in names}
    value, held, out, until = 1.0, [], [1.0], -1
    for i in range(n, size - 1, h):
        gain = {s: table[s][i] / table[s][i - n] - 1 for s in names if table[s][i] is not None and table[s][i - n] is not None}
        basket = sorted((s for s in gain if gain[s] > 0), key=lambda s: (-gain[s], s))[:k]
        value *= 1 - len(set(held) ^ set(basket)) / (2 * k) * cost
        held = list(basket)
        for j in range(i + 1, min(i + h, size - 1) + 1):
            if flags is not None and flags[j]:
                until = j + recover
                value *= 1 - (cost if held else 0)
                held = []
            elif flags is not None and j <= until:
                pass
            else:
                if flags is not None and not held and basket:
                    held = list(basket)
                    value *= 1 - cost
                gone = [s for s in held if loss is not None and last[s] < size - 1 and j > last[s]]
                stay = [s for s in held if s not in gone]
                moves = [table[s][j] / table[s][j - 1] - 1 for s in stay] + [-(loss or 0.0)] * len(gone)
                value *= 1 + (sum(moves) / len(moves) if moves else 0.0)
                held = stay
            out.append(value)
    return out


def random_table(seed, size=60, names="abcd"):
    rng = np.random.default_rng(seed)
    return {s: list(np.exp(np.cumsum(rng.normal(0, 0.05, size)))) for s in names}


def curve_of(rows, cell=0):
    return [r.equity for r in sorted(rows, key=lambda r: r.j) if r.cell == cell]


def test_rotation_against_python(spark):
    cells = [{"n": 5, "k": 2, "h": 3, "cost": 0.001}, {"n": 2, "k": 3, "h": 1, "cost": 0.01}, {"n": 9, "k": 1, "h": 20, "cost": 0.0}]
    table = random_table(3)
    rows = P.curve(paneled(spark, table), cells).collect()
    for i, c in enumerate(cells):
        assert curve_of(rows, i) == pytest.approx(plain_rotation(table, **c))
    falling = {"a": list(np.linspace(10, 1, 30))}
    assert set(curve_of(P.curve(paneled(spark, falling), [{"n": 3, "k": 1, "h": 2, "cost": 0.01}]).collect())) == {1.0}


def test_delisting_costs_once(spark):
    table = random_table(4, 40)
    table["b"][17:] = [None] * 23
    table["d"][30:] = [None] * 10
    cells = [{"n": 4, "k": 3, "h": h, "cost": 0.002, "loss": x} for h in (1, 6) for x in (0.0, 0.7)]
    rows = P.curve(paneled(spark, table), cells).collect()
    for i, c in enumerate(cells):
        assert curve_of(rows, i) == pytest.approx(plain_rotation(table, **c))


def test_breaker_against_python(spark):
    table, rng = random_table(6, 70), random.Random(1)
    cells = [{"n": 4, "k": 2, "h": h, "cost": 0.01, "recover": r} for h in (1, 5) for r in (0, 2, 9)]
    flags = [rng.random() < 0.15 for _ in range(70)]
    df = spark.createDataFrame([(c, j, f) for c in range(len(cells)) for j, f in enumerate(flags)], "cell int, j int, flag boolean")
    rows = P.curve(paneled(spark, table), cells, df).collect()
    for i, c in enumerate(cells):
        assert curve_of(rows, i) == pytest.approx(plain_rotation(table, flags=flags, **c))


def test_breaker_flags(spark):
    """On the next day, of a spike or a fall from the high; against pandas."""
    table = random_table(9, 60, "a")
    close = pd.Series(table["a"])
    r = close.pct_change()
    got = {r_.j: r_.flag for r_ in P.breaker_flags(paneled(spark, table), "a", [{"v": 5, "m": 1.2, "dd": 0.1}], 10, 20).collect()}
    up = (r.rolling(5).std() > 1.2 * r.rolling(20).std()) | (close / close.rolling(10).max() - 1 < -0.1)
    assert [got[j] for j in range(60)] == [False, *up[:-1].tolist()]


def test_vol_target_against_pandas(spark):
    base = P.curve(paneled(spark, random_table(5)), [{"n": 5, "k": 2, "h": 3, "cost": 0.001}])
    cell = {"target": 0.3, "lookback": 6, "most": 1.5, "cost": 0.001, "lend": 0.04, "borrow": 0.08}
    rows = sorted(P.vol_target(base, [cell]).collect(), key=lambda r: r.j)
    b = base.orderBy("j").toPandas()
    known = (b["ret"].rolling(6).std() * math.sqrt(365)).shift(1)
    e = (0.3 / known).clip(upper=1.5).fillna(0.0)
    day = b["ret"] * e + (1 - e).clip(lower=0) * 0.04 / 365 - (e - 1).clip(lower=0) * 0.08 / 365 - (b["turnover"] * e + e.diff().abs().fillna(0)) * 0.001
    assert [r.exposure for r in rows] == pytest.approx(e.tolist()) and [r.equity for r in rows] == pytest.approx((1 + day).cumprod().tolist())


def test_book_sync():
    b = B.BookSync(False)
    assert b.apply(1, 2, [], []) == "gap"
    b.snapshot(10, [(99.0, 1.0)], [(101.0, 2.0)])
    assert b.apply(8, 9, [], []) == "stale" and b.apply(9, 11, [(99.0, 3.0)], []) == "ok" and b.flows[("b", 99, "added")] == 198.0
    assert b.apply(12, 13, [(99.0, 0.0), (98.0, 1.0)], []) == "ok" and 99.0 not in b.levels["b"]
    assert b.apply(20, 21, [], []) == "gap" and not b.synced
    f = B.BookSync(True)
    f.snapshot(10, [(99.0, 1.0)], [(101.0, 2.0)])
    assert f.apply(9, 12, [], [], 8) == "ok" and f.apply(13, 14, [], [], 12) == "ok" and f.apply(15, 16, [], [], 99) == "gap"
    f.snapshot(20, [(99.0, 1.0)], [(101.0, 2.0)])
    assert f.apply(20, 22, [(102.0, 1.0)], [], 19) == "crossed"


FEED = "market string, seq long, ts double, kind string, u1 long, u2 long, pu long, side string, price double, qty double"


def feed(market, seed, snapshots, hours=12):
    """Change events with holes, crossings, ties and trades without a number; snapshots in some hours only."""
    r, u, out, seq = random.Random(seed), 100, [], itertools.count()
    for t in range(0, hours * 3600, 20):
        kind = "snapshot" if snapshots and t // 3600 % 4 != 2 and r.random() < 0.01 else "trade" if r.random() < 0.2 else "diff"
        hole = 5 * (r.random() < 0.005)
        first, u = u + 1 + hole, u + (kind != "trade") * r.choice([1, 1, 1, 2]) + hole
        for _ in range(r.randint(1, 4) if kind != "snapshot" else 8):
            side = r.choice("ab")
            price = r.choice([95.0, 97.0, 99.0, 99.5]) if side == "b" else r.choice([100.0, 101.0, 103.0, 99.4 if r.random() < 0.01 else 106.0])
            out.append((market, next(seq), t + r.choice([0.0, 0.5]) * (kind == "trade"), kind, first, None if kind == "trade" and r.random() < 0.5 else u, None, side, price, float(r.randint(0, 3))))
    return out


def test_reconstruct_in_stretches(spark):
    """A market's stretches give the minutes of one fold over all of it, in several tasks, whatever the order of the rows."""
    parts = {"x": feed("x", 1, True), "y": feed("y", 2, True), None: feed(None, 3, True), "z": feed("z", 4, False)}
    names = [c.split(" ")[0] for c in FEED.split(", ")]
    want = [(m, *r) for m, rows in parts.items() for r in B.minute_flows(pd.DataFrame(rows, columns=names), None, 2.0)[0]]
    rows = [r for p in parts.values() for r in p]
    random.Random(5).shuffle(rows)
    with_parts = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    for k, v in with_parts.items():
        spark.conf.set(k, v)
    try:
        out = B.reconstruct(spark.createDataFrame(rows, FEED).repartition(5), 2.0, ("seq",)).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k in with_parts:
            spark.conf.unset(k)
    key = lambda r: (str(r[0]), *r[1:])
    assert len(want) > 1000 and sorted((tuple(r)[:-1] for r in out), key=key) == sorted(want, key=key)
    assert len({r.part for r in out if r.market == "x"}) > 1


def test_reconstruct_breaks_ties_by_values(spark):
    rows = [("x", 0, 0.0, "snapshot", 9, 10, None, s, p, 5.0) for s, p in (("b", 99.0), ("a", 101.0))] + [("x", 0, 61.0, "diff", 10, 11, None, "b", 99.0, q) for q in (1.0, 4.0, 2.0)]
    got = {tuple(sorted(tuple(r) for r in B.reconstruct(spark.createDataFrame(x, FEED).coalesce(1)).where("minute = 1 and side = 'b'").collect())) for x in (rows, rows[::-1])}
    assert got == {(("x", 1, "b", 99, 4.0 * 99, 3.0 * 99, 4.0 * 99, 0.0, 1.0),)}


def test_reconstruct_holds_only_the_book(monkeypatch):
    """Minutes come out while most of a stretch has not been read."""
    monkeypatch.setattr(B, "OUT_ROWS", 10)
    read = []

    def batches():
        for m in range(1000):
            read.append(m)
            kind = "diff" if m else "snapshot"
            yield pa.RecordBatch.from_pylist([{"market": "x", "cut": -1, "ts": 60.0 * m, "kind": kind, "u2": m, "u1": m, "pu": None, "side": s, "price": p, "qty": 1.0 + m} for s, p in (("b", 99.0), ("a", 101.0))])

    out = B._stretches(1.0)(batches())
    assert next(out).num_rows == 10 and len(read) < 10
    assert 10 + sum(b.num_rows for b in out) == 2000


def test_bucket_border(spark):
    assert spark.range(1).select(B.bucket(F.lit(2400.0), F.lit(2.0))).first()[0] == 1200


def test_wall_episode_fates(spark):
    """Bucket 1 keeps the book deep, so that an empty bucket 10 counts as observed."""
    deep = [("s", "bid", 1, t, 1.0, False) for t in range(8)]

    def fates(rows, prices, flows=None):
        cells = spark.createDataFrame([r + (flows or {}).get((r[2], r[3]), (0.0, 0.0)) for r in rows], "symbol string, side string, k long, t long, usd double, is_wall boolean, traded double, removed double")
        p = spark.createDataFrame([("s", t, *x, True) for t, x in prices.items()], "symbol string, t long, lo double, hi double, clean boolean")
        judge = B.photo_fates if flows is None else B.flow_fates
        return [(r.k, r.fate, r.last_t, r.absent_t) for r in judge(B.episodes(cells, 1), cells, p, 1.0).collect()]

    high = dict.fromkeys(range(10), (50.0, 60.0))
    wall = [*deep, ("s", "bid", 10, 0, 100.0, True), ("s", "bid", 10, 1, 80.0, True)]
    assert fates(wall, high) == [(10, "PULLED", 1, 2)]
    assert fates([*wall, ("s", "bid", 12, 2, 90.0, False)], high) == [(10, "MOVED", 1, 2)]
    assert fates([*wall, ("s", "bid", 12, 1, 90.0, False), ("s", "bid", 12, 2, 90.0, False)], high) == [(10, "PULLED", 1, 2)]
    assert fates(wall, {**high, 2: (10.5, 60.0)}) == [(10, "REACHED", 1, 2)]
    assert fates(wall, {0: (50.0, 60.0)}) == [(10, "CENSORED", 1, 2)]
    assert [r[1] for r in fates([("s", "bid", 10, 0, 100.0, True), ("s", "bid", 50, 1, 1.0, False), ("s", "bid", 50, 2, 1.0, False)], high)] == ["CENSORED"]
    assert [r[1] for r in fates([("s", "bid", 10, 0, 100.0, True), ("s", "bid", 10, 9, 100.0, False)], high)] == ["CENSORED"]
    gone = [*wall, ("s", "bid", 10, 2, 0.0, False)]
    assert [r[1] for r in fates(gone, high, {(10, 2): (50.0, 100.0)})] == ["FILLED"]
    assert [r[1] for r in fates(gone, high, {(10, 2): (49.0, 100.0)})] == ["CANCELLED"]
    assert [r[1] for r in fates(gone, high, {(10, 2): (49.0, 0.0)})] == ["CENSORED"]


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, ver int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1), (3, "d", 1)], "k long, v string, ver int")
    once = upsert.ignore(old, new, ["k"])
    assert sorted(map(tuple, upsert.ignore(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect())) == [(1, "a", 0), (2, "b", 0), (3, "d", 1)]
    latest = upsert.replace(old, new, ["k"], "ver")
    assert sorted(map(tuple, upsert.replace(latest, new, ["k"], "ver").collect())) == sorted(map(tuple, latest.collect())) == [(1, "a", 0), (2, "c", 1), (3, "d", 1)]
    assert tuple(upsert.counted(old, new, ["k"]).first()) == (1, 2)


def test_archives(spark, tmp_path):
    (tmp_path / "k.csv").write_text("open_time,open\n1704067200000,1,2,0.5,1.5,10,0,0,0,4,0,0\n1704067200000000,1,2,0.5,1.5,10,0,0,0,40,0,0\n")
    k = archives.klines(spark, str(tmp_path / "k.csv"), "BTC")
    assert [r.ts for r in k.collect()] == [dt.datetime(2024, 1, 1)] * 2
    with pytest.raises(Exception, match="taker volume"):
        archives.checked_takers(k).collect()
    assert list(archives.objects('[{"a": 1}, {"b": {"c": 2}}, {"d": ')) == [{"a": 1}, {"b": {"c": 2}}]
    assert archives.query_batches(["a b", "c", "dddd"], 12) == ['"a b" OR c', "dddd"]
    assert tuple(spark.createDataFrame([("ETH-21JUN26-2200-C",)], "n string").select(archives.option_name(F.col("n")).alias("o")).select("o.*").first()) == ("ETH", dt.date(2026, 6, 21), 2200.0, "C")
    s = spark.createDataFrame([("BTCUSDT",), ("BTCUPUSDT",), ("USDCUSDT",), ("AAPLBUSDT",), ("BNBUSDT",), ("ETHEUR",)], "s string")
    assert [r.s for r in archives.tradeable(s, "s", "USDT").collect()] == ["BTCUSDT", "BNBUSDT"]
