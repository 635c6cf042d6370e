"""Readers, guards, sinks and keyed writes on small files and tables."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scorers
from tidemark.functions import text as T
from tidemark.operators import asof, book, outcomes
from tidemark.sources import archives, sinks, upsert


def test_book_depth_reads_two_time_formats(spark, tmp_path):
    (tmp_path / "d.csv").write_text("timestamp,percentage,depth,notional\n2024-01-01 00:00:05,-1.00,10,100\n1704067206000,2,11,120\n2024-01-01 00:00:07,0.20,9,9\n2024-01-01 00:00:07,0,9,9\nbad,1,9,9\n")
    got = sorted((r.ts, r.pct, r.depth, r.notional) for r in archives.book_depth(spark, str(tmp_path / "d.csv"), "X").collect())
    assert got == [(dt.datetime(2024, 1, 1, 0, 0, 5), -1, 10.0, 100.0), (dt.datetime(2024, 1, 1, 0, 0, 6), 2, 11.0, 120.0)]


def test_gkg_lines(spark, tmp_path):
    def line(n, **at):
        c = [""] * n
        for i, v in at.items():
            c[int(i[1:])] = v
        return "\t".join(c)

    rows = [line(27, c1="20240102030405", c4="http://a/bitcoin-falls", c15="-2.5,1,2"), line(27, c1="bad", c4="http://b/x", c13="SEC;FED", c15=""), line(27, c1="20240102030405", c4="http://c/none"), line(5, c4="http://d/bitcoin")]
    (tmp_path / "g.tsv").write_text("\n".join(rows) + "\n")
    got = sorted(map(tuple, archives.gkg(spark, str(tmp_path / "g.tsv"), r"bitcoin|\bsec\b").collect()), key=str)
    assert got == sorted([(dt.datetime(2024, 1, 2, 3, 4, 5), "http://a/bitcoin-falls", -2.5), (None, "http://b/x", None), (None, "http://d/bitcoin", None)], key=str)


def test_feed_entries(spark):
    now = F.lit("2024-01-10").cast("timestamp")
    rows = [("a long enough title", "2024-01-09T00:00:00Z", None), ("short", "2024-01-09T00:00:00Z", None), ("another long title", "Mon, 08 Jan 2024 10:00:00 +0000", None), ("an old long title", "2023-12-01T00:00:00Z", None), ("no date but long", None, None), ("dated by its update", "?", "2024-01-07T00:00:00Z")]
    got = {r.title: r.published_at for r in archives.feed_entries(spark.createDataFrame(rows, "title string, published string, updated string"), now).collect()}
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    assert got == {"a long enough title": day(9), "another long title": day(8, 10), "no date but long": day(10), "dated by its update": day(7)}


def test_salvaged_and_island(spark):
    rows = spark.createDataFrame([('[{"a": 1}, {"b": [2, {"c": 3}]}, {"d',), ("",), (None,)], "body string")
    assert sorted(json.loads(r.object).popitem()[0] for r in archives.salvaged(rows, "body").collect()) == ["a", "b"]
    html = '<p><script id="__NEXT_DATA__" type="application/json">{"flows": [{"d": "2024-01-02", "net": -3.5}]}</script>'
    page = spark.createDataFrame([(html,), ("<p>none</p>",)], "html string")
    got = [r.x for r in page.select(archives.data_island(F.col("html"), "flows array<struct<d: string, net: double>>").alias("x")).collect()]
    assert got[0].flows[0].net == -3.5 and (got[1] is None or got[1].flows is None)


def test_slots_units_and_columns(spark):
    assert archives.slots(spark, "2024-01-01 00:00:00", "2024-01-01 01:00:00").count() == 5
    for values, want in (([50.0, 60.0, 70.0], [0.5, 0.6, 0.7]), ([0.5, 0.6, 0.7], [0.5, 0.6, 0.7])):
        got = archives.scaled_iv(spark.createDataFrame([(v,) for v in values], "iv double"), "iv").collect()
        assert sorted(r.iv for r in got) == pytest.approx(want)
    df = archives.with_columns(spark.createDataFrame([(1, "x")], "b int, a string"), {"a": "string", "c": "double", "b": "long"})
    assert df.dtypes == [("a", "string"), ("c", "double"), ("b", "bigint")] and tuple(df.first()) == ("x", None, 1)


def test_guards(spark):
    pages = spark.createDataFrame([("s", 0, 5), ("s", 1, 9), ("s", 2, 9), ("s", 3, 20), ("t", 0, 1)], "k string, page int, ts int")
    assert sorted((r.k, r.page) for r in archives.progressing(pages, ["k"], "page", "ts").collect()) == [("s", 0), ("s", 1), ("t", 0)]
    listed = [("whole", 0, True), ("whole", 1, False), ("cut", 0, True), ("gap", 0, True), ("gap", 2, False), ("late", 1, False)]
    assert {r.listing for r in archives.complete_listings(spark.createDataFrame(listed, "listing string, page int, truncated boolean")).collect()} == {"whole"}
    closes = spark.createDataFrame([("a", 1, 10.0), ("a", 2, None), ("a", 3, 12.0), ("a", 4, 6.0)], "s string, d int, c double")
    assert [r.daily_return for r in archives.daily_returns(closes, ["s"], "d", "c").orderBy("d").collect()] == [None, None, pytest.approx(0.2), -0.5]


def test_keyed_writes(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 9))], "id int, ts timestamp")
    assert [r.id for r in upsert.retained(rows, "ts", F.lit("2024-01-10").cast("timestamp"), 5).collect()] == [2]
    alerts = spark.createDataFrame([(1, None, None), (2, "2024-01-01", "x"), (3, None, None)], "id int, consumed_at string, acked_by string")
    got = {r.id: (r.consumed_at, r.acked_by) for r in upsert.acknowledged(alerts, spark.createDataFrame([(1,), (2,), (9,)], "id int"), "me", F.lit("now")).collect()}
    assert got == {1: ("now", "me"), 2: ("2024-01-01", "x"), 3: (None, None)}
    moved = upsert.remapped(spark.createDataFrame([(7, "a"), (8, "a"), (9, "b")], "trigger int, v string"), spark.createDataFrame([(7, 8)], "old_id int, new_id int"), "trigger")
    assert sorted(map(tuple, moved.collect())) == [(8, "a"), (9, "b")]
    known = spark.createDataFrame([("a", 2, "x")], "k string, n long, note string")
    more = upsert.incremented(known, spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), ["k"], "n")
    assert sorted(map(tuple, more.collect())) == [("a", 4, "x"), ("b", 1, None)]
    once = outcomes.insert_new if hasattr(outcomes, "insert_new") else None
    assert once is None or callable(once)


def test_json_report(spark, tmp_path):
    sinks.json(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), str(tmp_path / "r"))
    assert sorted(r.k for r in spark.read.json(str(tmp_path / "r")).collect()) == [1, 2]


def test_text_parts(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    v = value(T.first_verb(F.lit("Iran never attacked the strait")))
    assert (v.lemma, v.negated) == ("attack", True)
    assert value(T.first_verb(F.lit("plain words")))["lemma"] is None and value(T.first_verb(F.lit("SEC eases rules")))["negated"] is False
    assert json.loads(value(T.json_merge(F.lit('{"a": 1, "b": 2}'), F.lit('{"b": 3, "c": 4}')))) == {"a": 1, "b": 3, "c": 4}


def test_scorers(spark):
    made = []

    def make():
        made.append(1)
        return lambda texts: [(len(t),) for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "xy")], "id int, title string")
    assert {r.id: r.size for r in scorers.scored(rows, "title", make, "size long").collect()} == {1: 3, 2: 0, 3: 2}
    got = scorers.rule_based()(["Bitcoin ETF approved by the SEC", "zzz"])
    assert len(got) == 2 and got[1] == ("uncategorized", "none")


def test_window_extremes(spark):
    left = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1))], "id int, s string, at timestamp")
    right = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, h), float(h), -float(h)) for h in (0, 1, 2, 5)], "s string, ts timestamp, high double, low double")
    r = asof.window_extremes(left, right, ["s"], "id", "at", "ts", "high", "low", 7200).first()
    assert (r.max_high, r.min_low) == (2.0, -2.0)


def test_cumulative_depth(spark):
    cells = spark.createDataFrame([(1, "bid", k, 10.0) for k in (5, 6, 7)] + [(1, "ask", k, 1.0) for k in (8, 9)], "snap int, side string, k long, usd double")
    got = {(r.side, r.k): r.depth for r in book.cumulative_depth(cells).collect()}
    assert got == {("bid", 7): 10.0, ("bid", 6): 20.0, ("bid", 5): 30.0, ("ask", 8): 1.0, ("ask", 9): 2.0}
    assert pd is not None
