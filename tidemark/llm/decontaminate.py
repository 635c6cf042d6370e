"""Benchmark decontamination with suffix arrays of the training text.

Each slice of documents is a shard. Its suffix array holds the suffixes that
begin with the first words of some test suffix, sorted word by word as far as
a window can reach; every suffix of a benchmark item that holds a whole window
is searched in it by bisection, word by word, as far as the window, which
yields all locations where the window stands. Windows that follow one another
in both item and document are joined to the longest verbatim matches. Matches
shorter than a window are not searched for.

The test suffixes go to the tasks in blocks of at most BLOCK_WORDS words, so
what is broadcast does not grow with the benchmark; with several blocks the
documents are stored with a key for each row, passed once for each block and
the results joined by that key.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import stored
from .words import ALNUM, Slice, rolling, slices, words

WINDOW = 13
BLOCK_WORDS = 1 << 19
_HEAD = 4  # words by which suffixes are chosen for the array


class TestSuffixes:
    """All suffixes of a block of items, as word hashes."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.ids, self.window = [i for i, _ in items], window
        data = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        offs = np.r_[0, np.cumsum([len(t) for _, t in items])].astype(np.int64)
        w = words(Slice(0, len(items), data, offs), ALNUM)
        self.h, self.bounds = w.hashes, w.bounds
        self.vocabulary = np.unique(self.h)
        # Windows: starts, lengths and items of those that can be hit.
        start, size, item = [], [], []
        for i in range(len(items)):
            a, b = int(w.bounds[i]), int(w.bounds[i + 1])
            n = min(window, b - a)
            for s in range(a, b - n + 1) if n else ():
                start.append(s)
                size.append(n)
                item.append(i)
        self.start, self.size, self.item = (np.array(x, np.int64) for x in (start, size, item))
        symbols = np.searchsorted(self.vocabulary, self.h) + 1 if len(self.h) else np.zeros(0, np.int64)
        pad = np.r_[symbols, np.zeros(window, np.int64)]
        self.rows = np.zeros((len(self.start), window), np.uint32)
        for j in range(window):
            inside = j < self.size
            self.rows[inside, j] = pad[self.start[inside] + j]
        # Equal windows are one row of the search; `of` lists the windows of each, `first` where its list begins.
        if len(self.rows):
            self.rows, number = np.unique(self.rows, axis=0, return_inverse=True)
            self.of = np.argsort(number.ravel(), kind="stable")
            self.first = np.searchsorted(number.ravel()[self.of], np.arange(len(self.rows) + 1))
            self.length = self.size[self.of[self.first[:-1]]]
        # First words, by which a shard's suffixes are chosen; shorter windows by all of theirs.
        self.heads = {}
        for k in range(1, min(_HEAD, window) + 1):
            own = self.size >= k if k == min(_HEAD, window) else self.size == k
            if own.any():
                at = self.start[own]
                self.heads[k] = np.unique(rolling_at(self.h, at, k))


def rolling_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words at some places."""
    return rolling(h, k)[at] if len(at) else np.zeros(0, np.uint64)


def search(rows: np.ndarray, size: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bisects each test suffix in a sorted suffix array.

    array: one row of symbols for each suffix, sorted. Returns for each test
    suffix the range [lo, hi) of array rows that begin with all its words,
    and the length of its longest verbatim match.
    """
    lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(array), np.int64)
    longest = np.zeros(len(rows), np.int64)
    for j in range(rows.shape[1]):
        go = np.flatnonzero((size > j) & (lo < hi))
        if not len(go):
            break
        column, want = array[:, j], rows[go, j]
        a, b = _bisect(column, lo[go], hi[go], want, False), _bisect(column, lo[go], hi[go], want, True)
        longest[go[a < b]] = j + 1
        lo[go], hi[go] = a, b
    return lo, hi, longest


def _bisect(column, lo, hi, want, right: bool) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        v = column[np.minimum(mid, len(column) - 1)]
        up = open_ & ((v <= want) if right else (v < want))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def suffix_array(test: TestSuffixes, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and symbol rows of a shard's chosen suffixes, sorted word by word."""
    n, chosen = len(h), np.zeros(len(h), bool)
    for k, heads in test.heads.items():
        run = rolling(h, k)
        at = np.minimum(np.searchsorted(heads, run), len(heads) - 1)
        chosen[: len(run)] |= heads[at] == run
    place = np.flatnonzero(chosen)
    end = bounds[np.searchsorted(bounds, place, "right")]
    rows = np.zeros((len(place), test.window), np.uint32)
    for j in range(test.window):
        at = place + j
        ok = at < end
        x = h[np.minimum(at, n - 1)]
        s = np.minimum(np.searchsorted(test.vocabulary, x), len(test.vocabulary) - 1)
        rows[:, j] = np.where(ok & (test.vocabulary[s] == x), s + 1, 0)
    order = np.lexsort(rows.T[::-1])
    return place[order], rows[order]


def matches(test: TestSuffixes, h: np.ndarray, bounds: np.ndarray):
    """For every document of a slice: hit words, and the items with windows there.

    Returns the number of hit words by document, whether each word is hit,
    (document, item) pairs, and the rows of the search found with their places.
    """
    n_docs = len(bounds) - 1
    cover = np.zeros(len(h) + 1, np.int64)
    none = np.zeros(0, np.int64)
    if not len(h) or not len(test.start):
        return np.zeros(n_docs, np.int64), cover[:-1] > 0, none, none, none, none
    place, array = suffix_array(test, h, bounds)
    lo, hi, longest = search(test.rows, test.length, array)
    full = np.flatnonzero(longest == test.length)
    at, row = _expand(lo[full], hi[full])
    at, row = place[at], full[row]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + test.length[row], -1)
    hit = np.cumsum(cover)[:-1] > 0
    pairs = np.unique(np.stack([np.searchsorted(bounds, at, "right") - 1, row]), axis=1)
    which, pair = _expand(test.first[pairs[1]], test.first[pairs[1] + 1])
    pairs = np.unique(np.stack([pairs[0][pair], test.item[test.of[which]]]), axis=1)
    total = np.r_[0, np.cumsum(hit)]
    return total[bounds[1:]] - total[bounds[:-1]], hit, pairs[0], pairs[1], row, at


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), and the range that each comes from."""
    count = hi - lo
    return np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum())), np.repeat(np.arange(len(lo)), count)


def longest_matches(test: TestSuffixes, row: np.ndarray, at: np.ndarray, bounds: np.ndarray):
    """The rows found and their places joined to longest matches: document, word there, words, item, word there."""
    which, place = _expand(test.first[row], test.first[row + 1])
    window, at = test.of[which], at[place]
    start, item, doc = test.start[window], test.item[window], np.searchsorted(bounds, at, "right") - 1
    order = np.lexsort((at, at - start, item, doc))
    window, at, start, item, doc = (x[order] for x in (window, at, start, item, doc))
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (start[1:] != start[:-1] + 1)
    cut = np.flatnonzero(new)
    size = test.size[window[cut]] + np.diff(cut, append=len(at)) - 1
    return doc[cut], at[cut] - bounds[doc[cut]], size, item[cut], start[cut] - test.bounds[item[cut]]


def verdict(n_words: int, n_hit: int) -> bool:
    """Contaminated: a twentieth of a document's words, at least one, are hit."""
    return n_hit > 0 and 20 * n_hit >= n_words


def _spans(hit: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return edge.reshape(-1, 2).tolist()


_MATCH = pa.struct([("word", pa.int64()), ("n_words", pa.int64()), ("item", pa.string()), ("item_word", pa.int64())])
_MATCH_SQL = "array<struct<word: long, n_words: long, item: string, item_word: long>>"
_FOUND_SQL = f"doc_id long, n_words long, n_hit long, items array<string>, spans string, matches {_MATCH_SQL}"


def _scan(test, with_matches):
    def run(batches):
        suffixes = test.value
        for b in batches:
            keys = [c for c in b.schema.names if c != "text"]
            n_words, n_hit, items, spans, longest = [], [], [], [], []
            for s in slices(b.column("text")):
                w = words(s, ALNUM)
                hits, hit, doc, item, row, at = matches(suffixes, w.hashes, w.bounds)
                n_words += np.diff(w.bounds).tolist()
                n_hit += hits.tolist()
                own: list[list[str]] = [[] for _ in range(s.hi - s.lo)]
                for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                    if suffixes.ids[i] is not None:
                        own[d].append(suffixes.ids[i])
                items += own
                held: list[list] = [[] for _ in range(s.hi - s.lo)]
                if with_matches and len(at):
                    for d, x, n, i, y in zip(*(c.tolist() for c in longest_matches(suffixes, row, at, w.bounds)), strict=True):
                        held[d].append({"word": x, "n_words": n, "item": suffixes.ids[i], "item_word": y})
                longest += held
                spans += [json.dumps(_spans(hit[w.bounds[i] : w.bounds[i + 1]])) if hits[i] else "[]" for i in range(s.hi - s.lo)]
            found = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.string()), pa.array(longest, pa.list_(_MATCH))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), *found], names=[*keys, "n_words", "n_hit", "items", "spans", "matches"])

    return run


def _item_blocks(benchmark: DataFrame, block_words: int):
    """The items in blocks of bounded size, one block on the driver at a time."""
    block, size = [], 0
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    for r in rows.toLocalIterator():
        block.append((r["i"], r["t"].encode()))
        size += len(r["t"]) // 2 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _union(sets: list[str]) -> list[list[int]]:
    """Union of span lists."""
    spans = sorted(x for s in sets for x in json.loads(s))
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, with_matches: bool = True) -> DataFrame:
    """Where benchmark windows stand in docs(doc_id, text).

    Returns one row for each document: doc_id, n_words, n_hit (words inside
    any occurrence of a window), items (sorted distinct item ids), spans (JSON
    list of hit word ranges) and matches (sorted; the longest verbatim matches
    of a window or more: first word and words in the document, item id and
    first word in the item; left empty without with_matches). A window is `window` consecutive words of
    an item, or the whole item if it has fewer. Null or empty texts have no
    words and are not hit; items whose text is null or without words hit nothing, and
    those without an id hit as any other but are not among items.
    Rows with the same doc_id or none are rows of their own, whatever the
    number of blocks. Other columns are ignored. Empty tables give an empty
    result, or no hits.
    """
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = _tests(benchmark, window, block_words)
    if len(tests) == 1:
        return cols.mapInArrow(_scan(tests[0], with_matches), _FOUND_SQL).withColumn("items", F.array_sort(F.array_distinct("items"))).withColumn("matches", F.array_sort("matches"))
    keyed = stored(cols.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "keyed")
    return _by_row(keyed, tests, with_matches).select("doc_id", "n_words", "n_hit", "items", "spans", "matches")


def _tests(benchmark: DataFrame, window: int, block_words: int) -> list:
    """The blocks of test suffixes, each of bounded size, as broadcasts."""
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(TestSuffixes(block, window)) for block in _item_blocks(benchmark, block_words)] or [sc.broadcast(TestSuffixes([], window))]


def _by_row(keyed: DataFrame, tests: list, with_matches: bool) -> DataFrame:
    """The findings of several blocks in stored documents with a row key, joined by that key."""
    found = [keyed.mapInArrow(_scan(test, with_matches), f"row long, {_FOUND_SQL}") for test in tests]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    union = F.udf(lambda s: json.dumps(_union(s)), "string")
    each = rows.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), union(F.collect_list("spans")).alias("spans"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    hits = F.aggregate(F.from_json("spans", "array<array<long>>"), F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return each.select("row", "doc_id", "n_words", hits.alias("n_hit"), "items", "spans", "matches")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document; rows as in `scan`.

    longest, longest_word, longest_item and longest_item_word tell of the
    longest verbatim match (the first of equal ones) how many words it has and
    where it stands in the document and in the item; null without one.
    """
    found = scan(docs, benchmark)
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["n_words"].alias("n"), (-m["word"]).alias("word"), (-m["item_word"]).alias("at"), m["item"].alias("item"))))
    return found.withColumn("best", best).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        _contaminated().alias("contaminated"),
        F.col("best.n").alias("longest"),
        (-F.col("best.word")).alias("longest_word"),
        F.col("best.item").alias("longest_item"),
        (-F.col("best.at")).alias("longest_item_word"),
    )


def _contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def _clean(test):
    def run(batches):
        """The rows of which too few words are hit, as they came."""
        suffixes = test.value
        for b in batches:
            keep = []
            for s in slices(b.column("text").cast(pa.string())):
                w = words(s, ALNUM)
                hits = matches(suffixes, w.hashes, w.bounds)[0]
                keep.append((hits == 0) | (20 * hits < np.diff(w.bounds)))
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return run


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that are not contaminated, unchanged.

    Every row is judged by its own text, whatever its doc_id and however often
    that occurs; null and empty texts have no words and stay. Columns of any
    name pass through; texts of any length are taken whole. Empty tables give
    an empty result, or all rows.
    """
    tests = _tests(benchmark, window, block_words)
    if len(tests) == 1:
        return docs.mapInArrow(_clean(tests[0]), docs.schema)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), whole), "keyed")
    bad = _by_row(keyed.select("row", "doc_id", "text"), tests, False).where(_contaminated()).select("row")
    return keyed.join(bad, "row", "left_anti").select("whole.*")


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
