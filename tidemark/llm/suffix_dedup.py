"""Suffix-array dedup: passages of MIN_WORDS words or more that stand in an earlier document.

Sparse suffixes. Of every MIN_WORDS consecutive words, the run of ANCHOR
words with the smallest hash is the minimiser; only suffixes that start at
minimisers are retained, about one word in 18. Equal passages have equal
minimisers at equal places, whatever stands around them. Suffixes whose first
ANCHOR words occur in one text only are dropped.

Sort and compare. What is left is dealt by the first ANCHOR words, and each
task sorts its suffixes word by word to the right and, by the words before
them, to the left. Lengths of common prefixes of neighbours in the two orders
say how far any two suffixes agree on either side.

Extend. A suffix stands for the windows of MIN_WORDS words whose minimiser it
is. With l words to its left and the rest to its right, two windows are equal
if their suffixes agree that far in both orders; the earliest document of each
such class is its source, and windows of later documents are repeats. Matches of
neighbouring windows and suffixes with one source are joined to maximal ones.

Texts are compared once, whatever the number of their copies: the copy with the
smallest doc_id is compared, the others are repeats as a whole. An anchor that
occurs in more than HOT texts is dealt to several tasks; each finds the repeats
among its own, and only suffixes that are a source there are compared again.
Words are compared by 64-bit hashes, one for each word.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import BLOCK, HotKeys, blocks, dealt, keep_ids, parts, read_blocks, small_ids, spread, stored, text_bytes
from .words import BLANKS, find_words, mix, powers, slices, words

MIN_WORDS, ANCHOR = 50, 16
SAMPLED, HOT = 64, 1 << 14  # one text in SAMPLED tells anchors of more than HOT texts, which are dealt to several tasks
PART_BYTES = 1 << 27  # bytes of text whose suffixes meet in one task
CHUNK = 1 << 13  # suffixes compared at a time, or those of one anchor
PART_ROWS = 1 << 14  # suffixes in one task, about 600 bytes each
_PLACE = np.uint64((1 << 24) - 1)
_SPAN = np.dtype([("doc", "<i8"), ("text", "<i8"), ("pos", "<i4"), ("n", "<i4"), ("first", "<i8"), ("at", "<i4")])


def _suffix_record(reach: int) -> np.dtype:
    """A suffix with the words that its windows reach: `left` of them before it, `right` of them after the anchor."""
    return np.dtype([("key", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("pos", "<i4"), ("hot", "u1"), ("left", "<i4"), ("right", "<i4"), ("before", "<u8", (reach,)), ("after", "<u8", (reach,))])


def run_prints(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * inverse[:n] + np.uint64(k))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(h: np.ndarray, bounds: np.ndarray, size: int, k: int):
    """Minimisers of all windows of `size` words inside documents.

    Returns the start of every window, its minimiser's place, and all
    fingerprints of k words. Slices hold fewer than 2**24 words at a time.
    """
    prints = run_prints(h, k)
    if len(h) < size:
        z = np.zeros(0, np.int64)
        return z, z, prints
    if len(h) > int(_PLACE):
        return _anchors_long(prints, bounds, size, k, len(h))
    tagged = prints & ~_PLACE | np.arange(len(prints), dtype=np.uint64)
    place = (_least(tagged, size - k + 1) & _PLACE).astype(np.int64)
    end = np.repeat(bounds[1:], np.diff(bounds))[: len(place)]
    start = np.flatnonzero(np.arange(len(place)) + size <= end)
    return start, place[start], prints


def _anchors_long(prints, bounds, size, k, n):
    """As `anchors`, for texts of more words than a place's bits can number: piece by piece."""
    step, starts, places = int(_PLACE) // 2, [], []
    for lo in range(0, n - size + 1, step):
        hi = min(n, lo + step + size - 1)
        tagged = prints[lo : hi - k + 1] & ~_PLACE | np.arange(hi - k + 1 - lo, dtype=np.uint64)
        place = (_least(tagged, size - k + 1) & _PLACE).astype(np.int64) + lo
        s = np.arange(lo, lo + len(place))
        ok = s + size <= bounds[np.searchsorted(bounds, s, "right")]
        starts.append(s[ok])
        places.append(place[ok])
    return np.concatenate(starts), np.concatenate(places), prints


def _doc_of(bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, at, "right") - 1


_SUFFIX = np.dtype([("key", "<u8"), ("text", "<i8")])


def _retained(b, size, k):
    """Records (first words' fingerprint, text) of the suffixes of a batch, slice by slice, each pair once."""
    text_key = b.column("text_key").to_numpy()
    for s in slices(b.column("text")):
        w = words(s, BLANKS)
        _, place, prints = anchors(w.hashes, w.bounds, size, k)
        place = np.unique(place)
        rec = np.empty(len(place), _SUFFIX)
        rec["key"], rec["text"] = prints[place], text_key[s.lo + _doc_of(w.bounds, place)]
        yield np.unique(rec)


def _plain_keys(size, k):
    def run(batches):
        for b in batches:
            for rec in _retained(b, size, k):
                yield pa.RecordBatch.from_arrays([pa.array(rec["key"].view(np.int64)), pa.array(np.ascontiguousarray(rec["text"]))], names=["key", "text_key"])

    return run


def _suffixes(size, k, n_parts, hot):
    def run(batches):
        """Retained suffixes as packed records, dealt by key, those of hot keys by key and text."""
        for b in batches:
            held, total = [], 0
            for rec in _retained(b, size, k):
                held.append(rec)
                total += len(rec)
                if total > 1 << 18:
                    yield _dealt_out(held, n_parts, hot.value)
                    held, total = [], 0
            if total:
                yield _dealt_out(held, n_parts, hot.value)

    return run


def _dealt_out(held, n_parts, hot) -> pa.RecordBatch:
    rec = np.concatenate(held)
    salts = hot.of(rec["key"])
    salt = np.where(salts > 0, mix(rec["text"].view(np.uint64)) % np.maximum(salts, 1), 0).astype(np.uint64)
    return blocks(spread(np.where(salt > 0, mix(rec["key"] + salt), rec["key"]), n_parts), n_parts, lambda rows: rec[rows].tobytes())


_NEED = pa.schema([("need_key", pa.int64()), ("keys", pa.list_(pa.struct([("key", pa.int64()), ("salts", pa.int64())])))])
_NEED_SQL = "need_key long, keys array<struct<key: long, salts: long>>"


def _shared(hot, every):
    """The sorted suffixes of a part, each compared with its neighbours: those of keys in several texts (or all), by text."""

    def run(batches):
        r = np.unique(read_blocks(batches, _SUFFIX))
        if not len(r):
            return
        same = np.zeros(len(r) + 1, bool)
        same[1:-1] = r["key"][1:] == r["key"][:-1]  # unique records of one key differ in text
        salts = np.maximum(hot.value.of(r["key"]), 1).astype(np.int64)
        keep = np.ones(len(r), bool) if every else same[1:] | same[:-1] | (hot.value.of(r["key"]) > 0)
        r, salts = r[keep], salts[keep]
        order = np.argsort(r["text"], kind="stable")
        r, salts = r[order], salts[order]
        cut = np.flatnonzero(np.diff(r["text"], prepend=~r["text"][:1]))
        ends = np.append(cut, len(r))
        for lo in range(0, len(cut), 5000):
            hi = min(len(cut), lo + 5000)
            x = slice(ends[lo], ends[hi])
            pairs = pa.StructArray.from_arrays([pa.array(r["key"][x].view(np.int64)), pa.array(salts[x])], names=["key", "salts"])
            lists = pa.ListArray.from_arrays(pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r["text"][cut[lo:hi]])), lists], schema=_NEED)

    return run


def _hot_keys(cols: DataFrame, size: int, k: int, n: int) -> HotKeys:
    """Keys of more than HOT texts, by one text in SAMPLED, and the parts each is dealt to; at most four for each of n parts.

    The sample only says how suffixes are dealt; which of them meet does not rest on it.
    """
    drawn = cols.where(F.pmod("text_key", F.lit(SAMPLED)) == 0).select("text", "text_key")
    each = drawn.mapInArrow(_plain_keys(size, k), "key long, text_key long").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    each = stored(each.where("rows > 1"), "sampled")
    total = each.agg(F.sum("rows").alias("n")).first()["n"] or 0
    level = max(HOT // SAMPLED, total // (4 * n))
    got = each.where(F.col("rows") > level).collect()
    return HotKeys([r["key"] for r in got], [-(-2 * r["rows"] // level) for r in got])


def _contexts(size, k, n_parts):
    kind, reach = _suffix_record(size - k), size - k

    def run(batches):
        """The shared suffixes of every text, with the words around them."""
        for b in batches:
            docs, text_key = b.column("doc_id").to_numpy(), b.column("text_key").to_numpy()
            keys = b.column("keys")
            cuts, flat = keys.offsets.to_numpy(), keys.values
            shared, salts = (flat.field(i).to_numpy() for i in range(2))
            for s in slices(b.column("text")):
                w = words(s, BLANKS)
                start, place, prints = anchors(w.hashes, w.bounds, size, k)
                doc = _doc_of(w.bounds, start)
                own = np.searchsorted(doc, np.arange(s.hi - s.lo + 1))
                for i in range(s.hi - s.lo):
                    wanted, salt = (x[cuts[s.lo + i] : cuts[s.lo + i + 1]] for x in (shared, salts))
                    if not len(wanted):
                        continue
                    order = np.argsort(wanted)
                    wanted, salt = wanted[order], salt[order]
                    st, pl = start[own[i] : own[i + 1]], place[own[i] : own[i + 1]]
                    first = np.flatnonzero(np.diff(pl, prepend=-1))  # the windows of one minimiser follow one another
                    last = np.append(first[1:], len(pl)) - 1
                    at = pl[first]
                    key = prints[at].view(np.int64)
                    j = np.minimum(np.searchsorted(wanted, key), max(0, len(wanted) - 1))
                    ok = wanted[j] == key if len(wanted) else np.zeros(len(key), bool)
                    at, lo, hi, j = at[ok], st[first][ok], st[last][ok], j[ok]
                    salted = np.where(salt[j] > 1, mix(np.full(1, text_key[s.lo + i]).view(np.uint64))[0] % np.maximum(salt[j], 1).astype(np.uint64), 0).astype(np.uint64)
                    key, hot = key[ok].view(np.uint64), salt[j] > 1
                    for c in range(0, len(at), 1 << 13):
                        x = slice(c, c + (1 << 13))
                        rec = np.zeros(len(at[x]), kind)
                        rec["key"], rec["doc"], rec["text"], rec["pos"] = key[x], docs[s.lo + i], text_key[s.lo + i], at[x] - w.bounds[i]
                        rec["left"], rec["right"], rec["hot"] = (at - lo)[x], (hi + size - at - k)[x], hot[x]
                        for name, by, first_at, n in (("before", -1, at[x] - 1, rec["left"]), ("after", 1, at[x] + k, rec["right"])):
                            word = first_at[:, None] + by * np.arange(reach)
                            rec[name] = np.where(np.arange(reach) < n[:, None], w.hashes[np.clip(word, 0, len(w.hashes) - 1)], 0)
                        yield spread(mix(key[x] + salted[x]), n_parts), rec

    def packed(batches):
        held, total = [], 0
        for part, rec in run(batches):
            held.append((part, rec))
            total += len(rec)
            if total > 1 << 13:
                yield _blocks(held, n_parts)
                held, total = [], 0
        if total:
            yield _blocks(held, n_parts)

    return packed


def _blocks(held, n_parts) -> pa.RecordBatch:
    part, rec = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
    return blocks(part, n_parts, lambda rows: rec[rows].tobytes())


def order_and_lcp(key: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by key and then word by word, and how many words each shares with the one before (-1: another key)."""
    order = np.lexsort((*beyond.T[::-1], key))
    k, x = key[order], beyond[order]
    lcp = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        differ = np.concatenate([x[1:] != x[:-1], np.ones((len(order) - 1, 1), bool)], axis=1)
        lcp[1:] = np.where(k[1:] == k[:-1], np.argmax(differ, axis=1), -1)
    return order, lcp


def sources(r: np.ndarray, reach: int, size: int, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix (those of an anchor sorted by doc, text and place) and every reach to the left: whether that window is there, and its source.

    The source is the row of the first suffix whose window is equal; -1 where
    the window is its own source or is no repeat of an earlier document.
    """
    classes = []
    for name in ("before", "after"):
        order, lcp = order_and_lcp(r["key"], r[name])
        rank = np.empty((reach + 1, len(r)), np.int32)
        for depth in range(reach + 1):
            rank[depth, order] = np.cumsum(lcp < depth)
        classes.append(rank)
    there = np.zeros((len(r), reach + 1), bool)
    source = np.full((len(r), reach + 1), -1, np.int32)
    for left in range(reach + 1):
        own = np.flatnonzero((r["left"] >= left) & (r["right"] >= reach - left))
        if not len(own):
            continue
        _, first, number = np.unique(classes[0][left, own].astype(np.int64) << 32 | classes[1][reach - left, own], return_index=True, return_inverse=True)
        f = own[first][number.ravel()]
        late = r["doc"][own] > r["doc"][f]
        if within:
            late |= (r["doc"][own] == r["doc"][f]) & (r["text"][own] == r["text"][f]) & (r["pos"][own] >= r["pos"][f] + size)
        there[own, left] = True
        source[own[late], left] = f[late]
    return there, source


_FOUND = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.binary())])


def _compare(size, k, n_parts, within, again):
    """Suffixes of a part: spans (kind 0) dealt by document; unless again, suffixes of hot anchors that are a source here (kind 1)."""
    kind, reach = _suffix_record(size - k), size - k

    def run(batches):
        every = read_blocks(batches, kind)
        if not len(every):
            return
        every = every[np.lexsort((every["pos"], every["text"], every["doc"], every["key"]))]
        border = np.flatnonzero(np.diff(every["key"], prepend=~every["key"][:1]))
        # Some anchors at a time: what is made of them is many times their size.
        lo = 0
        while lo < len(every):
            after = np.searchsorted(border, lo + CHUNK)
            hi = int(border[after]) if after < len(border) else len(every)
            yield from matched(every[lo:hi])
            lo = hi

    def matched(r):
        there, source = sources(r, reach, size, within)
        # Windows of one suffix with one source, next to one another, are one match.
        step = np.diff(source, axis=1, prepend=-1) != 0
        i, left = np.nonzero((source >= 0) & step)
        runs = np.cumsum(step, axis=1)
        n = np.zeros(len(i), np.int64)
        if len(i):
            # The length of each run: windows with its number in its row.
            number = np.where(source >= 0, np.arange(len(r))[:, None] * (reach + 2) + runs, -1)
            values, counts = np.unique(number[source >= 0], return_counts=True)
            n = counts[np.searchsorted(values, i * (reach + 2) + runs[i, left])]
        f = source[i, left]
        out = np.empty(len(i), _SPAN)
        low = left + n - 1  # the window that reaches farthest to the left starts first
        out["doc"], out["text"], out["pos"], out["n"] = r["doc"][i], r["text"][i], r["pos"][i] - low, size + n - 1
        out["first"], out["at"] = r["doc"][f], r["pos"][f] - low
        yield from _tagged(0, out, mix(out["doc"].astype(np.uint64)), n_parts)
        if not again:
            lead = np.flatnonzero((r["hot"] > 0) & (there & (source < 0)).any(axis=1))
            yield from _tagged(1, r[lead], mix(r["key"][lead]), n_parts)

    return run


def _tagged(kind, rec, h, n_parts):
    for lo in range(0, len(rec), 1 << 14):
        x = rec[lo : lo + (1 << 14)]
        b = blocks(spread(h[lo : lo + (1 << 14)], n_parts), n_parts, lambda rows, x=x: x[rows].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, kind, np.int32)), *b.columns], schema=_FOUND)


_SPANS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("first_doc_id", pa.int64()), ("first_word", pa.int32())])
_SPAN_SQL = "doc_id long, text_hash long, start_word int, n_words int, first_doc_id long, first_word int"


def _spans(size):
    def run(batches):
        """Matches of a document with one source, at one distance and with windows next to one another, as one."""
        r = read_blocks(batches, _SPAN)
        if not len(r):
            return
        shift = r["at"] - r["pos"]
        order = np.lexsort((r["pos"], shift, r["first"], r["text"], r["doc"]))
        r, shift = r[order], shift[order]
        end = r["pos"].astype(np.int64) + r["n"]
        new = np.ones(len(r), bool)
        new[1:] = (r["doc"][1:] != r["doc"][:-1]) | (r["text"][1:] != r["text"][:-1]) | (r["first"][1:] != r["first"][:-1]) | (shift[1:] != shift[:-1])
        group = np.cumsum(new)
        reach = np.maximum.accumulate(end + group * (1 << 33)) - group * (1 << 33)  # the farthest end of a group so far
        new[1:] |= r["pos"][1:] + size - 1 > reach[:-1]
        cut = np.flatnonzero(new)
        far = np.maximum.reduceat(end, cut)
        a = r[cut]
        columns = [a["doc"], a["text"], a["pos"], (far - a["pos"]).astype(np.int32), a["first"], a["at"]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], schema=_SPANS)

    return run


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR, by_text: bool = False, within: bool = False) -> DataFrame:
    """Maximal repeats in docs(doc_id, text): one row for each.

    doc_id, start_word, n_words, first_doc_id, first_word: these words of the
    document (split at blanks, numbered from 0, A-Z lower-cased) also stand in
    the document first_doc_id < doc_id from first_word on. Every window of
    min_words words that also stands in a document with a smaller id is inside
    some row, and no other is. Of documents with the same text, all but the
    one with the smallest id have one row, the whole text. Rows of one document
    may overlap where the source changes. Repeats inside one document count
    with `within` (first_doc_id is then the doc_id) where the two places do not
    overlap; repeats between different texts that share a doc_id do not. Texts
    that are null, empty or shorter than min_words, and rows with a null
    doc_id, have no repeats; repeated rows are one. Texts of any length are
    taken whole. Other columns are ignored; an empty table gives an empty
    result. by_text adds text_hash (xxhash64 of the text).
    """
    if not 0 < anchor <= min_words:
        raise ValueError("anchor must be between 1 and min_words")
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")).where("doc_id is not null and text is not null")
    n = parts(spark, text_bytes(cols), PART_BYTES)
    hot_keys = spark.sparkContext.broadcast(_hot_keys(cols, min_words, anchor, n))
    found = dealt(cols.select("text", "text_key").mapInArrow(_suffixes(min_words, anchor, n, hot_keys), BLOCK), n).mapInArrow(_shared(hot_keys, within), _NEED_SQL)
    need = stored(found.groupBy("need_key").agg(F.flatten(F.collect_list("keys")).alias("keys")), "need")
    totals = need.agg(F.sum(F.size("keys")).alias("rows")).first()["rows"] or 0
    hot = len(hot_keys.value.keys) > 0
    copies = stored(cols.select("doc_id", "text_key").distinct().groupBy("text_key").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")), "copies")

    n = parts(spark, totals, PART_ROWS)
    ids, few = small_ids(need.select("need_key"), "need_key")
    wanted = need.join(copies, F.col("need_key") == F.col("text_key")).select("need_key", F.col("low").alias("need_doc"), "keys")
    near = keep_ids(cols, "text_key", ids, few, "need_key").join(wanted, (F.col("text_key") == F.col("need_key")) & (F.col("doc_id") == F.col("need_doc"))).select("doc_id", "text", "text_key", "keys")
    found = dealt(near.mapInArrow(_contexts(min_words, anchor, n), BLOCK), n).mapInArrow(_compare(min_words, anchor, n, within, not hot), "kind int, part int, block binary")
    if hot:
        found = stored(found, "found")
        again = dealt(found.where("kind = 1").select("part", "block"), n).mapInArrow(_compare(min_words, anchor, n, within, True), "kind int, part int, block binary")
        found = found.unionByName(again)
    own = dealt(found.where("kind = 0").select("part", "block"), n).mapInArrow(_spans(min_words), _SPAN_SQL).distinct()

    # Copies of a text but the first: the whole text.
    several, few = small_ids(copies.where("copies > 1").select(F.col("text_key").alias("copied")), "copied")
    again = keep_ids(cols, "text_key", several, few, "copied")
    length = again.groupBy("text_key").agg(F.first("text").alias("text")).mapInArrow(_lengths, "text_key long, n_words int").where(F.col("n_words") >= min_words)
    twins = again.select("doc_id", "text_key").distinct().join(copies.select("text_key", "low").join(length, "text_key"), "text_key").where("doc_id > low")
    whole = twins.select("doc_id", F.col("text_key").alias("text_hash"), F.lit(0).alias("start_word"), "n_words", F.col("low").alias("first_doc_id"), F.lit(0).alias("first_word"))
    out = own.unionByName(whole)
    order = ["doc_id", "start_word", "n_words", "first_doc_id", "first_word"]
    return out.select(*order, "text_hash") if by_text else out.select(*order).distinct()


def _lengths(batches):
    for b in batches:
        n = [np.diff(find_words(s, BLANKS)[2]) for s in slices(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("text_key"), pa.array(np.concatenate(n).astype(np.int32) if n else np.zeros(0, np.int32))], names=["text_key", "n_words"])


def _cut(batches):
    for b in batches:
        texts, spans, left = b.column("text"), b.column("spans").to_pylist(), []
        out = texts.to_pylist()
        for s in slices(texts):
            starts, ends, bounds = find_words(s, BLANKS)
            for i in range(s.hi - s.lo):
                own = spans[s.lo + i]
                if not own:
                    continue
                a, e = int(bounds[i]), int(bounds[i + 1])
                gone = np.zeros(e - a + 1, np.int64)
                for x, n in ((x["start_word"], x["n_words"]) for x in own):
                    gone[x] += 1
                    gone[x + n] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
                at, piece = int(s.offs[i]), []
                for x, y in edge.tolist():
                    piece.append(s.data[at : starts[a + x]].tobytes())
                    at = int(starts[a + y]) if a + y < e else int(s.offs[i + 1])
                piece.append(s.data[at : int(s.offs[i + 1])].tobytes())
                out[s.lo + i] = b"".join(piece).decode()
                if gone.all():
                    left.append(s.lo + i)
        drop = set(left)
        keep = [i for i in range(len(out)) if i not in drop]
        rest = [b.column(c) for c in b.schema.names]
        t = pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else rest[j] for j, c in enumerate(b.schema.names)], names=b.schema.names)
        yield t.take(pa.array(keep, pa.int64())).drop_columns(["spans"])


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the words of their spans (`repeats` by_text), first occurrences kept.

    Documents without spans are unchanged, null and empty texts among them;
    those of which nothing would be left are dropped. Rows that share a doc_id
    lose the spans of their own text only, repeated rows the same ones. n_chars,
    where there is one, follows a text that was cut. Columns of any name pass
    through; an empty table gives an empty result.
    """
    each = spans.groupBy(F.col("doc_id").alias("span_doc"), F.col("text_hash").alias("span_text")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans"))
    text = F.col("text").cast("string")
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"), F.col("doc_id").cast("long").alias("join_id"), F.xxhash64(text).alias("join_text"))
    both = plain.join(each, (F.col("join_id") == F.col("span_doc")) & (F.col("join_text") == F.col("span_text")), "left")
    hit = both.where("spans is not null").select("row", "text", "spans")
    hit = hit.mapInArrow(_cut, hit.select("row", "text").schema).withColumn("row", F.col("row").withField("text", F.col("text").cast(docs.schema["text"].dataType)))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("row", F.col("row").withField("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return both.where("spans is null").select("row.*").unionByName(hit.select("row.*"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs after `cut` by `repeats`; rows and columns as there."""
    return cut(docs, stored(repeats(docs, min_words, by_text=True), "repeats"))
