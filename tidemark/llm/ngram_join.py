"""N-gram Jaccard join by parity sketches.

Each document is the set of its distinct k-word shingles. Links are all
pairs with 100 * |A & B| >= 100 * threshold * |A | B|, exactly.

Sketch. Within a size band, shingles are dealt by hash to m segments, and a
segment's word is the XOR of the 64-bit hashes dealt to it. One shingle that
two sets don't share changes one segment, so the Hamming distance of two
sketches, counted in segments, is at most the symmetric difference.

Pigeonhole. For Jaccard t a symmetric difference is at most
D = (|A| + |B|) * (1 - t) / (1 + t), so linked sets agree on at least m - D
segments. Segments with fewer than two shingles ("weak") carry no key: a
pair could be missed only if all segments on which it agrees are weak in
both sets, and then each of the two has at least m - D weak segments. Just
such sets also send the prefix keys of their sorted hashes, of which linked
sets share one. So no link is lost whatever the data are.

Equal sets share one 64-bit fingerprint and are one node from the start.
Every node also has a bit sketch of at least twice as many bits as it has
shingles, in which each shingle flips one bit; the Hamming distance of two
bit sketches is at most the symmetric difference too, so pairs above D are
no links. Buckets of equal keys are never expanded into rows of pairs: each
member is first held against the bucket's smallest node (sketch, then the
sets), components are taken, and members still in different components are
compared by sketch, in blocks of at most BLOCK members a side. Only pairs
within D leave a block, for the second verification.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import BLOCK as BLOCK_SQL
from .exchange import HotKeys, blocks, dealt, hot_join, keep_ids, parts, read_blocks, small_ids, spread, stored
from .words import BLANKS, mix, rolling, run_hash, slices, words

K, PERCENT = 5, 80
GROWTH = 1.6  # ratio of the largest to the smallest size whose larger set decides a band
CELL_ROWS = 1 << 17  # rows of bucket members in one task
KEY_ROWS = 1 << 20  # shingles whose keys meet in one task
SAMPLED, HOT = 64, 1 << 10  # one text in SAMPLED tells hot keys, of HOT sampled nodes or more
_REC = np.dtype([("key", "<u8"), ("node", "<i8")])
CHUNK = 48  # sets verified against one other set in a group
BLOCK = 1024  # members of a bucket on each side of a sketch comparison


def shingle_sets(column, k: int = K):
    """For each row of a string column: its index and its sorted distinct shingle hashes."""
    for s in slices(column):
        w = words(s, BLANKS)
        run = rolling(w.hashes, k)
        for i in range(s.hi - s.lo):
            a, b = w.bounds[i], w.bounds[i + 1]
            if b - a >= k:
                yield s.lo + i, np.unique(run[a : b - k + 1])
            elif b > a:
                yield s.lo + i, run_hash(w.hashes[a:b])
            else:
                yield s.lo + i, np.zeros(0, np.uint64)


def set_print(sets: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set of hashes; 0 for the empty set only."""
    if not len(sets):
        return 0
    with np.errstate(over="ignore"):
        h = mix(np.array([sets.sum(dtype=np.uint64) + np.bitwise_xor.reduce(mix(sets)) * np.uint64(3) + np.uint64(len(sets))], np.uint64))
    return int(h.view(np.int64)[0]) or 1


def bit_sketch(sets: np.ndarray) -> bytes:
    """Parities of the shingles by hash: the least power of two of bits, 64 or more, that is at least twice the set's size."""
    bits = 1 << max(6, (2 * len(sets) - 1).bit_length())
    at = (mix(sets ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, words_: int) -> np.ndarray:
    """A sketch brought down to fewer 64-bit words."""
    x = np.frombuffer(sketch, np.uint64)
    while len(x) > words_:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def plausible(size_u, size_v, sketch_u: np.ndarray, sketch_v: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and Hamming distances leave a link possible (arrays that broadcast)."""
    both = size_u + size_v
    near = np.bitwise_count(sketch_u ^ sketch_v).sum(axis=-1, dtype=np.int64) * (100 + percent) <= both * (100 - percent)
    return near & (100 * np.minimum(size_u, size_v) >= percent * np.maximum(size_u, size_v))


class Bands:
    """Size bands: sets that can link always meet in the band of the larger one."""

    def __init__(self, percent: int = PERCENT, growth: float = GROWTH):
        self.percent, self.growth, self.starts = percent, growth, [1]

    def of(self, n: int):
        """(band, segments, D for this size) of every band in which a set of n takes part."""
        while self.starts[-1] * self.percent <= n * 100:
            self.starts.append(int(self.starts[-1] * self.growth) + 1)
        p = self.percent
        for band in range(len(self.starts) - 1):
            low, top = self.starts[band], self.starts[band + 1] - 1
            if n > top or n * 100 < low * p:
                continue
            most = min(top, n * 100 // p)
            d = (n + most) * (100 - p) // (100 + p)
            d_band = 2 * top * (100 - p) // (100 + p)
            yield band, d_band + d_band // 4 + 1, d


def keys_of(sets: np.ndarray, bands: Bands) -> np.ndarray:
    """Bucket keys of one sorted set: at least one is shared by any two linked, unequal sets."""
    n, out = len(sets), []
    for band, m, d in bands.of(n):
        if not d:  # only equal sets link
            continue
        seg = (((sets >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(seg, prepend=-1))
        size = np.diff(cut, append=n)
        strong = size >= 2
        tag, low_tag = (np.uint64((band + 1) * c & (1 << 64) - 1) for c in (0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB))
        if strong.any():
            word = np.bitwise_xor.reduceat(mix(sets), cut)[strong]
            out.append(mix(word + tag + seg[cut][strong].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        if int(strong.sum()) <= d:  # at least m - d weak segments
            least = -(-n * bands.percent // 100)
            out.append(mix(sets[: n - least + 1] ^ low_tag))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


_FEATURES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _features(k, percent, sampled):
    def run(batches):
        """Node, size and sketch of every row; one text in `sampled` also brings its bucket keys, by which hot ones are known."""
        bands = Bands(percent)
        for b in batches:
            drawn = (b.column("text_key").to_numpy() % sampled == 0).tolist()
            columns: list[list] = [[], [], [], []]
            for i, x in shingle_sets(b.column("text"), k):
                for column, value in zip(columns, (set_print(x), len(x), bit_sketch(x) if len(x) else None, keys_of(x, bands).view(np.int64) if drawn[i] and len(x) else None), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *(pa.array(x, f.type) for x, f in zip(columns, list(_FEATURES)[2:], strict=True))], schema=_FEATURES)

    return run


def _keys(k, percent, n_parts, hot):
    def run(batches):
        """Records of every distinct set of a batch, dealt by key; those of hot keys by key and node."""
        bands = Bands(percent)
        for b in batches:
            seen, rec, size = set(), [], 0
            for _, x in shingle_sets(b.column("text"), k):
                node = set_print(x)
                if not node or node in seen:
                    continue
                seen.add(node)
                key = keys_of(x, bands)
                r = np.empty(len(key), _REC)
                r["key"], r["node"] = key, node
                rec.append(r)
                size += len(r)
                if size > 1 << 18:
                    yield _packed(rec, n_parts, hot.value)
                    rec, size = [], 0
            if size:
                yield _packed(rec, n_parts, hot.value)

    return run


def _packed(rec, n_parts, hot):
    r = np.concatenate(rec)
    salts = hot.of(r["key"])
    salt = np.where(salts > 0, mix(r["node"].view(np.uint64)) % np.maximum(salts, 1), 0).astype(np.uint64)
    part = spread(np.where(salt > 0, mix(r["key"] + salt), r["key"]), n_parts)
    return blocks(part, n_parts, lambda rows: r[rows].tobytes())


_MEMBERS = pa.schema([("bucket", pa.int64()), ("u", pa.int64()), ("node", pa.int64()), ("size", pa.int64())])


def _buckets(hot):
    def run(batches):
        """Distinct members of every key that at least two nodes share, with the smallest of them (u) and their number; of hot keys all, without."""
        r = np.unique(read_blocks(batches, _REC))
        if not len(r):
            return
        cut = np.flatnonzero(np.diff(r["key"], prepend=~r["key"][:1]))
        size = np.diff(cut, append=len(r))
        is_hot = hot.value.of(r["key"][cut]) > 0
        many = (size >= 2) | is_hot
        cut, size, is_hot = cut[many], size[many], is_hot[many]
        at = np.repeat(cut, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        u, n, bare = np.repeat(r["node"][cut], size), np.repeat(size, size), np.repeat(is_hot, size)
        for lo in range(0, len(at), 1 << 16):
            x = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(r["key"][at[x]].view(np.int64)), pa.array(u[x], mask=bare[x]), pa.array(np.ascontiguousarray(r["node"][at[x]])), pa.array(n[x], mask=bare[x])], schema=_MEMBERS)

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _verify(k, percent):
    def run(table: pa.Table) -> pa.Table:
        """One chunk: a centre and at most CHUNK others, with their texts."""
        sets = dict(shingle_sets(table.column("text"), k))
        centre = table.column("centre").to_pylist()
        node = table.column("node").to_pylist()
        mid = next((i for i, c in enumerate(centre) if c), None)
        out = [] if mid is None else [(node[mid], node[i]) for i, c in enumerate(centre) if not c and linked(sets[mid], sets[i], percent)]
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=_LINKS)

    return run


def verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes that link. reps: node and the text_key of one of its texts."""
    pairs = stored(pairs, "pairs")
    degree = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    cut = pairs.join(degree, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("chunks")).alias("salt"))
    need = cut.select(F.col("v").alias("node"), "u", "salt", F.lit(False).alias("centre")).unionByName(cut.select(F.col("u").alias("node"), "u", "salt", F.lit(True).alias("centre")).distinct())
    need = stored(need.join(reps, "node"), "need")
    ids, few = small_ids(need.select(F.col("text_key").alias("need_id")), "need_id")
    wanted = keep_ids(texts, "text_key", ids, few, "need_id")
    chunks = need.join(wanted.dropDuplicates(["text_key"]), "text_key").select("u", "salt", "node", "centre", "text")
    return chunks.groupBy("u", "salt").applyInArrow(_verify(k, percent), "u long, v long")


def _near(percent):
    def run(batches):
        """Pairs whose sketches leave a link possible."""
        for b in batches:
            su, sv = b.column("sketch_u").to_pylist(), b.column("sketch_v").to_pylist()
            n = [min(len(x), len(y)) // 8 for x, y in zip(su, sv, strict=True)]
            size_u, size_v = b.column("size_u").to_numpy(), b.column("size_v").to_numpy()
            keep = [bool(plausible(size_u[i], size_v[i], folded(su[i], n[i]), folded(sv[i], n[i]), percent)) for i in range(len(n))]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_pairs(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes that sizes and sketches do not rule out."""
    a, b = (info.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "uv")
    sized = pairs.join(a, "u").join(b, "v").where(f"100 * least(size_u, size_v) >= {percent} * greatest(size_u, size_v)")
    return sized.mapInArrow(_near(percent), "u long, v long")


_PAIR = np.dtype([("u", "<i8"), ("v", "<i8")])


def _apart(percent, n_parts):
    def run(batches):
        """Of the bucket blocks of a partition: plausible pairs of different components, dealt by their own hash.

        A pair meets in many buckets; as packed records its copies cost 16 bytes each.
        """
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        col = {c: t.column(c).to_numpy() for c in ("bucket", "a", "b", "side", "node", "root", "size")}
        order = np.lexsort((col["node"], col["side"], col["b"], col["a"], col["bucket"]))
        col = {c: x[order] for c, x in col.items()}
        sketch = t.column("sketch").combine_chunks().take(pa.array(order))
        new = np.ones(len(order), bool)
        new[1:] = np.any([col[c][1:] != col[c][:-1] for c in ("bucket", "a", "b")], axis=0)
        cut = np.flatnonzero(new)
        ends = np.append(cut[1:], len(order))
        open_ = np.flatnonzero(np.minimum.reduceat(col["root"], cut) < np.maximum.reduceat(col["root"], cut))
        out: list[np.ndarray] = []
        for g in open_.tolist():
            lo, hi = int(cut[g]), int(ends[g])
            own = sketch.slice(lo, hi - lo).to_pylist()
            n = min(len(x) for x in own) // 8
            s = np.stack([folded(x, n) for x in own])
            node, root, size, side = (col[c][lo:hi] for c in ("node", "root", "size", "side"))
            same = col["a"][lo] == col["b"][lo]
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
            step = max(1, (1 << 19) // max(1, len(right) * n))
            for x in range(0, len(left), step):
                rows = left[x : x + step]
                ok = plausible(size[rows][:, None], size[right][None, :], s[rows][:, None, :], s[right][None, :, :], percent)
                ok &= root[rows][:, None] != root[right][None, :]
                i, j = np.nonzero(ok)
                u, v = node[rows[i]], node[right[j]]
                out.append(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1))
        if out:
            pairs = np.unique(np.concatenate(out), axis=0)
            rec = np.empty(len(pairs), _PAIR)
            rec["u"], rec["v"] = pairs[:, 0], pairs[:, 1]
            key = mix(pairs[:, 0].astype(np.uint64) ^ mix(pairs[:, 1].astype(np.uint64)))
            yield blocks(spread(key, n_parts), n_parts, lambda rows: rec[rows].tobytes())

    return run


def _distinct_pairs(batches):
    r = np.unique(read_blocks(batches, _PAIR))
    if len(r):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r["u"])), pa.array(np.ascontiguousarray(r["v"]))], schema=_LINKS)


def _hot_keys(rows: DataFrame, n: int) -> HotKeys:
    """Keys that hold more than a quarter of an even part of the sampled records: at most four for each of n parts.

    The sample only says how keys are dealt; which members meet does not rest on it.
    """
    each = rows.where("keys is not null").select("node", F.explode("keys").alias("key")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    total = each.agg(F.sum("rows").alias("n")).first()["n"] or 0
    level = max(HOT, total // (4 * n))
    got = each.where(F.col("rows") > level).collect()
    return HotKeys([r["key"] for r in got], [-(-2 * r["rows"] // level) for r in got])


def _members(texts: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """bucket, u, node, size of all buckets with two nodes or more; u is the smallest node."""
    spark = texts.sparkSession
    shingles = rows.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    n = parts(spark, shingles, KEY_ROWS)
    hot = spark.sparkContext.broadcast(_hot_keys(rows, n))
    found = dealt(texts.select("text").mapInArrow(_keys(k, percent, n, hot), BLOCK_SQL), n).mapInArrow(_buckets(hot), "bucket long, u long, node long, size long")
    found = stored(found, "members")
    if not len(hot.value.keys):
        return found
    heads = found.where("u is null").groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    spread_ = found.where("u is null").select("bucket", "node").join(F.broadcast(heads), "bucket")  # at most four keys a part
    return found.where("u is not null").unionByName(spread_.select("bucket", F.col("head").alias("u"), "node", F.col("members").alias("size")))


def _cells(members: DataFrame, known: DataFrame) -> tuple[DataFrame, int]:
    """Members of buckets that still hold several components, once for each pair of blocks they take part in; and their number.

    members: bucket, node; known: node, size, sketch, root. The largest
    component of a bucket is its major part, all else the minor one. Members
    of the major part are linked already, so its blocks meet only the minor
    ones: what a bucket costs is its size times the blocks of its minor part.
    """
    members = stored(members.where("size > 2").select("bucket", "node").join(known.select("node", "root"), "node"), "members")
    by_root = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    split = by_root.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    blocks_of = lambda n: F.ceil(n / BLOCK).cast("long")
    split = split.select("bucket", F.col("top.root").alias("major"), blocks_of(F.col("n") - F.col("top.n")).alias("few"), blocks_of(F.col("top.n")).alias("many"), (F.col("n") - F.col("top.n")).alias("minor"), F.col("top.n").alias("rest"))
    split = stored(split, "split")
    rows = split.agg(F.sum(F.expr("minor * (few + many) + rest * few")).alias("n")).first()["n"] or 0
    own = hot_join(members, split.drop("minor", "rest"), "bucket").where("major is not null")
    inside = F.col("root") == F.col("major")
    block = F.pmod(F.xxhash64("node"), F.when(inside, F.col("many")).otherwise(F.col("few"))) + F.when(inside, F.col("few")).otherwise(0)
    last = F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    own = own.select("bucket", "node", block.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    cells = own.select("bucket", "node", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    return cells.join(known, "node"), int(rows)


def components_of(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """As `join`, with three more columns: text_key (xxhash64 of the text), node (0 for the empty set) and root (a node that names the component)."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    rows = stored(texts.mapInArrow(_features(k, percent, SAMPLED), "doc_id long, text_key long, node long, n_shingles long, sketch binary, keys array<long>"), "features")
    info = rows.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), F.max("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    info = stored(info, "nodes")
    reps, texts = info.select("node", "text_key"), texts.select("text", "text_key")

    members = _members(texts, rows, k, percent)
    stars = members.where("node <> u").select("u", F.col("node").alias("v")).distinct()
    first = stored(verified(near_pairs(stars, info, percent), texts, reps, k, percent), "links")
    known = stored(info.select("node", "size", "sketch").join(components(first), "node", "left").select("node", "size", "sketch", F.coalesce("root", "node").alias("root")), "known")
    cells, count = _cells(members, known)
    n = parts(spark, count, CELL_ROWS)
    pairs = dealt(cells.repartition(n, "bucket", "a", "b").mapInArrow(_apart(percent, n), BLOCK_SQL), n).mapInArrow(_distinct_pairs, "u long, v long")
    pairs = pairs.join(stars, ["u", "v"], "left_anti")
    roots = components(first.unionByName(verified(pairs, texts, reps, k, percent)))
    low = roots.join(info.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("low"))
    named = roots.join(low, "root").select("node", "root", "low")
    named = info.select("node", "doc_id").join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("low", "doc_id").alias("low"))
    out = hot_join(rows.select("doc_id", "text_key", "node", "n_shingles"), named, "node")
    return out.select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"), "text_key", "node", "root")


def join(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Components of the k-shingle Jaccard join of docs(doc_id, text, ...).

    Returns one row for each row of docs: doc_id, n_shingles (set size) and
    component_id (smallest doc_id reachable by links, itself included).
    Texts that are null, empty or without words have the empty set and link
    with nothing; with fewer than k words, the whole sequence is the only
    shingle. Rows with the same text, or the same doc_id, are rows of their
    own, each compared with its own text. A null doc_id stays null, with the
    smallest doc_id of its component. Texts of any length are taken whole.
    Other columns of docs are ignored. An empty table gives an empty result.
    """
    return components_of(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row of each group of linked rows of docs, unchanged: the smallest doc_id, then the smallest text hash.

    Rows with the same text are one group, so repeated rows leave one; so do
    rows without a doc_id that link with others. Rows without words (null,
    empty or blank texts) link with nothing and all stay. A doc_id with texts
    that do not link keeps them all. Columns of any name pass through; an
    empty table gives an empty result.
    """
    found = components_of(docs, k, percent).where("node <> 0").groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_key", "rows")).alias("best"))
    best = stored(best.select(F.col("best.doc_id").alias("kept_id"), F.col("best.text_key").alias("kept_key"), (F.col("best.rows") > 1).alias("several")), "kept")
    text = F.col("text").cast("string")
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"), F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    mine = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key"))
    out = plain.where(~F.col("worded")).select("row.*").unionByName(plain.where("worded").join(best.where("not several"), mine, "left_semi").select("row.*"))
    if not best.where("several").isEmpty():
        again = plain.where("worded").join(best.where("several"), mine, "left_semi")
        out = out.unionByName(again.groupBy("id", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*"))
    return out
