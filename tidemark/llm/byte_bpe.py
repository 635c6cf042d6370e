"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Pre-tokens of every document are exploded with their positions: a block
   of documents keeps its own list of distinct words, most frequent first,
   and each document a list of word numbers.
2. The distinct words of all blocks are dealt by hash; one task gets every
   copy of a word, encodes it once and answers each block.
3. The answers come back to their block, and ids are put together by position.
4. Decoding joins the ids with the table of token bytes.

Between tasks, lists travel as compressed binary blocks, so the number of
shuffled rows follows the blocks and not the words; what one task holds is
one block, or one part of the distinct words. Documents are split twice, once
for their words and once for their positions, instead of storing either; a
block is the same both times because it is a run of one scan partition, so
input that is not a plain scan of files is stored first.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .exchange import dealt, parts, plain_scan, spread, stored
from .hashindex import HashIndex, Lists
from .token_store import text_runs

BLOCK_CHARS = 1 << 23
_NONE = np.int32(1 << 30)
_LONG = 256  # bytes of a word beyond which merges are found one word at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """Encodes words, each by itself, and gives the bytes of ids."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.ranks = ranks
        self.byte = np.zeros(256, np.int32)
        for b in range(256):
            self.byte[b] = ranks[bytes([b])]
        pairs, to = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    to.append(rank)
        self.index = HashIndex(20)
        self.index.add(self._pair_hash(np.array(pairs, np.uint64)))
        self.merged = np.append(np.array(to, np.int32), _NONE)
        self.tokens = Lists(np.uint8)
        by_rank = sorted((r, t) for t, r in ranks.items())
        size = np.zeros(by_rank[-1][0] + 1, np.int64)
        for r, t in by_rank:
            size[r] = len(t)
        self.tokens.extend(np.frombuffer(b"".join(t for _, t in by_rank), np.uint8), size)

    @staticmethod
    def _pair_hash(p: np.ndarray) -> np.ndarray:
        h = p * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)

    def _join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of a and b joined, _NONE where they can't be."""
        return self.merged[self.index.get(self._pair_hash(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)))]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and each word's number of ids.

        All words merge at the same time: in every round, each word joins its
        leftmost pair of the lowest rank; words without such a pair are done.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        if not len(words):
            return np.zeros(0, np.int32), sizes
        large = np.flatnonzero(sizes > _LONG)
        if len(large):
            own = {int(i): self._one(words[i]) for i in large}
            short = [b"" if i in own else w for i, w in enumerate(words)]
            flat, count = self.encode(short)
            ends = np.cumsum(count)
            out = [own.get(i, flat[e - c : e]) for i, (e, c) in enumerate(zip(ends.tolist(), count.tolist(), strict=True))]
            return np.concatenate(out).astype(np.int32), np.array([len(x) for x in out], np.int64)
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        pair = np.full(len(sym), _NONE, np.int32)
        same = word[1:] == word[:-1]
        at = np.flatnonzero(same)
        pair[at] = self._join(sym[at], sym[at + 1])
        done = []
        while len(sym):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(pair, first)
            size = np.diff(first, append=len(word))
            over = np.repeat(low == _NONE, size)
            if over.any():
                done.append((word[over], sym[over]))
                sym, word, pair = sym[~over], word[~over], pair[~over]
                live = low != _NONE
                low, size = low[live], size[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(pair == np.repeat(low, size))
            hit = hit[np.flatnonzero(np.diff(word[hit], prepend=-1))]  # leftmost of each word
            sym[hit] = pair[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, pair = sym[keep], word[keep], pair[keep]
            at = hit - np.arange(len(hit))
            for i in (at, at[at > 0] - 1):
                i_next = np.minimum(i + 1, len(sym) - 1)
                ok = (i + 1 < len(sym)) & (word[i_next] == word[i])
                pair[i] = np.where(ok, self._join(sym[i], sym[i_next]), _NONE)
        w = np.concatenate([x[0] for x in done]) if done else np.zeros(0, np.int64)
        s = np.concatenate([x[1] for x in done]) if done else np.zeros(0, np.int32)
        return s[np.argsort(w, kind="stable")], np.bincount(w, minlength=len(words))

    def _one(self, word: bytes) -> np.ndarray:
        """Ids of one long word, with a heap over its pairs."""
        import heapq

        n = len(word)
        sym, after, before = [int(self.byte[b]) for b in word], list(range(1, n + 1)), list(range(-1, n - 1))
        bytes_of = [word[i : i + 1] for i in range(n)]
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if bytes_of[i] else n
            if j >= n or len(bytes_of[i]) != a or len(bytes_of[j]) != b:
                continue
            bytes_of[i] += bytes_of[j]
            bytes_of[j], sym[i], after[i] = b"", r, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get(bytes_of[x] + bytes_of[y])) is not None:
                    heapq.heappush(heap, (r, x, len(bytes_of[x]), len(bytes_of[y])))
        return np.array([s for s, b in zip(sym, bytes_of, strict=True) if b], np.int32)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and where each id's bytes end."""
        return self.tokens.gather(ids)


_BPES: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    if path not in _BPES:
        _BPES[path] = Bpe(path)
    return _BPES[path]


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True) if raw else b""


def _unpack(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True) if data else b""


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, packed one byte plane after another."""
    raw = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    return b"".join(len(p).to_bytes(4, "little") + p for p in (_pack(raw[:, j].tobytes()) if raw[:, j].any() else b"" for j in range(4)))


def _from_planes(data: bytes, n: int) -> np.ndarray:
    out, at = np.zeros((n, 4), np.uint8), 0
    for j in range(4):
        size = int.from_bytes(data[at : at + 4], "little")
        if size:
            out[:, j] = np.frombuffer(_unpack(data[at + 4 : at + 4 + size]), np.uint8)
        at += 4 + size
    return out.view("<u4").reshape(-1).astype(np.int64)


# Rows between tasks, of a block of documents.
# part -1: a doc_ids, b words of each document, c all word numbers in text order, d the part of each word.
# part >= 0: the words of that part; a their hashes, b their sizes, c their bytes.
# In answers, b has the number of ids of each word and c the ids.
_ROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_ROW_SQL = "block long, part int, a binary, b binary, c binary, d binary"
_NO_ID = np.iinfo(np.int64).min


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ROW, strict=True)], schema=_ROW)


class _Block:
    """Documents gathered until there is enough text, with their distinct words."""

    def __init__(self):
        self.docs, self.sizes, self.numbers, self.hashes, self.words = [], [], [], [], []
        self.index, self.chars = HashIndex(16), 0

    def add(self, doc_ids: np.ndarray, texts: list[str]):
        points, offs, whole = pretokens.code_points(texts)
        starts, bounds = pretokens.split(points, offs)
        h = pretokens.span_hashes(points, starts) | np.uint64(1)
        number = self.index.get(h)
        lost = np.flatnonzero(number < 0)
        if len(lost):
            new, at = np.unique(h[lost], return_index=True)
            at = lost[at]
            self.index.add(new)
            self.hashes.append(new)
            self.words += [whole[x:y].encode() for x, y in zip(starts[at].tolist(), starts[at + 1].tolist(), strict=True)]
            number[lost] = self.index.get(h[lost])
        self.docs.append(doc_ids)
        self.sizes.append(np.diff(bounds))
        self.numbers.append(number)
        self.chars += len(whole)

    def rows(self, block: int, n_parts: int, positions: bool):
        """The row of the block's documents, or the rows of its words."""
        number = np.concatenate(self.numbers)
        h = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        order = np.argsort(-np.bincount(number, minlength=len(h)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        h = h[order]
        part = spread(h, n_parts)
        if positions:
            yield _row(block, -1, _pack(np.concatenate(self.docs).astype("<i8").tobytes()), _pack(np.concatenate(self.sizes).astype("<i8").tobytes()), _planes(rank[number]), _pack(part.astype("<u4").tobytes()))
            return
        by = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[by], np.arange(n_parts + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            own = by[cuts[p] : cuts[p + 1]]
            words = [self.words[i] for i in order[own].tolist()]
            yield _row(block, p, h[own].tobytes(), _pack(np.array([len(w) for w in words], "<u4").tobytes()), _pack(b"".join(words)), None)


def _explode(n_parts, positions):
    def run(batches):
        from pyspark import TaskContext

        task, seq, held = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            doc_ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in text_runs(texts):
                held.add(doc_ids[lo:hi], texts[lo:hi])
                if held.chars >= BLOCK_CHARS:
                    yield from held.rows(task << 32 | seq, n_parts, positions)
                    held, seq = _Block(), seq + 1
        if held.docs:
            yield from held.rows(task << 32 | seq, n_parts, positions)

    return run


def _answer(vocabulary):
    def run(batches):
        """Encodes each distinct word of a part once and answers every block that sent it."""
        coder, index, ids = bpe(vocabulary), HashIndex(16), Lists(np.int32)
        for batch in batches:
            for block, part, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("block", "part", "a", "b", "c")), strict=True):
                h = np.frombuffer(a, np.uint64)
                row = index.get(h)
                lost = np.flatnonzero(row < 0)
                if len(lost):
                    ends, whole = np.cumsum(np.frombuffer(_unpack(b), "<u4").astype(np.int64)), _unpack(c)
                    flat, sizes = coder.encode([whole[(ends[i - 1] if i else 0) : ends[i]] for i in lost.tolist()])
                    index.add(h[lost])
                    ids.extend(flat, sizes)
                    row[lost] = index.get(h[lost])
                flat, ends = ids.gather(row)
                yield _row(block, part, None, _pack(np.diff(ends, prepend=0).astype("<u4").tobytes()), len(flat).to_bytes(8, "little") + _planes(flat), None)

    return run


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_TEXTS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def _reassemble(vocabulary, digest):
    def run(table: pa.Table) -> pa.Table:
        """One block: its documents and the answers to its words."""
        part = table.column("part").to_numpy()
        mine = int(np.flatnonzero(part < 0)[0])
        a, b, c, d = (table.column(x)[mine].as_py() for x in "abcd")
        doc_ids, sizes = np.frombuffer(_unpack(a), "<i8"), np.frombuffer(_unpack(b), "<i8")
        word_part = np.frombuffer(_unpack(d), "<u4")
        number = _from_planes(c, int(sizes.sum()))
        answers = sorted((int(p), i) for i, p in enumerate(part) if p >= 0)
        flat, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, i in answers:
            raw = table.column("c")[i].as_py()
            flat.append(_from_planes(raw[8:], int.from_bytes(raw[:8], "little")))
            count.append(np.frombuffer(_unpack(table.column("b")[i].as_py()), "<u4").astype(np.int64))
        if sum(map(len, count)) != len(word_part):
            raise ValueError("a block of documents has other words than before: the input changed between two scans")
        lists = Lists(np.int32)
        lists.extend(np.concatenate(flat).astype(np.int32), np.concatenate(count))
        place = np.empty(len(word_part), np.int64)  # where a word's answer stands among all answers
        place[np.argsort(word_part, kind="stable")] = np.arange(len(word_part))
        coder, cuts = bpe(vocabulary), np.r_[0, np.cumsum(sizes)]
        out: list[list] = [[], [], []] if not digest else [[], [], [], []]
        lo = 0
        while lo < len(doc_ids):  # a bounded number of words at a time
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + (1 << 18), "right")) - 1)
            ids, ends = lists.gather(place[number[cuts[lo] : cuts[hi]]])
            ends = np.r_[0, ends][cuts[lo : hi + 1] - cuts[lo]]
            text, byte_ends = coder.decode(ids)
            byte_ends = np.r_[0, byte_ends][ends]
            raw, text = memoryview(ids.astype("<u4")).cast("B"), memoryview(text)
            for i in range(hi - lo):
                x, y = int(ends[i]), int(ends[i + 1])
                p, q = int(byte_ends[i]), int(byte_ends[i + 1])
                if digest:
                    out[1].append(y - x)
                    out[2].append(hashlib.sha256(raw[4 * x : 4 * y]).hexdigest())
                    out[3].append(hashlib.sha256(text[p:q]).hexdigest())
                else:
                    out[1].append(ids[x:y])
                    out[2].append(bytes(text[p:q]))
            lo = hi
        schema = _DIGEST if digest else _TEXTS
        return pa.table([pa.array(doc_ids, mask=doc_ids == _NO_ID), *(pa.array(x, f.type) for x, f in zip(out[1:], list(schema)[1:], strict=True))], schema=schema)

    return run


def _run(docs: DataFrame, vocabulary: str, digest: bool) -> DataFrame:
    n = parts(docs.sparkSession)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not plain_scan(cols):
        cols = stored(cols, "documents")
    answers = dealt(cols.mapInArrow(_explode(n, False), _ROW_SQL), n).mapInArrow(_answer(vocabulary), _ROW_SQL)
    both = cols.mapInArrow(_explode(n, True), _ROW_SQL).unionByName(answers)
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded binary"
    return both.groupBy("block").applyInArrow(_reassemble(vocabulary, digest), kind)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and decoded bytes of docs(doc_id, text).

    Null and empty texts have no ids. Rows with the same doc_id or text are
    rows of their own; a null doc_id stays null. Other columns are ignored;
    an empty table gives an empty result.
    """
    return _run(docs, vocabulary, False)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256; rows as in `encode`."""
    return _run(docs, vocabulary, True)
