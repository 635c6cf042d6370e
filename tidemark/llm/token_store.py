"""Token ids in binary shard files: one wavelet matrix for each shard.

File: magic, the length of a JSON header, the header, then sections. Sections:
doc ids (int64), the end of each document's ids (int64), the directory, and for
every bit from the highest down one plane: its bits in the order of the matrix
(8 in a byte, lowest first), cut into blocks of BLOCK_BYTES. All sections and
blocks are compressed with zstd, each by itself. The directory has the number of
ones before each block of each plane and where the block begins, so one rank
reads one block. The header has the number of zeros of each plane.
Ids come back by access, by rank and select (counting, occurrences), which read
the directory and the blocks that they touch (`ShardFile`), or all at once by
undoing the stable partitions plane by plane (`from_bytes`).
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pretokens
from .exchange import new_path, parts, stored
from .hashindex import HashIndex, Lists

MAGIC = b"TMWM0002"
END_ID = 2
SHARD_IDS = 1 << 21  # a shard is closed by the document that brings it to this many ids
CHARS = 1 << 20  # characters encoded at a time
KNOWN_WORDS = 1 << 20  # distinct words a worker remembers
_STEP = 512
BLOCK_BYTES = 1 << 15  # bytes of a plane that are compressed together


class _Queries:
    """Token access, counting and occurrence lookup from bits and ranks of planes."""

    n: int
    bits: int
    zeros: list[int]

    def _bit(self, level: int, i: int) -> int:
        raise NotImplementedError

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        raise NotImplementedError

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        v = 0
        for level in range(self.bits):
            one = self._bit(level, i)
            r = self._rank1(level, i)
            i = self.zeros[level] + r if one else i - r
            v = v << 1 | one
        return v

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of value among the first i lie in the last order."""
        a, b = 0, i
        for level in range(self.bits):
            ra, rb = self._rank1(level, a), self._rank1(level, b)
            if value >> (self.bits - 1 - level) & 1:
                a, b = self.zeros[level] + ra, self.zeros[level] + rb
            else:
                a, b = a - ra, b - rb
        return a, b

    def count(self, value: int, upto: int | None = None) -> int:
        """Occurrences of value among the first `upto` (all, if not given): its rank."""
        if value >> self.bits or value < 0:
            return 0
        a, b = self._range(value, self.n if upto is None else upto)
        return b - a

    def select(self, value: int, k: int) -> int:
        """Position of occurrence k (from 0) of value."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        pos = self._range(value, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - level) & 1
            want = pos - self.zeros[level] if one else pos
            lo, hi = 0, self.n
            while lo < hi:  # the first i with more than `want` such bits up to and with i
                mid = (lo + hi) // 2
                r = self._rank1(level, mid + 1)
                if (r if one else mid + 1 - r) > want:
                    hi = mid
                else:
                    lo = mid + 1
            pos = lo
        return pos

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]


def _ones_before(block: np.ndarray, i: int) -> int:
    """Ones among the first i bits of some bytes."""
    n = int(np.bitwise_count(block[: i // 8]).sum())
    return n + (int(block[i // 8]) & (1 << i % 8) - 1).bit_count() if i % 8 else n


class WaveletMatrix(_Queries):
    """A sequence of non-negative integers below 2**bits as succinct bit planes in memory."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[np.ndarray]):
        self.n, self.bits, self.zeros, self.planes = n, bits, zeros, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        bits = max(1, top.bit_length())
        cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes = [], []
        for bit in range(bits - 1, -1, -1):
            one = (cur & cur.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            low = cur[~one]
            zeros.append(len(low))
            cur = np.concatenate([low, cur[one]])
        return cls(len(ids), bits, zeros, planes)

    def all(self) -> np.ndarray:
        """The whole sequence."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z = self.zeros[level]
            up = np.empty(self.n, kind)
            up[~one] = cur[:z]
            up[one] = cur[z:] | kind(1 << (self.bits - 1 - level))
            cur = up
        return cur

    def ranks(self, step: int) -> np.ndarray:
        """Ones before every `step` bytes of each plane, and in all: one row for each plane."""
        out = []
        for p in self.planes:
            full = np.zeros(-(-len(p) // step) * step, np.uint8)
            full[: len(p)] = p
            out.append(np.r_[0, np.cumsum(np.bitwise_count(full).reshape(-1, step).sum(axis=1, dtype=np.int64))])
        return np.stack(out)

    @functools.cached_property
    def _ranks(self) -> np.ndarray:
        return self.ranks(_STEP // 8)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> i % 8 & 1

    def _rank1(self, level: int, i: int) -> int:
        block = i // _STEP
        a = block * (_STEP // 8)
        return int(self._ranks[level][block]) + _ones_before(self.planes[level][a : a + _STEP // 8], i - block * _STEP)


def to_bytes(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard: doc_ids[i] has ids[ends[i - 1]:ends[i]]."""
    matrix = WaveletMatrix.build(ids)
    codec = pa.Codec("zstd", compression_level=1)
    pack = lambda x: codec.compress(x, asbytes=True) if len(x) else b""
    cut = [pack(p[a : a + BLOCK_BYTES].tobytes()) for p in matrix.planes for a in range(0, len(p), BLOCK_BYTES)]
    begin = np.r_[0, np.cumsum([len(x) for x in cut])].astype("<i8")
    raw = [doc_ids.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), matrix.ranks(BLOCK_BYTES).astype("<i8").tobytes() + begin.tobytes()]
    packed = [pack(x) for x in raw]
    head = json.dumps({"n": matrix.n, "bits": matrix.bits, "zeros": matrix.zeros, "block": BLOCK_BYTES, "sizes": [[len(a), len(b)] for a, b in zip(raw, packed, strict=True)]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *packed, *cut])


class ShardFile(_Queries):
    """A shard file opened for single look-ups: reads its header and directory, and later only blocks that are asked for."""

    def __init__(self, source, blocks_held: int = 64):
        """source: a path, or anything with read_at(size, offset), as Arrow's random-access files have."""
        if isinstance(source, str):
            fs, inner = _file_system(source)
            source = fs.open_input_file(inner)
        self._source, self._codec = source, pa.Codec("zstd")
        start = source.read_at(12, 0)
        if start[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(start[8:12], "little")
        head = json.loads(source.read_at(size, 12))
        self.n, self.bits, self.zeros, self._block, self._sizes = head["n"], head["bits"], head["zeros"], head["block"], head["sizes"]
        self._sections = np.r_[12 + size, 12 + size + np.cumsum([x for _, x in self._sizes])]
        plane = -(-self.n // 8)
        self._per_plane = -(-plane // self._block)
        self._last = plane - (self._per_plane - 1) * self._block if plane else 0
        directory = np.frombuffer(self._section(2), "<i8")
        self._ones = directory[: self.bits * (self._per_plane + 1)].reshape(self.bits, -1)
        self._begin = directory[self.bits * (self._per_plane + 1) :]
        self._load = functools.lru_cache(blocks_held)(self._read_block)

    def _section(self, i: int) -> bytes:
        plain, packed = self._sizes[i]
        return self._codec.decompress(self._source.read_at(packed, int(self._sections[i])), plain, asbytes=True) if plain else b""

    @functools.cached_property
    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self._section(0), "<i8")

    @functools.cached_property
    def ends(self) -> np.ndarray:
        return np.frombuffer(self._section(1), "<i8")

    def _read_block(self, level: int, block: int) -> np.ndarray:
        i = level * self._per_plane + block
        a, b = int(self._begin[i]), int(self._begin[i + 1])
        plain = self._last if block == self._per_plane - 1 else self._block
        return np.frombuffer(self._codec.decompress(self._source.read_at(b - a, int(self._sections[-1]) + a), plain, asbytes=True), np.uint8)

    def _bit(self, level: int, i: int) -> int:
        return int(self._load(level, i // 8 // self._block)[i // 8 % self._block]) >> i % 8 & 1

    def _rank1(self, level: int, i: int) -> int:
        block, inside = divmod(i, self._block * 8)
        n = int(self._ones[level][block])
        return n + _ones_before(self._load(level, block), inside) if inside else n

    def matrix(self) -> WaveletMatrix:
        """All planes, in memory."""
        planes = [np.concatenate([self._read_block(level, b) for b in range(self._per_plane)] or [np.zeros(0, np.uint8)]) for level in range(self.bits)]
        return WaveletMatrix(self.n, self.bits, self.zeros, planes)


class _Bytes:
    def __init__(self, data: bytes):
        self.data = data

    def read_at(self, size: int, offset: int) -> bytes:
        return self.data[offset : offset + size]


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Doc ids, ends and the matrix of a whole file."""
    f = ShardFile(_Bytes(data))
    return f.doc_ids, f.ends, f.matrix()


def _file_system(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + os.path.abspath(path))


def put_file(folder: str, name: str, data: bytes) -> str:
    """Writes a file under a name of its own for each attempt and returns its path."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}.wm"
    fs, inner = _file_system(path)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    with fs.open_output_stream(inner) as f:
        f.write(data)
    return path


def get_file(path: str) -> bytes:
    fs, inner = _file_system(path)
    with fs.open_input_stream(inner) as f:
        return f.read()


@functools.cache
def _byte_letters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class WordEncoder:
    """Ids of whole texts: each distinct pre-token is encoded once by the tokenizers library."""

    def __init__(self, path: str, encode_special_tokens: bool = False):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.model = whole.model
        added = {i: t for i, t in whole.get_added_tokens_decoder().items() if not (t.special and encode_special_tokens)}
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized and whole.normalizer for t in added.values()):
            raise ValueError("added tokens with rules of their own are not supported")
        self.added = {t.content: i for i, t in added.items()}
        # The longest of those that start at a place, as the library takes them.
        self.find = re.compile("|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True))).finditer if added else None
        self.letters = dict(enumerate(_byte_letters()))
        self._clear()

    def _clear(self):
        self.index, self.lists = HashIndex(16), Lists(np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the end of each text's.

        Texts are split at added tokens, which give their own id, before anything else.
        """
        if self.find is None:
            return self._encode(texts)
        pieces, marks, last = [], [], []  # a piece, the id of the added token after it or -1, each text's last piece
        for t in texts:
            at = 0
            for m in self.find(t):
                pieces.append(t[at : m.start()])
                marks.append(self.added[m[0]])
                at = m.end()
            last.append(len(pieces))
            pieces.append(t[at:])
            marks.append(-1)
        ids, ends = self._encode(pieces)
        if len(pieces) == len(texts):
            return ids, ends
        mark = np.array(marks, np.int32)
        own = mark >= 0
        return np.insert(ids, ends[own], mark[own]), (ends + np.cumsum(own))[last]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.index.n > KNOWN_WORDS:
            self._clear()
        points, offs, whole = pretokens.code_points(texts)
        starts, bounds = pretokens.split(points, offs)
        h = pretokens.span_hashes(points, starts) | np.uint64(1)
        row = self.index.get(h)
        lost = np.flatnonzero(row < 0)
        if len(lost):
            new, at = np.unique(h[lost], return_index=True)
            at = lost[at]
            tokenize, letters = self.model.tokenize, self.letters
            found = [[t.id for t in tokenize(whole[a:b].encode().decode("latin-1").translate(letters))] for a, b in zip(starts[at].tolist(), starts[at + 1].tolist(), strict=True)]
            self.lists.extend(np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64))
            self.index.add(new)
            row[lost] = self.index.get(h[lost])
        ids, ends = self.lists.gather(row)
        return ids, np.r_[0, ends][bounds[1:]] if len(ends) else np.zeros(len(texts), np.int64)


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, encode_special_tokens: bool = False) -> WordEncoder:
    key = path, encode_special_tokens
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]


def text_runs(texts: list[str], limit: int = CHARS):
    """(lo, hi) of consecutive texts of at most `limit` characters, or of one text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


_SHARD = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64())])


def _write(folder, vocabulary, end_id, shard_ids, encode_special_tokens):
    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        docs, sizes, held, total = [], [], [], 0

        def shut():
            ids = np.concatenate(held)
            data = to_bytes(np.concatenate(docs), np.cumsum(np.concatenate(sizes)), ids)
            path = put_file(folder, f"shard-{part:06d}-{seq:06d}", data)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([path]), pa.array([len(ids)], pa.int64())], schema=_SHARD)

        enc = encoder(vocabulary, encode_special_tokens)
        for b in batches:
            doc_ids = b.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            texts = [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in text_runs(texts):
                ids, ends = enc.encode(texts[lo:hi])
                ids = np.insert(ids, ends, end_id)
                size = np.diff(ends, prepend=0) + 1
                docs.append(doc_ids[lo:hi])
                sizes.append(size)
                held.append(ids)
                total += len(ids)
                if total >= shard_ids:
                    yield shut()
                    docs, sizes, held, total, seq = [], [], [], 0, seq + 1
        if docs:
            yield shut()

    return run


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, encode_special_tokens: bool = False) -> DataFrame:
    """Encodes docs(doc_id, text) into shard files under folder; returns their stored manifest.

    Documents are in ascending doc_id order over (part, seq) and within a
    shard, null doc_ids first; those with the same doc_id lie side by side,
    ordered by text hash. Null texts are empty and hold only the end id. An
    empty table writes no file. encode_special_tokens is the library's own
    setting: whether special tokens that stand in a text are encoded as any
    other characters. Texts of any length are taken whole; other columns are
    ignored.
    """
    spark = docs.sparkSession
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cols.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = rows.mapInArrow(_write(folder, vocabulary, end_id, shard_ids, encode_special_tokens), "part int, seq int, path string, n_ids long")
    return stored(made, "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`, the ids of all shards before each: sums of parts first, then within parts."""
    by_part = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = by_part.select("part", (F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")
    return manifest.withColumn("inner", inner).join(before, "part").select("path", "n_ids", (F.col("before") + F.col("inner")).alias("start"))


_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _digests(batches):
    for b in batches:
        for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
            file = ShardFile(_Bytes(get_file(path)))
            doc_ids, ends, matrix = file.doc_ids, file.ends, file.matrix()
            if len(ends) and file.access(int(ends[-1]) - 1) != matrix.access(int(ends[-1]) - 1):
                raise ValueError(f"the directory of {path} is damaged")
            ids = memoryview(matrix.all().astype("<u4")).cast("B")
            begins = np.r_[0, ends[:-1]]
            crc = [zlib.crc32(ids[4 * a : 4 * e]) for a, e in zip(begins.tolist(), ends.tolist(), strict=True)]
            null = np.iinfo(np.int64).min
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == null), pa.array(start + begins), pa.array(ends - begins), pa.array(crc, pa.int64())], schema=_DIGEST)


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shard files."""
    spark = manifest.sparkSession
    return with_starts(manifest).repartition(parts(spark)).mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, encode_special_tokens: bool = False) -> DataFrame:
    """Writes docs into shards in the shared folder and returns what reading them back gives; options as in `write_shards`."""
    spark: SparkSession = docs.sparkSession
    return read_digests(write_shards(docs, new_path(spark, "tokens"), vocabulary, encode_special_tokens=encode_special_tokens))
