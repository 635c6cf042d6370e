"""The corpus operators against brute force, on small tables with awkward rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import public_tokenizers
from tidemark.llm import byte_bpe, components, decontaminate, embedding_dedup, exchange, language_id, license_scan, ngram_join, pretokens, quality, sharding, suffix_dedup, token_store
from tidemark.llm.hashindex import HashIndex

WORDS = "the and of ing tion éa ouen der und que con ar el bra lum".split()
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def make(seed=1, n=60):
    """(doc_id, text) with copies, near copies, shared passages, empty, null, short and long texts, ties and a hot group."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3)))
    text = lambda k: " ".join(word() for _ in range(k))
    rows = [text(rng.choice([1, 3, 5, 6, 20, 80, 200])) for _ in range(n)]
    base, passage = text(120), text(70)
    rows += [base] * 12
    for _ in range(14):  # near copies of one text
        w = base.split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [text(rng.randint(3, 40)) + " " + passage + "\n" + text(rng.randint(3, 40)) for _ in range(6)]
    rows += ["", None, "   \n", "one", "One", "a b c d", "A B c d", text(4000), "x" * 3000, "<|endoftext|> don't 'S \x1c\x85", "!!! ### 123"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i * 3 + 1, rows[j]) for i, j in enumerate(order)]


@pytest.fixture(scope="module")
def rows():
    return make()


def frame(spark, rows, extra=True):
    """Rows with columns that clash with the operators' own names."""
    data = [(i, t, 7, "x", None) for i, t in rows]
    df = spark.createDataFrame(data, "doc_id long, text string, part int, node string, block string")
    return df if extra else df.select("doc_id", "text")


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def closure(nodes, links):
    up = {i: i for i in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def test_ngram_join(spark, rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = closure(ids, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(frame(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), roots[i]) for i in ids}
    kept = ngram_join.one_of_each(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == set(roots.values()) and kept.columns == frame(spark, rows).columns


def test_ngram_join_of_rows_that_share_an_id(spark):
    """Each row links by its own text, in any order of the rows, with or without a doc_id."""
    a = " ".join(f"w{i}" for i in range(60))
    near, other = a.replace("w59", "x"), " ".join(f"q{i}" for i in range(40))
    for rows in ([(1, a), (1, other), (2, near), (None, other), (None, None)], [(1, other), (None, None), (2, near), (None, other), (1, a)]):
        docs = spark.createDataFrame([(i, t, 3, "s") for i, t in rows], "doc_id long, text string, kept_id int, root string")
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.join(docs).collect())
        assert got == [("1", 36, "1"), ("1", 56, "1"), ("2", 56, "1"), ("None", 0, "None"), ("None", 36, "1")]
        left = ngram_join.one_of_each(docs)
        assert left.columns == docs.columns and sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted([("1", a), ("1", other), ("None", "None")])
    bare = spark.createDataFrame([(None, a), (None, near), (7, near)], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in ngram_join.join(bare).collect()) == ["7"] * 3 and [r.doc_id for r in ngram_join.one_of_each(bare).collect()] == [7]


@pytest.mark.parametrize("hot", [1 << 10, 2])
def test_ngram_join_of_large_buckets(spark, monkeypatch, hot):
    """Buckets far above the block size, with several components in them, lose no link; nor do those dealt to several tasks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "SAMPLED", 64 if hot > 2 else 1)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rng = random.Random(8)
    base, rows = [[f"{c}{i}" for i in range(80)] for c in "ab"], []
    for i in range(90):
        w = list(base[i % 2])
        if i % 3 == 0:
            w[40:] = base[0][40:]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r.doc_id: r.component_id for r in ngram_join.join(frame(spark, rows)).collect()} == closure(sets, links)


def test_hot_join(spark):
    left = spark.range(9000).selectExpr("id", "if(id % 3 = 0, 1, if(id % 7 = 0, null, id)) as k")
    right = spark.range(0, 9000, 2).selectExpr("id + 1 as k", "id as x")
    want = sorted(map(str, left.join(right, "k", "left").collect()))
    assert sorted(map(str, exchange.hot_join(left, right, "k").collect())) == want


def test_ngram_keys_meet():
    """Any two sets that link share a bucket key, whatever their sizes."""
    rng = np.random.default_rng(0)
    bands = ngram_join.Bands()
    for n in (5, 6, 8, 9, 10, 12, 17, 30, 60, 150, 700):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = rng.integers(0, len(a) // 5 + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, rng.integers(0, len(a) // 5 + 1), dtype=np.uint64)]))
            if len(b) and ngram_join.linked(a, b, 80) and len(np.setxor1d(a, b)):
                assert len(np.intersect1d(ngram_join.keys_of(a, bands), ngram_join.keys_of(b, bands)))
                n_words = min(len(ngram_join.bit_sketch(a)), len(ngram_join.bit_sketch(b))) // 8
                assert ngram_join.plausible(len(a), len(b), ngram_join.folded(ngram_join.bit_sketch(a), n_words), ngram_join.folded(ngram_join.bit_sketch(b), n_words), 80)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)]
    want = {n: r for n, r in closure({x for p in links for x in p}, links).items()}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: r for n, r in want.items() if n in got} and set(want) - set(got) <= {a for a, b in links if a == b}


def test_suffix_dedup(spark, rows):
    seen, want = set(), {}
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    for i in sorted(words):
        w = words[i]
        windows = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        hit = {x for j, k in enumerate(windows) if k in seen for x in range(j, j + 50)}
        seen.update(windows)
        if hit:
            want[i] = hit
    spans = suffix_dedup.repeats(frame(spark, rows))
    got = collections.defaultdict(set)
    for r in spans.collect():
        got[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
        assert r.first_doc_id < r.doc_id
        assert words[r.doc_id][r.start_word : r.start_word + r.n_words] == words[r.first_doc_id][r.first_word : r.first_word + r.n_words]
    assert dict(got) == want
    left = {r.doc_id: r.text for r in suffix_dedup.dedup(frame(spark, rows)).collect()}
    texts = dict(rows)
    for i, t in texts.items():
        rest = [w for k, w in enumerate(words[i]) if k not in want.get(i, ())]
        if i in want and not rest:
            assert i not in left
        else:
            assert left[i] == t if i not in want else left[i].encode().lower().split() == rest


def test_suffix_dedup_of_hot_anchors(spark, monkeypatch):
    """A passage in most texts, its anchors dealt to many tasks, is found in all of them but the first."""
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    rng = random.Random(2)
    word = lambda: f"v{rng.randrange(3000)}"
    passage = [word() for _ in range(90)]
    rows = []
    for i in range(40):
        own = [word() for _ in range(rng.randint(0, 60))]
        part = passage[rng.randint(0, 25) : rng.randint(70, 90)] if i % 4 else []
        rows.append((i, " ".join([*own, *part, *(word() for _ in range(rng.randint(0, 60)))])))
    seen, want = set(), {}
    words = {i: t.split() for i, t in rows}
    for i, w in words.items():
        windows = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        hit = {x for j, k in enumerate(windows) if k in seen for x in range(j, j + 50)}
        seen.update(windows)
        if hit:
            want[i] = hit
    got = collections.defaultdict(set)
    for r in suffix_dedup.repeats(frame(spark, rows)).collect():
        got[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
        assert r.first_doc_id < r.doc_id and words[r.doc_id][r.start_word : r.start_word + r.n_words] == words[r.first_doc_id][r.first_word : r.first_word + r.n_words]
    assert dict(got) == want and len(want) > 20


def test_suffix_dedup_within_documents(spark):
    """Repeats of a document's own words count on request, where the two places do not overlap."""
    p, q = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    rows = [(1, f"{p} x {q} y {p}"), (2, "z " * 120), (3, q)]
    got = sorted(map(tuple, suffix_dedup.repeats(frame(spark, rows), within=True).collect()))
    assert (1, 122, 60, 1, 0) in got and (3, 0, 60, 1, 61) in got
    assert {x for r in got if r[0] == 2 for x in range(r[1], r[1] + r[2])} == set(range(50, 120))
    assert sorted(map(tuple, suffix_dedup.repeats(frame(spark, rows)).collect())) == [(3, 0, 60, 1, 61)]


def test_order_and_lcp():
    """The two orders against sorting and comparing the words themselves."""
    rng = np.random.default_rng(5)
    key, beyond = rng.integers(0, 3, 200).astype(np.uint64), rng.integers(1, 3, (200, 6)).astype(np.uint64)
    order, lcp = suffix_dedup.order_and_lcp(key, beyond)
    rows = [(int(key[i]), *beyond[i].tolist()) for i in order]
    assert rows == sorted(rows) and lcp[0] == -1
    for a, b, n in zip(rows, rows[1:], lcp[1:].tolist(), strict=False):
        same = next((j for j in range(7) if a[j] != b[j]), 7)
        assert n == same - 1


def test_suffix_dedup_of_texts_that_share_an_id(spark):
    """Each row loses what its own text repeats, not what another text of the same doc_id does."""
    passage, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    plain, short = " ".join(f"r{i}" for i in range(90)), "only a few words"
    rows = [(1, passage), (1, other), (5, f"a b {passage} c"), (5, plain), (5, short), (5, f"{other} d"), (5, f"{other} d"), (5, None)]
    left = sorted((r.doc_id, str(r.text)) for r in suffix_dedup.dedup(frame(spark, rows)).collect())
    assert [(i, " ".join(t.split())) for i, t in left] == sorted([(1, passage), (1, other), (5, "a b c"), (5, plain), (5, short), (5, "d"), (5, "d"), (5, "None")])


def test_anchors_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(0)
    h, bounds = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), np.array([0, 1200, 1230, 5000])
    start, place, _ = suffix_dedup.anchors(h, bounds, 50, 16)
    prints = suffix_dedup.run_prints(h, 16)
    monkeypatch.setattr(suffix_dedup, "_PLACE", np.uint64(1023))
    start2, place2, _ = suffix_dedup._anchors_long(prints, bounds, 50, 16, len(h))
    assert np.array_equal(start, start2) and (place == place2).mean() > 0.99


def test_decontaminate(spark, rows):
    rng = random.Random(2)
    texts = [t for _, t in rows if t and len(ALNUM.findall(low(t))) > 40]
    items = [(f"i{k}", " ".join(rng.choice(texts).split()[3:30])) for k in range(6)] + [("short", "one"), ("none", "!!"), ("null", None), ("tie", "a b c d")]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(i)
    want = {}
    for d, t in rows:
        w = ALNUM.findall(low(t))
        hit, own = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    own |= windows[k]
                    hit[j : j + n] = [1] * n
        want[d] = (len(w), sum(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(frame(spark, rows), bench).collect()}
    assert got == want
    left = {r.doc_id for r in decontaminate.remove(frame(spark, rows), bench).collect()}
    assert left == {d for d, x in want.items() if not x[4]}
    blocks = decontaminate.scan(frame(spark, [r for r in rows if r[1]]), bench, block_words=10).collect()
    assert {r.doc_id: r.n_hit for r in blocks} == {d: x[1] for d, x in want.items() if dict(rows)[d]}


def test_decontaminate_rows_of_several_blocks(spark):
    """Rows that share a doc_id, or have none, stay rows of their own with any number of blocks."""
    texts = ["p q r s t", "v w x y z", "p q v w x", "", None, "p q r s t"]
    docs = frame(spark, [(i, t) for i in (None, 5) for t in texts])
    bench = spark.createDataFrame([("a", "p q"), ("b", "v w x"), ("c", "t"), ("d", "none here")], "item_id string, text string")
    one, many = ([tuple(map(str, r)) for r in decontaminate.scan(docs, bench, block_words=n).collect()] for n in (decontaminate.BLOCK_WORDS, 1))
    hits = {"p q r s t": (5, 3), "v w x y z": (5, 3), "p q v w x": (5, 5), "": (0, 0), None: (0, 0)}
    assert sorted(one) == sorted(many)
    assert sorted(r[:3] for r in many) == sorted((str(i), *map(str, hits[t])) for i in (None, 5) for t in texts)


def test_decontaminate_removes_rows_by_their_own_text(spark):
    bench = spark.createDataFrame([("a", "p q"), ("b", "v w x")], "item_id string, text string")
    rows = [(1, "p q r"), (1, "clean words"), (None, "v w x"), (None, "clean"), (2, None), (2, ""), (3, "clean words"), (3, "clean words")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, bad_id int, spans string")
    for n in (decontaminate.BLOCK_WORDS, 1):
        left = decontaminate.remove(docs, bench, block_words=n)
        assert left.columns == docs.columns
        assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted((str(i), str(t)) for i, t in rows if t not in ("p q r", "v w x"))


def test_decontaminate_longest_in_report(spark):
    item = [f"w{i}" for i in range(40)]
    docs = frame(spark, [(1, " ".join(["x", *item[5:30], "y", *item[:13]])), (2, "none"), (3, None)])
    bench = spark.createDataFrame([("a", " ".join(item)), ("b", " ".join(item[4:25]))], "item_id string, text string")
    got = {r.doc_id: (r.longest, r.longest_word, r.longest_item, r.longest_item_word, r.n_items) for r in decontaminate.report(docs, bench).collect()}
    assert got == {1: (25, 1, "a", 5, 2), 2: (None,) * 4 + (0,), 3: (None,) * 4 + (0,)}


def test_decontaminate_items_without_id(spark):
    docs = frame(spark, [(1, "p q r s t"), (2, "v w x")])
    bench = spark.createDataFrame([(None, "q r"), ("b", "s t")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(docs, bench).collect()}
    assert got == {1: (4, 1, True), 2: (0, 0, False)}


def test_decontaminate_longest_matches(spark):
    """Matches reach beyond the window and carry their places, with any number of blocks."""
    item = [f"w{i}" for i in range(40)]
    texts = [" ".join(["x", *item[5:30], "y", *item[:13], "z"]), " ".join(item[28:]), "one and one"]
    bench = spark.createDataFrame([("a", " ".join(item)), ("b", "one"), (None, " ".join(item[6:20]))], "item_id string, text string")
    for n in (decontaminate.BLOCK_WORDS, 1):
        got = {r.doc_id: sorted(map(tuple, r.matches), key=str) for r in decontaminate.scan(frame(spark, list(enumerate(texts))), bench, block_words=n).collect()}
        assert got == {0: sorted([(1, 25, "a", 5), (27, 13, "a", 0), (2, 14, None, 0)], key=str), 1: [], 2: [(0, 1, "b", 0), (2, 1, "b", 0)]}


def tik(name):
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, rows):
    name = "byte_bpe_multi_50k.tiktoken"
    enc = tik(name)
    got = {r.doc_id: tuple(r)[1:] for r in byte_bpe.digests(frame(spark, rows), public_tokenizers.path(name)).collect()}
    for i, t in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        assert got[i] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.encode(frame(spark, rows[:20]), public_tokenizers.path(name)).collect()}
    assert back == {i: t or "" for i, t in rows[:20]}


def test_pretokens_follow_the_pattern():
    import regex

    rule, rng = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    letters = "ab'strevmld  \n\t1٣é.!-'漢　\xa0\x1c\x85’ 𝔸"
    for _ in range(500):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(5)]
        points, offs, whole = pretokens.code_points(texts)
        starts, bounds = pretokens.split(points, offs)
        assert [[whole[starts[j] : starts[j + 1]] for j in range(bounds[i], bounds[i + 1])] for i in range(5)] == [rule.findall(t) for t in texts]


def test_hash_index_with_shared_leading_bits():
    h = (np.arange(1, 50001, dtype=np.uint64) * np.uint64(2)) | np.uint64(5 << 60)
    index = HashIndex(4)
    index.add(h[:20000])
    index.add(h[20000:])
    assert np.array_equal(index.get(h), np.arange(50000)) and (index.get(h + np.uint64(1)) == -1).all()


def test_token_store(spark, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for special in (False, True):
        t.encode_special_tokens = special
        got = sorted(map(tuple, token_store.round_trip(frame(spark, rows), path, special).collect()))
        start, want = 0, []
        for i, text in sorted(rows, key=lambda r: r[0]):
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert got == want


def test_token_store_reads_added_tokens(spark, rows, tmp_path):
    """The query's ids are the library's by default, where special tokens in a text give their own id."""
    from tokenizers import Tokenizer

    from tidemark.llm import queries

    t, end = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), "<|endoftext|>"
    assert t.encode(f"a {end} b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts = [f"a {end} b", end, end * 3, f"{end}\n\n x  {end}  ", f"don{end}'t {end[:-1]} <{end}>", None, "", f"  {end}é 12"]
    data = [*rows, *((10000 + i, x) for i, x in enumerate(texts))]
    frame(spark, data).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op8_token_store(spark, str(tmp_path)).collect()))
    start, want = 0, []
    for i, text in sorted(data, key=lambda r: r[0]):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, np.int64), np.zeros(3, np.int64), rng.integers(0, 50257, 3000), np.repeat([5, 70000], 700)):
        docs, ends, w = token_store.from_bytes(token_store.to_bytes(np.array([1, 2]), np.array([len(ids) // 2, len(ids)]), ids))
        assert np.array_equal(w.all(), ids) and docs.tolist() == [1, 2] and ends.tolist() == [len(ids) // 2, len(ids)]
        for i in range(0, len(ids), 211):
            v = int(ids[i])
            assert w.access(i) == v and w.count(v, i) == int((ids[:i] == v).sum()) and w.select(v, w.count(v, i)) == i
            assert w.occurrences(v) == np.flatnonzero(ids == v).tolist()
        assert w.count(60000) == int((ids == 60000).sum())


def test_shard_file_reads_parts(tmp_path):
    """Look-ups in a file agree with the sequence and read a small part of it."""
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 2_000_000) % 50000
    path = token_store.put_file(str(tmp_path), "s", token_store.to_bytes(np.array([9]), np.array([len(ids)]), ids))
    whole = token_store.get_file(path)
    read = []

    class Counted(token_store._Bytes):
        def read_at(self, size, offset):
            read.append(size)
            return super().read_at(size, offset)

    f = token_store.ShardFile(Counted(whole))
    for i in (0, 777_777, len(ids) - 1):
        v = int(ids[i])
        assert f.access(i) == v and f.count(v, i) == int((ids[:i] == v).sum())
    assert sum(read) < len(whole) / 2
    rare = int(np.flatnonzero(np.bincount(ids) == 2)[0])
    again = token_store.ShardFile(path)
    assert again.occurrences(rare) == np.flatnonzero(ids == rare).tolist() and again.count(49999) == int((ids == 49999).sum())
    assert again.doc_ids.tolist() == [9] and again.ends.tolist() == [len(ids)] and np.array_equal(again.matrix().all(), ids)


def test_sharding(spark, rows):
    data = [*rows, (rows[0][0], rows[0][1])]
    got = sharding.assign(frame(spark, data)).collect()
    assert len(got) == len(data)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    texts = dict(rows)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
    keys = np.arange(200000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert np.bincount(sharding.jump(keys, 40)).std() < 120 and (sharding.jump(keys, 1) == 0).all()


def test_jump_hash_law():
    """Equal to the published loop for one key, and one more shard takes keys only into itself."""

    def one(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    rng = random.Random(6)
    keys = [rng.randrange(1 << 64) for _ in range(400)] + [0, 1, (1 << 64) - 1]
    last = None
    for n in (1, 2, 3, 7, 40, 41, 1000):
        got = sharding.jump(np.array(keys, np.uint64), n).tolist()
        assert got == [one(k, n) for k in keys]
    for n in range(1, 60):
        now = sharding.jump(np.array(keys, np.uint64), n)
        assert last is None or ((now == last) | (now == n - 1)).all()
        last = now


def test_sharding_write(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", 5) for i in range(50)] + [(None, None, 5)], "doc_id long, text string, shard int")
    sharding.write(docs, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    want = {r.doc_id: r.shard for r in sharding.assign(docs).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want and back.where("shard_before = 5").count() == 51


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    data, base = [], rng.normal(size=(8, 16))
    for i in range(240):
        v = base[i % 8] + rng.normal(size=16) * (0.02 if i % 3 else 0.35)
        data.append((i, [float(x) for x in v], int(i % 2)))
    data += [(300 + k, data[0][1], 0) for k in range(5)] + [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [float("nan")] + [1.0] * 15, 0), (404, data[0][1], None), (405, [None] + [1.0] * 15, 0), (406, [1.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<double>, label int, class string")
    links, count = [], collections.Counter()
    ok = [(i, np.array(v, float), lab) for i, v, lab in data if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for x, (i, a, p) in enumerate(ok):
        for j, b, q in ok[x + 1 :]:
            if p == q and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links.append((i, j))
                count.update((i, j))
    roots = closure([r[0] for r in data], links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(df).collect()}
    assert got == {i: (count[i], roots[i], roots[i] == i) for i, _, _ in data}


@pytest.mark.parametrize("most", [1024, 8])
def test_embedding_recall(spark, monkeypatch, most):
    """Recall of links against brute force over 40 cells and more, most links just above the threshold; also with cells of cells."""
    monkeypatch.setattr(embedding_dedup, "MAX_CENTRES", most)
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.normal(size=(12000, 32)))
    again = base[rng.integers(0, len(base), 9000)]
    far = unit(rng.normal(size=again.shape))
    cos = rng.uniform(0.925, 0.96, (len(again), 1))
    far = unit(far - (far * again).sum(axis=1, keepdims=True) * again)
    x = np.concatenate([base, cos * again + np.sqrt(1 - cos**2) * far])
    true = {}
    for lo in range(0, len(x), 2000):
        i, j = np.nonzero(x[lo : lo + 2000] @ x.T >= 0.93)
        for a, b in zip((lo + i).tolist(), j.tolist(), strict=True):
            if a != b:
                true.setdefault(a, set()).add(b)
    df = spark.createDataFrame(([i, v, 4] for i, v in enumerate(x.tolist())), "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.link(df).collect()}
    total = sum(map(len, true.values()))
    assert len(got) == len(x) and all(r.n_links <= len(true.get(i, ())) for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * total > 9000
    roots = closure(range(len(x)), [(a, b) for a, own in true.items() for b in own])
    assert all(roots[i] == roots[r.component_id] for i, r in got.items()) and np.mean([r.component_id == roots[i] for i, r in got.items()]) >= 0.95


def test_automaton():
    rng = random.Random(3)
    for _ in range(100):
        seqs = [[rng.randint(0, 3) for _ in range(rng.randint(1, 8))] for _ in range(3)]
        auto, subs = license_scan.Automaton(seqs), collections.defaultdict(set)
        for n, s in enumerate(seqs):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    subs[tuple(s[i:j])].add((n, j))
        stream, state, size = [rng.randint(0, 4) for _ in range(30)], 0, 0
        for i, x in enumerate(stream):
            state, size = auto.step(state, size, x)
            assert size == max(k for k in range(i + 2) if not k or tuple(stream[i + 1 - k : i + 1]) in subs)
            assert not size or auto.ends[state] == subs[tuple(stream[i + 1 - size : i + 1])]


def test_license_scan(spark, rows):
    extra = ["CC BY and cc  by, All rights\nreserved. cc", "by the General Public License", "cc-by 4.0", license_scan.TEMPLATES[0][0].upper(), "x " + " ".join(license_scan.TEMPLATES[1][0].split()[:14]), "all rights reserved rights reserved all rights reserved"]
    data = [*rows, *((10000 + i, t) for i, t in enumerate(extra))]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, data)).collect()}
    for i, t in data:
        w, places = ALNUM.findall(low(t)), []
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            places += [(j, label) for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
        r, at = got[i], [j for j, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert "mit" in got[10003].labels and "apache-2.0" in got[10004].labels


def test_license_matches_and_chains():
    """Maximal matches, shares and spans against a search of all runs and all chains."""
    rng = random.Random(12)
    letters = "a b c d".split()
    for _ in range(40):
        templates = tuple((" ".join(rng.choice(letters) for _ in range(rng.randint(4, 9))), f"t{i}") for i in range(3))
        m = license_scan.Scanner((("zz yy", "base"),), templates)
        text = [rng.choice([*letters, *letters, "x"]) for _ in range(rng.randint(0, 24))]
        h = np.array([license_scan.word_hash(w.encode()) for w in text], np.uint64)
        _, found = m.scan(h, np.array([0, len(h)]))
        # The longest run that ends at each word and stands in any template; those that cannot be extended, in all templates.
        runs = {tuple(t.split()[i:j]) for t, _ in templates for i in range(10) for j in range(i + 1, len(t.split()) + 1)}
        size = [max(k for k in range(i + 2) if not k or tuple(text[i + 1 - k : i + 1]) in runs) for i in range(len(text))]
        want = set()
        for i, k in enumerate(size):
            if k >= license_scan.MIN_MATCH and (i + 1 == len(text) or size[i + 1] <= k):
                for n, (t, _) in enumerate(templates):
                    w = t.split()
                    want |= {(n + 1, j, j + k, i + 1 - k) for j in range(len(w) - k + 1) if w[j : j + k] == text[i + 1 - k : i + 1]}
        assert {x for own in found.values() for x in own} == want
        for n, (share, first, end) in (m.chains(sorted(want)) if want else {}).items():
            own = sorted((w, a, b) for q, a, b, w in want if q == n)

            def grow(end_, to, covered, at, own=own):
                top = covered
                for x in range(at, len(own)):
                    w, a, b = own[x]
                    late = max(0, end_ - w, to - a) if covered else 0
                    if (not covered or w - end_ <= license_scan.MAX_GAP) and late < b - a:
                        top = max(top, grow(w + b - a, b, covered + b - a - late, x + 1))
                return top

            assert first < end <= len(text) and share * len(m.seqs[n]) <= grow(0, 0, 0, 0) + 1e-9
            assert share * len(m.seqs[n]) >= max(b - a for _, a, b in own)


def test_license_texts(spark):
    """Whole licences keep their label with a changed line, a name put in, or a part left out."""
    mit, bsd3 = license_scan.TEXTS[0][0], license_scan.TEXTS[2][0] + " " + license_scan.TEXTS[3][0]
    texts = [mit, "Copyright (c) 2001 A. Person\n" + mit.replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM"), bsd3, " ".join(mit.split()[40:44]), "free of charge"]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, list(enumerate(texts)))).collect()}
    assert ["mit" in got[i].labels.split(",") for i in range(5)] == [True, True, False, False, False]
    assert {"bsd", "bsd-3-clause"} <= set(got[2].labels.split(",")) and got[0].score == 1.0 and got[1].score > 0.9


def test_license_phrases_inside_templates(spark):
    """Base phrases are found where a longer match holds them."""
    t = [x for x, label in license_scan.TEMPLATES if label == "gpl"][0]
    texts = ["under the GNU General Public License", t, "x " + t + " y general public license", "gnu general public license gnu general public license", "gnu general public"]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, list(enumerate(texts)))).collect()}
    n = len(t.split())
    assert [(got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels) for i in range(5)] == [
        (1, 3, 3, "gpl", "gpl"), (1, n - 3, n - 3, "gpl", "gpl"), (2, n - 2, n + 2, "gpl", "gpl"), (2, 1, 5, "gpl", "gpl"), (0, None, None, "", ""),
    ]
    assert [got[i].score for i in range(4)] == [1.0] * 4 and got[4].score < 1
    nested = license_scan.Scanner((("b c", "x"), ("a b c", "y"), ("c", "z")), (("q a b c d", "t"),))
    h = np.array([license_scan.word_hash(w.encode()) for w in "q a b c d a b c b c".split()], np.uint64)
    places, _ = nested.scan(h, np.array([0, len(h)]))
    assert sorted(places[0]) == [(0, 2), (0, 6), (0, 8), (1, 1), (1, 5), (2, 3), (2, 7), (2, 9)]


def test_classifiers(spark):
    rng = random.Random(5)
    parts = {"en": "the ing tion and th wh er".split(), "de": "ung der sch ich ein über".split(), "fr": "eau oux ent lle que ré".split()}
    data = []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        good = i % 4 > 0
        data.append((i, " ".join(words if good else [w.upper() + "###" for w in words]), lang, int(good)))
    awkward = [(900, None, "en", 1), (901, "", "en", 1), (902, "123 !!", None, 0), (903, "the ing " * 20000, None, 1)]
    df = spark.createDataFrame([*data, *awkward], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert len(got) == len(data) + 4 and [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "en"
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in data if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in data)
    assert np.mean([a == b for a, b in held]) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in language_id.accepted(df).collect()}
    assert kept == {i for i, r in got.items() if not r.rejected} and len(kept) > 0.97 * len(data)

    clean = [(" ".join(rng.choice(parts[x]) + rng.choice(parts[x]) for _ in range(40)), x, 1.0) for x in parts for _ in range(100)]
    model = language_id.train(clean)
    noisy = language_id.noise([x[0] for x in clean], np.random.default_rng(17))
    junk = spark.createDataFrame(list(enumerate(noisy)), "doc_id long, text string")
    assert np.mean([r.rejected for r in language_id.identify(junk, model).collect()]) > 0.95 and language_id.accepted(junk, model).count() < 0.05 * len(clean)
    mixed = spark.createDataFrame([(1, " ".join(data[0][1].split() + data[1][1].split()))], "doc_id long, text string")
    assert not language_id.identify(mixed, model).first().rejected
    folded = language_id.mean_logits(model, np.frombuffer(b"The Ingwhe", np.uint8), np.array([0, 3, 10]))
    for part, row in zip((b"the", b" ingwhe"), folded, strict=True):  # the mean of the table's rows, gram by gram
        grams = [language_id.buckets(np.frombuffer(part[i : i + n], np.uint8), n)[0] for n in language_id.GRAMS for i in range(len(part) - n + 1)]
        assert row == pytest.approx(np.mean(model.table[grams], axis=0), rel=1e-4)

    labels = df.select("doc_id", df["score"].alias("quality"))
    out = {r.doc_id: r for r in quality.score(df, quality.fit(df, labels)).collect()}
    held = [(out[i].predicted, good) for i, _, _, good in data if out[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())


def test_factorisation_identity():
    """The linear-time score equals the sum over all pairs."""
    import pyarrow as pa

    from tidemark.llm.words import slices

    rng = np.random.default_rng(0)
    size = quality.BUCKETS + quality.N_STATS
    m = quality.Model(0.3, rng.normal(size=size), rng.normal(size=(size, 3)), np.zeros(quality.N_STATS), np.ones(quality.N_STATS))
    s = next(iter(slices(pa.array(["the and of the", ""]))))
    at, bucket, share, stat = quality.features(s)
    x = np.zeros((2, size))
    x[at, bucket] = share
    x[:, quality.BUCKETS :] = m.scale(stat)
    for row, z in zip(x, m.logit(at, bucket, share, stat), strict=True):
        on = np.flatnonzero(row)
        pairs = sum(m.v[i] @ m.v[j] * row[i] * row[j] for a, i in enumerate(on) for j in on[a + 1 :])
        assert z == pytest.approx(m.w0 + m.w @ row + pairs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    multi, plain = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    for df in (
        ngram_join.join(docs), suffix_dedup.dedup(docs), language_id.identify(docs), sharding.assign(docs), license_scan.scan(docs), decontaminate.report(docs, bench),
        token_store.round_trip(docs, plain), byte_bpe.digests(docs, multi), quality.score(docs, quality.fit(docs, labels)), embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    ):
        assert df.count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l")]
    docs = frame(spark, rows)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.join(docs).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("2", 2, "2"), ("None", 0, "None"), ("None", 2, "1")]
    assert sorted((str(r.doc_id), str(r.text)) for r in ngram_join.one_of_each(docs).collect()) == [("1", "a b c d e f"), ("2", "g h i j k l"), ("None", "None")]
    for df in (sharding.assign(docs), license_scan.scan(docs), token_store.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")), byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))):
        assert sorted(str(r.doc_id) for r in df.collect()) == ["1", "1", "2", "None", "None"]
    assert suffix_dedup.repeats(docs).count() == 0 and suffix_dedup.dedup(docs).count() == 5
