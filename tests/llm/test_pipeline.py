"""The pipeline against the operators' brute-force rules, stage by stage."""

import hashlib

import pytest

import public_tokenizers
from tidemark.llm import language_id

from .test_ops import ALNUM, closure, low, make, shingles, tik


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = make(7, 40)
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(next(t for _, t in rows if t and len(t.split()) > 150).split()[5:40]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")

    texts = {r.doc_id: r.text for r in language_id.accepted(table).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    left = {i: texts[i] for i in sorted(set(closure(ids, links).values()))}
    seen, cut = set(), {}
    for i, t in left.items():
        w = t.encode().lower().split()
        windows = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        hit = {x for j, k in enumerate(windows) if k in seen for x in range(j, j + 50)}
        seen.update(windows)
        if not w or len(hit) < len(w):
            cut[i] = hit
    w = ALNUM.findall(low(items[0][1]))
    windows = {tuple(w[j : j + 13]) for j in range(len(w) - 12)}
    enc, want = tik("byte_bpe_multi_50k.tiktoken"), {}
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    for i, gone in cut.items():
        words = [x for k, x in enumerate(left[i].encode().lower().split()) if k not in gone]
        own = ALNUM.findall(low(b" ".join(words).decode()))
        hit = [0] * len(own)
        for j in range(len(own) - 12):
            if tuple(own[j : j + 13]) in windows:
                hit[j : j + 13] = [1] * 13
        if not (sum(hit) and 20 * sum(hit) >= len(own)):
            want[i] = gone
    assert set(got) == set(want)
    for i, gone in want.items():
        if not gone:
            raw = left[i].encode()
            assert got[i].decoded_sha256 == hashlib.sha256(raw).hexdigest() and got[i].n_tokens == len(enc.encode_ordinary(left[i]))
    assert pipeline.ORACLE_SQL is None and [n for n, _ in pipeline.STAGES] == ["language_id", "ngram_join", "suffix_dedup", "decontaminate", "byte_bpe"]
    assert public_tokenizers
