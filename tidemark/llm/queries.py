"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, embedding_dedup, language_id, license_scan, ngram_join, quality, sharding, suffix_dedup, token_store


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of the 5-word Jaccard join at 0.8."""
    return ngram_join.join(_documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start_word, n_words, first_doc_id, first_word of every passage of 50 words or more that an earlier document holds."""
    return suffix_dedup.repeats(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of all documents."""
    return language_id.identify(_documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    docs = _documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard with 40 shards."""
    return sharding.assign(_documents(spark, sf_dir))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all embeddings at cosine 0.93."""
    return embedding_dedup.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of all documents."""
    return license_scan.scan(_documents(spark, sf_dir))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated against all of benchmark."""
    return decontaminate.report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from wavelet-matrix shards; added tokens in a text give their own ids."""
    import public_tokenizers

    return token_store.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of byte-level BPE and back."""
    import public_tokenizers

    return byte_bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_join, op2_suffix_dedup, op3_language_id, op4_sharding, op5_embedding_dedup, op6_license_scan, op7_decontaminate, op8_token_store, op9_byte_bpe, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {}
