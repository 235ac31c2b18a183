"""Registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import fresh_path, materialize, table
from tesserae.llm.oracles import ORACLE_SQL  # noqa: F401 - what the entry module registers


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.importance import resample

    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return resample(table(spark, sf_dir, "documents"), target, share=0.85)


def op2_patched_frame_of_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.token_blocks import token_table

    return token_table(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=0).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_zstd_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.warc import archive_table, page_rows

    return page_rows(archive_table(table(spark, sf_dir, "pages")))


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op5_digest_cache_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a cache that an earlier run has filled with half of their contents (by a hash of the text)."""
    from tesserae.llm.token_counts import count_tokens

    docs, cache = table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_path(spark, "token-counts")
    count_tokens(docs.where(F.xxhash64("text") < 0), "word_bpe_49k.json", cache)
    return count_tokens(docs, "word_bpe_49k.json", cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.chaining import fuzzy_passages

    return fuzzy_passages(table(spark, sf_dir, "documents"), min_words=50, min_identity=0.8)


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.mixing import mix, word_count

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("n_tokens"))
    return mix(docs, max_repeats=1.5, tokens=F.col("n_tokens"))


def op8_decision_list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.quality_rules import STATISTICS, judge, learn_rules, text_statistics

    keep = ["doc_id", *STATISTICS, "n_upper", "n_digits", "n_lines", "n_distinct_words"]
    stats = materialize(text_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*keep), "text-statistics")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rules = learn_rules(stats.join(labels, "doc_id"), "quality", "doc_id")
    return judge(stats, rules).select("doc_id", *STATISTICS, "base_failed", "kept", "rule")


def op9_minhash_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=5, threshold=0.8).select("doc_id", "class_id", "n_links")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "text_hash")


def op11_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.sharding import record_size, two_pass_shuffle

    shards = two_pass_shuffle(table(spark, sf_dir, "documents"), fresh_path(spark, "shards"), shards=40)
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return shards.select("doc_id", record_size("text").alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_byte_owner_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.alignment import alignment_scores

    return alignment_scores(table(spark, sf_dir, "documents"))


def op13_partial_distance_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.clustering import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"), clusters=16, rounds=3, scale=64).drop("centroid")


QUERIES = {f.__name__: f for f in (
    op1_importance_resampling, op2_patched_frame_of_reference, op3_zstd_warc_archives, op4_counterfactual_toxicity, op5_digest_cache_token_counts, op6_collinear_chaining, op7_temperature_mixing,
    op8_decision_list_quality, op9_minhash_ngram_jaccard, op10_benchmark_decontamination,
    op11_two_pass_shuffle, op12_byte_owner_alignment, op13_partial_distance_clusters,
)}
