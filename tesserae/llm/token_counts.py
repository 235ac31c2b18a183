"""Token counts through a digest cache.

A text's key is the SHA-256 of the tokenizer's version digest and the text's normalised content (runs of ASCII white
space become one space, which the tokenizers that drop white space do themselves; others take the text as it is).
Counts already stored are joined; only distinct texts that miss are encoded, and their counts are appended. Copies of a
text collapse before the shuffle, so neither a hot text nor rows without an id meet in one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import fresh_path, tokenizer_path
from tesserae.llm.encoding import Encoder, encoder

CACHE_SCHEMA = "digest string, tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: another vocabulary never meets these counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column, collapse: bool) -> Column:
    plain = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(plain, r"[ \t\n\x0B\f\r]+", " ")) if collapse else plain


def _counter(path: str):
    def count(batches):
        enc = encoder(path)
        for b in batches:
            tokens = [enc.count(t) for t in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(tokens, pa.int64())], ["digest", "tokens"])

    return count


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", cache: str | None = None, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit, digest.

    `cache` is the path of a stored count table (made if it isn't there; a fresh one in the shared folder if None); it
    grows by the distinct misses, each once, and takes one writer at a time. Null texts count as empty: 0 bytes, 0
    tokens. Repeated rows and null ids keep their rows.
    """
    spark, path = docs.sparkSession, tokenizer_path(tokenizer)
    collapse = Encoder(path).mode == "words"
    version = tokenizer_version(path)
    at = cache or fresh_path(spark, "token-counts")
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), normalised(F.col(text), collapse).alias("content"),
    ).withColumn("digest", F.sha2(F.concat(F.lit(version + "\n"), F.col("content")), 256))
    misses = keyed.groupBy("digest").agg(F.first("content").alias("content"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        misses = misses.join(spark.read.schema(CACHE_SCHEMA).parquet(at).select("digest").hint("merge"), "digest", "left_anti")
    misses.mapInArrow(_counter(path), CACHE_SCHEMA).write.mode("append").parquet(at)
    # Each digest is stored once, so this is a plain merge of two scans, whose hot keys the adaptive plan splits.
    stored = spark.read.schema(CACHE_SCHEMA).parquet(at)
    return keyed.drop("content").join(stored.hint("merge"), "digest", "left").select(
        "doc_id", "n_bytes", F.col("tokens").alias("n_tokens"), (F.col("tokens") > limit).alias("over_limit"), "digest"
    )
