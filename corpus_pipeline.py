"""The corpus pipeline: toxicity filter, near-duplicate removal, decontamination, mixing, token blocks.

Every stage is a function of (spark, docs, sf_dir) to a DataFrame; what it returns is written as Parquet and read again
as the next stage's `docs`. All but the last return the columns of `documents`. Rows are only dropped by a stage's own
verdict: toxic documents, near-duplicates other than the smallest id of a class, contaminated documents. Mixing drops
nothing; it repeats documents of small sources (its order is not among a document's columns, and the last stage writes by
id). The last stage returns one row per document of the mix, read back from the written token blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import materialize, table
from tesserae.llm.decontamination import keep_clean
from tesserae.llm.mixing import mix
from tesserae.llm.ngram_join import keep_one_per_class, ngram_jaccard_join
from tesserae.llm.token_blocks import token_table
from tesserae.llm.toxicity import drop_toxic, fit

ORACLE_SQL = None  # SQL can express neither the classifier nor the tokenizer


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold, all columns kept; null and empty texts are scored like others. The model is fitted on this stage's own labelled rows."""
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of 0.8 or more in five-word n-grams, that of the smallest id; rows without words stay."""
    return keep_one_per_class(docs, ngram_jaccard_join(docs, n=5, threshold=0.8))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; null and empty texts stay."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources flattened until the smallest is read one and a half times; every document is read at least once."""
    return mix(docs, max_repeats=1.5, places=False)


def write_token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row of the mix, read back from the written blocks: integer ids in ascending order, null ids first, null texts as empty ones."""
    return token_table(docs, "byte_bpe_50k.json", end_id=0)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_blocks", write_token_blocks),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
