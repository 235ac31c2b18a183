"""Sampling, splitting and statistics of token corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.order import drawn


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by the order of a seeded digest of the key: the same rows on every run and every cluster. A filter: no row moves."""
    return df.where(drawn(df, key, n, seed))


def split_by_sample(df: DataFrame, key: str, val_size: int, seed: int = 0) -> DataFrame:
    """`df` with `split`: exactly min(val_size, rows) rows are "val", drawn by digest, the others "train". No row moves."""
    return df.withColumn("split", F.when(drawn(df, key, val_size, seed), "val").otherwise("train"))


def split_by_offset(df: DataFrame, index: str, train: int | None, val: int | None) -> DataFrame:
    """Rows of the first `train` places and the `val` places behind them, with `split`; all rows train unless both are given."""
    if train is None or val is None:
        return df.withColumn("split", F.lit("train"))
    at = F.col(index)
    return df.where(at < train + val).withColumn("split", F.when(at < train, "train").otherwise("val"))


def length_statistics(df: DataFrame, tokens: Column) -> DataFrame:
    """Count, sum, least, most, mean and median of the sequences' lengths (integers, so the median's buffer is one count per length)."""
    n = df.select(F.size(tokens).cast("long").alias("n"))
    return n.agg(
        F.count("*").alias("n_molecules"), F.sum("n").alias("n_tokens"), F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"),
        F.round(F.avg("n"), 6).alias("mean_tokens"), F.round(F.percentile("n", 0.5), 6).alias("median_tokens"),
    )
