"""Helpers that the corpus operators share: tables, shared storage, exact top-k.

Intermediate tables lie in one folder per application under the shared one. Operators delete those that nothing lazy
reads any more; the others hold what a returned DataFrame still reads, and `drop_run` deletes them all once results are out.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.shared import shared_dir

#: Rows that a worker turns into Python objects at once; Spark's batches hold 10,000.
SLICE_ROWS = 1024
#: Spark's setting that deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def sliced(make):
    """`make`, a function for mapInArrow, on slices of the batches; what Arrow keeps of them is given back behind the last, as workers live on."""

    def run(batches):
        yield from make(b.slice(lo, SLICE_ROWS) for b in batches for lo in range(0, b.num_rows, SLICE_ROWS))
        pa.default_memory_pool().release_unused()

    return run


#: By owner, what empties the cache that its module keeps in this process.
CACHES: dict[str, Callable[[], None]] = {}


def only_cache(own: str = "") -> None:
    """Empty the caches but `own`: worker processes live on, and what one operator's tasks left would lie beside the next one's."""
    for owner, clear in CACHES.items():
        if owner != own:
            clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tesserae/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_run(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. DataFrames that the operators returned cannot be read afterwards."""
    delete_path(spark, run_dir(spark))


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    The shuffle files of the write go with it; else they would lie until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    kept = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out._tesserae_path = path
    return out


def drop_materialized(*frames: DataFrame) -> None:
    """Free tables of `materialize` that nothing lazy refers to any more."""
    for df in frames:
        if path := getattr(df, "_tesserae_path", None):
            delete_path(df.sparkSession, path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kth_largest(df: DataFrame, key: str, k: int) -> tuple[int, int] | None:
    """(value of the k-th largest long in column `key`, how many rows equal to it belong to the top k); None if k < 1 or there are fewer rows.

    A radix selection: four jobs count 16 bits each, so at most 65,536 counts reach the driver however many rows there are.
    """
    if k < 1:
        return None
    prefix, rest = None, k
    shifted = F.col(key).bitwiseXOR(F.lit(-(2**63)))  # unsigned order
    for at in (48, 32, 16, 0):
        part = df
        if prefix is not None:
            part = df.where(F.shiftrightunsigned(shifted, at + 16) == F.lit(prefix))
        digit = F.shiftrightunsigned(shifted, at).bitwiseAND(F.lit(0xFFFF))
        counts = sorted(((r[0], r[1]) for r in part.groupBy(digit.alias("d")).count().collect()), reverse=True)
        for d, n in counts:
            if rest <= n:
                prefix = ((prefix or 0) << 16) | d
                break
            rest -= n
        else:
            return None
    value = prefix ^ (1 << 63)
    value = value - 2**64 if value >= 2**63 else value
    return value, rest


def tokenizer_path(name: str) -> str:
    """A vocabulary file by name, or by path where one is given; the files stay outside this repository."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
