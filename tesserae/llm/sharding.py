"""Shuffled shards of a corpus by a two-pass external shuffle.

The first pass scatters the records into buckets of about `bucket_bytes` by a seeded hash. The second shuffles each
bucket in memory by Fisher-Yates (Spark's `shuffle`, seeded by bucket) and writes it. The buckets one after another are
one random order of all records; shards are equal cuts of that order, so their row counts differ by one at most.

A record's hash is of its id and text, so neither a source nor a group of copies can fill a bucket. Before anything moves,
one scan counts the records of 2**20 cells of the hash; buckets are runs of cells, so a bucket's place in the order is a
running sum over cells, whatever the size of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from tesserae.llm.common import drop_materialized, materialize

#: Cells of the scatter hash: the table of their counts has so many rows at most, and there are no more buckets.
CELL_BITS = 20
#: Bytes of a bucket, held in memory a few times over by one task.
BUCKET_BYTES = 1 << 24
#: What a record counts besides its text.
RECORD_BYTES = 16


def record_size(text: str | Column = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long")


def _named(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of `docs` has."""
    longest = max(docs.columns, key=len, default="")
    return [f"{longest}_{n}" for n in names]


def two_pass_shuffle(docs: DataFrame, path: str, shards: int = 40, seed: int = 1, bucket_bytes: int = BUCKET_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write `docs` in a random order as `shards` shards to `path` (shard=K folders) and return what `read_shards` reads there.

    All rows and columns are kept, with `shard` (int) and `slot` (long, the place in the shard, from 0) added; columns of
    `docs` with these names (in any case) are replaced. Row counts of two shards differ by one at most. Equal seeds give
    equal shards, however the input is partitioned; records of equal id and text take each other's places.
    Null ids and texts are values like others. An empty table gives no rows. A record that is repeated whole more often
    than cells differ by chance is numbered by its place in a written copy of the input, so that its copies spread.
    """
    spark = docs.sparkSession
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("shard", "slot")))
    columns = list(docs.columns)
    own, cell, bucket = _named(docs, "hash", "cell", "bucket")
    hashed = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))

    def counted(rows: DataFrame, key: Column) -> tuple[DataFrame, int, int, int]:
        cells = rows.select(F.shiftrightunsigned(key, 64 - CELL_BITS).alias("cell"), record_size(text).alias("size"))
        cells = materialize(cells.groupBy("cell").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")), "shuffle-cells")
        n, total, most = cells.agg(F.sum("rows"), F.sum("bytes"), F.max("rows")).first()
        return cells, n or 0, total or 0, most or 0

    cells, n, total, most = counted(docs, hashed)
    mean = n / (1 << CELL_BITS)
    if most > mean + 12 * math.sqrt(mean) + 32:  # one record many times
        (number,) = _named(docs, "number")
        docs = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered-records")
        hashed = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text), F.col(number))
        drop_materialized(cells)
        cells, n, total, most = counted(docs, hashed)
    n_buckets = max(1, min(1 << CELL_BITS, math.ceil(total / bucket_bytes)))
    of_cell = lambda c: F.shiftright(c * F.lit(n_buckets), CELL_BITS).cast("int")
    # At most 2**20 rows, however many records there are: one task sums them and they may be broadcast.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = cells.groupBy(of_cell(F.col("cell")).alias("bucket")).agg(F.sum("rows").alias("rows"))
    places = places.select(F.col("bucket").alias("of"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    keyed = docs.withColumn(own, hashed).withColumn(cell, F.shiftrightunsigned(own, 64 - CELL_BITS)).withColumn(bucket, of_cell(F.col(cell)))
    # Bucket k is partition k, so the shuffle's seed, which Spark draws from the partition's number, is the bucket's own.
    scattered = keyed.repartitionById(n_buckets, F.col(bucket)).sortWithinPartitions(bucket, own, doc_id)
    held = scattered.groupBy(bucket).agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in columns))).alias("rows"))
    mixed = held.select(F.col(bucket).alias("of"), F.shuffle("rows", seed).alias("rows"))
    placed = mixed.join(F.broadcast(places), "of").select("before", F.posexplode("rows").alias("nth", "row"))
    at = F.col("before") + F.col("nth")
    shard = F.expr(f"CAST((before + nth) * {shards} DIV {max(n, 1)} AS INT)")
    first = F.expr(f"(CAST(shard AS BIGINT) * {n} + {shards - 1}) DIV {shards}")
    placed = placed.select("row", at.alias("at"), shard.alias("shard")).select("row.*", (F.col("at") - first).alias("slot"), "shard")
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    drop_materialized(cells, docs)
    return read_shards(spark, path, StructType([f for f in docs.schema.fields if f.name in columns]))


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of written shards, with shard and slot; `schema` is that of the records."""
    return spark.read.schema(StructType([*schema.fields, StructField("slot", LongType()), StructField("shard", IntegerType())])).parquet(path)
