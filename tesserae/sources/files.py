"""Readers and writers: CSV with nested columns, Parquet with global row numbers, codebooks, corpora, results."""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.arrays import json_if_nested, parse_numbers, parse_vectors
from tesserae.sources.csv_ranges import filesystem, read_csv_rows
from tesserae.sources.shared import Folder

SAMPLE_COLUMNS = ("property_id", "configuration_id", "dataset_id", "atomic_numbers", "positions", "atomic_forces", "energy", "multiplicity", "cell", "pbc")
#: A shard's file lies in a folder of its number.
PART = re.compile(r"/shard_number=(\d+)/")
#: Shards that one task writes, where there are more than tasks; and moves that run at once.
SHARDS_A_TASK, MOVERS = 64, 16
#: Bytes of a shard's rows that a task holds before they become a row group.
GROUP_BYTES = 64 << 20


def read_molecule_csv(spark: SparkSession, path: str, max_rows: int | None = None, **options) -> DataFrame:
    """Molecules of CSV files whose nested columns are JSON text, with row_idx, their place in file order. `max_rows` takes the first ones; nothing is sorted."""
    rows = read_csv_rows(spark, path, SAMPLE_COLUMNS, max_rows, **options)
    kinds = {"energy": F.col("energy").cast("double"), "multiplicity": F.col("multiplicity").cast("int")}
    return rows.withColumns({"atomic_numbers": parse_numbers(F.col("atomic_numbers")), "positions": parse_vectors(F.col("positions")), "atomic_forces": parse_vectors(F.col("atomic_forces")), **kinds})


def write_molecule_csv(df: DataFrame, path: str, columns: tuple[str, ...] = SAMPLE_COLUMNS) -> None:
    """A CSV of fixed columns: nested ones as JSON, missing ones empty."""
    kinds = dict(df.dtypes)
    out = [json_if_nested(c, kinds[c]) if c in kinds else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*out).write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_molecule_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The four columns that tokenising needs, pruned at the scan."""
    return spark.read.parquet(path).select("atomic_numbers", "positions", "atomic_forces", "energy")


def read_evaluation(spark: SparkSession, path: str, split: str = "val", max_samples: int = 0, load_labels: bool = True) -> DataFrame:
    """Structures to score: id, atomic_numbers, positions, natoms, and energy and forces of the val split.

    `energy` may be called `total_energy`; a missing id is the row's place; 0 samples means all.
    """
    rows = with_row_index(spark.read.parquet(path), "row_idx")
    has = set(rows.columns)
    id_ = F.coalesce(F.col("id").cast("string"), F.col("row_idx").cast("string")) if "id" in has else F.col("row_idx").cast("string")
    out = [id_.alias("id"), F.col("atomic_numbers"), F.col("positions"), F.size("atomic_numbers").alias("natoms")]
    if split == "val" and load_labels:
        energies = [F.col(c) for c in ("energy", "total_energy") if c in has]
        out += [F.coalesce(*energies).alias("energy"), F.col("forces")]
    if max_samples:
        rows = rows.where(F.col("row_idx") < max_samples)
    return rows.select(*out)


def file_offsets(df: DataFrame) -> DataFrame:
    """(file, rows, first_row) of the files behind a scan: an exclusive running count in the order of their paths.

    The counts read no columns; one row per file is summed in order.
    """
    counts = df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("rows"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long").alias("first_row"))


def with_row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """A scan with each row's place in the whole data set: its place in its file behind all rows of earlier files. No shuffle of rows."""
    starts = file_offsets(df).select("file", "first_row")
    placed = df.withColumns({"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.row_index")})
    # A row per input file, thousands of times fewer than data rows. Without the hint Spark, which cannot tell how few they
    # are, first deals all rows by their file's name.
    joined = placed.join(F.broadcast(starts), placed["__file"] == starts["file"], "left")
    return joined.withColumn(name, F.col("__at") + F.col("first_row")).drop("__file", "__at", "file", "first_row")


def write_corpus(tokens: DataFrame, path: str, info: dict) -> None:
    """Token rows as Parquet, and what describes them as one JSON line beside it."""
    tokens.write.mode("overwrite").parquet(f"{path}/tokens")
    tokens.sparkSession.createDataFrame([(json.dumps(info, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/tokens"), json.loads(spark.read.text(f"{path}/info").first()[0])


def shard_numbers(df: DataFrame, draw: Column, shard_size: int, split: str = "split", digits: int = 4) -> DataFrame:
    """Each row's shard of exactly `shard_size` rows within its split (the last one smaller): a row's rank by `draw` decides.

    `draw` is hexadecimal text that is spread evenly, as a digest is. Rows are ranked within its first digits, and those
    cells' counts (16**digits per split at most) are summed in order, so no split is ordered in a single task.
    """
    cells = df.withColumn("__o", draw).withColumn("__c", F.substring("__o", 1, digits))
    sizes = cells.groupBy(split, "__c").agg(F.count("*").alias("n"))
    before = Window.partitionBy(split).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(split, "__c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__s"))
    ranked = cells.withColumn("__r", F.row_number().over(Window.partitionBy(split, "__c").orderBy("__o")) - 1)
    shard = F.floor((F.col("__r") + F.col("__s")) / shard_size).cast("long")
    return ranked.join(starts, [split, "__c"]).withColumn("shard", shard).drop("__o", "__c", "__r", "__s")


def shard_starts(df: DataFrame, draw: Column, shard_size: int, split: str = "split") -> dict[str, list[str]]:
    """The first `draw` of every shard of `shard_numbers`, in order, by split: one text per shard reaches the driver."""
    rows = shard_numbers(df.withColumn("__d", draw), F.col("__d"), shard_size, split).groupBy(split, "shard").agg(F.min("__d").alias("first"))
    out: dict[str, list[str]] = {}
    for r in rows.orderBy(split, "shard").collect():
        out.setdefault(r[split], []).append(r["first"])
    return out


def place_in_shards(df: DataFrame, draw: Column, firsts: dict[str, list[str]], split: str = "split") -> DataFrame:
    """`df` with the `shard` whose range of `draw` a row falls in: a binary search per row, and no shuffle."""
    starts = {s: np.array(x) for s, x in firsts.items()}

    @F.arrow_udf("long")
    def shard(splits: pa.Array, draws: pa.Array) -> pa.Array:
        own, d = splits.to_numpy(zero_copy_only=False), draws.to_numpy(zero_copy_only=False).astype(str)
        out = np.zeros(len(d), np.int64)
        for s, first in starts.items():
            out[own == s] = np.searchsorted(first, d[own == s], "right") - 1
        return pa.array(np.maximum(out, 0))

    return df.withColumn("shard", shard(F.col(split), draw))


#: What files of a split are called where it is not the split's own name.
SPLIT_NAMES = {"val": "validation"}


def write_shards(df: DataFrame, path: str, shards: dict[str, int] | None = None, split: str = "split", shard: str = "shard") -> list[str]:
    """One file per shard, called data/<split>-<number>.parquet with five digits, of the columns other than `split` and `shard`; returns the names.

    Shards are dealt by number, not by hash: every task has one, or a run of up to SHARDS_A_TASK where there are many (a
    task and a row of shuffle blocks for each shard would grow with the square of the input). Files are written aside and moved when all are there: a failed write leaves what was there before. Tasks write a file by its final name
    themselves where Arrow opens the store: listing and moving files one by one on the driver took longer than making them. `shards` says how many each
    split has; without it one more aggregation finds out. A shard without rows has no file.
    """
    spark, columns = df.sparkSession, [c for c in df.columns if c not in (split, shard)]
    if shards is None:
        shards = {r[0]: r[1] + 1 for r in df.groupBy(split).agg(F.max(shard)).collect()}  # a row per split
    wanted = [f"{SPLIT_NAMES.get(s, s)}-{k:05d}.parquet" for s in sorted(shards) for k in range(shards[s])]
    first, at = {}, 0
    for s in sorted(shards):
        first[s], at = at, at + shards[s]
    number = F.coalesce(*(F.when((F.col(split) == s) & F.col(shard).between(0, shards[s] - 1), F.col(shard) + k) for s, k in first.items()), F.raise_error(F.lit("a row lies in no shard")).cast("int")) if first else F.lit(0)
    out, aside = Folder(spark, path), f"_publish-{uuid.uuid4().hex}"
    try:
        width = max(min(at, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-at // SHARDS_A_TASK), 1)
        numbered = df.select(*columns, number.cast("int").alias("shard_number"))
        placed = numbered.repartitionById(width, F.floor(F.col("shard_number").cast("long") * width / max(at, 1)).cast("int"))
        out.fs.mkdirs(out.child(f"{aside}/data"))
        uri = out.fs.makeQualified(out.path).toString()
        if _arrow_opens(uri):
            out.fs.mkdirs(out.child(f"{aside}/tasks"))
            named = sorted((k, SPLIT_NAMES.get(s, s)) for s, k in first.items())
            moved = [r[0] for r in placed.sortWithinPartitions("shard_number").mapInArrow(_shard_writer(uri, aside, named), "file string").collect()]
        else:
            placed.write.option("maxRecordsPerFile", 0).partitionBy("shard_number").parquet(f"{path}/{aside}/parts")
            parts = [(name, int(PART.search(name)[1])) for name, _ in Folder(spark, f"{path}/{aside}/parts").files()] if at else []
            moved = [wanted[k] for _, k in parts]
        if len(set(moved)) < len(moved):
            raise ValueError("a shard was written by two tasks")
        if not _arrow_opens(uri):
            with ThreadPoolExecutor(MOVERS) as movers:
                list(movers.map(lambda x: out.move(out.path_of(x[0]), out.child(f"{aside}/data/{wanted[x[1]]}")), parts))
        out.delete(out.child("data"))
        out.move(out.child(f"{aside}/data"), out.child("data"))
    finally:
        out.delete(out.child(aside))
    return sorted(moved)


def _arrow_opens(uri: str) -> bool:
    """Whether tasks can write there by themselves; else Spark writes, and the driver moves file by file."""
    try:
        filesystem(uri)
    except (pa.ArrowException, OSError, ImportError):
        return False
    return True


def _shard_writer(uri: str, aside: str, named: list[tuple[int, str]]):
    """Rows, ordered by shard_number, as a file each of their shard's name; returns the names. `named`: first numbers of the splits, ascending, and their names.

    A file is written under a name of its own and renamed when it is whole, so a task that runs twice does no harm.
    """

    def write(batches):
        system, root = filesystem(uri)
        number, held, size, writer, aim = None, [], 0, None, ""

        def grouped():
            nonlocal writer, held, size, aim
            if writer is None:
                aim = f"{root}/{aside}/tasks/{uuid.uuid4().hex}.parquet"
                writer = pq.ParquetWriter(aim, held[0].schema, filesystem=system, store_schema=False)
            writer.write_table(pa.Table.from_batches(held))
            held, size = [], 0

        def ended() -> str:
            nonlocal writer
            if held:
                grouped()
            writer.close()
            writer = None
            begin, split = next(x for x in reversed(named) if x[0] <= number)
            name = f"{split}-{number - begin:05d}.parquet"
            try:
                system.move(aim, f"{root}/{aside}/data/{name}")
            except OSError:  # an earlier attempt's file is there, and this store does not replace it
                system.delete_file(f"{root}/{aside}/data/{name}")
                system.move(aim, f"{root}/{aside}/data/{name}")
            return name

        for b in batches:
            made, numbers = [], b.column("shard_number").to_numpy()
            rows = b.select([c for c in b.schema.names if c != "shard_number"])
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if number is not None and number != numbers[lo]:
                    made.append(ended())
                number = int(numbers[lo])
                held.append(rows.slice(lo, hi - lo))
                size += held[-1].nbytes
                if size >= GROUP_BYTES:
                    grouped()
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(made)], ["file"])
        if number is not None:
            yield pa.RecordBatch.from_arrays([pa.array([ended()])], ["file"])

    return write


def write_results(results: DataFrame, path: str) -> None:
    """Metric rows as JSON lines."""
    results.coalesce(1).write.mode("overwrite").json(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """(id, energy, forces, natoms) as Parquet."""
    predictions.select("id", "energy", "forces", F.size("forces").alias("natoms")).write.mode("overwrite").parquet(path)
