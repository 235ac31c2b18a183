"""A sample of Parquet rows by bounded shuffle buffers, which stops reading once it has what it needs.

Files and their row groups are taken in a seeded order until they hold the sample and one buffer more. A row group is
read front to back through a buffer of fixed size: every further row replaces a drawn one, which goes out. Each has a
share of the sample in proportion to its rows and is left as soon as that is out, so a task never holds more than
twice the buffer and what lies outside the chosen row groups is not read at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tesserae.functions.arrays import draw
from tesserae.sources.csv_ranges import _open, dealt
from tesserae.sources.shared import Folder, written

BUFFER = 10_000
GROUPS = "file_no int, file string, row_group int, rows long"


def _footers(batches):
    import pyarrow.parquet as pq

    for b in batches:
        out = []
        for r in b.to_pylist():
            with _open(r["file"]) as f:
                meta = pq.ParquetFile(f).metadata
            out += [(r["file_no"], r["file"], g, meta.row_group(g).num_rows) for g in range(meta.num_row_groups)]
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["file_no", "file", "row_group", "rows"])


def buffered(batches: Iterator[pa.Table], buffer: int, rng: np.random.Generator) -> Iterator[pa.Table]:
    """The rows of `batches` in another order: from `buffer` held rows on each further row takes the place of a drawn one; the held ones come last, shuffled."""
    held = None
    for b in batches:
        both = b if held is None else pa.concat_tables([held, b])
        n = both.num_rows
        if n <= buffer:
            held = both
            continue
        slots, out = np.arange(buffer), np.empty(n - buffer, np.int64)
        for k, j in enumerate(rng.integers(0, buffer, n - buffer).tolist()):
            out[k] = slots[j]
            slots[j] = buffer + k
        yield both.take(out)
        held = both.take(slots).combine_chunks()
    if held is not None and held.num_rows:
        yield held.take(rng.permutation(held.num_rows))


def group_rng(seed: int, file_no: int, row_group: int) -> np.random.Generator:
    """The draws of one row group: they follow from the seed and the group's place in the file layout."""
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{file_no}:{row_group}".encode()).digest()[:8], "big"))


def _reader(columns: Sequence[str], target: pa.Schema, buffer: int, seed: int):
    import pyarrow.parquet as pq

    def rows(batches):
        for b in batches:
            for r in b.to_pylist():
                left = r["share"]
                with _open(r["file"]) as f:
                    parts = pq.ParquetFile(f).iter_batches(batch_size=buffer, row_groups=[r["row_group"]], columns=list(columns))
                    read = (pa.Table.from_batches([x]).select(list(columns)).cast(target) for x in parts)
                    for out in buffered(read, buffer, group_rng(seed, r["file_no"], r["row_group"])):
                        yield from out.slice(0, left).combine_chunks().to_batches()
                        left -= min(left, out.num_rows)
                        if not left:
                            break

    return rows


def chosen_groups(spark: SparkSession, path: str, n: int, seed: int = 0, buffer: int = BUFFER) -> DataFrame:
    """(file_no, file, row_group, rows, share) of the row groups that a sample of n rows reads, and how many rows of it each gives.

    Footers are read in the files' seeded order, four times as many each time, until they hold n rows and a buffer.
    """
    files = [(k, f) for k, (f, size) in enumerate(Folder(spark, path).files()) if size and f.endswith(".parquet")]
    files.sort(key=lambda x: hashlib.md5(f"{seed}:{x[0]}".encode()).digest())
    most = 16
    while True:
        some = files[:most]
        table = spark.createDataFrame(some, "file_no int, file string")
        groups = written(dealt(table).mapInArrow(_footers, GROUPS).where("rows > 0"), "row-groups")
        if most >= len(files) or (groups.agg(F.sum("rows")).first()[0] or 0) >= n + buffer:
            break
        most *= 4
    # One row per row group of these files, thousands of times fewer than data rows, is summed in the seeded order.
    order = [draw(F.concat_ws(":", "file_no", "row_group"), seed), "file_no", "row_group"]
    before = F.coalesce(F.sum("rows").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = groups.withColumn("before", before).where(F.col("before") < n + buffer)
    total = F.sum("rows").over(Window.partitionBy())
    upto = lambda at: F.expr(f"cast(floor({at} * cast(least({n}L, total) as decimal(20, 0)) / total) as long)")
    shares = taken.withColumn("total", total).withColumn("share", upto("(before + rows)") - upto("before"))
    return shares.select("file_no", "file", "row_group", "rows", "share").where("share > 0")


def buffered_sample(spark: SparkSession, path: str, n: int, columns: Sequence[str] | None = None, seed: int = 0, buffer: int = BUFFER) -> DataFrame:
    """n rows (all, if there are fewer) of the Parquet files under `path`, which share one schema, by bounded shuffle buffers.

    The same rows for one seed, buffer and layout of files. Not a uniform sample of all rows: like any shuffle buffer it
    takes what the chosen row groups hold; `sample_rows` draws from everything. No files or n < 1 give no rows.
    """
    source = spark.read.parquet(path)
    schema = source.select(*(columns or source.columns)).schema
    shares = written(chosen_groups(spark, path, max(n, 0), seed, buffer), "row-group-shares")
    read = _reader(schema.names, to_arrow_schema(schema), buffer, seed)
    return dealt(shares).mapInArrow(read, schema)
