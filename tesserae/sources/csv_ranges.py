"""CSV files read by byte ranges, with each row's place in the whole data set.

Fields may hold line ends and doubled quotes, so a range cannot tell by itself whether it begins inside a field. Whether
a byte is inside quotes is the parity of the quotes before it, and parities add up: a first pass counts each range's
quotes, and its record starts for either parity; a running sum over ranges then gives the true parity and the number of
the first row. The second pass parses the records that begin in its range, reading past its end to finish the last one.
Nothing is sorted, and with a row limit ranges behind it are neither counted nor read.
"""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.sources.shared import Folder, written

RANGE_BYTES = 8 << 20
#: Tasks that ranges are dealt over at most. Rows that only name a range are too small for a width that Spark derives from their bytes.
MOST_TASKS = 20_000
RANGES = "file_no int, file string, size long, start long, end long"
NEWLINE, QUOTE, RETURN = 10, 34, 13


def filesystem(uri: str):
    """(Arrow's file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _open(uri: str):
    system, path = filesystem(uri)
    return system.open_input_file(path)


def _starts(raw: np.ndarray, before: bool, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, parities) of the records that begin in the first `whole` bytes, for a start outside quotes.

    `before`: the first byte belongs to the range before; else the file begins here. Blank lines are no records.
    """
    lines = np.flatnonzero(raw[: whole + before - 1 if before else max(whole - 1, 0)] == NEWLINE)
    at = lines + 1 if before else np.r_[0, lines + 1]
    quotes = np.flatnonzero(raw[int(before) :] == QUOTE) + int(before)
    padded = np.r_[raw, np.array([NEWLINE, NEWLINE], np.uint8)]
    blank = (padded[at] == NEWLINE) | (padded[at] == RETURN) & (padded[at + 1] == NEWLINE)
    inside = np.searchsorted(quotes, at) & 1
    return at[~blank], inside[~blank]


def _read(f, start: int, end: int, size: int) -> np.ndarray:
    """The bytes of a range, with one before it and two behind it where there are such."""
    lo, hi = max(start - 1, 0), min(end + 2, size)
    return np.frombuffer(f.read_at(hi - lo, lo), np.uint8)


def _count(batches):
    for b in batches:
        out = []
        for r in b.to_pylist():
            with _open(r["file"]) as f:
                raw = _read(f, r["start"], r["end"], r["size"])
            before = r["start"] > 0
            inside = _starts(raw, before, r["end"] - r["start"])[1]
            quotes = int(np.count_nonzero(raw[int(before) : int(before) + r["end"] - r["start"]] == QUOTE))
            out.append((r["file_no"], r["file"], r["size"], r["start"], r["end"], quotes, int((inside == 0).sum()), int((inside == 1).sum())))
        yield pa.RecordBatch.from_pydict(dict(zip((*_names(RANGES), "quotes", "even", "odd"), [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.string(), *[pa.int64()] * 6], strict=True)], strict=True)))


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _record_end(f, at: int, size: int, odd: bool) -> int:
    """Where the record ends whose bytes from `at` on are not in the range; odd: `at` is inside quotes."""
    while at < size:
        raw = np.frombuffer(f.read_at(min(1 << 16, size - at), at), np.uint8)
        lines = np.flatnonzero(raw == NEWLINE)
        quotes = np.flatnonzero(raw == QUOTE)
        ends = lines[(np.searchsorted(quotes, lines) & 1) == odd]
        if len(ends):
            return at + int(ends[0]) + 1
        odd ^= bool(len(quotes) & 1)
        at += len(raw)
    return size


def _header(f, size: int) -> list[str]:
    from pyarrow import csv

    line = f.read_at(_record_end(f, 0, size, False), 0)
    table = csv.read_csv(io.BytesIO(line), read_options=csv.ReadOptions(autogenerate_column_names=True), parse_options=csv.ParseOptions(newlines_in_values=True))
    return [c.strip() for c in (str(table.column(i)[0]) for i in range(table.num_columns))] if table.num_rows else []


def _parser(columns: Sequence[str], most: int | None):
    from pyarrow import csv

    def rows(batches):
        for b in batches:
            for r in b.to_pylist():
                with _open(r["file"]) as f:
                    raw, before = _read(f, r["start"], r["end"], r["size"]), r["start"] > 0
                    at, inside = _starts(raw, before, r["end"] - r["start"])
                    at = at[inside == r["odd"]] + r["start"] - int(before)
                    if not len(at):
                        continue
                    head, first, low = _header(f, r["size"]), r["first_row"], int(at[0])
                    if r["start"] == 0:  # the header is record -1
                        at = at[1:]
                        if not len(at):
                            continue
                        low = int(at[0])
                    # From the last record's start on the parity is even, so its end is found from there.
                    high = _record_end(f, int(at[-1]), r["size"], False)
                    text = f.read_at(high - low, low)
                table = csv.read_csv(
                    io.BytesIO(text), read_options=csv.ReadOptions(column_names=head, block_size=max(len(text) + 1, 1 << 16)), parse_options=csv.ParseOptions(newlines_in_values=True),
                    convert_options=csv.ConvertOptions(column_types={c: pa.string() for c in head}, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False),
                )
                if table.num_rows != len(at):
                    raise ValueError(f"{r['file']}: {table.num_rows} rows where {len(at)} records begin, from byte {low} on")
                place = first + np.arange(len(at))
                keep = len(at) if most is None else int(np.searchsorted(place, most))
                out = [table.column(c).combine_chunks() if c in head else pa.nulls(len(at), pa.string()) for c in columns]
                made = pa.RecordBatch.from_arrays([*(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in out), pa.array(place)], [*columns, "row_idx"])
                yield made.slice(0, keep)

    return rows


def dealt(named: DataFrame) -> DataFrame:
    """Rows that each name a piece of work, one to a task up to MOST_TASKS tasks and evenly beyond."""
    return named.repartition(max(1, min(named.count(), MOST_TASKS)))


def csv_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, upto: int | None = None) -> tuple[DataFrame, int]:
    """The byte ranges of all files under `path` in the order of their paths (file_no, file, size, start, end), and the bytes of all files.

    `upto` keeps ranges that begin in the first so many bytes of all.
    """
    files, total = [], 0
    for f, n in Folder(spark, path).files():
        if n:
            files.append((len(files), f, n, total))
            total += n
    table = spark.createDataFrame(files, "file_no int, file string, size long, base long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))
    rows = table.where(F.lit(upto is None) | (F.col("base") < F.lit(upto))).withColumn("start", starts)
    rows = rows.where(F.lit(upto is None) | (F.col("base") + F.col("start") < F.lit(upto)))
    return rows.select("file_no", "file", "size", "start", F.least(F.col("start") + range_bytes, F.col("size")).alias("end")), total


def count_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges with `odd` (whether they begin inside quotes), `records` that begin in them, and `first_row` of each, header lines not counted.

    One row per range is summed in order inside its file, and one per file over all.
    """
    counts = dealt(ranges).mapInArrow(_count, f"{RANGES}, quotes long, even long, odd long")
    counts = written(counts, "csv-counts")
    earlier = Window.partitionBy("file_no").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = counts.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    state = state.select(*_names(RANGES), F.col("inside").cast("int").alias("odd"), F.when(F.col("inside") == 1, F.col("odd")).otherwise(F.col("even")).alias("records"))
    files = state.groupBy("file_no").agg(F.greatest(F.sum("records") - 1, F.lit(0)).alias("rows"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_no", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("file_row"))
    own = F.coalesce(F.sum("records").over(earlier), F.lit(0)) - F.when(F.col("start") > 0, 1).otherwise(0)
    return state.withColumn("own", own).join(files, "file_no").select(*_names(RANGES), "odd", "records", (F.col("file_row") + F.col("own")).cast("long").alias("first_row"))


def read_csv_rows(spark: SparkSession, path: str, columns: Sequence[str], max_rows: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows of all CSV files under `path` in file order: `columns` as text (null where a file has none), and row_idx, their place from 0.

    Every file begins with a header line. Quotes inside quoted fields are doubled; quotes inside unquoted fields are not
    supported. Blank lines are no rows; an empty field is null, a quoted empty one is ''. Files are opened through
    Arrow's file systems. `max_rows` keeps the first rows in file order: ranges are counted from the front, four
    times as many each time, until they hold so many, so what lies far behind is not read at all. No files give no rows.
    """
    upto = None if max_rows is None else 4 * range_bytes
    while True:
        ranges, total = csv_ranges(spark, path, range_bytes, upto)
        counted = written(count_ranges(ranges), "csv-ranges")
        if upto is None or upto >= total:
            break
        held = counted.agg(F.max(F.col("first_row") + F.col("records") - F.when(F.col("start") == 0, 1).otherwise(0))).first()[0]
        if (held or 0) >= max_rows:
            break
        upto *= 4
    if max_rows is not None:
        counted = counted.where(F.col("first_row") < max_rows)
    schema = ", ".join([*(f"`{c}` string" for c in columns), "row_idx long"])
    return dealt(counted.where("records > 0")).mapInArrow(_parser(list(columns), None if max_rows is None else max(max_rows, 0)), schema)
