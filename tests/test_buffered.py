"""The sampler of bounded shuffle buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tesserae.sources import buffered as bf


def by_hand(rows, buffer, rng):
    """The buffer row by row, drawing as many numbers at once as a batch brings."""
    held, out = rows[:buffer], []
    for lo in range(buffer, len(rows), buffer):
        part = rows[lo : lo + buffer]
        for x, j in zip(part, rng.integers(0, buffer, len(part)).tolist(), strict=True):
            out.append(held[j])
            held[j] = x
    return out + [held[i] for i in rng.permutation(len(held))]


def files_of(path, sizes, group):
    at = 0
    for k, n in enumerate(sizes):
        own = pa.table({"id": pa.array(range(at, at + n), pa.int64()), "text": [f"t{i}" for i in range(at, at + n)], "list": [[float(i)] * (i % 3) for i in range(at, at + n)]})
        pq.write_table(own, path / f"{k:03}.parquet", row_group_size=group)
        at += n
    return at


@pytest.mark.parametrize(("n", "buffer"), [(0, 10), (1, 1), (57, 10), (300, 25), (10_000, 10)])
def test_samples_equal_the_buffer_by_hand(spark, tmp_path, n, buffer):
    total = files_of(tmp_path, [130, 0, 61, 200, 9], 64)
    got = bf.buffered_sample(spark, str(tmp_path), n, ["id", "list"], 3, buffer).collect()
    shares = bf.chosen_groups(spark, str(tmp_path), n, 3, buffer).collect()
    want = []
    for r in shares:
        own = pq.ParquetFile(r["file"].removeprefix("file:")).read_row_group(r["row_group"], columns=["id"])["id"].to_pylist()
        want += by_hand(own, buffer, bf.group_rng(3, r["file_no"], r["row_group"]))[: r["share"]]
    assert sorted(r["id"] for r in got) == sorted(want) and len(set(want)) == len(want) == min(n, total)
    assert all(r["list"] == [float(r["id"])] * (r["id"] % 3) for r in got)


def test_a_sample_reads_few_row_groups_in_several_tasks(spark, tmp_path):
    total = files_of(tmp_path, [400] * 40, 50)
    shares = bf.chosen_groups(spark, str(tmp_path), 500, 1, 100).collect()
    assert 600 <= sum(r["rows"] for r in shares) < 700 < total and sum(r["share"] for r in shares) == 500
    sample = bf.buffered_sample(spark, str(tmp_path), 500, None, 1, 100)
    assert sample.columns == ["id", "text", "list"]
    rows = sample.withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in rows}) > 4
    again = bf.buffered_sample(spark, str(tmp_path), 500, ["id"], 1, 100)
    assert sorted(r["id"] for r in again.collect()) == sorted(r["id"] for r in rows)
    other = bf.buffered_sample(spark, str(tmp_path), 500, ["id"], 2, 100)
    assert sorted(r["id"] for r in other.collect()) != sorted(r["id"] for r in rows)


def test_a_buffer_draws_evenly():
    """Rows of a stream that fits the buffer come out in an even order: chi-square over 16 places of 16 rows, 4,000 streams."""
    seen = np.zeros((16, 16))
    for s in range(4000):
        (out,) = bf.buffered(iter([pa.table({"x": range(16)})]), 20, np.random.default_rng(s))
        seen[np.arange(16), out["x"].to_numpy()] += 1
    assert ((seen - 250) ** 2 / 250).sum() < 225 + 4 * np.sqrt(2 * 225)


def test_no_files(spark, tmp_path):
    spark.createDataFrame([], "id long").write.parquet(str(tmp_path / "none"))
    assert bf.buffered_sample(spark, str(tmp_path / "none"), 5).collect() == []


def test_the_sampler_job_writes_the_samples_columns(spark, tmp_path):
    from tesserae.plans import pipelines
    from tesserae.sources import files

    rows = spark.range(300).select(F.col("id").cast("string").alias("property_id"), F.array(F.lit(1), F.lit(8)).alias("atomic_numbers"), F.col("id").cast("double").alias("energy"), F.lit("x").alias("other"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    pipelines.stream_sample_to_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), n=40, seed=2, buffer=16)
    back = files.read_molecule_csv(spark, str(tmp_path / "out")).collect()
    assert len({r["property_id"] for r in back}) == len(back) == 40
    assert all(r["energy"] == float(r["property_id"]) and r["atomic_numbers"] == [1, 8] for r in back)
