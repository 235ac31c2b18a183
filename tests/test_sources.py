"""CSV ranges and shard files."""

from __future__ import annotations

import csv
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_operators import FIXED_BOOKS, FIXED_SCALES, SPACE, molecules

from tesserae.operators import molecule, vocab
from tesserae.plans import pipelines
from tesserae.sources import csv_ranges as csv_ranges_module
from tesserae.sources import files
from tesserae.sources.csv_ranges import count_ranges, csv_ranges, read_csv_rows


def write(path, rows, head, ending="\n", last=True):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=ending)
        w.writerow(head)
        w.writerows(rows)
        if not last:
            f.seek(0, os.SEEK_END)
            f.truncate(f.tell() - len(ending))


def odd_rows(n, seed):
    rng = random.Random(seed)
    field = lambda: "".join(rng.choice(['"', "\n", ",", "a", "é", "b c", "\r\n", "'"]) for _ in range(rng.randrange(1, 9)))
    return [[f"k{seed}-{i}", field(), "" if rng.random() < 0.2 else field()] for i in range(n)]


@pytest.mark.parametrize("size", [3, 17, 64, 1 << 20])
def test_csv_ranges_give_file_order_whatever_their_size(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(csv_ranges_module, "MOST_TASKS", 16)  # several ranges to a task
    want, heads = [], (["key", "a", "b"], ["b", "key", "a"], ["key", "a", "b"])
    for k, (head, ending, last) in enumerate(zip(heads, ("\n", "\r\n", "\n"), (True, True, False), strict=True)):
        rows = odd_rows(12, k)
        write(tmp_path / f"{k}.csv", [[dict(zip(("key", "a", "b"), r, strict=True))[c] for c in head] for r in rows], head, ending, last)
        want += rows
    (tmp_path / "3.csv").write_text("key,a,b\n")  # a header alone
    (tmp_path / "4.csv").write_text("")
    (tmp_path / "_hidden").write_text("key,a,b\nx,y,z\n")
    got = read_csv_rows(spark, str(tmp_path), ["key", "a", "b", "none"], range_bytes=size).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in got] == list(range(36)) and {r["none"] for r in got} == {None}
    assert [[r["key"], r["a"], r["b"] or ""] for r in got] == want
    for n in (0, 1, 13, 24, 99):
        first = read_csv_rows(spark, str(tmp_path), ["key"], max_rows=n, range_bytes=size).collect()
        assert sorted(r["row_idx"] for r in first) == list(range(min(n, 36))) and {r["key"] for r in first} == {w[0] for w in want[:n]}


def test_a_row_limit_stops_reading(spark, tmp_path):
    for k in range(40):
        write(tmp_path / f"{k:02}.csv", [[str(i), "x" * 50] for i in range(20)], ["key", "text"])
    ranges, total = csv_ranges(spark, str(tmp_path), 256, upto=4 * 256)
    assert ranges.count() * 10 < csv_ranges(spark, str(tmp_path), 256)[0].count() and total > 40_000
    os.remove(tmp_path / "39.csv")
    (tmp_path / "39.csv").write_bytes(b"\xff\xfe broken, not read")
    assert read_csv_rows(spark, str(tmp_path), ["key"], max_rows=30, range_bytes=256).count() == 30
    state = count_ranges(csv_ranges(spark, str(tmp_path / "00.csv"), 100)[0]).orderBy("start").collect()
    assert sum(r["records"] for r in state) == 21 and [r["first_row"] for r in state] == [sum(s["records"] for s in state[:i]) - (i > 0) for i in range(len(state))]


def test_ranges_are_parsed_by_many_tasks(spark, tmp_path):
    for k in range(4):
        write(tmp_path / f"{k}.csv", [[str(i), "x" * 50] for i in range(200)], ["key", "text"])
    rows = read_csv_rows(spark, str(tmp_path), ["key"], range_bytes=2048)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(sizes) >= 20 and sum(sizes) == 800 and max(sizes) < 80


def test_no_files_and_blank_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert read_csv_rows(spark, str(tmp_path / "in"), ["a"]).count() == 0
    (tmp_path / "in" / "a.csv").write_text('a,b\n\n1,2\n\r\n"",4\n,5\n\n')
    assert [(r["a"], r["b"], r["row_idx"]) for r in read_csv_rows(spark, str(tmp_path / "in"), ["a", "b"], range_bytes=2).orderBy("row_idx").collect()] == [("1", "2", 0), ("", "4", 1), (None, "5", 2)]


# Shards


def shard_files(path):
    return {f: pq.read_metadata(f"{path}/data/{f}").num_rows for f in os.listdir(f"{path}/data") if f.endswith(".parquet")}


def test_published_files_have_names_and_sizes(spark, tmp_path):
    source = molecules(spark, [1 + k % 3 for k in range(60)])
    seen = pipelines.publish(source, FIXED_BOOKS, FIXED_SCALES, str(tmp_path / "out"), val_size=13, shard_size=10)
    assert shard_files(tmp_path / "out") == {**{f"train-{k:05d}.parquet": 10 for k in range(4)}, "train-00004.parquet": 7, "validation-00000.parquet": 10, "validation-00001.parquet": 3}
    tokens = molecule.tokenize(source, FIXED_BOOKS, FIXED_SCALES)
    texts = [r["text"] for r in tokens.select(vocab.tokens_to_text(F.col("tokens"), SPACE).alias("text")).collect()]
    out = spark.read.parquet(str(tmp_path / "out/data"))
    assert out.columns == ["text"] and sorted(r["text"] for r in out.collect()) == sorted(texts)
    assert seen == {"rows": 60, "tokens": sum(len(r["tokens"]) for r in tokens.collect()), "validation": 13}
    assert [f for f in os.listdir(tmp_path / "out") if not f.startswith(".")] == ["data"]
    pipelines.publish(source.limit(0), FIXED_BOOKS, FIXED_SCALES, str(tmp_path / "none"), val_size=3, shard_size=2)
    assert shard_files(tmp_path / "none") == {}


def test_one_task_writes_one_shard_and_a_failed_one_leaves_nothing(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("n"), F.lit("train").alias("split"), (F.col("id") % 50).alias("shard"))
    assert files.write_shards(rows, str(tmp_path)) == [f"train-{k:05d}.parquet" for k in range(50)]
    assert set(shard_files(tmp_path).values()) == {20}
    for k in (0, 49):
        assert {n % 50 for n in pq.read_table(tmp_path / f"data/train-{k:05d}.parquet").column("n").to_pylist()} == {k}
    broken = rows.withColumn("n", F.when(F.col("n") == 777, F.raise_error(F.lit("broken row")).cast("long")).otherwise(F.col("n") + 1))
    with pytest.raises(Exception, match="broken row"):
        files.write_shards(broken, str(tmp_path), {"train": 50})
    with pytest.raises(Exception, match="no shard"):
        files.write_shards(rows, str(tmp_path), {"train": 49})
    assert len(shard_files(tmp_path)) == 50 and 0 in pq.read_table(tmp_path / "data/train-00000.parquet").column("n").to_pylist()
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["data"]


def test_many_shards_share_tasks(spark, tmp_path):
    """300 shards are written by a handful of tasks, each whole and by its name."""
    rows = spark.range(1500).select(F.col("id").alias("text"), F.lit("train").alias("split"), F.floor(F.col("id") / 5).cast("long").alias("shard"))
    group = f"shards-{tmp_path.name}"
    spark.sparkContext.setJobGroup(group, group)
    names = files.write_shards(rows, str(tmp_path), {"train": 300})
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    assert max(tasks) < 50
    assert names == [f"train-{k:05d}.parquet" for k in range(300)]
    back = spark.read.parquet(f"{tmp_path}/data").select("text", F.col("_metadata.file_name").alias("f")).collect()
    assert len(back) == 1500 and all(r["f"] == f"train-{r['text'] // 5:05d}.parquet" for r in back)


def test_shard_files_are_not_listed_or_moved_one_by_one(spark, tmp_path, monkeypatch):
    """Tasks write files by their final names; a shard of several row groups, and one of two attempts, is whole."""
    moved, listed = [], []
    move, found = files.Folder.move, files.Folder.files
    monkeypatch.setattr(files.Folder, "move", lambda self, a, b: moved.append(b) or move(self, a, b))
    monkeypatch.setattr(files.Folder, "files", lambda self: listed.append(self) or found(self))
    rows = spark.range(3000).select(F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") < 90, "val").otherwise("train").alias("split"), F.floor(F.col("id") / 30).alias("shard"))
    names = files.write_shards(rows, str(tmp_path / "out"), {"train": 100, "val": 3})
    assert names == [f"train-{k:05d}.parquet" for k in range(3, 100)] + [f"validation-{k:05d}.parquet" for k in range(3)]
    assert len(moved) == 1 and not listed
    assert set(shard_files(tmp_path / "out").values()) == {30} and os.listdir(tmp_path / "out/data") and not [f for f in os.listdir(tmp_path / "out") if f.startswith("_")]
    monkeypatch.setattr(files, "GROUP_BYTES", 64)
    (tmp_path / "a/data").mkdir(parents=True)
    (tmp_path / "a/tasks").mkdir()
    batch = lambda at, n: pa.RecordBatch.from_arrays([pa.array([f"{k}" * 20 for k in range(n)]), pa.array([at] * n, pa.int32())], ["text", "shard_number"])
    for _ in range(2):
        write = files._shard_writer(f"file:{tmp_path}", "a", [(0, "train"), (5, "validation")])
        assert [n for b in write(iter([batch(4, 9), batch(4, 9), batch(5, 3), batch(5, 0)])) for n in b.column("file").to_pylist()] == ["train-00004.parquet", "validation-00000.parquet"]
    assert shard_files(tmp_path / "a") == {"train-00004.parquet": 18, "validation-00000.parquet": 3} and os.listdir(tmp_path / "a/tasks") == []


def test_stores_that_arrow_cannot_open_get_their_shards_from_spark(spark, tmp_path, monkeypatch):
    rows = spark.range(50).select(F.col("id").alias("n"), F.lit("train").alias("split"), (F.col("id") % 5).alias("shard"))
    assert not files._arrow_opens("viewfs://store/x")
    monkeypatch.setattr(files, "_arrow_opens", lambda uri: False)
    assert files.write_shards(rows, str(tmp_path)) == [f"train-{k:05d}.parquet" for k in range(5)]
    assert set(shard_files(tmp_path).values()) == {10}
