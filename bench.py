"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tesserae.queries import QUERIES

HEADLINE = (
    "rvq1d_encode", "rvq1d_decode_error", "rvq1d_encode_256", "rvq3d_encode_256", "scale_stats", "centered_positions", "morton_codebook", "rvq3d_encode", "token_ids", "token_text", "token_stats",
    "decode_tokens", "roundtrip_error", "recon_report", "parse_defaults", "wordlevel_ids", "md5_sample", "train_val_split", "shard_sizes", "s2ef_metrics", "task_summary",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().write.format("noop").mode("overwrite").save()  # start-up is not a query
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
