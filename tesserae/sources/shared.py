"""Storage that the driver and every executor see: small tables that cut lineage, and folders moved into place."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set, local mode makes its own and a cluster raises."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tesserae/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: it is made once and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def child(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def path_of(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def files(self) -> list[tuple[str, int]]:
        """(path, bytes) of the files below, by path; names that begin with _ or . are left out."""
        status = self.fs.getFileStatus(self.path)
        if status.isFile():
            return [(status.getPath().toString(), status.getLen())]
        found, it = [], self.fs.listFiles(self.path, True)
        while it.hasNext():
            s = it.next()
            below = s.getPath().toString().removeprefix(status.getPath().toString())
            if not any(part[:1] in ("_", ".") for part in below.split(os.sep)):
                found.append((s.getPath().toString(), s.getLen()))
        return sorted(found)

    def move(self, source, target) -> None:
        """Rename, or raise: a rename that only returns false must not lose a file."""
        if not self.fs.rename(source, target):
            raise OSError(f"cannot move {source} to {target}")

    def delete(self, path=None) -> None:
        self.fs.delete(path or self.path, True)
