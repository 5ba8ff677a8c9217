"""Scratch space on shared storage: tables that are used more than once are written there, and removed again."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only where that is unset and Spark runs in this process alone, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lexweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def even_tasks(spark: SparkSession) -> int:
    """How many tasks a pass over rows is dealt out to that holds no more than a few rows at a time: some for each core, whatever the size of the rows."""
    return 4 * spark.sparkContext.defaultParallelism


class _Written(threading.local):
    """Folders that this thread's calls of materialize() wrote and that are not yet removed, in order."""

    def __init__(self):
        self.paths: list[str] = []


_WRITTEN = _Written()


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back. This cuts the lineage, so that a lost
    executor costs no recomputation and every reader sees the same rows. The folder is removed by release(), and else when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lexweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    _WRITTEN.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    return len(_WRITTEN.paths)


def release(spark: SparkSession, since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Remove the folders written since then, but for those that the tables to keep are read from."""
    kept = {f.rsplit("/", 2)[-2] for df in keep for f in df.inputFiles()}
    for path in _WRITTEN.paths[since:]:
        if path.rsplit("/", 1)[-1] not in kept:
            files, at = _file_system(spark, path)
            files.delete(at, True)
            _WRITTEN.paths.remove(path)
