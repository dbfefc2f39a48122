"""Tables between the steps of a job, written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What opening a file counts as in bytes where many small files are read.
OPEN_BYTES = 64 << 10

#: Folders written since the outermost `scratch` began; None outside of one.
_written: list[str] | None = None


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local master may do without that setting; a temporary folder is set in its stead."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "local-cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir is not set; executors need a shared folder")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"


def staged(df: DataFrame, narrow: bool = False) -> DataFrame:
    """df written as Parquet and read back: its lineage is cut, and the planner knows its size.

    narrow: for a few numbers a row, at most one file for each core.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    if narrow:
        df = df.coalesce(max(2, spark.sparkContext.defaultParallelism))
    df.write.parquet(path)
    if _written is not None:
        _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Deletes what `staged` wrote for df, which nothing may read from then on."""
    delete(df.sparkSession, df.staged_at)


@contextmanager
def many_small_files(spark: SparkSession) -> Iterator[None]:
    """Reads that start within it take a few hundred small files a task; by Spark's default opening one counts as 4 MB, so tasks get a few files each.

    The number of tasks is settled when a read runs, so what is read is to be staged within it.
    """
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was staged within it: results are to be written inside."""
    global _written
    outer, _written = _written, []
    try:
        yield
    finally:
        mine, _written = _written, outer
        for path in mine:
            delete(spark, path)
