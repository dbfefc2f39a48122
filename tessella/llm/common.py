"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as the inside of a regular-expression class.
SPACES = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares (spark.checkpoint.dir).

    Only a local master may do without that setting: there the driver and the
    executors are one process, and a temporary folder is set in its stead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; a cluster needs a shared folder")
        if "[" in spark.sparkContext.master and "local-cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir is not set; executors need a shared folder")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessella-{uuid.uuid4().hex}"


def persist(df: DataFrame, codec: str = "zstd", narrow: bool = False) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    narrow: for tables of a few numbers a row, at most one file for each core,
    as many shuffle partitions would only mean many tiny files.

    Cuts the lineage, survives the loss of any executor, and gives the planner
    the true size of what follows (a small table is then broadcast, a large one
    is not).
    """
    path = shared_dir(df.sparkSession)
    if narrow:
        df = df.coalesce(max(2, df.sparkSession.sparkContext.defaultParallelism))
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds the Arrow batches sent to Python: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; all other characters stay. Plain ASCII takes the short way."""
    plain = F.length(col) == F.octet_length(col)
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))
