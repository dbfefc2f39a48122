"""Runs that make only what is not there yet.

What is made stands in a folder for each run; a manifest, written after it,
names the keys and their run. A run that ended early has no entry there: its
folder is not read, and its keys are made again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST, MADE = "manifest", "made"


def _is_there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The keys that are made, with their run."""
    whole = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
    if not _is_there(spark, f"{path}/{MANIFEST}"):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(f"{path}/{MANIFEST}")


def missing(plan: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """The planned keys, each once, that no finished run has made; keys are joined, none comes to the driver."""
    wanted = plan.select(*keys).distinct()
    return wanted.join(manifest(plan.sparkSession, path, wanted.schema), list(keys), "left_anti")


def run(plan: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, keys: Sequence[str], again: bool = False) -> str | None:
    """Makes what is missing below path and gives the run's name, None if nothing was missing.

    make gets the missing keys and gives rows that hold them; keys of which it
    gives no row count as made. again: makes all planned keys anew; the latest
    run of a key is the one that is read. Keys may not be null.
    """
    spark = plan.sparkSession
    name = uuid.uuid4().hex
    wanted = plan.select(*keys).distinct() if again else missing(plan, path, keys)
    # The keys of this run are fixed before anything is made.
    asked = f"{path}/asked/run={name}"
    wanted.write.parquet(asked)
    todo = spark.read.schema(wanted.schema).parquet(asked)
    if todo.isEmpty():
        return None
    # By run, so that a repeated write of this run replaces its own rows only.
    made = make(todo).withColumn("run", F.lit(name))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/{MADE}")
    order = spark.createDataFrame([], "run string") if not _is_there(spark, f"{path}/{MANIFEST}") else spark.read.parquet(f"{path}/{MANIFEST}").select("run").distinct()
    # Names of runs begin with their number, so the latest one is the greatest.
    number = order.count()
    todo.withColumn("run", F.lit(f"{number:08d}-{name}")).coalesce(max(1, spark.sparkContext.defaultParallelism)).write.mode("append").parquet(f"{path}/{MANIFEST}")
    return name


def made(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """What finished runs have made, of each key the latest run's rows, with run; only folders of finished runs are read."""
    rows = spark.read.option("mergeSchema", "false").parquet(f"{path}/{MADE}")
    latest = spark.read.parquet(f"{path}/{MANIFEST}").groupBy(*keys).agg(F.max("run").alias("run")).withColumn("run", F.substring_index("run", "-", -1))
    return rows.join(latest, [*keys, "run"], "left_semi")
