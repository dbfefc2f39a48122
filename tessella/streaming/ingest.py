"""Tiles that arrive one file after another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.pixels import append_max


def tile_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def ingest_max(stream: DataFrame, out: str, checkpoint: str, pixel: Sequence[str], value: str = "value", layers: int = 16) -> StreamingQuery:
    """Writes each batch, merged in itself, as a layer of out; read_layers merges the layers.

    The maximum does not depend on order and repeats, so a batch that runs
    again after a failure replaces its own layer and changes nothing. Layers
    go to `layers` hash folders by pixel, so that reading merges folder by
    folder in parallel.
    """

    def merge(batch: DataFrame, number: int) -> None:
        merged = append_max(batch, pixel=pixel, value=value).withColumn("bucket", F.pmod(F.xxhash64(*pixel), F.lit(layers)))
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/layer={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_layers(spark: SparkSession, out: str, pixel: Sequence[str], value: str = "value") -> DataFrame:
    return append_max(spark.read.parquet(out), pixel=pixel, value=value)


def stream_max(stream: DataFrame, pixel: Sequence[str], value: str = "value") -> DataFrame:
    """The same merge as a streaming aggregation, for sinks that take updates."""
    return stream.groupBy(*pixel).agg(F.max(value).alias(value))
