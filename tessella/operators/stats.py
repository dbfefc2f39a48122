"""Statistics of tilings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("real_world_extent", "source_width", "source_height", "width_ratio", "height_ratio")


def tile_metrics(tiles: DataFrame, disk_w: int, disk_h: int) -> DataFrame:
    """raster_name and the five metrics of each tile, which carries its raster's transform: extent in metres (mean of both sides), source size, disk pixels a source pixel."""
    w, h = F.col("src_w"), F.col("src_h")
    extent = (w * F.sqrt(F.col("transform.a") ** 2 + F.col("transform.d") ** 2) + h * F.sqrt(F.col("transform.b") ** 2 + F.col("transform.e") ** 2)) / 2
    return tiles.select("raster_name", extent.alias("real_world_extent"), w.cast("double").alias("source_width"), h.cast("double").alias("source_height"), (disk_w / w).alias("width_ratio"), (disk_h / h).alias("height_ratio"))


def _summaries() -> list:
    return [f(m).alias(f"{m}_{n}") for m in METRICS for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]


def tiling_statistics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("raster_name").agg(F.count(F.lit(1)).alias("n_tiles"), *_summaries())


def tiling_statistics_rollup(metrics: DataFrame) -> DataFrame:
    """A row for each raster and one (raster_name null) over all tiles' values together."""
    return metrics.rollup("raster_name").agg(F.count(F.lit(1)).alias("n_tiles"), *_summaries())
