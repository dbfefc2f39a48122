"""Synthetic predictions from labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 50


def frame(px: DataFrame, size: tuple[int, int], stride: tuple[int, int], index: int, width: int = 5, value: str = "value") -> DataFrame:
    """px with the frame of the reliable window (half a stride, cut, around the centre) set to index."""

    def inside(at: str, n: int, s: int, less: int) -> Column:
        half = int(s / 2) - less
        return (F.col(at) >= n // 2 - half) & (F.col(at) < n // 2 + half)

    outer = inside("x", size[0], stride[0], 0) & inside("y", size[1], stride[1], 0)
    inner = inside("x", size[0], stride[0], width) & inside("y", size[1], stride[1], width)
    return px.withColumn(value, F.when(outer & ~inner, index).otherwise(F.col(value)))


def pattern(kind: str, height: int) -> Column:
    """0 or 1 at (y, x): stripes of PERIOD pixels."""
    down = F.pmod(F.col("y"), F.lit(PERIOD))
    up = F.pmod(F.pmod(F.lit(height) - F.col("y"), F.lit(height)), F.lit(PERIOD))
    v = {"horizontal": down, "vertical": F.col("x"), "diagonal_1": down + F.col("x"), "diagonal_2": up + F.col("x")}[kind]
    return F.rint(F.pmod(v, F.lit(PERIOD)) / PERIOD - 0.25).cast("int")


def knock_out(px: DataFrame, height: int, value: str = "value") -> DataFrame:
    """px with 0 where two patterns differ. The first changes with each new x_off of a raster, the second
    whenever y_off changes along the tiles sorted by (x_off, y_off)."""
    tiles = px.select("raster_name", "x_off", "y_off").distinct()
    order = Window.partitionBy("raster_name").orderBy("x_off", "y_off")
    changed = F.when(F.col("y_off").eqNullSafe(F.lag("y_off").over(order)), 0).otherwise(1)
    tiles = tiles.withColumn("_x", F.pmod(F.dense_rank().over(Window.partitionBy("raster_name").orderBy("x_off")) - 1, F.lit(2))).withColumn("_c", changed)
    tiles = tiles.withColumn("_y", F.pmod(F.sum("_c").over(order) - 1, F.lit(2))).drop("_c")
    first = F.when(F.col("_x") == 0, pattern("horizontal", height)).otherwise(pattern("vertical", height))
    second = F.when(F.col("_y") == 0, pattern("diagonal_1", height)).otherwise(pattern("diagonal_2", height))
    return px.join(tiles, ["raster_name", "x_off", "y_off"]).withColumn(value, F.when(first != second, 0).otherwise(F.col(value))).drop("_x", "_y")
