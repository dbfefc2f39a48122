"""Composition of tiles on a raster's canvas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import exprs as X


def project(px: DataFrame, tilings: DataFrame, order: Sequence[str] = ("x_off", "y_off"), value: str = "value") -> DataFrame:
    """raster_name, y, x, value on the raster: a tile pixel lands at its offset plus its place; what falls outside
    is clipped; of several tiles the last in order wins."""
    placed = px.join(tilings.select("raster_name", "width", "height"), "raster_name").select("raster_name", (F.col("y_off") + F.col("y")).alias("y"), (F.col("x_off") + F.col("x")).alias("x"), "width", "height", F.struct(*order).alias("_order"), value)
    inside = placed.where("y between 0 and height - 1 and x between 0 and width - 1")
    return inside.groupBy("raster_name", "y", "x").agg(F.max_by(value, "_order").alias(value))


def project_affine(px: DataFrame, matrix: str = "matrix") -> DataFrame:
    """px with raster_x, raster_y: the tile-to-raster matrix applied, cut to whole pixels."""
    m = F.col(matrix)
    return px.withColumns({"raster_x": (m["a"] * F.col("x") + m["b"] * F.col("y") + m["c"]).cast("int"), "raster_y": (m["d"] * F.col("x") + m["e"] * F.col("y") + m["f"]).cast("int")})


def project_by_matrix(px: DataFrame, matrices: DataFrame, tilings: DataFrame, tile: Sequence[str] = ("x_off", "y_off"), value: str = "value") -> DataFrame:
    """raster_name, y, x, value: project with a tile-to-raster matrix of each tile instead of its offset.

    matrices: raster_name, tile, matrix. Several tile pixels may land on one
    raster pixel and several tiles may meet there; the last tile in order
    wins, and of its pixels the last by row and column.
    """
    placed = project_affine(px.join(matrices.select("raster_name", *tile, "matrix"), ["raster_name", *tile])).join(tilings.select("raster_name", "width", "height"), "raster_name")
    inside = placed.where("raster_y between 0 and height - 1 and raster_x between 0 and width - 1")
    return inside.groupBy("raster_name", F.col("raster_y").alias("y"), F.col("raster_x").alias("x")).agg(F.max_by(value, F.struct(*tile, "y", "x")).alias(value))


def mercator_windows(tiles: DataFrame, rasters: DataFrame) -> DataFrame:
    """tiles (raster_name, z, x, y) with x_off, y_off, src_w, src_h: the whole pixels of a raster in EPSG:4326 that a mercator tile covers.

    rasters: raster_name, transform, width, height. Tiles that do not lie inside
    their raster, or reach its last row or column, are left out, as in tiles_within.
    """
    sized = tiles.join(rasters.select("raster_name", X.inverse("transform").alias("_inv"), "width", "height"), "raster_name")
    at = lambda dx, dy: (X.apply_x("_inv", X.tile_west(F.col("x") + dx, "z"), X.tile_north(F.col("y") + dy, "z")), X.apply_y("_inv", X.tile_west(F.col("x") + dx, "z"), X.tile_north(F.col("y") + dy, "z")))
    (left, top), (right, bottom) = at(0, 0), at(1, 1)
    placed = sized.withColumns({"x_off": X.trunc(left), "y_off": X.trunc(top), "src_w": X.trunc(right - left), "src_h": X.trunc(bottom - top), "_l": left, "_t": top})
    inside = "_l >= 0 and _t >= 0 and src_w > 0 and src_h > 0 and x_off + src_w < width and y_off + src_h < height"
    return placed.where(inside).select(*tiles.columns, "x_off", "y_off", "src_w", "src_h")


def project_mercator(px: DataFrame, rasters: DataFrame, disk: int, value: str = "value") -> DataFrame:
    """raster_name, y, x, value: mercator tiles of disk x disk pixels (raster_name, z, x, y, row, col, value) back on their rasters.

    A tile is brought to its window by nearest neighbour, so labels stay
    labels; where tiles meet, the last by x and y wins. See mercator_windows.
    """
    windows = mercator_windows(px.select("raster_name", "z", "x", "y").distinct(), rasters)

    def targets(at: str, size: str):
        """All d of the window with floor(d disk / size) = at."""
        first, last = F.ceil(F.col(at) * F.col(size) / disk).cast("int"), (F.ceil((F.col(at) + 1) * F.col(size) / disk) - 1).cast("int")
        return F.filter(F.sequence(first, F.greatest(first, last)), lambda d: (d <= last) & (d < F.col(size)))

    spread = px.join(windows, ["raster_name", "z", "x", "y"]).withColumn("_ty", F.explode(targets("row", "src_h"))).withColumn("_tx", F.explode(targets("col", "src_w")))
    return spread.groupBy("raster_name", (F.col("y_off") + F.col("_ty")).alias("y"), (F.col("x_off") + F.col("_tx")).alias("x")).agg(F.max_by(value, F.struct("z", F.col("x").alias("tx"), F.col("y").alias("ty"))).alias(value))


def tiles_within(tiles: DataFrame) -> DataFrame:
    """The tiles that lie inside their raster, whose width and height they carry, and do not reach its last row or column."""
    return tiles.where("x_off >= 0 and y_off >= 0 and x_off + src_w < width and y_off + src_h < height")


def project_polygons(px: DataFrame, size: tuple[int, int], width: int, height: int, value: str = "value") -> DataFrame:
    """raster_name, y, x, value: tiles composed by way of their regions' polygons.

    The regions of each value become polygons in raster pixels, which are burnt
    again; of several values the largest palette index wins, the background 0 never.
    """
    from tessella.operators import vector

    key = ["raster_name", "x_off", "y_off"]
    found = vector.vectorize(px.select(*key, "y", "x", value), key, *size, value=value)
    placed = found.withColumn("rings", vector.moved_rings("rings", F.col("x_off"), F.col("y_off"))).withColumn("feature_id", F.struct("x_off", "y_off", "part"))
    return vector.rasterize(placed.select("raster_name", "feature_id", "rings", value), width, height, value, ["raster_name"])


def overlay(raster: DataFrame, layer: DataFrame, pixel: Sequence[str], channels: Sequence[str] = ("r", "g", "b"), weight: int = 192) -> DataFrame:
    """raster with alpha 255, replaced by the layer (alpha weight) where that is not black."""
    top = layer.where(" or ".join(f"{c} <> 0" for c in channels)).select(*pixel, *[F.col(c).alias(f"_{c}") for c in channels])
    joined = raster.join(top, list(pixel), "left")
    return joined.select(*pixel, *[F.coalesce(f"_{c}", c).alias(c) for c in channels], F.when(F.col(f"_{channels[0]}").isNull(), 255).otherwise(weight).alias("a"))


def grid_canvas(tiles: DataFrame, tilings: DataFrame) -> DataFrame:
    """raster_name, y, x of the one-pixel frames of all tiles, clipped to their rasters."""
    from tessella.operators.tiling import border_pixels

    frames = border_pixels(tiles).select("raster_name", (F.col("y_off") + F.col("y")).alias("y"), (F.col("x_off") + F.col("x")).alias("x"))
    return frames.join(tilings.select("raster_name", "width", "height"), "raster_name").where("y between 0 and height - 1 and x between 0 and width - 1").select("raster_name", "y", "x").distinct()
