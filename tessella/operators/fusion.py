"""Fusion of overlapping tile predictions: base tiles take the reliable middle of aux tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import exprs as X
from tessella.operators.spatial import overlap_join, tile_boxes

TILE = ["raster_name", "x_off", "y_off"]


def base_and_aux(tiles: DataFrame, tilings: DataFrame) -> DataFrame:
    """tiles with is_base; base tiles that are not inside their raster are dropped.

    tilings, a row for each raster: raster_name, width, height, origin_x,
    origin_y, stride_x, stride_y. Base tiles lie on a grid from the origin
    whose stride is the multiple of the tiles' stride nearest to their size;
    a pixel of rounding is allowed, a remainder between that and 16 is an error.
    """
    t = tiles.join(tilings.select("raster_name", "width", "height", "origin_x", "origin_y", "stride_x", "stride_y"), "raster_name")

    def remainder(off: str, origin: str, size: str, stride: str):
        step = F.col(stride) * F.rint(F.col(size) / F.col(stride))
        rel = F.col(off) - F.col(origin)
        return rel - F.rint(rel / step) * step

    rx, ry = F.abs(remainder("x_off", "origin_x", "src_w", "stride_x")), F.abs(remainder("y_off", "origin_y", "src_h", "stride_y"))
    odd = ((rx > 1) & (rx < 16) & (F.col("stride_x") >= 16)) | ((ry > 1) & (ry < 16) & (F.col("stride_y") >= 16))
    is_base = F.when(odd, F.raise_error(F.concat(F.lit("tile off the grid in "), "raster_name")).cast("boolean")).otherwise((rx <= 1) & (ry <= 1))
    inside = (F.col("x_off") >= 0) & (F.col("y_off") >= 0) & (X.end_coord("x_off", "src_w") < F.col("width")) & (X.end_coord("y_off", "src_h") < F.col("height"))
    return t.withColumns({"is_base": is_base, "_inside": inside}).where(~F.col("is_base") | F.col("_inside")).select(*tiles.columns, "is_base")


def overlapping_pairs(classified: DataFrame, cell: tuple[float, float]) -> DataFrame:
    """raster_name, x_off, y_off of base tiles with aux_x, aux_y of each aux tile that meets them."""
    boxes = tile_boxes(classified)
    base = boxes.where("is_base").select(*TILE, "x0", "y0", "x1", "y1")
    aux = boxes.where("not is_base").select("raster_name", F.col("x_off").alias("aux_x"), F.col("y_off").alias("aux_y"), "x0", "y0", "x1", "y1")
    return overlap_join(base, aux, ["raster_name"], cell).select(*TILE, "aux_x", "aux_y")


def fuse(px: DataFrame, tilings: DataFrame, size: tuple[int, int], stride: tuple[float, float], value: str = "value", disk: tuple[int, int] | None = None, enabled: bool = True) -> DataFrame:
    """Pixels (raster_name, x_off, y_off, y, x, value) of the base tiles, fused.

    px: raster_name, x_off, y_off, src_w, src_h, y, x, value. A base pixel takes
    the value of the aux tile that shows it within half a stride of its centre;
    of several the last in the order (aux x_off, y_off) wins. All base tiles
    come out, also those that nothing changes. With enabled=False these are
    the base tiles as they are.
    """
    (w, h), (dw, dh) = size, disk or size
    tiles = px.select(*TILE, "src_w", "src_h").distinct()
    classified = base_and_aux(tiles, tilings)
    base = px.join(classified.where("is_base").select(*TILE), TILE, "left_semi").select(*TILE, "y", "x", value)
    if not enabled:
        return base
    half_x, half_y = (int(-(-s * d // (2 * n))) for s, d, n in ((stride[0], dw, w), (stride[1], dh, h)))
    cx, cy = dw // 2, dh // 2
    middle = px.where((F.col("x") >= cx - half_x) & (F.col("x") < cx + half_x) & (F.col("y") >= cy - half_y) & (F.col("y") < cy + half_y))
    middle = middle.select("raster_name", F.col("x_off").alias("aux_x"), F.col("y_off").alias("aux_y"), F.col("y").alias("ay"), F.col("x").alias("ax"), F.col(value).alias("_new"))
    pairs = overlapping_pairs(classified, (float(w), float(h)))
    moved = pairs.join(middle, ["raster_name", "aux_x", "aux_y"])
    at_x, at_y = F.col("ax") + X.disk_shift("aux_x", "x_off", F.lit(dw), F.lit(w)), F.col("ay") + X.disk_shift("aux_y", "y_off", F.lit(dh), F.lit(h))
    moved = moved.select(*TILE, at_y.alias("y"), at_x.alias("x"), F.struct("aux_x", "aux_y").alias("_order"), "_new")
    moved = moved.where(F.col("x").between(0, dw - 1) & F.col("y").between(0, dh - 1))
    both = base.withColumns({"_order": F.lit(None).cast("struct<aux_x:int,aux_y:int>"), "_new": F.lit(None).cast("int")}).unionByName(moved.withColumn(value, F.lit(None).cast("int")), allowMissingColumns=True)
    # One aggregation in place of a join: a base pixel and what may replace it meet under their key.
    fused = F.coalesce(F.max_by("_new", "_order"), F.max(value)).alias(value)
    return both.groupBy(*TILE, "y", "x").agg(fused)
