"""The engine's entry points, DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import compare as C
from tessella.operators import compose, cover as covers, fusion, pixels, stats, tiling, vector
from tessella.operators.scheme import LocalScheme, MercatorScheme
from tessella.sources import readers


def tile(rasters: DataFrame, px: DataFrame, scheme: LocalScheme, cover: DataFrame | None = None, nodata: int = 0, threshold: float = 100, labels: bool = False, value: str = "value") -> DataFrame:
    """Pixels of the tiles of rasters (raster_name, width, height, transform; px: raster_name, y, x, value) that a
    cover keeps and that are not empty."""
    tiles = tiling.local_tiles(rasters, scheme)
    if cover is not None:
        tiles = covers.keep_covered(tiles, cover, ["raster_name", "x_off", "y_off", "src_w", "src_h"])
    size = (int(scheme.size[0]), int(scheme.size[1]))
    cut = readers.windowed_read(px, tiles, size, nodata, value)
    key = ["raster_name", "x_off", "y_off"]
    found = pixels.kept_tiles(pixels.nodata_statistics(cut, key, *size, value=value, nodata=nodata), threshold, scheme.keep_borders, labels)
    return cut.join(found.select(*key), key, "left_semi")


def mercator_cover(rasters: DataFrame, scheme: MercatorScheme) -> DataFrame:
    """Distinct mercator tiles that rasters with bounds (west, south, east, north) touch."""
    return covers.tiles_of_bounds(rasters, "west", "south", "east", "north", scheme.zoom).select(*covers.KEY).distinct()


def cover(tiles: DataFrame, zoom: int | None = None, splits: Sequence[int] | None = None, seed: int = 0) -> DataFrame:
    """A cover, at another zoom or split, or both."""
    out = covers.union_distinct(tiles) if zoom is None else covers.at_zoom(tiles, zoom)
    return covers.split(out, splits, seed) if splits else out


def rasterize(features: DataFrame, tiles: DataFrame, size: tuple[int, int], value: str) -> DataFrame:
    """raster_name, x_off, y_off, y, x, value: label tiles of the polygons (feature_id, rings in raster pixels, value)."""
    from tessella.functions.stages import staged
    from tessella.operators.spatial import tile_boxes
    from tessella.operators.tiling import dealt

    w, h = size
    # The planner sizes tiles by what they were made of; written first they have their own size, and polygons are not sent out in their stead.
    boxes = staged(tile_boxes(tiles.select("raster_name", "x_off", "y_off", "src_w", "src_h")).select("raster_name", "x_off", "y_off", "x0", "y0", "x1", "y1"), narrow=True)
    # Each polygon makes many pixels; dealt out by it, its rows need not be shuffled to be paired.
    met = vector.tile_candidates(boxes, dealt(features, "feature_id"), ["raster_name"], (float(w), float(h)), stage_left=True)
    local = met.withColumn("_ox", F.col("x_off")).withColumn("_oy", F.col("y_off"))
    moved = local.withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] - F.col("_ox")).alias("x"), (p["y"] - F.col("_oy")).alias("y")))))
    return vector.rasterize(moved.select("raster_name", "x_off", "y_off", "feature_id", "rings", value), w, h, value, ["raster_name", "x_off", "y_off"])


def fuse(px: DataFrame, tilings: DataFrame, scheme: LocalScheme, enabled: bool = True, value: str = "value") -> DataFrame:
    scheme.check_fusable()
    size = (int(scheme.size[0]), int(scheme.size[1]))
    return fusion.fuse(px, tilings, size, scheme.stride, value, enabled=enabled)


def compare(px: DataFrame, categories: DataFrame, label: str, mask: str, **options) -> DataFrame:
    return C.confusion_map(px, categories, label, mask, **options)


def aggregate(px: DataFrame, tilings: DataFrame, categories: DataFrame, value: str = "value") -> DataFrame:
    """raster_name, y, x, value, r, g, b: gray and colour canvases of rasters from their tiles."""
    return pixels.colored(compose.project(px, tilings, value=value), categories, value)


def aggregate_polygons(px: DataFrame, size: tuple[int, int], value: str = "value") -> DataFrame:
    """Polygons of each category and tile, moved to raster pixels."""
    key = ["raster_name", "x_off", "y_off"]
    found = vector.vectorize(px.select(*key, "y", "x", value), key, *size, value=value)
    return found.withColumn("rings", vector.moved_rings("rings", F.col("x_off"), F.col("y_off")))


def tiling_summary(rasters: DataFrame, scheme: LocalScheme, disk: tuple[int, int]) -> DataFrame:
    """Statistics of a tiling that is not carried out."""
    return stats.tiling_statistics_rollup(stats.tile_metrics(tiling.local_tiles(rasters, scheme, "transform"), *disk))
