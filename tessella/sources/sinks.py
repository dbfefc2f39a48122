"""Writers: tiles, covers, features, metadata."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import exprs as X


def write_tiles(tiles: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet by raster_name. mode "ignore" skips a path that is there."""
    tiles.write.mode(mode).partitionBy("raster_name").parquet(path)


def write_tile_files(px: DataFrame, path: str, size: tuple[int, int], name: Column, keys: Sequence[str], categories: DataFrame | None = None, bands: Sequence[str] = ("r", "g", "b"), value: str = "value", mode: str = "append") -> None:
    """A PNG file for each tile, by executors: of labels (value) in the categories' palette if these are given, else of the bands' colours.

    px: keys, y, x and value or bands, all pixels of each tile. name: the file's
    name without its ending, of the keys.
    """
    from tessella.sources import tiff

    w, h = size
    options = {"kind": "uint8", "file": "png"}
    if categories is not None:
        # At most 256 rows: a palette's index is one byte.
        known = {r["palette_index"]: list(r["palette_color"]) for r in categories.where("palette_index between 0 and 255").select("palette_index", "palette_color").collect()}
        options["palette"] = json.dumps([known.get(i, [0, 0, 0]) for i in range(256)])
    shown = F.array(value) if categories is not None else F.array(*bands)
    tiles = px.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "x", shown.cast("array<int>").alias("_v")))).alias("_p"))
    whole = F.when(F.size("_p") == w * h, F.flatten(F.transform("_p", lambda p: p["_v"]))).otherwise(F.raise_error("a tile lacks pixels").cast("array<int>"))
    tiff.write_rasters(tiles.select(name.alias("name"), F.lit(w).alias("width"), F.lit(h).alias("height"), whole.alias("data")), path, mode, **options)


def category_features(px: DataFrame, keys: Sequence[str], categories: DataFrame, patch: int = 64, value: str = "value") -> DataFrame:
    """keys, name, first_y, first_x, feature: the regions of each category as GeoJSON features, filled with its colour, whole over all tiles of a raster."""
    from tessella.operators.regions import whole_regions

    found = whole_regions(px.select(*keys, "y", "x", F.col(value).alias("value")), keys, patch=patch)
    named = categories.select(F.col("palette_index").alias("value"), "name", X.rgb_hex(*[F.col("palette_color")[i] for i in range(3)]).alias("_fill"))
    style = F.struct(F.col("name"), F.col("_fill").alias("fill"), F.lit(0.5).alias("fill-opacity"))
    return found.join(named, "value").select(*keys, "name", "first_y", "first_x", feature_json(F.col("rings"), style).alias("feature"))


def append_max(spark, layer: DataFrame, path: str, out: str, pixel: Sequence[str], value: str = "value") -> None:
    """Writes to out the layer at path (if any) with another put over it: the larger value of a pixel stays."""
    from tessella.operators.pixels import append_max as merged

    merged(spark.read.parquet(path), layer, pixel=pixel, value=value).write.parquet(out)


def cover_lines(tiles: DataFrame) -> Column:
    """"MercatorTile,x,y,z" or "ImagePixelTile,raster,x,y,w,h", by the columns that tiles has."""
    if "z" in tiles.columns:
        return F.concat_ws(",", F.lit("MercatorTile"), "x", "y", "z")
    return F.concat_ws(",", F.lit("ImagePixelTile"), "raster_name", "x_off", "y_off", "src_w", "src_h")


def tile_json(tiles: DataFrame) -> Column:
    """A class-tagged object of each tile's key."""
    web = "z" in tiles.columns
    keys = ("x", "y", "z") if web else ("raster_name", "x_off", "y_off", "src_w", "src_h")
    return F.to_json(F.struct(F.lit("MercatorTile" if web else "ImagePixelTile").alias("class"), *keys))


def bounds_json(bounds) -> Column:
    """A GeoJSON polygon of struct(left, bottom, right, top), closed."""
    b = X.col(bounds)
    ring = F.array(*[F.array(b[x], b[y]) for x, y in (("left", "top"), ("right", "top"), ("right", "bottom"), ("left", "bottom"), ("left", "top"))])
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def write_cover(tiles: DataFrame, path: str, splits: str | None = None) -> None:
    """Text lines; with a split column a folder for each split."""
    line = cover_lines(tiles).alias("value")
    if splits:
        tiles.select(line, splits).write.partitionBy(splits).text(path)
    else:
        tiles.select(line).write.text(path)


def mercator_footprint(x="x", y="y", z="z") -> Column:
    """The closed ring of a tile in lon/lat, six decimals."""
    w, e = F.round(X.tile_west(x, z), 6), F.round(X.tile_west(X.col(x) + 1, z), 6)
    n, s = F.round(X.tile_north(y, z), 6), F.round(X.tile_north(X.col(y) + 1, z), 6)
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.array(F.array(point(w, s), point(w, n), point(e, n), point(e, s), point(w, s)))


def feature_json(rings: Column, properties: Column) -> Column:
    """A GeoJSON Feature; null geometry types do not occur."""
    coordinates = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")))


def write_features(features: DataFrame, path: str, rings: str = "rings", color: tuple[int, int, int] = (0, 0, 0), by: str | None = None) -> None:
    """One feature a line (GeoJSON text sequence), filled half opaque; by: a folder for each value.

    Lines, not one collection, so that no task or driver holds all features.
    """
    style = F.struct(F.lit("#%02x%02x%02x" % color).alias("fill"), F.lit(0.5).alias("fill-opacity"))
    out = features.select(feature_json(F.col(rings), style).alias("value"), *([by] if by else []))
    (out.write.partitionBy(by) if by else out.write).text(path)


def corner_ring(transform, width, height) -> Column:
    """The closed ring of a pixel area's corners in its CRS."""
    at = lambda c, r: F.struct(X.apply_x(transform, c, r).alias("x"), X.apply_y(transform, c, r).alias("y"))
    zero = F.lit(0)
    return F.array(F.array(at(zero, zero), at(zero, X.col(height)), at(X.col(width), X.col(height)), at(X.col(width), zero), at(zero, zero)))


def tiling_json(tilings: DataFrame) -> DataFrame:
    """raster_name, value: the metadata of each raster's tiling as JSON."""
    fields = F.struct(
        F.col("raster_name").alias("raster_fn"), F.col("crs").alias("raster_crs"), F.array(*[F.col(f"transform.{n}") for n in "abcdef"]).alias("raster_transform"), F.col("width").alias("raster_width"), F.col("height").alias("raster_height"),
        F.struct(
            F.format_string("[%d %d] pixel", F.col("layout_x.origin"), F.col("layout_y.origin")).alias("tiling_source_offset_int"), F.format_string("[%s %s] pixel", F.col("stride_x").cast("string"), F.col("stride_y").cast("string")).alias("tiling_source_stride_float"),
            F.format_string("[%d %d] pixel", "src_w", "src_h").alias("tiling_source_size_int"),
        ).alias("tiling_info"),
    )
    return tilings.select("raster_name", F.to_json(fields).alias("value"))


def overview_lines(shared: DataFrame) -> DataFrame:
    """raster, line: how many tiles a raster has alone and shared, padded."""
    name = F.concat(F.lit("raster "), F.col("raster").cast("string"))
    return shared.select("raster", X.padded_line(name, F.format_string("%d non-shared, %d shared", "non_shared", "shared")).alias("line"))


def with_tags(rasters: DataFrame, tags: dict[str, str]) -> DataFrame:
    """rasters with tags merged in; the new value wins."""
    new = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    kept = F.map_filter("tags", lambda k, v: ~k.isin(*tags))
    return rasters.withColumn("tags", F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), new))


def copied_georeference(target: DataFrame, source: DataFrame) -> DataFrame:
    """target with the transform and CRS of the source's raster of the same name."""
    geo = source.select("raster_name", F.col("transform").alias("_t"), F.col("crs").alias("_c"))
    return target.drop("transform", "crs").join(geo, "raster_name", "left").withColumnsRenamed({"_t": "transform", "_c": "crs"})
