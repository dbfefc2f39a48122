"""Readers of covers, tile directories, GeoJSON, catalogs and metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import exprs as X
from tessella.operators.warping import sampled

GEOMETRY = "struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>"
FEATURE = f"struct<type:string,geometry:{GEOMETRY},features:array<struct<type:string,geometry:{GEOMETRY}>>,crs:struct<properties:struct<name:string>>>"


def parse_cover_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """tile_class, z, x, y, raster_name, x_off, y_off, src_w, src_h, extra of lines "MercatorTile,x,y,z[,floats]" or
    "ImagePixelTile,raster,x,y,w,h", parted by commas or tabs; other lines are left out."""
    p = F.split(F.trim(F.col(value)), r"[,\t]")
    rows = lines.select(p.alias("p")).where(F.col("p")[0].isin("MercatorTile", "ImagePixelTile"))
    web = F.col("p")[0] == "MercatorTile"
    num = lambda i: F.try_element_at("p", F.lit(i + 1)).cast("int")
    pick = lambda cond, c: F.when(cond, c)
    return rows.select(
        F.col("p")[0].alias("tile_class"), pick(web, F.try_element_at("p", F.lit(4)).cast("int")).alias("z"), pick(web, num(1)).alias("x"), pick(web, num(2)).alias("y"), pick(~web, F.col("p")[1]).alias("raster_name"),
        pick(~web, F.try_element_at("p", F.lit(3)).cast("int")).alias("x_off"), pick(~web, F.try_element_at("p", F.lit(4)).cast("int")).alias("y_off"), pick(~web, F.try_element_at("p", F.lit(5)).cast("int")).alias("src_w"),
        pick(~web, F.try_element_at("p", F.lit(6)).cast("int")).alias("src_h"), pick(web, F.transform(F.slice("p", 5, 1000), lambda x: x.try_cast("double"))).alias("extra"),
    )


def tiles_of_json(df: DataFrame, text: str) -> DataFrame:
    """tile_class and key of class-tagged JSON objects, as sinks.tile_json writes them."""
    return df.select(F.from_json(text, "class string, raster_name string, x_off int, y_off int, src_w int, src_h int, x int, y int, z int").alias("t")).where("t.class is not null").select(F.col("t.class").alias("tile_class"), *[f"t.{n}" for n in ("raster_name", "x_off", "y_off", "src_w", "src_h", "x", "y", "z")])


def read_cover(spark: SparkSession, path: str) -> DataFrame:
    return parse_cover_lines(spark.read.text(path))


def read_tile_dir(spark: SparkSession, path: str, ext: str = "png", raster_name: str | None = None, cover: DataFrame | None = None) -> DataFrame:
    """tile_path and key of each tile file under path; sidecars are not tiles. Contents are read only if selected later."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{ext}").load(path).select(F.col("path").alias("tile_path"))
    return tiles_of_paths(files, "tile_path", raster_name, cover)


def tiles_of_paths(files: DataFrame, path: str = "tile_path", raster_name: str | None = None, cover: DataFrame | None = None) -> DataFrame:
    """files with the key in each path; sidecars (aux.xml, geojson) and other files go."""
    p = F.col(path)
    tiles = files.where(~p.endswith(".aux.xml") & ~p.endswith(".geojson")).select("*", *X.parsed_tile_path(path)).where("tile_class is not null")
    if raster_name is not None:
        tiles = tiles.where(F.col("raster_name") == raster_name)
    if cover is not None:
        keys = [k for k in ("z", "x", "y", "raster_name", "x_off", "y_off", "src_w", "src_h") if k in cover.columns]
        tiles = tiles.join(cover.select(*keys), keys, "left_semi")
    return tiles


def the_tile_class(tiles: DataFrame) -> DataFrame:
    """One row, tile_class: that of all tiles; an error if there are none or several."""
    found = tiles.agg(F.min("tile_class").alias("_low"), F.max("tile_class").alias("_high"))
    return found.select(F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.raise_error("tiles of one class are expected")).alias("tile_class"))


def files_of_tiles(keys: DataFrame, files: DataFrame, key: Sequence[str], path: str = "tile_path") -> DataFrame:
    """keys with the one file of each tile, null if it has none; several are an error."""
    own = files.groupBy(*key).agg(F.min(path).alias("_low"), F.max(path).alias("_high"))
    one = F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_low")).otherwise(F.raise_error(F.concat(F.lit("several files: "), "_low", F.lit(", "), "_high")))
    return keys.join(own, list(key), "left").withColumn(path, one).drop("_low", "_high")


def listed_files(files: DataFrame, path: str = "path", ext: str | None = None, include: Sequence[str] = (), ignore: Sequence[str] = ()) -> DataFrame:
    """Files of an extension (any case) whose path holds all of include and none of ignore, with base_name and stem."""
    p = F.col(path)
    keep = F.lit(True) if ext is None else F.endswith(F.lower(p), F.lit(ext.lower()))
    for part in include:
        keep = keep & F.contains(p, F.lit(part))
    for part in ignore:
        keep = keep & ~F.contains(p, F.lit(part))
    return files.where(keep).withColumn("base_name", F.regexp_extract(p, "[^/]*$", 0)).withColumn("stem", F.regexp_replace(p, r"\.[^./]*$", ""))


def concatenated(*segmentations: DataFrame) -> DataFrame:
    """The features of several segmentations, which must stand in one CRS."""
    out = segmentations[0]
    for s in segmentations[1:]:
        out = out.unionByName(s)
    return same_crs(out)


def without_ignored(files: DataFrame, path: str, search: str, ignore: str | None) -> DataFrame:
    """Files that match a regular expression and not another."""
    found = files.where(F.col(path).rlike(search))
    return found.where(~F.col(path).rlike(ignore)) if ignore else found


def paired(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, names: Sequence[str] = ("left_path", "right_path"), path: str = "path") -> DataFrame:
    """Files of two listings that a derived name pairs."""
    a = left.select(F.col(path).alias(names[0]), left_key.alias("pair_key"))
    return a.join(right.select(F.col(path).alias(names[1]), right_key.alias("pair_key")), "pair_key")


def _rings(coordinates: Column) -> Column:
    """Rings of a polygon's coordinates; heights are dropped."""
    raw = F.from_json(coordinates, "array<array<array<double>>>")
    return F.transform(raw, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def _multi(coordinates: Column) -> Column:
    raw = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return F.transform(raw, lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))


def _geometry_polygons(g: Column) -> Column:
    return F.when(g["type"] == "Polygon", F.array(_rings(g["coordinates"]))).when(g["type"] == "MultiPolygon", _multi(g["coordinates"]))


def geojson_polygons(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """keys, part, rings, crs of GeoJSON texts: Feature or FeatureCollection; Polygon, MultiPolygon and
    GeometryCollection (one level). Other and null geometries and empty polygons give no row."""
    f = F.from_json(F.col(text), FEATURE)
    rows = df.select(*keys, f.alias("_f")).withColumn("_g", F.when(F.col("_f.type") == "FeatureCollection", F.transform("_f.features", lambda x: x["geometry"])).otherwise(F.array("_f.geometry")))
    rows = rows.select(*keys, geojson_crs(F.col("_f.crs.properties.name")).alias("crs"), F.explode("_g").alias("_g")).where("_g is not null")
    parts = F.when(F.col("_g.type") == "GeometryCollection", F.flatten(F.filter(F.transform("_g.geometries", _geometry_polygons), lambda x: x.isNotNull()))).otherwise(_geometry_polygons(F.col("_g")))
    polygons = rows.select(*keys, "crs", F.posexplode(parts).alias("part", "rings"))
    return polygons.where("rings is not null and size(rings) > 0 and size(rings[0]) > 0")


def geojson_crs(name: Column) -> Column:
    """The EPSG code of a named CRS; 4326 if it is absent or no code."""
    last = F.element_at(F.split(name, ":"), -1)
    return F.coalesce(F.when(last == "CRS84", 4326).when(last == "900913", 3857).otherwise(last.try_cast("int")), F.lit(4326))


def same_crs(features: DataFrame) -> DataFrame:
    """features, with an error at their evaluation if they stand in several CRS."""
    found = features.agg(F.min("crs").alias("_low"), F.max("crs").alias("_high"))
    joined = features.crossJoin(F.broadcast(found))  # one row
    checked = F.when(F.col("_low") == F.col("_high"), F.col("crs")).otherwise(F.raise_error("several CRS").cast("int"))
    return joined.withColumn("crs", checked).drop("_low", "_high")


def read_tiling_json(spark: SparkSession, path: str) -> DataFrame:
    """A row for each raster of a tiling's metadata."""
    doc = spark.read.option("multiLine", "true").json(path)
    return doc.select(F.explode("raster_tiling_result_list").alias("r")).select("r.*")


def tilings_of_json(texts: DataFrame, text: str = "value") -> DataFrame:
    """A row for each raster of texts as sinks.tiling_json writes them: raster_name, crs, transform, width, height, origin, stride, size."""
    t = F.from_json(text, "raster_fn string, raster_crs string, raster_transform array<double>, raster_width int, raster_height int, tiling_info struct<tiling_source_offset_int:string,tiling_source_stride_float:string,tiling_source_size_int:string>")
    rows = texts.select(t.alias("t"))
    number = lambda c: X.quantity(F.col(f"t.tiling_info.{c}"))
    return rows.select(
        F.col("t.raster_fn").alias("raster_name"), F.col("t.raster_crs").alias("crs"), X.affine(*[F.col("t.raster_transform")[i] for i in range(6)]).alias("transform"),
        F.col("t.raster_width").alias("width"), F.col("t.raster_height").alias("height"), number("tiling_source_offset_int").alias("origin"), number("tiling_source_stride_float").alias("stride"), number("tiling_source_size_int").alias("size"),
    )


def read_blocks(spark: SparkSession, path: str, raster_names: Sequence[str] | None = None) -> DataFrame:
    """Raster blocks or tiles stored by the parquet sink; the raster filter prunes partitions."""
    blocks = spark.read.parquet(path)
    return blocks.where(F.col("raster_name").isin(*raster_names)) if raster_names else blocks


def windowed_read(px: DataFrame, tiles: DataFrame, size: tuple[int, int], fill: int = 0, value: str = "value") -> DataFrame:
    """raster_name, x_off, y_off, y, x, value of tiles cut from rasters' pixels; what lies outside is filled.

    px: raster_name, y, x, value. A pixel finds its tiles by grid cells of the
    tile's size, an equi-join on (raster, cell).
    """
    w, h = size
    cells = lambda low, n: F.sequence(F.floor(F.col(low) / n), F.floor((F.col(low) + n - 1) / n))
    dealt = tiles.select("raster_name", "x_off", "y_off", F.explode(cells("x_off", w)).alias("_cx")).select("*", F.explode(cells("y_off", h)).alias("_cy"))
    there = px.select("raster_name", F.col("y").alias("_py"), F.col("x").alias("_px"), value, F.floor(F.col("x") / w).alias("_cx"), F.floor(F.col("y") / h).alias("_cy"))
    cut = there.join(dealt, ["raster_name", "_cx", "_cy"]).select("raster_name", "x_off", "y_off", (F.col("_py") - F.col("y_off")).alias("y"), (F.col("_px") - F.col("x_off")).alias("x"), value)
    cut = cut.where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))
    blank = tiles.select("raster_name", "x_off", "y_off", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x"))
    return blank.join(cut, ["raster_name", "x_off", "y_off", "y", "x"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def warped_read(rasters: DataFrame, px: DataFrame, tiles: DataFrame, disk: int, value: str = "value", resampling: str = "nearest", block: int = 256) -> DataFrame:
    """z, x, y, row, col, value of mercator tiles read from rasters in EPSG:4326, 0 outside them.

    rasters: raster_name, transform, width, height. tiles: raster_name, z, x, y.
    Each tile pixel's centre is mapped back into the raster. The nearest pixel
    is met by an equi-join; other kernels (see warping.RESAMPLING) work within
    blocks of source pixels.
    """
    every = F.sequence(F.lit(0), F.lit(disk - 1))
    t = tiles.join(rasters.select("raster_name", X.inverse("transform").alias("_inv"), "width", "height"), "raster_name")
    grid = t.select("*", F.explode(every).alias("row")).select("*", F.explode(every).alias("col"))
    lon = X.tile_west(F.col("x") + (F.col("col") + 0.5) / disk, "z")
    lat = X.tile_north(F.col("y") + (F.col("row") + 0.5) / disk, "z")
    placed = grid.withColumns({"_sx": X.apply_x("_inv", lon, lat), "_sy": X.apply_y("_inv", lon, lat)})
    if resampling != "nearest":
        places = placed.select("raster_name", "z", F.col("x").alias("_tile_x"), F.col("y").alias("_tile_y"), F.col("row").alias("y"), F.col("col").alias("x"), F.col("_sy").alias("sy"), F.col("_sx").alias("sx"))
        found = sampled(px, places, ["raster_name"], ["z", "_tile_x", "_tile_y"], resampling, block, value)
        return found.select("raster_name", "z", F.col("_tile_x").alias("x"), F.col("_tile_y").alias("y"), F.col("y").alias("row"), F.col("x").alias("col"), value)
    at = placed.withColumns({"_x": F.floor("_sx").cast("int"), "_y": F.floor("_sy").cast("int")})
    source = px.select("raster_name", F.col("x").alias("_x"), F.col("y").alias("_y"), value)
    return at.join(source, ["raster_name", "_x", "_y"], "left").select("raster_name", "z", F.col("x"), F.col("y"), "row", "col", F.coalesce(value, F.lit(0)).alias(value))


def read_tiles(rasters: DataFrame, px: DataFrame, tiles: DataFrame, disk: int, value: str = "value", resampling: str = "nearest", block: int = 256) -> DataFrame:
    """tile_class, raster_name, the tile's key, row, col, value of tiles of both classes, each read as its class asks.

    tiles: tile_class, raster_name, z, x, y (of mercator tiles, else null) and
    x_off, y_off, src_w, src_h (of pixel tiles, else null). A mercator tile is
    warped from a raster in EPSG:4326; a pixel tile is a window brought to disk
    x disk pixels by the same kernel. An unknown class is an error.
    """
    known = F.col("tile_class").isin("MercatorTile", "ImagePixelTile")
    checked = tiles.withColumn("tile_class", F.when(known, F.col("tile_class")).otherwise(F.raise_error(F.concat(F.lit("no such tile class: "), F.coalesce("tile_class", F.lit("null"))))))
    web = warped_read(rasters, px, checked.where("tile_class = 'MercatorTile'").select("raster_name", "z", "x", "y"), disk, value, resampling, block)
    every = F.sequence(F.lit(0), F.lit(disk - 1))
    window = ["x_off", "y_off", "src_w", "src_h"]
    cells = checked.where("tile_class = 'ImagePixelTile'").select("raster_name", *window, F.explode(every).alias("y")).select("*", F.explode(every).alias("x"))
    places = cells.withColumns({"sy": F.col("y_off") + (F.col("y") + 0.5) * F.col("src_h") / disk, "sx": F.col("x_off") + (F.col("x") + 0.5) * F.col("src_w") / disk})
    if resampling == "nearest":
        at = places.withColumns({"_x": F.floor("sx").cast("int"), "_y": F.floor("sy").cast("int")})
        cut = at.join(px.select("raster_name", F.col("x").alias("_x"), F.col("y").alias("_y"), value), ["raster_name", "_x", "_y"], "left").withColumn(value, F.coalesce(value, F.lit(0)))
    else:
        cut = sampled(px, places, ["raster_name"], window, resampling, block, value)
    none = lambda *names: [F.lit(None).cast("int").alias(n) for n in names]
    local = cut.select(F.lit("ImagePixelTile").alias("tile_class"), "raster_name", *none("z", "tile_x", "tile_y"), *[F.col(k).cast("int").alias(k) for k in window], F.col("y").alias("row"), F.col("x").alias("col"), value)
    warped = web.select(F.lit("MercatorTile").alias("tile_class"), "raster_name", *[F.col(a).cast("int").alias(b) for a, b in (("z", "z"), ("x", "tile_x"), ("y", "tile_y"))], *none(*window), "row", "col", value)
    return warped.unionByName(local)
