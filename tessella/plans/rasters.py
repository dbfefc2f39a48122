"""Queries: pixels, labels, fusion, comparison, simulation, vectors, composition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import api
from tessella.functions import exprs as X
from tessella.operators import categories as K
from tessella.operators import compare as CMP
from tessella.operators import compose, fusion, georeference, pixels, simulate, spatial, tiling, vector
from tessella.operators.scheme import LocalScheme
from tessella.plans import bases as B
from tessella.sources import adapters as A
from tessella.sources import readers

TILE = ["raster_name", "x_off", "y_off"]
FUSION = LocalScheme((8, 8), (4, 4), alignment="aligned_to_image_border")


def _labels(spark: SparkSession, d: str, value: str = "val") -> DataFrame:
    return A.predicted_pixels(spark, d).select(*TILE, "src_w", "src_h", "y", "x", F.col(value).alias("value"))


def _tilings(px: DataFrame) -> DataFrame:
    """The tilings of the embedded rasters: 44 x 44 pixels, tiles from 0."""
    zero, side, step = F.lit(0), F.lit(44), F.lit(4.0)
    return px.select("raster_name").distinct().select("raster_name", side.alias("width"), side.alias("height"), zero.alias("origin_x"), zero.alias("origin_y"), step.alias("stride_x"), step.alias("stride_y"))


def _categories(spark: SparkSession) -> DataFrame:
    return K.to_df(spark, K.LAND_COVER)


def _colors(spark: SparkSession, d: str) -> DataFrame:
    """The layered pixels as full colours: a band counts as 255 from 25 on."""
    wide = pixels.bands_wide(A.layered_pixels(spark, d), ["tile_id", "raster_ord", "y", "x"], [0, 1, 2], ["r", "g", "b"])
    return wide.withColumns({c: F.when(F.col(c) >= 25, 255).otherwise(0) for c in "rgb"})


def _base_raster_pixels(spark: SparkSession, d: str) -> DataFrame:
    """The rasters of 40 x 40 pixels that the tiles without overlap (every second one each way) make up; the others repeat their area."""
    return A.tile_pixels(spark, d).where("x_off % 8 = 0 and y_off % 8 = 0").select("raster_name", (F.col("y_off") + F.col("y")).alias("y"), (F.col("x_off") + F.col("x")).alias("x"), F.col("val").alias("value"))


def nodata_ratio(spark, d):
    s = pixels.nodata_statistics(A.tile_pixels(spark, d), TILE, 8, 8, "val", 2)
    return s.select(*TILE, "n_nodata", "n_values", "empty_border", F.round(F.col("n_nodata") / F.col("n_values"), 6).alias("ratio"))


def nodata_filter(spark, d):
    s = pixels.nodata_statistics(A.tile_pixels(spark, d), TILE, 8, 8, "val", 2)
    return pixels.kept_tiles(s, 50).select(*TILE)


def keep_rule(spark, d):
    """Tiles that stay as they are not empty or several rasters share them."""
    px = A.layered_pixels(spark, d)
    s = pixels.nodata_statistics(px, ["tile_id", "raster_ord"], 32, 32)
    n = pixels.tile_rasters(px.where("value > 45"), ["tile_id"])
    return pixels.kept_tiles(s.join(n.select("tile_id", "n_rasters"), "tile_id"), 20, n_rasters="n_rasters").select("tile_id", "raster_ord")


def tile_to_rasters(spark, d):
    return pixels.tile_rasters(A.layered_pixels(spark, d), ["tile_id", "y"]).select("tile_id", "y", F.array_join(F.col("rasters").cast("array<string>"), ",").alias("rasters"), "n_rasters")


def shared_tile_counts(spark, d):
    return pixels.shared_counts(pixels.tile_rasters(A.layered_pixels(spark, d).where("value > 0"), ["tile_id", "y", "x"]))


def multi_raster_tiles(spark, d):
    return pixels.tile_rasters(A.layered_pixels(spark, d), ["tile_id", "y", "x"]).where("n_rasters > 1").select("tile_id", "y", "x", "n_rasters")


def mosaic_first_nonzero(spark, d):
    return pixels.mosaic(A.layered_pixels(spark, d), ["tile_id", "y", "x", "band"])


def append_max(spark, d):
    px = A.layered_pixels(spark, d)
    return pixels.append_max(px.where("raster_ord < 2"), px.where("raster_ord >= 2"), pixel=["tile_id", "y", "x", "band"])


def alpha_channel(spark, d):
    m = pixels.mosaic(A.layered_pixels(spark, d), ["tile_id", "y", "x", "band"])
    return pixels.with_alpha(m, ["tile_id", "y", "x"], 3)


def band_selection(spark, d):
    return pixels.bands_wide(A.layered_pixels(spark, d), ["tile_id", "raster_ord", "y", "x"], [0, 2], ["first", "third"])


def image_to_label(spark, d):
    return pixels.colors_to_labels(_colors(spark, d), _categories(spark)).select("tile_id", "raster_ord", "y", "x", "label")


def unique_colors(spark, d):
    return pixels.unique_colors(_colors(spark, d))


def palette_lookup(spark, d):
    return pixels.colored(A.tile_pixels(spark, d).select("vec_id", "y", "x", "val"), _categories(spark), "val").select("vec_id", "y", "x", "r", "g", "b")


def palette_inverse(spark, d):
    found = _colors(spark, d).join(pixels.inverse_palette(_categories(spark)), ["r", "g", "b"])
    return found.groupBy("palette_index").agg(F.count("y").alias("n"))


def category_filters(spark, d):
    """Pixels of the active categories that are not ignored."""
    c = K.not_ignored(K.active(_categories(spark)))
    return A.tile_pixels(spark, d).groupBy(F.col("val").alias("palette_index")).agg(F.count("val").alias("n")).join(c, "palette_index", "right").select("name", "palette_index", F.coalesce("n", F.lit(0)).alias("n"))


def category_json(spark, d):
    c = _categories(spark).select("name", "palette_index", F.to_json(F.struct("name", "palette_index", "palette_color", "is_active", "is_ignore")).alias("category"))
    return A.tile_pixels(spark, d).groupBy(F.col("val").alias("palette_index")).agg(F.count("val").alias("n")).join(c, "palette_index").select("category", "n")


def coco_json(spark, d):
    c = K.not_ignored(_categories(spark)).select("palette_index", K.coco_json_column().alias("category"))
    return A.tile_pixels(spark, d).groupBy(F.col("val").alias("palette_index")).agg(F.count("val").alias("n")).join(c, "palette_index").select("category", "n")


def color_hex(spark, d):
    return pixels.unique_colors(_colors(spark, d)).select(X.rgb_hex("r", "g", "b").alias("fill"), "n")


def normalize_uint8(spark, d):
    px = A.tile_pixels(spark, d).select("vec_id", "y", "x", (F.col("u8") * 257).alias("wide"), F.element_at(F.array(*map(F.lit, ("uint16", "int16", "uint8"))), (F.col("x") % 3 + 1).cast("int")).alias("dtype"))
    return px.select("vec_id", "y", "x", X.normalized_uint8(F.when(F.col("dtype") == "uint8", F.col("wide") % 256).otherwise(F.col("wide") % 32768 - F.when(F.col("dtype") == "int16", 1000).otherwise(0)), "dtype").alias("value"))


def base_aux_split(spark, d):
    tiles = A.tile_pixels(spark, d).select(*TILE, "src_w", "src_h").distinct()
    return fusion.base_and_aux(tiles, _tilings(tiles)).select(*TILE, "is_base")


def overlap_pairs(spark, d):
    tiles = A.tile_pixels(spark, d).select(*TILE, "src_w", "src_h").distinct()
    return fusion.overlapping_pairs(fusion.base_and_aux(tiles, _tilings(tiles)), (8.0, 8.0))


def fuse_tiles(spark, d):
    px = _labels(spark, d)
    return api.fuse(px, _tilings(px), FUSION)


def fuse_disabled(spark, d):
    px = _labels(spark, d)
    return api.fuse(px, _tilings(px), FUSION, enabled=False)


def fusion_confusion(spark, d):
    """Fused predictions against labels: outcomes of each category."""
    px = _labels(spark, d, "pred")
    fused = api.fuse(px, _tilings(px), FUSION)
    both = CMP.joined_tiles(fused, _labels(spark, d), [*TILE, "y", "x"])
    return CMP.confusion_counts(both, _categories(spark), "original", "value")


def confusion_map(spark, d):
    px = A.predicted_pixels(spark, d).select(*TILE, "y", "x", "val", "pred")
    return CMP.confusion_map(px, _categories(spark), "val", "pred", {"tp": 1, "fp": 2, "tn": 3, "fn": 4})


def confusion_counts(spark, d):
    return CMP.confusion_counts(A.predicted_pixels(spark, d), _categories(spark), "val", "pred", ["raster_name"])


def rgb_difference(spark, d):
    px = A.layered_pixels(spark, d)
    key = ["tile_id", "y", "x"]
    return CMP.difference_map(pixels.mosaic(px, [*key, "band"]), pixels.append_max(px, pixel=[*key, "band"]), key, 11)


def simulate_border(spark, d):
    return simulate.frame(_labels(spark, d), (8, 8), (6, 4), 10, 1).select(*TILE, "y", "x", "value")


def simulate_pattern(spark, d):
    return simulate.knock_out(_labels(spark, d), 8).select(*TILE, "y", "x", "value")


def metatile(spark, d):
    px = A.tile_pixels(spark, d).where("x_off % 8 = 0 and y_off % 8 = 0").select(*TILE, "y", "x", F.col("val").alias("value"))
    return pixels.metatile(px, ["raster_name"], 8)


def tile_boundary(spark, d):
    return A.tile_pixels(spark, d).select(*TILE, "y", "x", F.when(F.col("y").isin(0, 7) | F.col("x").isin(0, 7), 1).otherwise(0).alias("boundary"))


def category_mask(spark, d):
    return A.tile_pixels(spark, d).where("val = 3").select(*TILE, "y", "x")


def packed_roundtrip(spark, d):
    px = A.tile_pixels(spark, d).select("vec_id", "y", "x", F.col("u8").alias("value"))
    return pixels.unpacked(pixels.packed(px, ["vec_id"]), ["vec_id"], 8)


def overviews(spark, d):
    return pixels.overviews(A.tile_pixels(spark, d).select("vec_id", "y", "x", F.col("u8").alias("value")), ["vec_id"], [2, 4])


def resize_nearest(spark, d):
    return pixels.resize_nearest(A.tile_pixels(spark, d).select("vec_id", "y", "x", F.col("val").alias("value")), ["vec_id"], (8, 8), (12, 5))


def resize_bilinear(spark, d):
    out = pixels.resize_bilinear(A.tile_pixels(spark, d).select("vec_id", "y", "x", F.col("u8").alias("value")), ["vec_id"], (8, 8), (12, 5))
    return out.withColumn("value", F.round("value", 6))


def windowed_read(spark, d):
    """Overhanging tiles cut from rasters that are put together from base tiles."""
    px = _base_raster_pixels(spark, d)
    tiles = tiling.local_tiles(px.select("raster_name").distinct().withColumns({"width": F.lit(40), "height": F.lit(40)}), LocalScheme((12, 12), (9, 9)))
    return readers.windowed_read(px, tiles, (12, 12))


def warped_read(spark, d):
    """A mercator tile over each raster, which spans 4 degrees, read by nearest neighbour."""
    px = _base_raster_pixels(spark, d)
    rasters = px.select("raster_name").distinct().select("raster_name", F.lit(40).alias("width"), F.lit(40).alias("height"), X.affine(0.1, 0, 10.0, 0, -0.1, 52.0).alias("transform"))
    tiles = rasters.select("raster_name", F.lit(8).alias("z"), F.lit(136).alias("x"), F.lit(84).alias("y"))
    return readers.warped_read(rasters, px, tiles, 16)


def warp_raster(spark, d):
    """Rasters in EPSG:4326 on a grid in EPSG:3857."""
    px = _base_raster_pixels(spark, d)
    names = px.select("raster_name").distinct()
    rasters = names.withColumn("transform", X.affine(0.1, 0, 10.0, 0, -0.1, 52.0))
    grids = names.select("raster_name", X.affine(20000.0, 0, 1100000.0, 0, -20000.0, 6820000.0).alias("grid"), F.lit(25).alias("width"), F.lit(30).alias("height"))
    return georeference.warp(px, rasters, grids, 4326, 3857)


def project_pixels(spark, d):
    px = _labels(spark, d)
    return compose.project(px, _tilings(px))


def overlay_composite(spark, d):
    px = _labels(spark, d)
    canvas = compose.project(px, _tilings(px))
    layer = pixels.colored(canvas.where("value in (1, 4)"), _categories(spark), "value").drop("value")
    raster = canvas.select("raster_name", "y", "x", *[(F.col("value") * 40).alias(c) for c in "rgb"])
    return compose.overlay(raster, layer, ["raster_name", "y", "x"])


def grid_canvas(spark, d):
    tiles = A.tile_pixels(spark, d).where("x_off % 8 = 0 and y_off % 8 = 0").select(*TILE, "src_w", "src_h").distinct()
    return compose.grid_canvas(tiles, _tilings(tiles))


def geojson_polygons(spark, d):
    p = readers.geojson_polygons(A.geojson(spark, d), "feature_json", ["id"])
    corner = p.select("id", "part", "crs", F.posexplode(F.col("rings")[0]).alias("corner", "p"))
    return corner.select("id", "part", "crs", "corner", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def geojson_crs(spark, d):
    name = F.element_at(F.array(F.lit("urn:ogc:def:crs:OGC:1.3:CRS84"), F.lit("EPSG:900913"), F.lit("urn:ogc:def:crs:EPSG::32633"), F.lit("local")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), readers.geojson_crs(name).alias("crs"))


def polygon_bbox(spark, d):
    return A.triangles(spark, d).select("feature_id", vector.polygon_bounds().alias("b")).select("feature_id", "b.*")


def polygon_areas(spark, d):
    return A.triangles(spark, d).select("feature_id", vector.polygon_area().alias("area"), vector.is_valid_polygon().alias("valid"))


def tile_polygon_candidates(spark, d):
    """Tiles of every raster with the polygons of that raster; polygons are dealt to the rasters by their number."""
    px = A.tile_pixels(spark, d)
    tiles = spatial.tile_boxes(px.select(*TILE, "src_w", "src_h").distinct()).select(*TILE, "x0", "y0", "x1", "y1")
    n_rasters = px.agg((F.floor(F.max("vec_id") / 100) + 1).alias("n")).scalar()
    raster = F.concat(F.lit("r"), F.col("feature_id") % n_rasters)
    features = A.triangles(spark, d).select(raster.alias("raster_name"), "feature_id", "rings")
    return vector.tile_candidates(tiles, features, ["raster_name"], (8.0, 8.0)).select(*TILE, "feature_id")


def rasterize_polygons(spark, d):
    f = A.triangles(spark, d).select("feature_id", "rings", "category_index")
    return vector.burnt_pixels(f, ["feature_id"], 44, 44)


def rasterize_append(spark, d):
    return vector.rasterize(A.triangles(spark, d), 44, 44, "category_index")


def rasterize_tiles(spark, d):
    tiles = tiling.local_tiles(spark.read.parquet(f"{d}/orders.parquet").select(F.lit("a").alias("raster_name")).distinct().withColumns({"width": F.lit(44), "height": F.lit(44)}), LocalScheme((16, 16)))
    return api.rasterize(A.triangles(spark, d).withColumn("raster_name", F.lit("a")), tiles, (16, 16), "category_index")


def buffer_polygons(spark, d):
    """Pixels of each polygon grown by a pixel and shrunk by a half, counted."""
    f = A.triangles(spark, d)
    about = vector.pixels_about(f, ["feature_id"], 1.0, 60, 60)
    return about.groupBy("feature_id").agg(F.count_if(vector.stays_in(1.0)).alias("grown"), F.count_if(vector.stays_in(-0.5)).alias("shrunk"))


def vectorize_stats(spark, d):
    """Polygons of each category and tile: their area together equals the pixels."""
    found = api.aggregate_polygons(_labels(spark, d), (8, 8))
    return found.groupBy(*TILE, "value").agg(F.sum(vector.polygon_area()).alias("area"), F.min(vector.polygon_bounds()["left"]).alias("left"), F.max(vector.polygon_bounds()["top"]).alias("top"))


def vectorize_regions(spark, d):
    """Number of regions of each category and tile."""
    return api.aggregate_polygons(_labels(spark, d), (8, 8)).groupBy(*TILE, "value").agg(F.count("part").alias("regions"))


def tile_pipeline(spark, d):
    """Tiles cut from rasters and filtered for nodata, from catalog to pixels."""
    px = _base_raster_pixels(spark, d)
    rasters = px.select("raster_name").distinct().withColumns({"width": F.lit(40), "height": F.lit(40)})
    return api.tile(rasters, px, LocalScheme((12, 12), (9, 9), keep_borders=False), threshold=50)


_BASE = f"""{B.PREDICTED}, lab as (select raster_name, x_off, y_off, y, x, val as value from pred), tl as (select distinct raster_name, x_off, y_off from px),
  bs as (select * from tl where x_off % 8 = 0 and y_off % 8 = 0), ax as (select * from tl where not (x_off % 8 = 0 and y_off % 8 = 0)),
  pr as (select b.raster_name, b.x_off, b.y_off, a.x_off ax, a.y_off ay from bs b join ax a on a.raster_name = b.raster_name and abs(a.x_off - b.x_off) < 8 and abs(a.y_off - b.y_off) < 8)"""


def _fused(value: str) -> str:
    return f"""fused as (select b.raster_name, b.x_off, b.y_off, b.y, b.x, coalesce(m.v, b.{value}) as value from pred b join bs using (raster_name, x_off, y_off) left join
  (select p.raster_name, p.x_off, p.y_off, a.y + p.ay - p.y_off y, a.x + p.ax - p.x_off x, arg_max(a.{value}, (p.ax, p.ay)) v from pr p join pred a on a.raster_name = p.raster_name and a.x_off = p.ax and a.y_off = p.ay
   where a.y between 2 and 5 and a.x between 2 and 5 group by 1, 2, 3, 4, 5) m on (m.raster_name, m.x_off, m.y_off, m.y, m.x) = (b.raster_name, b.x_off, b.y_off, b.y, b.x))"""


_COUNTS = "count(*) filter (where {l} = c.palette_index and {m} = c.palette_index) tp, count(*) filter (where {l} <> c.palette_index and {m} = c.palette_index) fp, count(*) filter (where {l} = c.palette_index and {m} <> c.palette_index) fn, count(*) filter (where {l} <> c.palette_index and {m} <> c.palette_index) tn"
_RGB = f"""{B.LAYERED}, col as (select tile_id, raster_ord, y, x, case when max(value) filter (where band = 0) >= 25 then 255 else 0 end r, case when max(value) filter (where band = 1) >= 25 then 255 else 0 end g,
  case when max(value) filter (where band = 2) >= 25 then 255 else 0 end b from lay group by 1, 2, 3, 4)"""
_NODATA = f"""{B.PIXELS}, st as (select raster_name, x_off, y_off, count(*) filter (where val = 2) n_nodata, count(*) n_values, coalesce(bool_and(val = 2) filter (where y = 0), false) or bool_and(val = 2) filter (where y = 7)
  or bool_and(val = 2) filter (where x = 0) or bool_and(val = 2) filter (where x = 7) empty_border from px group by 1, 2, 3)"""
_CANVAS = f"{B.PIXELS}, cv as (select raster_name, y_off + y y, x_off + x x, arg_max(val, (x_off, y_off)) as value from px group by 1, 2, 3)"
_FULL = f"{B.PIXELS}, ras as (select raster_name, y_off + y y, x_off + x x, val from px where x_off % 8 = 0 and y_off % 8 = 0)"
#: 40 pixels, size 12, stride 9, centred: 4 tiles each way.
_CUT = f"""{_FULL}, o as (select unnest([11, 2, -7, 20, 29]) o), tl as (select distinct raster_name, a.o x_off, b.o y_off from ras, o a, o b),
  cut as (select t.raster_name, x_off, y_off, i.i::int y, j.i::int x, coalesce(r.val, 0) as value from tl t cross join generate_series(0, 11) i(i) cross join generate_series(0, 11) j(i) left join ras r on r.raster_name = t.raster_name and r.y = y_off + i.i and r.x = x_off + j.i)"""
_EDGES = f"""{B.TRIANGLES}, ed as (select feature_id, category_index, unnest([{{'ax': x0, 'ay': y0, 'bx': x1, 'by': y1}}, {{'ax': x1, 'ay': y1, 'bx': x2, 'by': y2}}, {{'ax': x2, 'ay': y2, 'bx': x0, 'by': y0}}]) e from tri),
  hit as (select feature_id, category_index, r.i::int y, e.ax + (r.i + 0.5 - e.ay) / (e.by - e.ay) * (e.bx - e.ax) at_x from ed, generate_series(0, 59) r(i) where (e.ay > r.i + 0.5) <> (e.by > r.i + 0.5)),
  burnt as (select feature_id, category_index, y, c.i::int x from hit, generate_series(0, 59) c(i) group by all having count(*) filter (where at_x < c.i + 0.5) % 2 = 1)"""

QUERIES = {
    f.__name__: f
    for f in (
        nodata_ratio, nodata_filter, keep_rule, tile_to_rasters, shared_tile_counts, multi_raster_tiles, mosaic_first_nonzero, append_max, alpha_channel, band_selection, image_to_label, unique_colors, palette_lookup, palette_inverse,
        category_filters, category_json, coco_json, color_hex, normalize_uint8, base_aux_split, overlap_pairs, fuse_tiles, fuse_disabled, fusion_confusion, confusion_map, confusion_counts, rgb_difference, simulate_border,
        simulate_pattern, metatile, tile_boundary, category_mask, packed_roundtrip, overviews, resize_nearest, resize_bilinear, windowed_read, warped_read, warp_raster, project_pixels, overlay_composite, grid_canvas, geojson_polygons, geojson_crs,
        polygon_bbox, polygon_areas, tile_polygon_candidates, rasterize_polygons, rasterize_append, rasterize_tiles, buffer_polygons, vectorize_stats, vectorize_regions, tile_pipeline,
    )
}

ORACLE_SQL = {
    "nodata_ratio": f"with {_NODATA} select *, round(n_nodata / n_values, 6) ratio from st",
    "nodata_filter": f"with {_NODATA} select raster_name, x_off, y_off from st where not empty_border and n_nodata < n_values * 0.5",
    "keep_rule": f"""with {B.LAYERED}, n as (select tile_id, count(distinct raster_ord) n from lay where value > 45 group by 1), s as (select tile_id, raster_ord, count(*) filter (where value = 0) z, count(*) c,
        coalesce(bool_and(value = 0) filter (where y = 0), false) or coalesce(bool_and(value = 0) filter (where y = 31), false) or coalesce(bool_and(value = 0) filter (where x = 0), false) or coalesce(bool_and(value = 0) filter (where x = 31), false) e from lay group by 1, 2)
        select tile_id, raster_ord from s join n using (tile_id) where n > 1 or not (e or z >= c * 0.2)""",
    "tile_to_rasters": f"with {B.LAYERED} select tile_id, y, string_agg(distinct raster_ord::varchar, ',' order by raster_ord::varchar) rasters, count(distinct raster_ord)::int n_rasters from lay group by 1, 2",
    "shared_tile_counts": f"""with {B.LAYERED}, r as (select distinct tile_id, y, x, raster_ord from lay where value > 0), n as (select *, count(*) over (partition by tile_id, y, x) n from r)
        select raster_ord raster, count(*) filter (where n = 1) non_shared, count(*) filter (where n > 1) shared from n group by 1""",
    "multi_raster_tiles": f"with {B.LAYERED} select tile_id, y, x, count(distinct raster_ord)::int n_rasters from lay group by 1, 2, 3 having count(distinct raster_ord) > 1",
    "mosaic_first_nonzero": f"with {B.LAYERED} select tile_id, y, x, band, coalesce(arg_min(value, raster_ord) filter (where value <> 0), 0) as value from lay group by 1, 2, 3, 4",
    "append_max": f"with {B.LAYERED} select tile_id, y, x, band, max(value) as value from lay group by 1, 2, 3, 4",
    "alpha_channel": f"""with {B.LAYERED} select tile_id, y, x, band, coalesce(arg_min(value, raster_ord) filter (where value <> 0), 0) as value from lay group by 1, 2, 3, 4 union all select distinct tile_id, y, x, 3, 255 from lay""",
    "band_selection": f"""with {B.LAYERED} select tile_id, raster_ord, y, x, coalesce(max(value) filter (where band = 0), 0) "first", coalesce(max(value) filter (where band = 2), 0) third from lay where band in (0, 2) group by 1, 2, 3, 4""",
    "image_to_label": f"with {_RGB}, {B.CATEGORIES} select tile_id, raster_ord, y, x, coalesce((select max(palette_index) from cats where (cats.r, cats.g, cats.b) = (col.r, col.g, col.b)), 0) label from col",
    "unique_colors": f"with {_RGB} select r, g, b, count(*) n from col group by 1, 2, 3",
    "palette_lookup": f"with {B.PIXELS}, {B.CATEGORIES} select vec_id, y, x, r, g, b from px join cats on palette_index = val",
    "palette_inverse": f"with {_RGB}, {B.CATEGORIES} select palette_index, count(*) n from col join cats using (r, g, b) group by 1",
    "category_filters": f"with {B.PIXELS}, {B.CATEGORIES} select name, palette_index, (select count(*) from px where val = palette_index) n from cats where is_active and not is_ignore",
    "category_json": f"""with {B.PIXELS}, {B.CATEGORIES} select to_json({{'name': name, 'palette_index': palette_index, 'palette_color': [r, g, b], 'is_active': is_active, 'is_ignore': is_ignore}})::varchar category, count(*) n from px join cats on palette_index = val group by all""",
    "coco_json": f"""with {B.PIXELS}, {B.CATEGORIES} select to_json({{'supercategory': '', 'color': [r, g, b], 'isthing': 0, 'id': palette_index, 'name': name}})::varchar category, count(*) n from px join cats on palette_index = val where not is_ignore group by all""",
    "color_hex": f"with {_RGB} select printf('#%02x%02x%02x', r, g, b) fill, count(*) n from col group by 1",
    "normalize_uint8": f"""with {B.PIXELS}, w as (select vec_id, y, x, u8 * 257 w from px) select vec_id, y, x, (case x % 3 when 0 then floor((w % 32768) / 256.0) when 1 then greatest(0, floor((w % 32768 - 1000)::double / 10000 * 256)) % 256 else w % 256 end)::int as value from w""",
    "base_aux_split": f"with {B.PIXELS} select distinct raster_name, x_off, y_off, x_off % 8 = 0 and y_off % 8 = 0 is_base from px",
    "overlap_pairs": f"with {_BASE} select raster_name, x_off, y_off, ax aux_x, ay aux_y from pr",
    "fuse_tiles": f"with {_BASE}, {_fused('val')} select * from fused",
    "fuse_disabled": f"with {_BASE} select lab.* from lab join bs using (raster_name, x_off, y_off)",
    "fusion_confusion": f"with {_BASE}, {_fused('pred')}, {B.CATEGORIES}, j as (select f.value v, lab.value l from fused f join lab using (raster_name, x_off, y_off, y, x)) select c.name as name, {_COUNTS.format(l='l', m='v')} from j, cats c where is_active and not is_ignore group by 1",
    "confusion_map": f"""with {B.PREDICTED}, {B.CATEGORIES} select raster_name, x_off, y_off, y, x, name, case when val = palette_index and pred = palette_index then 1 when pred = palette_index then 2 when val = palette_index then 4 else 3 end outcome
        from pred, cats where is_active and not is_ignore""",
    "confusion_counts": f"with {B.PREDICTED}, {B.CATEGORIES} select raster_name, c.name as name, {_COUNTS.format(l='val', m='pred')} from pred, cats c where is_active and not is_ignore group by 1, 2",
    "rgb_difference": f"""with {B.LAYERED}, m as (select tile_id, y, x, band, coalesce(arg_min(value, raster_ord) filter (where value <> 0), 0) a, max(value) b from lay group by 1, 2, 3, 4) select tile_id, y, x, case when bool_or(a <> b) then 11 else 0 end as value from m group by 1, 2, 3""",
    "simulate_border": f"""with {B.PIXELS} select raster_name, x_off, y_off, y, x, case when x between 1 and 6 and y between 2 and 5 and not (x between 2 and 5 and y between 3 and 4) then 10 else val end as value from px""",
    "simulate_pattern": f"""with {B.PIXELS}, t as (select distinct raster_name, x_off, y_off from px), c as (select *, (dense_rank() over (partition by raster_name order by x_off) - 1) % 2 sx, case when lag(y_off) over w is not distinct from y_off then 0 else 1 end ch from t window w as (partition by raster_name order by x_off, y_off)),
        s as (select *, (sum(ch) over (partition by raster_name order by x_off, y_off) - 1) % 2 sy from c)
        select raster_name, x_off, y_off, y, x, case when (case when sx = 0 then round_even(y % 50 / 50.0 - 0.25, 0) else round_even(x % 50 / 50.0 - 0.25, 0) end) <> (case when sy = 0 then round_even((y + x) % 50 / 50.0 - 0.25, 0) else round_even(((8 - y) % 8 + x) % 50 / 50.0 - 0.25, 0) end) then 0 else val end as value
        from px join s using (raster_name, x_off, y_off)""",
    "metatile": f"""with {_FULL}, tl as (select distinct raster_name, x_off, y_off from px where x_off % 8 = 0 and y_off % 8 = 0) select t.raster_name, x_off, y_off, i.i::int y, j.i::int x, coalesce(r.val, 0) as value
        from tl t cross join generate_series(0, 11) i(i) cross join generate_series(0, 11) j(i) left join ras r on r.raster_name = t.raster_name and r.y = y_off + i.i - 2 and r.x = x_off + j.i - 2""",
    "tile_boundary": f"with {B.PIXELS} select raster_name, x_off, y_off, y, x, (y in (0, 7) or x in (0, 7))::int boundary from px",
    "category_mask": f"with {B.PIXELS} select raster_name, x_off, y_off, y, x from px where val = 3",
    "packed_roundtrip": f"with {B.PIXELS} select vec_id, y, x, u8 as value from px",
    "overviews": f"with {B.PIXELS} select vec_id, f::int factor, (y // f)::int y, (x // f)::int x, round_even(avg(u8), 0)::int as value from px, (values (2), (4)) t(f) group by 1, 2, 3, 4",
    "resize_nearest": f"with {B.PIXELS} select vec_id, i.i::int y, j.i::int x, val as value from generate_series(0, 4) i(i) cross join generate_series(0, 11) j(i) join px on px.y = i.i * 8 // 5 and px.x = j.i * 8 // 12",
    "resize_bilinear": f"""with {B.PIXELS}, dy as (select i::int y, (i + 0.5::double) * 8 / 5 - 0.5 p from generate_series(0, 4) g(i)), dx as (select i::int x, (i + 0.5::double) * 8 / 12 - 0.5 p from generate_series(0, 11) g(i)),
        wy as (select y, greatest(0, least(7, floor(p)))::int s, 1 - (p - floor(p)) w from dy union all select y, greatest(0, least(7, floor(p) + 1))::int, p - floor(p) from dy),
        wx as (select x, greatest(0, least(7, floor(p)))::int s, 1 - (p - floor(p)) w from dx union all select x, greatest(0, least(7, floor(p) + 1))::int, p - floor(p) from dx)
        select vec_id, wy.y as y, wx.x as x, round(sum(u8 * wy.w * wx.w), 6) as value from px join wy on wy.s = px.y join wx on wx.s = px.x group by 1, 2, 3""",
    "windowed_read": f"with {_CUT} select * from cut",
    "warped_read": f"""with {_FULL}, t as (select distinct raster_name from ras) select t.raster_name, 8 z, 136 x, 84 y, i.i::int "row", j.i::int col, coalesce(r.val, 0) as value from t cross join generate_series(0, 15) i(i) cross join generate_series(0, 15) j(i)
        left join ras r on r.raster_name = t.raster_name and r.x = floor((136 + (j.i + 0.5::double) / 16) / 256 * 360 - 180 - 10.0::double) * 0 + floor(((136 + (j.i + 0.5::double) / 16) / 256 * 360 - 180) * 10 - 100)
        and r.y = floor((degrees(atan(sinh(pi() * (1 - 2 * (84 + (i.i + 0.5::double) / 16) / 256))))) * -10 + 520)""",
    "warp_raster": f"""with {_FULL}, t as (select distinct raster_name from ras) select t.raster_name, i.i::int y, j.i::int x, coalesce(r.val, 0) as value from t cross join generate_series(0, 29) i(i) cross join generate_series(0, 24) j(i)
        left join ras r on r.raster_name = t.raster_name and r.x = floor((degrees((1100000 + 20000 * (j.i + 0.5::double)) / 6378137) - 10) * 10)
        and r.y = floor((52 - degrees(2 * atan(exp((6820000 - 20000 * (i.i + 0.5::double)) / 6378137)) - pi() / 2)) * 10)""",
    "project_pixels": f"with {_CANVAS} select * from cv",
    "overlay_composite": f"""with {_CANVAS} select raster_name, y, x, case when value in (1, 4) then 0 else value * 40 end r, case value when 1 then 0 when 4 then 255 else value * 40 end g, case when value in (1, 4) then 255 else value * 40 end b, case when value in (1, 4) then 192 else 255 end a from cv""",
    "grid_canvas": f"with {B.PIXELS} select distinct raster_name, y_off + y y, x_off + x x from px where x_off % 8 = 0 and y_off % 8 = 0 and (y in (0, 7) or x in (0, 7))",
    "geojson_polygons": f"""with {B.TRIANGLES} select feature_id id, 0 part, 4326 crs, c::int corner, case c when 1 then x1 when 2 then x2 else x0 end x, case c when 1 then y1 when 2 then y2 else y0 end y from
        (select o_orderkey feature_id, o_orderkey % 40 x0, o_custkey % 40 y0, o_orderkey % 40 + 7 x1, o_custkey % 40 + 1 y1, o_orderkey % 40 + 2 x2, o_custkey % 40 + 6 y2 from orders), generate_series(0, 3) g(c)""",
    "geojson_crs": "select o_orderkey id, case o_orderkey % 4 when 0 then 4326 when 1 then 3857 when 2 then 32633 else 4326 end crs from orders",
    "polygon_bbox": f"""with {B.TRIANGLES} select feature_id, x0 "left", y0 bottom, x1 "right", y2 top from tri""",
    "polygon_areas": f"with {B.TRIANGLES} select feature_id, 20.0::double area, true valid from tri",
    "tile_polygon_candidates": f"""with {B.PIXELS}, {B.TRIANGLES}, t as (select distinct raster_name, x_off, y_off from px), f as (select *, 'r' || (feature_id % (select max(vec_id) // 100 + 1 from embeddings)) raster_name from tri)
        select raster_name, x_off, y_off, feature_id from t join f using (raster_name) where x0 <= x_off + 7 and x1 >= x_off and y0 <= y_off + 7 and y2 >= y_off""",
    "rasterize_polygons": f"with {_EDGES} select feature_id, y, x from burnt where y < 44 and x < 44",
    "rasterize_append": f"with {_EDGES} select y, x, max(category_index) category_index from burnt where y < 44 and x < 44 group by 1, 2",
    "rasterize_tiles": f"with {_EDGES}, o as (select unnest([22, 38, 6, -10]) o) select 'a' raster_name, a.o x_off, b.o y_off, y - b.o y, x - a.o x, max(category_index) category_index from burnt, o a, o b where x - a.o between 0 and 15 and y - b.o between 0 and 15 group by all",
    "buffer_polygons": f"""with {_EDGES}, sh as (select distinct on (o_orderkey % 40, o_custkey % 40) o_orderkey % 40 sx, o_custkey % 40 sy, o_orderkey fid from orders), se as (select ed.* from ed join sh on fid = feature_id),
        p as (select fid, sx, sy, x::int x, y::int y from sh, generate_series(greatest(sx - 2, 0), sx + 9) a(x), generate_series(greatest(sy - 2, 0), sy + 8) b(y)),
        d as (select p.fid, p.sx, p.sy, p.x, p.y, min(sqrt(power(p.x + 0.5 - e.ax - t * (e.bx - e.ax), 2) + power(p.y + 0.5 - e.ay - t * (e.by - e.ay), 2))) dist from
             (select p.*, e, greatest(0, least(1, ((p.x + 0.5 - e.ax) * (e.bx - e.ax) + (p.y + 0.5 - e.ay) * (e.by - e.ay)) / (power(e.bx - e.ax, 2) + power(e.by - e.ay, 2)))) t from p join se on feature_id = fid) p group by 1, 2, 3, 4, 5),
        c as (select d.sx, d.sy, count(*) filter (where b.x is not null or dist <= 1.0) grown, count(*) filter (where b.x is not null and dist >= 0.5) shrunk from d left join burnt b on b.feature_id = d.fid and b.x = d.x and b.y = d.y group by 1, 2)
        select o_orderkey feature_id, grown, shrunk from orders join c on sx = o_orderkey % 40 and sy = o_custkey % 40""",
    "vectorize_stats": f"""with {B.PIXELS} select raster_name, x_off, y_off, val as value, count(*)::double area, min(x_off + x)::double "left", max(y_off + y + 1)::double top from px where val <> 0 group by 1, 2, 3, 4""",
    "tile_pipeline": f"""with {_CUT}, s as (select raster_name, x_off, y_off from cut group by 1, 2, 3 having count(*) filter (where value = 0) < 72 and not (bool_and(value = 0) filter (where y = 0) or bool_and(value = 0) filter (where y = 11) or bool_and(value = 0) filter (where x = 0) or bool_and(value = 0) filter (where x = 11)))
        select cut.* from cut join s using (raster_name, x_off, y_off)""",
}
#: Other names under which these are known.
