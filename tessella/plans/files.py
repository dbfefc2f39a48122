"""Queries: files and their paths, GeoJSON, metadata, tags, georeferences, footprints, composition by matrix and polygon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import api
from tessella.functions import exprs as X
from tessella.operators import categories as K
from tessella.operators import compose, pixels, tiling, vector
from tessella.operators import cover as C
from tessella.operators import georeference as G
from tessella.operators.scheme import LocalScheme
from tessella.plans import bases as B
from tessella.plans import rasters as R
from tessella.plans import tiles as P
from tessella.sources import adapters as A
from tessella.sources import images, readers, sinks

#: Added before rounding, so that no exact result lies halfway between two rounded ones.
OFF_HALVES = 0.0000001
KEY = ["tile_class", "raster_name", "x_off", "y_off", "src_w", "src_h"]


def _points(json, path: str = "$.coordinates"):
    """The outer ring of a polygon written as GeoJSON, as (corner, p)."""
    return F.posexplode(F.from_json(F.get_json_object(json, path), "array<array<array<double>>>")[0]).alias("corner", "p")


def tile_bounds_json(spark, d):
    """Bounds of tiles as GeoJSON, read again."""
    t = tiling.with_georeference(tiling.local_tiles(A.rasters(spark, d), P.CENTERED, "transform"), 64, 64)
    c = t.select("raster_name", "tile_ord", _points(sinks.bounds_json("bounds")))
    return c.select("raster_name", "tile_ord", "corner", F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))


def feature_lines(spark, d):
    """Polygons as GeoJSON features with their colour, read again."""
    fill = F.struct(F.lit("#0a0b0c").alias("fill"), F.lit(0.5).alias("fill-opacity"))
    lines = A.triangles(spark, d).select(F.col("feature_id").alias("id"), sinks.feature_json(F.col("rings"), fill).alias("value"))
    found = readers.geojson_polygons(lines, "value", ["id", "value"])
    return found.select("id", F.get_json_object("value", "$.properties.fill").alias("fill"), F.size(F.col("rings")[0]).alias("points"), vector.polygon_area().alias("area"))


def pixel_corners(spark, d):
    """Corners of rasters in their CRS as GeoJSON, read again."""
    r = A.rasters(spark, d).select("raster_name", _points(sinks.feature_json(sinks.corner_ring("transform", "width", "height"), F.struct("raster_name")), "$.geometry.coordinates"))
    return r.select("raster_name", "corner", F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))


def cover_extent_text(spark, d):
    return C.extent_text(A.cover(spark, d))


def tiling_json_roundtrip(spark, d):
    t = readers.tilings_of_json(sinks.tiling_json(tiling.raster_tilings(A.rasters(spark, d), P.CENTERED)))
    number = lambda c, i: F.col(f"{c}.values")[i]
    return t.select("raster_name", "crs", "width", "height", F.round("transform.a", 6).alias("t_a"), number("origin", 0).alias("origin_x"), number("origin", 1).alias("origin_y"), number("stride", 0).alias("stride_x"), number("size", 1).alias("size_y"), F.col("size.unit").alias("unit"))


def tiling_lines(spark, d):
    """Names and values of rasters as padded lines of text."""
    r = A.rasters(spark, d)
    return r.select("raster_name", F.explode(F.array(X.padded_line(F.lit("__raster_width"), F.col("width").cast("string")), X.padded_line(F.lit("raster_height"), F.format_string("%d px", "height"), 50))).alias("line"))


def shared_tile_lines(spark, d):
    return sinks.overview_lines(R.shared_tile_counts(spark, d))


def quantities(spark, d):
    text = F.when(F.col("s_suppkey") % 2 == 0, F.format_string("[%d %d] pixel", "s_suppkey", F.col("s_suppkey") * 2)).otherwise(F.format_string("%.1f meter", F.col("s_suppkey") / 2))
    q = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", X.quantity(text).alias("q"))
    return q.select("s_suppkey", F.size("q.values").alias("n"), F.col("q.values")[0].alias("first"), F.col("q.unit").alias("unit"))


def int_lists(spark, d):
    text = F.concat_ws(", ", F.col("p_partkey").cast("string"), (F.col("p_partkey") * 3).cast("string"), F.lit("7"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.aggregate(X.int_list(text), F.lit(0), lambda s, x: s + x).alias("total"))


def raster_tags(spark, d):
    """Tags merged into those of rasters, and the pixel sizes that they state."""
    r = A.rasters(spark, d).withColumn("tags", F.create_map(F.lit("GSD"), F.format_string("(%.2f,%.2f)", "gsd", F.col("gsd") * 2), F.lit("AREA"), F.lit("old")))
    t = sinks.with_tags(r, {"AREA": "Point", "NAME": "n"})
    x, y = X.gsd("tags", "transform")
    return t.select("raster_name", F.size("tags").alias("n"), F.col("tags")["AREA"].alias("area"), x.alias("gsd_x"), y.alias("gsd_y"))


def copied_georeference(spark, d):
    """Rasters without a georeference take that of another listing."""
    r = A.rasters(spark, d)
    bare = r.withColumn("transform", X.affine(1, 0, 0, 0, 1, 0)).withColumn("crs", F.lit(None).cast("string"))
    c = sinks.copied_georeference(bare, r.where(F.col("width") % 2 == 0))
    return c.select("raster_name", "crs", F.round("transform.c", 3).alias("t_c"))


def georeference_validity(spark, d):
    r = A.rasters(spark, d).withColumn("transform", F.when(F.col("width") % 3 == 0, X.affine(1, 0, 0, 0, 1, 0)).otherwise(F.col("transform")))
    return r.select("raster_name", X.is_default_transform("transform").alias("is_default"))


def virtual_mosaic(spark, d):
    """Two layers under one another as one view, and its mosaic."""
    px = A.layered_pixels(spark, d).drop("raster_ord")
    both = images.virtual_mosaic(px.where("band = 0"), px.where("band <> 0").withColumn("band", F.lit(0)))
    return pixels.mosaic(both.groupBy("tile_id", "y", "x", "band", "raster_ord").agg(F.max("value").alias("value")), ["tile_id", "y", "x", "band"])


def granules_of_tiles(spark, d):
    """Granules of many sizes around points that meet the tiles of a cover."""
    c = A.cover(spark, d).distinct()
    tiles = c.select(X.tile_west("x", "z").alias("west"), X.tile_north(F.col("y") + 1, "z").alias("south"), X.tile_west(F.col("x") + 1, "z").alias("east"), X.tile_north("y", "z").alias("north"))
    p = A.points(spark, d)
    half = F.col("point_id") % 12 + 0.1
    granules = p.select(F.concat(F.lit("g"), "point_id").alias("granule"), (F.col("lon") - half).alias("west"), (F.col("lat") - half).alias("south"), (F.col("lon") + half).alias("east"), (F.col("lat") + half).alias("north"))
    return images.granules_of_tiles(tiles, granules)


def polygon_reprojection(spark, d):
    fx, fy = G.transformer(4326, 3857)
    moved = A.triangles(spark, d).select("feature_id", vector.map_points("rings", lambda x, y: fx(x), lambda x, y: fy(y)).alias("rings"))
    return moved.select("feature_id", vector.polygon_bounds().alias("b")).select("feature_id", *[F.round(f"b.{n}", 3).alias(n) for n in ("left", "bottom", "right", "top")])


def disk_centers(spark, d):
    x, y = X.disk_center("width", "height")
    return A.rasters(spark, d).select("raster_name", x.alias("x"), y.alias("y"))


def category_counts(spark, d):
    """How many categories there are, how many are not ignored, and the index of one by its name; with the pixels that have it."""
    c = R._categories(spark)
    n = c.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_ignore")).alias("n_not_ignored"), F.max(F.when(F.col("name") == F.lower(F.lit("TREE")), F.col("palette_index"))).alias("tree"))
    return A.tile_pixels(spark, d).groupBy(F.col("val").alias("tree")).agg(F.count("val").alias("pixels")).join(n, "tree")


def concatenated_features(spark, d):
    """Features of two files in one CRS."""
    p = readers.geojson_polygons(A.geojson(spark, d), "feature_json", ["id"])
    both = readers.concatenated(p.where("id % 2 = 0"), p.where("id % 2 = 1"))
    return both.groupBy("crs").agg(F.count("id").alias("n"), F.sum("id").alias("ids"))


def dataset_tile_class(spark, d):
    return readers.the_tile_class(readers.tiles_of_paths(A.tile_files(spark, d)))


def files_of_tiles(spark, d):
    """The file of each tile on a grid of offsets, null where there is none."""
    files = readers.tiles_of_paths(A.tile_files(spark, d)).select("tile_path", *KEY).distinct()
    keys = files.select("raster_name", "x_off", "src_w").distinct().select("raster_name", "x_off", F.explode(F.sequence(F.lit(-150), F.lit(5250), F.lit(450))).alias("y_off"), F.lit("ImagePixelTile").alias("tile_class"), "src_w", F.col("src_w").alias("src_h"))
    return readers.files_of_tiles(keys, files, KEY).select("raster_name", "x_off", "y_off", "tile_path")


def listed_files(spark, d):
    f = readers.listed_files(A.tile_files(spark, d).select(F.col("tile_path").alias("path")).distinct(), ext=".PNG", include=["/r3/", "width_offset"], ignore=["height_offset_-"])
    return f.select("path", "base_name", "stem")


def moved_paths(spark, d):
    """Paths under another root, whole and by parent folder and name."""
    f = A.tile_files(spark, d).select("file_id", "tile_path")
    return f.select("file_id", X.rerooted_path("tile_path", "image_pixel_tiles/", "predictions/tiles/").alias("rerooted"), X.normalised_tile_path("tile_path", "normal").alias("normalised"))


def tiles_within_rasters(spark, d):
    return compose.tiles_within(tiling.local_tiles(A.rasters(spark, d), P.CENTERED, "width", "height")).select("raster_name", "tile_ord", "x_off", "y_off")


def default_grids(spark, d):
    """Grids in EPSG:3857 of rasters that lie in EPSG:4326."""
    k = F.col("s_suppkey")
    r = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("raster_"), k).alias("raster_name"), (600 + (k * 37) % 400).cast("int").alias("width"), (500 + (k * 53) % 300).cast("int").alias("height"), X.affine(0.001, 0, (k % 300 - 150).cast("double"), 0, -0.001, (k % 100 - 40).cast("double")).alias("transform"))
    g = G.default_grid(r, 4326, 3857)
    return g.select("raster_name", "width", "height", F.round("grid.a", 4).alias("pixel"), F.round("grid.c", 3).alias("left"), F.round("grid.f", 3).alias("top"))


def project_matrix(spark, d):
    """Tiles composed at half their size by a matrix of each tile."""
    px = R._labels(spark, d)
    m = px.select("raster_name", "x_off", "y_off").distinct().withColumn("matrix", X.affine(0.5, 0, F.col("x_off") / 2 + 0.25, 0, 0.5, F.col("y_off") / 2 + 0.25))
    return compose.project_by_matrix(px, m, R._tilings(px))


def project_polygons(spark, d):
    return compose.project_polygons(R._labels(spark, d), (8, 8), 44, 44)


def resize_cubic(spark, d):
    out = pixels.resize_by_kernel(A.tile_pixels(spark, d).select("vec_id", "y", "x", F.col("u8").alias("value")), ["vec_id"], (8, 8), (12, 7), "cubic")
    return out.withColumn("value", F.round(F.col("value") + OFF_HALVES, 6))


def resize_lanczos(spark, d):
    out = pixels.resize_by_kernel(A.tile_pixels(spark, d).select("vec_id", "y", "x", F.col("u8").alias("value")), ["vec_id"], (8, 8), (12, 7), "lanczos")
    return out.withColumn("value", F.round(F.col("value") + OFF_HALVES, 6))


def vectorize_rings(spark, d):
    """Regions of each tile and value, with the length and the corners of their rings."""
    found = api.aggregate_polygons(R._labels(spark, d), (8, 8))
    return found.groupBy(*R.TILE, "value").agg(F.count("part").alias("regions"), F.sum(vector.ring_length()).alias("length"), F.sum(vector.ring_corners()).alias("corners"))


def dissolve_polygons(spark, d):
    """A cover as polygons of patches: their area, length and corners."""
    found = vector.dissolved_polygons(A.cover(spark, d), patch=64)
    return found.groupBy("z", "patch_x", "patch_y").agg(F.sum(vector.polygon_area()).alias("area"), F.sum(vector.ring_length()).alias("length"), F.sum(vector.ring_corners()).alias("corners"), F.min(vector.polygon_bounds()["left"]).alias("left"))


def mask_footprint(spark, d):
    """Where rasters have data, as polygons."""
    canvas = R.project_pixels(spark, d)
    found = vector.mask_footprint(canvas, F.col("value") != 2)
    return found.groupBy("raster_name").agg(F.count("part").alias("parts"), F.sum(vector.polygon_area()).alias("area"), F.sum(vector.ring_length()).alias("length"))


def covered_tile_pipeline(spark, d):
    """tile_pipeline for label tiles of a cover: the cover keeps tiles, none is dropped as empty."""
    px = R._base_raster_pixels(spark, d)
    rasters = px.select("raster_name").distinct().withColumns({"width": F.lit(40), "height": F.lit(40)})
    scheme = LocalScheme((12, 12), (9, 9))
    kept = tiling.local_tiles(rasters, scheme).where("(x_off + y_off) % 2 = 0")
    cut = api.tile(rasters, px, scheme, cover=kept, labels=True)
    return pixels.colored(cut, R._categories(spark), "value")


def category_names(spark, d):
    """Names of categories are lower-case, whatever their source writes."""
    parsed = K.from_json('[{"name": "Building", "palette_index": 1, "palette_color": "#0000ff"}, {"name": "TREE", "palette_index": 2, "palette_color": [0, 255, 0], "is_ignore": true}]', include_ignore=True)
    c = K.to_df(spark, parsed).select("name", "palette_index", X.rgb_hex(*[F.col("palette_color")[i] for i in range(3)]).alias("color"))
    return A.tile_pixels(spark, d).groupBy(F.col("val").alias("palette_index")).agg(F.count("val").alias("n")).join(c, "palette_index").select("name", "color", "n")


QUERIES = {
    f.__name__: f
    for f in (
        tile_bounds_json, feature_lines, pixel_corners, cover_extent_text, tiling_json_roundtrip, tiling_lines, shared_tile_lines, quantities, int_lists, raster_tags, copied_georeference, georeference_validity, virtual_mosaic, granules_of_tiles,
        polygon_reprojection, disk_centers, category_counts, concatenated_features, dataset_tile_class, files_of_tiles, listed_files, moved_paths, tiles_within_rasters, default_grids, project_matrix, project_polygons, resize_cubic, resize_lanczos,
        vectorize_rings, dissolve_polygons, mask_footprint, covered_tile_pipeline, category_names,
    )
}


def _kernel_sql(weight: str, reach: int) -> str:
    """resize_by_kernel as SQL; weight of |d|."""
    taps = lambda name, at, n, m: f"""{name} as (select {at}, greatest(0, least({n - 1}, floor(p) + k))::int s, {weight} w from (select *, abs(p - floor(p) - k) d from (select i::int {at}, (i + 0.5::double) * {n} / {m} - 0.5 p from generate_series(0, {m - 1}) g(i)), generate_series({1 - reach}, {reach}) h(k)))"""
    share = lambda name, at: f"select {at}, s, sum(w) / sum(sum(w)) over (partition by {at}) w from {name} group by 1, 2"
    return f"""with {B.PIXELS}, {taps('ty', 'y', 8, 7)}, {taps('tx', 'x', 8, 12)}, wy as ({share('ty', 'y')}), wx as ({share('tx', 'x')})
        select vec_id, wy.y as y, wx.x as x, round(sum(u8 * wy.w * wx.w) + {OFF_HALVES:.7f}::double, 6) as value from px join wy on wy.s = px.y join wx on wx.s = px.x group by 1, 2, 3"""


#: Cells (k, y, x, v): of each the sides and corners that its region's rings have there. A side counts where the neighbour differs, a corner where both neighbours at it differ, or both are alike and the cell between them is not.
_OUTLINE = """nb as (select c.k, c.y, c.x, c.v, bool_or(n.y = c.y - 1 and n.x = c.x) u, bool_or(n.y = c.y + 1 and n.x = c.x) d, bool_or(n.y = c.y and n.x = c.x - 1) l, bool_or(n.y = c.y and n.x = c.x + 1) r,
        bool_or(n.y = c.y - 1 and n.x = c.x - 1) ul, bool_or(n.y = c.y - 1 and n.x = c.x + 1) ur, bool_or(n.y = c.y + 1 and n.x = c.x - 1) dl, bool_or(n.y = c.y + 1 and n.x = c.x + 1) dr
        from cell c join cell n on n.k = c.k and n.v = c.v and abs(n.y - c.y) <= 1 and abs(n.x - c.x) <= 1 group by 1, 2, 3, 4),
    outline as (select *, (not u)::int + (not d)::int + (not l)::int + (not r)::int sides,
        (u = l and not (u and ul))::int + (u = r and not (u and ur))::int + (d = l and not (d and dl))::int + (d = r and not (d and dr))::int corners from nb)"""
#: The least cell that each cell reaches over neighbours of its value: regions are their different values.
_REACH = """reach(k, v, y, x, ty, tx) as (select k, v, y, x, y, x from cell union select r.k, r.v, r.y, r.x, c.y, c.x from reach r join cell c on c.k = r.k and c.v = r.v and abs(c.y - r.ty) + abs(c.x - r.tx) = 1),
    region as (select k, v, y, x, min(ty * 100000 + tx) g from reach group by 1, 2, 3, 4)"""

REGIONS_SQL = f"""with recursive {B.PIXELS}, cell as (select vec_id k, raster_name, x_off, y_off, y, x, val v from px where val <> 0), {_REACH}
    select raster_name, x_off, y_off, v as value, count(distinct g) regions from region join (select distinct vec_id k, raster_name, x_off, y_off from px) using (k) group by 1, 2, 3, 4"""

ORACLE_SQL = {
    "tile_bounds_json": f"""{P._CENTERED}, b as (select raster_name, tile_ord, round(origin_x + gsd * x_off, 6) l, round(origin_y - gsd * (y_off + src_h), 6) b, round(origin_x + gsd * (x_off + src_w), 6) r, round(origin_y - gsd * y_off, 6) t from tiles join rasters using (raster_name))
        select raster_name, tile_ord, c::int corner, case when c in (1, 2) then r else l end x, case when c in (2, 3) then b else t end y from b, generate_series(0, 4) g(c)""",
    "feature_lines": f"with {B.TRIANGLES} select feature_id id, '#0a0b0c' fill, 4 points, 20.0::double area from tri",
    "pixel_corners": f"""with {B.RASTERS} select raster_name, c::int corner, round(origin_x + case when c in (2, 3) then gsd * width else 0 end, 6) x, round(origin_y - case when c in (1, 2) then gsd * height else 0 end, 6) y from rasters, generate_series(0, 4) g(c)""",
    "cover_extent_text": f"""with {B.COVER} select printf('%.8f,%.8f,%.8f,%.8f', min({P._WEST}), min({P._NORTH.format(y='(y + 1)')}), max({P._NORTH.format(y='y')}), max((x + 1) / 1024.0::double * 360 - 180)) as value from cov""",
    "tiling_json_roundtrip": f"with {B.RASTERS} select raster_name, 'EPSG:32633' crs, width, height, round(gsd, 6) t_a, (width // 2)::double origin_x, (height // 2)::double origin_y, 45.0::double stride_x, 90.0::double size_y, 'pixel' unit from rasters",
    "tiling_lines": f"""with {B.RASTERS} select raster_name, rpad('raster_width', 40, ' ') || width line from rasters union all select raster_name, rpad('raster_height', 50, ' ') || height || ' px' from rasters""",
    "shared_tile_lines": f"""with {B.LAYERED}, r as (select distinct tile_id, y, x, raster_ord from lay where value > 0), n as (select *, count(*) over (partition by tile_id, y, x) n from r)
        select raster_ord raster, rpad('raster ' || raster_ord, 40, ' ') || count(*) filter (where n = 1) || ' non-shared, ' || count(*) filter (where n > 1) || ' shared' line from n group by 1""",
    "quantities": """select s_suppkey, case when s_suppkey % 2 = 0 then 2 else 1 end n, case when s_suppkey % 2 = 0 then s_suppkey::double else printf('%.1f', s_suppkey / 2)::double end "first", case when s_suppkey % 2 = 0 then 'pixel' else 'meter' end unit from supplier""",
    "int_lists": "select p_partkey, (p_partkey * 4 + 7)::int total from part",
    "raster_tags": f"with {B.RASTERS} select raster_name, 3 n, 'Point' area, printf('%.2f', gsd)::double gsd_x, printf('%.2f', gsd * 2)::double gsd_y from rasters",
    "copied_georeference": f"with {B.RASTERS} select raster_name, case when width % 2 = 0 then 'EPSG:32633' end crs, case when width % 2 = 0 then round(origin_x, 3) end t_c from rasters",
    "georeference_validity": f"with {B.RASTERS} select raster_name, width % 3 = 0 is_default from rasters",
    "virtual_mosaic": f"""with {B.LAYERED}, v as (select tile_id, y, x, (band > 0)::int o, max(value) as value from lay group by 1, 2, 3, 4) select tile_id, y, x, 0 band, coalesce(arg_min(value, o) filter (where value <> 0), 0) as value from v group by 1, 2, 3""",
    "granules_of_tiles": f"""with {B.COVER}, {B.POINTS}, t as (select {P._WEST} w, {P._NORTH.format(y='(y + 1)')} s, (x + 1) / 1024.0::double * 360 - 180 e, {P._NORTH.format(y='y')} n from cov)
        select 'g' || point_id granule from points where exists (select 1 from t where w <= lon + (point_id % 12 + 0.1::double) and e >= lon - (point_id % 12 + 0.1::double) and s <= lat + (point_id % 12 + 0.1::double) and n >= lat - (point_id % 12 + 0.1::double))""",
    "polygon_reprojection": f"""with {B.TRIANGLES} select feature_id, round(radians(x0) * 6378137, 3) "left", round(ln(tan(pi() / 4 + radians(y0) / 2)) * 6378137, 3) bottom, round(radians(x1) * 6378137, 3) "right", round(ln(tan(pi() / 4 + radians(y2) / 2)) * 6378137, 3) top from tri""",
    "disk_centers": f"with {B.RASTERS} select raster_name, width / 2 x, height / 2 y from rasters",
    "category_counts": f"with {B.PIXELS}, {B.CATEGORIES} select 2 tree, count(*) pixels, (select count(*) from cats) n, (select count(*) from cats where not is_ignore) n_not_ignored from px where val = 2",
    "concatenated_features": "select 4326 crs, count(*) n, sum(o_orderkey)::bigint ids from orders",
    "dataset_tile_class": f"with {B.FILES} select 'ImagePixelTile' tile_class from files limit 1",
    "files_of_tiles": f"""with {B.FILES}, t as (select distinct tile_path, regexp_extract(tile_path, 'tiles/([^/]+)', 1) raster_name, regexp_extract(tile_path, 'width_offset_([-0-9]+)', 1)::int x_off, regexp_extract(tile_path, 'height_offset_([-0-9]+)', 1)::int y_off from files where ends_with(tile_path, '.png'))
        select k.raster_name, k.x_off, k.y_off::int y_off, t.tile_path from (select distinct raster_name, x_off, y_off from (select distinct raster_name, x_off from t), generate_series(-150, 5250, 450) g(y_off)) k left join t on (t.raster_name, t.x_off, t.y_off) = (k.raster_name, k.x_off, k.y_off)""",
    "listed_files": f"""with {B.FILES} select distinct tile_path path, regexp_extract(tile_path, '[^/]*$') base_name, regexp_replace(tile_path, '\\.[^./]*$', '') stem from files where ends_with(tile_path, '.png') and contains(tile_path, '/r3/') and not contains(tile_path, 'height_offset_-')""",
    "moved_paths": f"""with {B.FILES} select file_id, replace(tile_path, 'image_pixel_tiles/', 'predictions/tiles/') rerooted, 'normal/' || regexp_extract(tile_path, '[^/]*/[^/]*$') normalised from files""",
    "tiles_within_rasters": f"{P._CENTERED} select raster_name, tile_ord, x_off, y_off from tiles join rasters using (raster_name) where x_off >= 0 and y_off >= 0 and x_off + src_w < width and y_off + src_h < height",
    "default_grids": """with r as (select 'raster_' || s_suppkey raster_name, 600 + (s_suppkey * 37) % 400 w, 500 + (s_suppkey * 53) % 300 h, (s_suppkey % 300 - 150)::double lon, (s_suppkey % 100 - 40)::double lat from supplier),
        m as (select raster_name, w, h, radians(lon) * 6378137 l, radians(lon + w * 0.001::double) * 6378137 r, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137 t, ln(tan(pi() / 4 + radians(lat - h * 0.001::double) / 2)) * 6378137 b from r),
        p as (select *, sqrt((r - l) * (r - l) + (t - b) * (t - b)) / sqrt((w * w + h * h)::double) p from m)
        select raster_name, floor((r - l) / p + 0.5)::int width, floor((t - b) / p + 0.5)::int height, round(p, 4) pixel, round(l, 3) "left", round(t, 3) top from p""",
    "project_matrix": f"""with {B.PIXELS}, m as (select raster_name, trunc(y * 0.5 + y_off / 2 + 0.25)::int ry, trunc(x * 0.5 + x_off / 2 + 0.25)::int rx, x_off, y_off, y, x, val from px) select raster_name, ry y, rx x, arg_max(val, (x_off, y_off, y, x)) as value from m group by 1, 2, 3""",
    "project_polygons": f"with {B.PIXELS} select raster_name, y_off + y y, x_off + x x, max(val) as value from px group by 1, 2, 3 having max(val) > 0",
    "resize_cubic": _kernel_sql("case when d <= 1 then (1.25::double * d - 2.25::double) * d * d + 1 when d < 2 then ((-0.75::double * d + 3.75::double) * d - 6) * d + 3 else 0 end", 2),
    "resize_lanczos": _kernel_sql("case when d = 0 then 1 when d < 4 then sin(pi() * d) / (pi() * d) * sin(pi() * d / 4) / (pi() * d / 4) else 0 end", 4),
    "vectorize_rings": f"""with recursive {B.PIXELS}, cell as (select vec_id k, y, x, val v from px where val <> 0), {_REACH}, {_OUTLINE}, o as (select k, v, sum(sides)::double length, sum(corners)::bigint corners from outline group by 1, 2), g as (select k, v, count(distinct g) regions from region group by 1, 2)
        select raster_name, x_off, y_off, v as value, regions, length, corners from o join g using (k, v) join (select distinct vec_id k, raster_name, x_off, y_off from px) using (k)""",
    "dissolve_polygons": f"""with {B.COVER}, cell as (select z * 10000 + (x // 64) * 100 + y // 64 k, y, x, 1 v from cov), {_OUTLINE}
        select (k // 10000)::int z, (k // 100 % 100)::int patch_x, (k % 100)::int patch_y, count(*)::double area, sum(sides)::double length, sum(corners)::bigint corners, min(x)::double "left" from outline group by 1, 2, 3""",
    "mask_footprint": f"""with recursive {R._CANVAS}, cell as (select raster_name k, y, x, 1 v from cv where value <> 2), edge as (select * from cell), lab as (select k, y, x, y * 1000 + x g from cell), {_OUTLINE},
        step(i, k, y, x, g) as (select 0, k, y, x, g from lab union all select s.i + 1, s.k, s.y, s.x, min(n.g) from step s join step n on n.k = s.k and abs(n.y - s.y) + abs(n.x - s.x) <= 1 where s.i < 150 group by 1, 2, 3, 4)
        select o.k raster_name, (select count(distinct g) from step s where s.i = 150 and s.k = o.k) parts, count(*)::double area, sum(sides)::double length from outline o group by 1""",
    "covered_tile_pipeline": f"with {R._CUT}, {B.CATEGORIES} select raster_name, x_off, y_off, y, x, value, r, g, b from cut join cats on palette_index = value where (x_off + y_off) % 2 = 0",
    "category_names": f"""with {B.PIXELS} select case val when 1 then 'building' else 'tree' end as name, case val when 1 then '#0000ff' else '#00ff00' end color, count(*) n from px where val in (1, 2) group by 1, 2""",
}
