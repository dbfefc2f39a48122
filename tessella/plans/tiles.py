"""Queries: tile enumeration, covers, mercator maths, statistics, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import exprs as X
from tessella.operators import cover as C
from tessella.operators import georeference as G
from tessella.operators import stats, tiling
from tessella.operators.scheme import LocalScheme
from tessella.plans import bases as B
from tessella.sources import adapters as A
from tessella.sources import readers, sinks

CENTERED = LocalScheme((90, 90), (45, 45))
LAYOUTS = {
    "tile_layout_centered": CENTERED,
    "tile_layout_optimized": LocalScheme((90, 80), (90, 80), alignment="optimized"),
    "tile_layout_border": LocalScheme((90, 90), (33.5, 40.25), alignment="aligned_to_image_border"),
    "tile_layout_no_overhang": LocalScheme((90, 90), (45, 45), overhang=False),
    "tile_layout_base_aligned": LocalScheme((90, 90), (40, 40), alignment="optimized", align_to_base=True),
}
METERS = LocalScheme((9, 9), (4.5, 6), unit="meter")


def _layout_sql(scheme: LocalScheme) -> str:
    """The layout of both axes as SQL over rasters: size and stride expressions by unit."""
    conv = "ceil" if scheme.overhang else "floor"
    meter = scheme.unit == "meter"
    parts = []
    for axis, length, i in (("x", "width", 0), ("y", "height", 1)):
        size = f"({scheme.size[i]}::double / gsd)" if meter else f"{scheme.size[i]}::double"
        stride = f"({scheme.stride[i]}::double / gsd)" if meter else f"{scheme.stride[i]}::double"
        base = f"{stride} * greatest(round_even({size} / {stride}, 0), 1)" if scheme.align_to_base else stride
        origin = {
            "centered_to_image": "floor(len / 2.0)",
            "aligned_to_image_border": "0",
            "optimized": f"floor((len - (greatest({conv}((len + base - size) / base), 0) * base + size - base)) / 2)",
        }[scheme.alignment]
        parts.append(f"""
  {axis}0 as (select raster_name, {length} len, trunc({size})::int size, {stride} stride, {base} base from rasters),
  {axis}1 as (select *, ({origin})::int origin from {axis}0),
  {axis}2 as (select *, greatest({conv}((len - origin + stride - size) / stride), 0)::int pos, greatest({conv}((origin + least(size - stride, len - origin) + stride - size) / stride), 0)::int neg from {axis}1),
  {axis}s as (select raster_name, size, i - 1 ord, (case when i <= neg then origin - floor(i * stride) else origin + floor((i - neg - 1) * stride) end)::int off, neg + pos n
          from {axis}2, generate_series(1, neg + pos) g(i))""")
    return f"with {B.RASTERS}, {','.join(parts)}, tiles as (select xs.raster_name, (xs.ord * ys.n + ys.ord)::int tile_ord, xs.off x_off, ys.off y_off, xs.size src_w, ys.size src_h from xs join ys using (raster_name))"


def _layout(scheme: LocalScheme):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return tiling.local_tiles(A.rasters(spark, d), scheme)

    return query


def tile_count_closed_form(spark, d):
    """Tiles of each raster by the closed form, by enumeration, and of these the ones inside the raster."""
    n = (F.col("layout_x.negative") + F.col("layout_x.positive")) * (F.col("layout_y.negative") + F.col("layout_y.positive"))
    inside = F.count_if((F.col("x_off") >= 0) & (F.col("y_off") >= 0) & (F.col("x_off") + F.col("src_w") <= F.col("width")) & (F.col("y_off") + F.col("src_h") <= F.col("height")))
    t = tiling.local_tiles(A.rasters(spark, d), CENTERED, "width", "height", n.cast("int").alias("closed"))
    return t.groupBy("raster_name", "closed").agg(F.count("tile_ord").cast("int").alias("listed"), inside.cast("int").alias("inside"))


def debug_first_k_tiles(spark, d):
    return tiling.first_local_tiles(A.rasters(spark, d), CENTERED, 5)


def tile_transform(spark, d):
    t = tiling.with_georeference(tiling.local_tiles(A.rasters(spark, d), CENTERED, "transform"), 64, 64)
    return t.select("raster_name", "tile_ord", *[F.round(f"transform.{n}", 6).alias(f"t_{n}") for n in "acef"])


def tile_bounds(spark, d):
    t = tiling.with_georeference(tiling.local_tiles(A.rasters(spark, d), CENTERED, "transform"), 64, 64)
    return t.select("raster_name", "tile_ord", *[F.round(f"bounds.{n}", 6).alias(n) for n in ("left", "bottom", "right", "top")])


def tile_paths(spark, d):
    t = tiling.local_tiles(A.rasters(spark, d), CENTERED)
    return t.select("raster_name", "tile_ord", X.local_tile_path("raster_name", "x_off", "y_off", "src_w", "src_h").alias("tile_path"))


def tile_path_parse(spark, d):
    return readers.tiles_of_paths(A.tile_files(spark, d)).select("file_id", "tile_class", "raster_name", "x_off", "y_off", "src_w", "src_h")


def files_minus_ignored(spark, d):
    return readers.without_ignored(A.tile_files(spark, d), "tile_path", r"\.(png|xml)$", r"\.aux\.xml$").groupBy("tile_path").agg(F.count("file_id").alias("n"))


def paired_files(spark, d):
    """Tile files and their sidecars by the name of the tile."""
    f = A.tile_files(spark, d).select(F.col("tile_path").alias("path")).distinct()
    stem = F.regexp_replace("path", r"(\.aux\.xml)$", "")
    return readers.paired(f.where(~F.col("path").endswith(".xml")), f.where(F.col("path").endswith(".xml")), stem, stem).select("left_path", "right_path")


def natural_sort_key(spark, d):
    return A.tile_files(spark, d).select("file_id", X.natural_key("tile_path").alias("sort_key"))


def mercator_index(spark, d):
    p = A.points(spark, d)
    return p.select("point_id", X.mercator_x("lon", F.lit(12)).alias("x"), X.mercator_y("lat", F.lit(12)).alias("y"))


def mercator_bounds(spark, d):
    c = A.cover(spark, d).distinct()
    b = [X.tile_west("x", "z"), X.tile_north(F.col("y") + 1, "z"), X.tile_west(F.col("x") + 1, "z"), X.tile_north("y", "z"), X.tile_left_3857("x", "z"), X.tile_top_3857("y", "z")]
    return c.select("z", "x", "y", *[F.round(e, 6).alias(n) for e, n in zip(b, ("west", "south", "east", "north", "left_3857", "top_3857"), strict=True)])


def mercator_tiles_of_bbox(spark, d):
    """Tiles of boxes around points; boxes that go on beyond the antimeridian have both parts."""
    w, e = F.col("lon") - 0.3, F.col("lon") + 0.3
    boxes = A.points(spark, d).select("point_id", F.when(w < -180, w + 360).otherwise(w).alias("w"), (F.col("lat") - 0.2).alias("s"), F.when(e > 180, e - 360).otherwise(e).alias("e"), (F.col("lat") + 0.2).alias("n"))
    return C.tiles_of_bounds(boxes, "w", "s", "e", "n", 9).select("point_id", "z", "x", "y")


def mercator_footprint(spark, d):
    ring = A.cover(spark, d).distinct().select("z", "x", "y", F.posexplode(sinks.mercator_footprint()[0]).alias("corner", "p"))
    return ring.select("z", "x", "y", "corner", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


def lonlat_to_3857(spark, d):
    return A.points(spark, d).select("point_id", F.round(X.lon_to_3857("lon"), 4).alias("x"), F.round(X.lat_to_3857("lat"), 4).alias("y"))


def utm_round_trip(spark, d):
    """UTM coordinates of points moved into zone 33, and the points that these lead back to."""
    p = A.points(spark, d).select("point_id", (F.col("lon") / 60 + 15).alias("lon"), F.abs("lat").alias("lat")).where("lat < 84")
    e, n = X.utm("lon", "lat", 33)
    there = p.select("point_id", e.alias("e"), n.alias("n"))
    lon, lat = X.utm_inverse("e", "n", 33)
    return there.select("point_id", F.round("e", 3).alias("easting"), F.round("n", 3).alias("northing"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def cover_distinct(spark, d):
    c = A.cover(spark, d)
    p = A.points(spark, d)
    return C.union_distinct(c, p.select(F.lit(10).alias("z"), X.mercator_x("lon", F.lit(10)).alias("x"), X.mercator_y("lat", F.lit(10)).alias("y")))


def cover_zoom_in(spark, d):
    return C.at_zoom(A.cover(spark, d), 12)


def cover_zoom_out(spark, d):
    return C.at_zoom(A.cover(spark, d), 7)


def cover_extent(spark, d):
    return C.extent(A.cover(spark, d)).select(*[F.round(c, 8).alias(c) for c in ("west", "south", "north", "east")])


def cover_split(spark, d):
    return C.split(A.cover(spark, d), [50, 15, 35], 7)


def cover_semi_join(spark, d):
    tiles = A.points(spark, d).select("point_id", F.lit(10).alias("z"), X.mercator_x("lon", F.lit(10)).alias("x"), (F.col("point_id") % 1024).cast("int").alias("y"))
    return C.keep_covered(tiles, A.cover(spark, d))


def cover_csv_roundtrip(spark, d):
    """Cover lines written as text and parsed again."""
    web = A.cover(spark, d).distinct()
    local = A.tile_pixels(spark, d).select("raster_name", "x_off", "y_off", "src_w", "src_h").distinct()
    lines = web.select(sinks.cover_lines(web).alias("value")).unionByName(local.select(sinks.cover_lines(local).alias("value")))
    return readers.parse_cover_lines(lines).drop("extra")


def tile_json_roundtrip(spark, d):
    t = tiling.local_tiles(A.rasters(spark, d), CENTERED)
    return readers.tiles_of_json(t.select(sinks.tile_json(t).alias("value")), "value").select("tile_class", "raster_name", "x_off", "y_off", "src_w", "src_h")


def pixel_coordinates(spark, d):
    """Coordinates of the centre pixel of every tile."""
    t = tiling.local_tiles(A.rasters(spark, d), CENTERED, "transform")
    x, y = X.pixel_coord("transform", F.col("x_off") + F.floor(F.col("src_w") / 2), F.col("y_off") + F.floor(F.col("src_h") / 2))
    return t.select("raster_name", "tile_ord", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def dissolve_edges(spark, d):
    return C.dissolved_edges(A.cover(spark, d))


def neighbors(spark, d):
    t = A.cover(spark, d).distinct()
    return tiling.neighbours(t, "x", "y")


def surrounded_tiles(spark, d):
    t = A.tile_pixels(spark, d).select("raster_name", "x_off", "y_off").distinct()
    return tiling.surrounded(t, ["raster_name"], "x_off", "y_off", 4, 4)


def border_pixels(spark, d):
    t = A.tile_pixels(spark, d).select("raster_name", "x_off", "y_off", "src_w", "src_h").distinct()
    return tiling.border_pixels(t, thickness=2)


def tiling_statistics(spark, d):
    out = stats.tiling_statistics(stats.tile_metrics(tiling.local_tiles(A.rasters(spark, d), METERS, "transform"), 64, 64))
    return out.select("raster_name", "n_tiles", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def tiling_statistics_rollup(spark, d):
    out = stats.tiling_statistics_rollup(stats.tile_metrics(tiling.local_tiles(A.rasters(spark, d), METERS, "transform"), 64, 64))
    return out.select("raster_name", "n_tiles", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def ratio_comment(spark, d):
    s = stats.tiling_statistics(stats.tile_metrics(tiling.local_tiles(A.rasters(spark, d), METERS, "transform"), 64, 64))
    return s.select("raster_name", X.ratio_comment("width_ratio_avg").alias("comment"))


def tiling_metadata(spark, d):
    return sinks.tiling_json(tiling.raster_tilings(A.rasters(spark, d), CENTERED)).select("raster_name", F.get_json_object("value", "$.tiling_info.tiling_source_offset_int").alias("origin"), F.get_json_object("value", "$.raster_width").cast("int").alias("width"))


def reprojected_bounds(spark, d):
    c = A.cover(spark, d).distinct()
    b = F.struct(X.tile_west("x", "z").alias("left"), X.tile_north(F.col("y") + 1, "z").alias("bottom"), X.tile_west(F.col("x") + 1, "z").alias("right"), X.tile_north("y", "z").alias("top"))
    m = c.select("z", "x", "y", G.reprojected_bounds(b, 4326, 3857).alias("b"))
    return m.select("z", "x", "y", *[F.round(f"b.{n}", 3).alias(n) for n in ("left", "bottom", "right", "top")])


def gcp_transform(spark, d):
    """Transforms fitted to the corners and centre of each raster."""
    r = tiling.dealt(A.rasters(spark, d), "raster_name")
    at = lambda c, w: F.struct(w.alias("row"), c.alias("col"), X.apply_x("transform", c, w).alias("x"), X.apply_y("transform", c, w).alias("y"))
    zero, w, h = F.lit(0), F.col("width"), F.col("height")
    fitted = r.select("raster_name", G.resolved_transform(X.affine(1, 0, 0, 0, 1, 0), F.array(at(zero, zero), at(w, zero), at(w, h), at(zero, h), at(F.floor(w / 2), F.floor(h / 2)))).alias("t"))
    return fitted.select("raster_name", *[F.round(f"t.{n}", 4).alias(f"t_{n}") for n in "abcdef"])


def mercator_tile_pixel_size(spark, d):
    c = A.cover(spark, d).distinct()
    w, h = G.tile_size_in_pixels(X.affine(0.001, 0, -180.0, 0, -0.0005, 90.0), "x", "y", "z")
    return c.select("z", "x", "y", F.round(w, 4).alias("w"), F.round(h, 4).alias("h"))


_CENTERED = _layout_sql(CENTERED)
_METRICS = f"""{_layout_sql(METERS)}, m as (select raster_name, (src_w * gsd + src_h * gsd) / 2 real_world_extent, src_w::double source_width, src_h::double source_height, 64::double / src_w width_ratio, 64::double / src_h height_ratio
  from tiles join rasters using (raster_name))"""
_SUMMARY = ", ".join(f"round({f}({m}), 6) {m}_{f}" for m in stats.METRICS for f in ("avg", "min", "max"))
_WEST = "x / 1024.0::double * 360 - 180"
_NORTH = "degrees(atan((exp(pi() * (1 - 2 * {y} / 1024.0::double)) - exp(-pi() * (1 - 2 * {y} / 1024.0::double))) / 2))"
_IDX = "greatest(least(floor(({lon} / 360.0::double + 0.5 + 1e-14::double) * {n}), {n} - 1), 0)::int"
_IDY = "greatest(least(floor((0.5::double - ln((1 + sin(radians(greatest(least({lat}, 85.051129::double), -85.051129::double)))) / (1 - sin(radians(greatest(least({lat}, 85.051129::double), -85.051129::double))))) * 0.25 / pi() + 1e-14::double) * {n}), {n} - 1), 0)::int"

QUERIES = {name: _layout(s) for name, s in {**LAYOUTS, "tile_layout_meters": METERS}.items()} | {
    f.__name__: f
    for f in (
        tile_count_closed_form, debug_first_k_tiles, tile_transform, tile_bounds, tile_paths, tile_path_parse, files_minus_ignored, paired_files, natural_sort_key, mercator_index, mercator_bounds, mercator_tiles_of_bbox,
        mercator_footprint, lonlat_to_3857, utm_round_trip, cover_distinct, cover_zoom_in, cover_zoom_out, cover_extent, cover_split, cover_semi_join, cover_csv_roundtrip, tile_json_roundtrip, pixel_coordinates, dissolve_edges, neighbors, surrounded_tiles, border_pixels,
        tiling_statistics, tiling_statistics_rollup, ratio_comment, tiling_metadata, reprojected_bounds, gcp_transform, mercator_tile_pixel_size,
    )
}

ORACLE_SQL = {name: f"{_layout_sql(s)} select * from tiles" for name, s in {**LAYOUTS, "tile_layout_meters": METERS}.items()} | {
    "tile_count_closed_form": f"{_CENTERED} select raster_name, count(*)::int closed, count(*)::int listed, (count(*) filter (where x_off >= 0 and y_off >= 0 and x_off + src_w <= width and y_off + src_h <= height))::int inside from tiles join rasters using (raster_name) group by 1",
    "debug_first_k_tiles": f"{_CENTERED} select * from tiles qualify row_number() over (partition by raster_name order by tile_ord) <= 5",
    "tile_transform": f"""{_CENTERED} select raster_name, tile_ord, round(gsd * src_w / 64, 6) t_a, round(origin_x + gsd * x_off, 6) t_c, round(-gsd * src_h / 64, 6) t_e, round(origin_y - gsd * y_off, 6) t_f from tiles join rasters using (raster_name)""",
    "tile_bounds": f"""{_CENTERED} select raster_name, tile_ord, round(origin_x + gsd * x_off, 6) "left", round(origin_y - gsd * (y_off + src_h), 6) bottom, round(origin_x + gsd * (x_off + src_w), 6) "right", round(origin_y - gsd * y_off, 6) top from tiles join rasters using (raster_name)""",
    "tile_paths": f"""{_CENTERED} select raster_name, tile_ord, 'image_pixel_tiles/' || raster_name || '/width_height_' || src_w || '_' || src_h || '/width_offset_' || x_off || '/height_offset_' || y_off || '.png' tile_path from tiles""",
    "tile_path_parse": f"""with {B.FILES} select file_id, 'ImagePixelTile' tile_class, 'r' || (file_id // 2 % 7) raster_name, ((file_id // 2 % 13) * 450 - 150)::int x_off, ((file_id // 2 % 11) * 450 - 150)::int y_off, 900 src_w, 900 src_h from files where not ends_with(tile_path, '.aux.xml')""",
    "files_minus_ignored": f"with {B.FILES} select tile_path, count(*) n from files where ends_with(tile_path, '.png') group by 1",
    "paired_files": f"with {B.FILES} select distinct a.tile_path left_path, b.tile_path right_path from files a join files b on b.tile_path = a.tile_path || '.aux.xml'",
    "natural_sort_key": f"""with {B.FILES} select file_id, array_to_string(list_transform(regexp_extract_all(tile_path, '[0-9]+|[^0-9]+'), lambda p: case when regexp_matches(p, '^[0-9]') then lpad(p, 20, '0') else p end), '') sort_key from files""",
    "mercator_index": f"with {B.POINTS} select point_id, {_IDX.format(lon='lon', n=4096)} x, {_IDY.format(lat='lat', n=4096)} y from points",
    "mercator_bounds": f"""with {B.COVER} select z, x, y, round({_WEST}, 6) west, round({_NORTH.format(y='(y + 1)')}, 6) south, round({_WEST} + 360 / 1024.0::double, 6) east, round({_NORTH.format(y='y')}, 6) north,
        round(x / 1024.0::double * 40075016.685578488 - 20037508.342789244, 6) left_3857, round(20037508.342789244 - y / 1024.0::double * 40075016.685578488, 6) top_3857 from cov""",
    "mercator_tiles_of_bbox": f"""with {B.POINTS}, b as (select point_id, case when lon - 0.3::double < -180 then lon - 0.3::double + 360 else lon - 0.3::double end w, lat - 0.2::double s, case when lon + 0.3::double > 180 then lon + 0.3::double - 360 else lon + 0.3::double end e, lat + 0.2::double n from points),
        p as (select point_id, s, n, {_IDX.format(lon='w', n=512)} x0, case when w <= e then {_IDX.format(lon='(e - 1e-11::double)', n=512)} else 511 end x1 from b union all select point_id, s, n, 0, {_IDX.format(lon='(e - 1e-11::double)', n=512)} from b where w > e),
        r as (select point_id, x0, x1, {_IDY.format(lat='n', n=512)} y0, {_IDY.format(lat='(s + 1e-11::double)', n=512)} y1 from p)
        select point_id, 9 z, x::int x, y::int y from r, generate_series(x0, greatest(x0, x1)) gx(x), generate_series(y0, greatest(y0, y1)) gy(y)""",
    "mercator_footprint": f"""with {B.COVER}, e as (select *, round({_WEST}, 6) w, round((x + 1) / 1024.0::double * 360 - 180, 6) e, round({_NORTH.format(y='y')}, 6) n, round({_NORTH.format(y='(y + 1)')}, 6) s from cov)
        select z, x, y, c::int corner, case when c in (0, 1, 4) then w else e end lon, case when c in (1, 2) then n else s end lat from e, generate_series(0, 4) g(c)""",
    "lonlat_to_3857": f"with {B.POINTS} select point_id, round(radians(lon) * 6378137, 4) x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 4) y from points",
    "cover_distinct": f"with {B.COVER}, {B.POINTS} select z, x, y from cov union select 10, {_IDX.format(lon='lon', n=1024)}, {_IDY.format(lat='lat', n=1024)} from points",
    "cover_zoom_in": f"with {B.COVER} select 12 z, (x * 4 + i)::int x, (y * 4 + j)::int y from cov, generate_series(0, 3) a(i), generate_series(0, 3) b(j)",
    "cover_zoom_out": f"with {B.COVER} select distinct 7 z, (x // 8)::int x, (y // 8)::int y from cov",
    "cover_extent": f"with {B.COVER} select round(min({_WEST}), 8) west, round(min({_NORTH.format(y='(y + 1)')}), 8) south, round(max({_NORTH.format(y='y')}), 8) north, round(max((x + 1) / 1024.0::double * 360 - 180), 8) east from cov",
    "cover_split": f"""with {B.COVER}, p as (select *, row_number() over (order by md5(z || ',' || x || ',' || y || ',7')) i, count(*) over () n from cov),
        s as (select *, n * 50 // 100 a, n * 15 // 100 b, n * 35 // 100 c from p), t as (select *, a + case when n > 100 then n - a - b - c else 0 end a2 from s)
        select z, x, y, case when i <= a2 then 0 when i <= a2 + b then 1 else 2 end::int split from t where i <= a2 + b + c""",
    "cover_semi_join": f"with {B.COVER}, {B.POINTS}, t as (select point_id, 10 z, {_IDX.format(lon='lon', n=1024)} x, (point_id % 1024)::int y from points) select * from t where (z, x, y) in (select (z, x, y) from cov)",
    "cover_csv_roundtrip": f"""with {B.COVER}, {B.PIXELS} select 'MercatorTile' tile_class, z, x, y, null::varchar raster_name, null::int x_off, null::int y_off, null::int src_w, null::int src_h from cov
        union all select distinct 'ImagePixelTile', null, null, null, raster_name, x_off, y_off, src_w, src_h from px""",
    "tile_json_roundtrip": f"{_CENTERED} select 'ImagePixelTile' tile_class, raster_name, x_off, y_off, src_w, src_h from tiles",
    "pixel_coordinates": f"{_CENTERED} select raster_name, tile_ord, round(origin_x + gsd * (x_off + src_w // 2 + 0.5::double), 6) x, round(origin_y - gsd * (y_off + src_h // 2 + 0.5::double), 6) y from tiles join rasters using (raster_name)",
    "dissolve_edges": f"""with {B.COVER}, e as (select z, unnest([{{'x0': x, 'y0': y, 'x1': x + 1, 'y1': y}}, {{'x0': x, 'y0': y + 1, 'x1': x + 1, 'y1': y + 1}}, {{'x0': x, 'y0': y, 'x1': x, 'y1': y + 1}}, {{'x0': x + 1, 'y0': y, 'x1': x + 1, 'y1': y + 1}}]) s from cov)
        select z, s.x0 x0, s.y0 y0, s.x1 x1, s.y1 y1 from e group by z, s having count(*) = 1""",
    "neighbors": f"""with {B.COVER} select z, x, y, pos::int pos, (x + dx)::int nx, (y + dy)::int ny from cov, (values (0, -1, -1), (1, 0, -1), (2, 1, -1), (3, -1, 0), (4, 1, 0), (5, -1, 1), (6, 0, 1), (7, 1, 1)) n(pos, dx, dy)""",
    "surrounded_tiles": f"""with {B.PIXELS}, t as (select distinct raster_name, x_off, y_off from px) select a.raster_name, a.x_off, a.y_off from t a join t b on a.raster_name = b.raster_name and abs(a.x_off - b.x_off) <= 4 and abs(a.y_off - b.y_off) <= 4
        group by 1, 2, 3 having count(*) = 9""",
    "border_pixels": f"""with {B.PIXELS}, t as (select distinct raster_name, x_off, y_off from px), o as (select unnest([-1, 0, 1]) o), i as (select unnest(range(8)) i)
        select distinct raster_name, x_off, y_off, p.x::int x, p.y::int y from (select raster_name, x_off, y_off, unnest([{{'x': i, 'y': o}}, {{'x': i, 'y': 7 + o}}, {{'x': o, 'y': i}}, {{'x': 7 + o, 'y': i}}]) p from t, o, i)""",
    "tiling_statistics": f"{_METRICS} select raster_name, count(*) n_tiles, {_SUMMARY} from m group by raster_name",
    "tiling_statistics_rollup": f"{_METRICS} select raster_name, count(*) n_tiles, {_SUMMARY} from m group by rollup (raster_name)",
    "ratio_comment": f"""{_METRICS} select raster_name, case when avg(width_ratio) < 0.5 then 'ratio below 0.5: most source pixels are lost' when avg(width_ratio) > 1 then 'ratio above 1: tiles are blurred' else '' end as comment from m group by 1""",
    "tiling_metadata": f"with {B.RASTERS} select raster_name, '[' || (width // 2) || ' ' || (height // 2) || '] pixel' origin, width from rasters",
    "reprojected_bounds": f"""with {B.COVER}, e as (select z, x, y, {_WEST} w, (x + 1) / 1024.0::double * 360 - 180 e, {_NORTH.format(y='y')} n, {_NORTH.format(y='(y + 1)')} s from cov)
        select z, x, y, round(radians(w) * 6378137, 3) "left", round(ln(tan(pi() / 4 + radians(s) / 2)) * 6378137, 3) bottom, round(radians(e) * 6378137, 3) "right", round(ln(tan(pi() / 4 + radians(n) / 2)) * 6378137, 3) top from e""",
    "gcp_transform": f"with {B.RASTERS} select raster_name, round(gsd, 4) t_a, 0.0::double t_b, round(origin_x, 4) t_c, 0.0::double t_d, round(-gsd, 4) t_e, round(origin_y, 4) t_f from rasters",
    "mercator_tile_pixel_size": f"""with {B.COVER} select z, x, y, round(360 / 1024.0::double / 0.001, 4) w, round(({_NORTH.format(y='y')} - {_NORTH.format(y='(y + 1)')}) / 0.0005::double, 4) h from cov""",
    "utm_round_trip": f"""with {B.POINTS}, p as (select point_id, lon, lat, radians(abs(lat)) phi, radians(lon / 60) lam from points where abs(lat) < 84),
        k as (select 6378137.0::double a, 1 / 298.257223563::double f), n as (select a, f / (2 - f) n from k),
        c as (select *, a / (1 + n) * (1 + n**2 / 4 + n**4 / 64) rad, n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 a1, 13 * n**2 / 48 - 3 * n**3 / 5 a2, 61 * n**3 / 240 a3, 2 * sqrt(n) / (1 + n) ec from n),
        t as (select *, sinh(atanh(sin(phi)) - ec * atanh(ec * sin(phi))) tt from p, c), q as (select *, atan2(tt, cos(lam)) xi, atanh(sin(lam) / sqrt(1 + tt * tt)) eta from t)
        select point_id, round(500000 + 0.9996::double * rad * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) easting,
               round(0.9996::double * rad * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) northing, round(lon / 60 + 15, 6) lon, round(abs(lat), 6) lat from q""",
}
#: Another name under which this is known.
