"""Worked examples and properties of single operators."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import api
from tessella.functions import exprs as X
from tessella.functions.ranking import shuffled_position
from tessella.operators import categories as K
from tessella.operators import compare, compose, cover, fusion, pixels, simulate, spatial, tiling, vector
from tessella.operators.scheme import LocalScheme, MercatorScheme
from tessella.sources import readers, sinks
from tessella.streaming import ingest

GOLDEN = [
    (6000, 900, 900, "centered_to_image", False, True, 3000, [2100, 1200, 300, -600, 3000, 3900, 4800, 5700]),
    (6000, 900, 450, "centered_to_image", False, True, 3000, [2550, 2100, 1650, 1200, 750, 300, -150, 3000, 3450, 3900, 4350, 4800, 5250]),
    (6000, 900, 450, "centered_to_image", True, True, 3000, [2550, 2100, 1650, 1200, 750, 300, -150, 3000, 3450, 3900, 4350, 4800, 5250]),
    (6000, 900, 900, "optimized", False, True, -150, [-150, 750, 1650, 2550, 3450, 4350, 5250]),
    (6000, 900, 900, "optimized", False, False, 300, [300, 1200, 2100, 3000, 3900, 4800]),
    (6000, 900, 900, "aligned_to_image_border", False, True, 0, [0, 900, 1800, 2700, 3600, 4500, 5400]),
    (1000, 300, 100.5, "centered_to_image", False, True, 500, [400, 299, 199, 98, -2, 500, 600, 701]),
    (1000, 300, 100.5, "aligned_to_image_border", False, False, 0, [0, 100, 201, 301, 402, 502, 603]),
]


@pytest.mark.parametrize("case", GOLDEN)
def test_axis_layouts(spark, case):
    length, size, stride, alignment, base, overhang, origin, offsets = case
    scheme = LocalScheme((size, size), (stride, stride), alignment=alignment, align_to_base=base, overhang=overhang)
    got = spark.range(1).select(tiling.axis_layout(F.lit(length), F.lit(float(size)), F.lit(float(stride)), scheme).alias("l")).first()["l"]
    assert (got["origin"], got["offsets"]) == (origin, offsets)


def test_tiles_cover_the_raster_without_overhang_inside(spark):
    for length in (97, 100, 250):
        for stride in (10, 25, 33.3):
            scheme = LocalScheme((30, 30), (stride, stride), overhang=False, alignment="aligned_to_image_border")
            got = spark.range(1).select(tiling.axis_layout(F.lit(length), F.lit(30.0), F.lit(float(stride)), scheme)["offsets"].alias("o")).first()["o"]
            count = 0
            while count * stride + 30 <= length:
                count += 1
            assert len(got) == count and all(0 <= o and o + 30 <= length for o in got)


def test_mercator_index_and_bounds(spark):
    r = spark.createDataFrame([(13.05, 52.40), (-0.2, 5.6), (-180.0, 89.0), (180.0, -89.0)], "lon double, lat double").select(X.mercator_x("lon", F.lit(19)).alias("x"), X.mercator_y("lat", F.lit(19)).alias("y")).collect()
    last = 2**19 - 1
    assert [tuple(x) for x in r] == [(281149, 172229), (261852, 253975), (0, 0), (last, last)]
    t = spark.range(1).select(X.tile_west(F.lit(0), F.lit(0)).alias("w"), X.tile_north(F.lit(0), F.lit(0)).alias("n"), X.tile_left_3857(F.lit(1), F.lit(1)).alias("l")).first()
    assert t["w"] == -180 and t["n"] == pytest.approx(85.0511287798) and t["l"] == 0


def test_crs_round_trips(spark):
    df = spark.createDataFrame([(13.4, 52.5), (15.0, 0.0)], "lon double, lat double")
    r = df.select(X.x_3857_to_lon(X.lon_to_3857("lon")).alias("lon"), X.y_3857_to_lat(X.lat_to_3857("lat")).alias("lat")).collect()
    assert [tuple(x) for x in r] == [pytest.approx((13.4, 52.5)), pytest.approx((15.0, 0.0))]
    e, n = X.utm("lon", "lat", 33)
    u = df.select(e.alias("e"), n.alias("n")).collect()
    assert tuple(u[0]) == pytest.approx((391379.6, 5817747.2), abs=1500) and tuple(u[1]) == pytest.approx((500000, 0), abs=1e-6)


def test_affine_inverse_and_gsd(spark):
    df = spark.range(1).select(X.affine(0.5, 0.1, 10, -0.2, -0.5, 20).alias("t"), F.create_map(F.lit("GSD"), F.lit("(0.1, 0.2)")).alias("tags"))
    both = df.select("tags", "t", X.compose("t", X.inverse("t")).alias("i"))
    assert both.select(X.is_default_transform("i").alias("d")).first()["d"]
    assert [both.select(g.alias("g")).first()["g"] for g in X.gsd("tags", "t")] == [0.1, 0.2]
    assert [both.select(g.alias("g")).first()["g"] for g in X.gsd(F.create_map().cast("map<string,string>"), "t")] == [0.5, 0.5]


def test_strings(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    assert one(X.rgb_hex(F.lit(255), F.lit(0), F.lit(16))) == "#ff0010"
    assert one(X.quantity(F.lit("[900 450.5] pixel"))) == ([900.0, 450.5], "pixel")
    assert one(X.int_list(F.lit("512, 256"))) == [512, 256]
    assert one(X.padded_line(F.lit("__name"), F.lit("v"), 8)) == "name    v"
    assert sorted(["a10", "a9", "b1"], key=lambda p: one(X.natural_key(F.lit(p)))) == ["a9", "a10", "b1"]
    assert one(X.half_even(F.lit(2.5))) == 2 and one(X.trunc(F.lit(-1.7))) == -1
    path = one(X.local_tile_path(F.lit("r"), F.lit(-5), F.lit(7), F.lit(9), F.lit(9)))
    got = spark.createDataFrame([(path,), (one(X.mercator_tile_path(F.lit(1), F.lit(2), F.lit(3))),)], "p string").select(*X.parsed_tile_path("p")).collect()
    assert tuple(got[0])[:6] == ("ImagePixelTile", "r", -5, 7, 9, 9) and tuple(got[1])[0] == "MercatorTile" and tuple(got[1])[6:] == (3, 1, 2)


def test_scheme_validation():
    for bad in ({"alignment": "x"}, {"unit": "mile"}, {"stride": (0, 1)}):
        with pytest.raises(ValueError):
            LocalScheme((1, 1), **bad)
    with pytest.raises(ValueError):
        LocalScheme((1, 1), alignment="optimized").check_fusable()
    with pytest.raises(ValueError):
        LocalScheme((1, 1), overhang=False).check_fusable()
    assert LocalScheme((3, 4)).stride == (3, 4) and LocalScheme((3, 4)).with_stride((1, 2)).stride == (1, 2)


def test_cover_split_sizes(spark):
    for n, wanted in ((101, [51, 15, 35]), (100, [50, 15, 35]), (7, [3, 1, 2])):
        t = spark.range(n).select(F.lit(9).alias("z"), F.col("id").cast("int").alias("x"), F.lit(1).alias("y"))
        got = {r["split"]: r["count"] for r in cover.split(t, [50, 15, 35]).groupBy("split").count().collect()}
        assert [got.get(i, 0) for i in range(3)] == wanted
    with pytest.raises(ValueError):
        cover.split(t, [60, 50])


def test_shuffled_positions(spark):
    df = spark.range(1000).withColumn("k", F.col("id").cast("string"))
    a, b = (sorted((r["id"], r["position"]) for r in shuffled_position(d, F.col("k")).collect()) for d in (df, df.repartition(17)))
    assert a == b and sorted(p for _, p in a) == list(range(1, 1001))


def test_zoom_changes_and_antimeridian(spark):
    t = spark.createDataFrame([(3, 1, 2), (4, 15, 15)], "z int, x int, y int")
    assert {tuple(r) for r in cover.at_zoom(t, 2).collect()} == {(2, 0, 1), (2, 3, 3)}
    assert {(r["x"], r["y"]) for r in cover.at_zoom(t.where("z = 3"), 4).collect()} == {(2, 4), (2, 5), (3, 4), (3, 5)}
    box = spark.createDataFrame([(170.0, 0.1, -170.0, 1.0)], "w double, s double, e double, n double")
    assert {r["x"] for r in cover.tiles_of_bounds(box, "w", "s", "e", "n", 4).collect()} == {0, 15}
    rasters = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (0.5, 0.5, 1.5, 1.5)], "west double, south double, east double, north double")
    assert api.mercator_cover(rasters, MercatorScheme(4)).count() == 1
    assert api.cover(t, 2).count() == 2


def test_overlap_join_against_brute_force(spark):
    draw = np.random.default_rng(3)
    boxes = lambda n: [(int(draw.integers(0, 2)), i, int(x), int(y), int(x + w), int(y + h)) for i, (x, y, w, h) in enumerate(zip(*draw.integers(-40, 40, (2, n)), *draw.integers(0, 25, (2, n)), strict=True))]
    a, b = boxes(80), boxes(90)
    da, db = (spark.createDataFrame(r, f"g int, {n} int, x0 int, y0 int, x1 int, y1 int") for r, n in ((a, "ia"), (b, "ib")))
    got = sorted((r["ia"], r["ib"]) for r in spatial.overlap_join(da, db, ["g"], (7.0, 11.0)).collect())
    assert got == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5])


def fusion_input(spark, size=8, stride=4, side=24):
    tiles = [(x, y) for x in range(0, side - size + 1, stride) for y in range(0, side - size + 1, stride)]
    rows = [("r", x, y, size, size, r, c, x * 1000 + y) for x, y in tiles for r in range(size) for c in range(size)]
    px = spark.createDataFrame(rows, "raster_name string, x_off int, y_off int, src_w int, src_h int, y int, x int, value int")
    tilings = spark.createDataFrame([("r", side, side, 0, 0, float(stride), float(stride))], "raster_name string, width int, height int, origin_x int, origin_y int, stride_x double, stride_y double")
    return px, tilings


def test_fusion_takes_reliable_windows(spark):
    px, tilings = fusion_input(spark)
    got = {(r["x_off"], r["y_off"], r["y"], r["x"]): r["value"] for r in api.fuse(px, tilings, LocalScheme((8, 8), (4, 4), alignment="aligned_to_image_border")).collect()}
    base = {k[:2] for k in got}
    assert base == {(x, y) for x in (0, 8, 16) for y in (0, 8, 16)}
    assert got[8, 8, 3, 3] == 8008 and got[8, 8, 7, 3] == 8012 and got[8, 8, 0, 3] == 8004 and got[8, 8, 3, 7] == 12008 and got[0, 0, 0, 0] == 0
    same = px.withColumn("value", F.lit(5))
    assert {r["value"] for r in api.fuse(same, tilings, LocalScheme((8, 8), (4, 4), alignment="aligned_to_image_border")).collect()} == {5}


def test_base_tiles_of_the_worked_grid(spark):
    offs = [2550, 2100, 1650, 1200, 750, 300, -150, 3000, 3450, 3900, 4350, 4800, 5250]
    tiles = spark.createDataFrame([("r", x, 300, 900, 900) for x in offs], "raster_name string, x_off int, y_off int, src_w int, src_h int")
    tilings = spark.createDataFrame([("r", 6000, 6000, 3000, 3000, 450.0, 450.0)], "raster_name string, width int, height int, origin_x int, origin_y int, stride_x double, stride_y double")
    got = fusion.base_and_aux(tiles, tilings).collect()
    assert sorted(r["x_off"] for r in got if r["is_base"]) == [300, 1200, 2100, 3000, 3900, 4800]
    assert sorted(r["x_off"] for r in got if not r["is_base"]) == [-150, 750, 1650, 2550, 3450, 4350, 5250]


def test_joined_tiles_must_match(spark):
    px, _ = fusion_input(spark)
    key = ["raster_name", "x_off", "y_off", "y", "x"]
    assert compare.joined_tiles(px.select(*key, "value"), px, key).count() == px.count()
    with pytest.raises(Exception, match="without original"):
        compare.joined_tiles(px.select(*key, "value"), px.where("x > 0"), key).agg(F.sum("original")).collect()
    with pytest.raises(ValueError):
        compare.confusion_map(px, px, "value", "value", {"tp": 1})


def test_resize_against_numpy(spark):
    draw = np.random.default_rng(2)
    m = draw.integers(0, 255, (6, 9))
    px = spark.createDataFrame([(1, int(r), int(c), int(m[r, c])) for r in range(6) for c in range(9)], "t int, y int, x int, value int")
    near = {(r["y"], r["x"]): r["value"] for r in pixels.resize_nearest(px, ["t"], (9, 6), (4, 13)).collect()}
    assert near == {(i, j): m[i * 6 // 13, j * 9 // 4] for i in range(13) for j in range(4)}
    for disk in ((4, 13), (20, 3), (9, 6)):
        soft = {(r["y"], r["x"]): r["value"] for r in pixels.resize_bilinear(px, ["t"], (9, 6), disk).collect()}
        for i in range(disk[1]):
            for j in range(disk[0]):
                y, x = (i + 0.5) * 6 / disk[1] - 0.5, (j + 0.5) * 9 / disk[0] - 0.5
                y0, x0 = math.floor(y), math.floor(x)
                at = lambda a, b: m[min(max(a, 0), 5), min(max(b, 0), 8)]
                fy, fx = y - y0, x - x0
                want = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
                assert soft[i, j] == pytest.approx(want), (disk, i, j)


def burn(rings, w, h):
    out = set()
    for r in range(h):
        for c in range(w):
            x, y, inside = c + 0.5, r + 0.5, False
            for ring in rings:
                for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
                    if (ay > y) != (by > y) and x > ax + (y - ay) / (by - ay) * (bx - ax):
                        inside = not inside
            out |= {(r, c)} if inside else set()
    return out


POLYGONS = [
    [[(1, 1), (9, 2), (5, 8), (1, 1)]],
    [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(3, 3), (7, 3), (7, 7), (3, 7), (3, 3)]],
    [[(-5, -5), (4.5, 3.2), (20, -1), (11, 30), (-5, -5)]],
    [[(2.5, 2.5), (6.5, 2.5), (6.5, 6.5), (2.5, 6.5), (2.5, 2.5)]],
]


def polygons(spark):
    return spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in p], i + 1) for i, p in enumerate(POLYGONS)], "feature_id int, rings array<array<struct<x:double,y:double>>>, v int")


def test_rasterize_against_brute_force(spark):
    got = {}
    for r in vector.burnt_pixels(polygons(spark), ["feature_id"], 12, 14).collect():
        got.setdefault(r["feature_id"], set()).add((r["y"], r["x"]))
    for i, p in enumerate(POLYGONS[:3]):
        assert got[i] == burn(p, 12, 14)
    assert len(got[3]) == 16
    top = {(r["y"], r["x"]): r["v"] for r in vector.rasterize(polygons(spark), 12, 14, "v").collect()}
    assert all(v == max(i + 1 for i in got if k in got[i]) for k, v in top.items())


def test_vectorize_and_rasterize_are_inverse(spark):
    draw = np.random.default_rng(9)
    m = draw.integers(0, 3, (12, 12))
    px = spark.createDataFrame([(1, int(r), int(c), int(m[r, c])) for r in range(12) for c in range(12)], "t int, y int, x int, value int")
    found = vector.vectorize(px, ["t"], 12, 12).withColumn("feature_id", F.monotonically_increasing_id())
    back = np.zeros((12, 12), int)
    for r in vector.rasterize(found, 12, 12, "value").collect():
        back[r["y"], r["x"]] = r["value"]
    assert (back == m).all()
    assert found.agg(F.sum(vector.polygon_area())).first()[0] == (m > 0).sum()
    assert found.where(~vector.is_valid_polygon()).count() == 0


def test_buffers(spark):
    square = polygons(spark).where("feature_id = 1")
    inside = vector.burnt_pixels(square, ["feature_id"], 30, 30).count()
    assert inside == 84
    assert vector.buffered_pixels(square, ["feature_id"], -1.0, 30, 30).count() < inside < vector.buffered_pixels(square, ["feature_id"], 1.0, 30, 30).count()


def test_geojson_kinds(spark):
    square = [[[0, 0, 5], [1, 0, 5], [1, 1, 5], [0, 0, 5]]]
    texts = [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "FeatureCollection", "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}, "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}, {"type": "Feature", "geometry": None}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}]},
        {"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": square}, {"type": "Point", "coordinates": [0, 0]}]}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": []}},
    ]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(texts)] + [(9, "no json"), (8, None)], "i int, t string")
    got = readers.geojson_polygons(df, "t", ["i"])
    assert {r["i"]: r["count"] for r in got.groupBy("i").count().collect()} == {0: 1, 1: 2, 2: 1}
    assert {r["crs"] for r in got.where("i = 1").collect()} == {3857} and tuple(got.where("i = 0").first()["rings"][0][1]) == (1.0, 0.0)
    assert readers.same_crs(got.where("i = 1")).count() == 2
    with pytest.raises(Exception, match="several CRS"):
        readers.same_crs(got).agg(F.max("crs")).collect()


def test_categories_and_palettes(spark):
    c = K.to_df(spark, K.LAND_COVER)
    assert [r["name"] for r in K.not_ignored(K.active(c)).collect()][-1] == "reliable_area"
    text = json.dumps([{"name": "A", "palette_index": 1, "palette_color": "#0102ff"}, {"name": "b", "palette_index": 2, "palette_color": [1, 2, 3], "is_ignore": True}])
    assert [x.palette_color for x in K.from_json(text)] == [(1, 2, 255), (1, 2, 3)] and len(K.from_json(text, include_ignore=False)) == 1
    with pytest.raises(ValueError):
        K.Category("x", 1, (1, 2))
    with pytest.raises(ValueError):
        K.to_df(spark, K.from_json(text)[:1])
    twice = K.to_df(spark, [K.Category("a", 1, (9, 9, 9)), K.Category("b", 2, (9, 9, 9))])
    assert pixels.inverse_palette(twice).collect()[0]["palette_index"] == 2


def test_border_metatile_and_neighbours(spark):
    t = spark.createDataFrame([("r", 0, 0, 3, 3)], "raster_name string, x_off int, y_off int, src_w int, src_h int")
    assert tiling.border_pixels(t).count() == 8
    assert len(tiling.neighbours(t, "x_off", "y_off", "src_w", "src_h").collect()) == 8
    px, _ = fusion_input(spark, 4, 4, 8)
    m = {(r["x_off"], r["y_off"], r["y"], r["x"]): r["value"] for r in pixels.metatile(px, ["raster_name"], 4).collect()}
    assert len(m) == 4 * 36 and m[0, 0, 0, 0] == 0 and m[0, 0, 1, 5] == 4000 and m[4, 4, 0, 1] == 4000


def test_projection_clips_and_orders(spark):
    px = spark.createDataFrame([("r", x, 0, 0, c, x * 10 + c) for x in (-2, 2) for c in range(6)], "raster_name string, x_off int, y_off int, y int, x int, value int")
    tilings = spark.createDataFrame([("r", 5, 1)], "raster_name string, width int, height int")
    assert {r["x"]: r["value"] for r in compose.project(px, tilings).collect()} == {0: -18, 1: -17, 2: 20, 3: 21, 4: 22}


def test_simulated_frame(spark):
    px, _ = fusion_input(spark, 8, 8, 8)
    got = {(r["y"], r["x"]) for r in simulate.frame(px, (8, 8), (4, 4), 99, 1).where("value = 99").collect()}
    assert got == {(r, c) for r in range(2, 6) for c in range(2, 6)} - {(r, c) for r in (3, 4) for c in (3, 4)}


def test_sinks_and_readers(spark, tmp_path):
    px, _ = fusion_input(spark)
    path = str(tmp_path / "tiles")
    sinks.write_tiles(px, path)
    sinks.write_tiles(px, path, mode="ignore")
    assert readers.read_blocks(spark, path, ["r"]).count() == px.count() and readers.read_blocks(spark, path, ["q"]).count() == 0
    web = spark.createDataFrame([(3, 1, 2, 0), (3, 2, 2, 1)], "z int, x int, y int, split int")
    sinks.write_cover(web, str(tmp_path / "cover"))
    assert {tuple(r) for r in readers.read_cover(spark, str(tmp_path / "cover")).select("z", "x", "y").collect()} == {(3, 1, 2), (3, 2, 2)}
    sinks.write_cover(web, str(tmp_path / "splits"), "split")
    assert readers.read_cover(spark, str(tmp_path / "splits/split=1")).select("x").first()["x"] == 2
    (tmp_path / "odd.csv").write_text("MercatorTile\t5\t6\t7\t0.5\nImagePixelTile,r,-1,2,3,4\nother,1\n")
    odd = readers.read_cover(spark, str(tmp_path / "odd.csv")).orderBy("tile_class").collect()
    assert (odd[0]["raster_name"], odd[0]["x_off"], odd[0]["src_h"]) == ("r", -1, 4) and (odd[1]["z"], odd[1]["extra"]) == (7, [0.5])
    sinks.write_features(polygons(spark), str(tmp_path / "features"), color=(1, 2, 255), by="v")
    line = json.loads(spark.read.text(str(tmp_path / "features/v=2")).first()["value"])
    assert line["properties"] == {"fill": "#0102ff", "fill-opacity": 0.5} and len(line["geometry"]["coordinates"]) == 2
    folder = tmp_path / "image_pixel_tiles/r/width_height_8_8/width_offset_0"
    folder.mkdir(parents=True)
    (folder / "height_offset_4.png").write_bytes(b"x")
    (folder / "height_offset_4.png.aux.xml").write_bytes(b"x")
    assert [(r["raster_name"], r["y_off"]) for r in readers.read_tile_dir(spark, str(tmp_path / "image_pixel_tiles")).collect()] == [("r", 4)]
    rasters = spark.createDataFrame([("r", {"a": "1", "b": "2"})], "raster_name string, tags map<string,string>")
    assert sinks.with_tags(rasters, {"b": "3"}).first()["tags"] == {"a": "1", "b": "3"}


def test_streamed_tiles_equal_a_batch(spark, tmp_path):
    draw = np.random.default_rng(4)
    schema = "t int, y int, x int, value int"
    for i in range(4):
        rows = [(1, int(y), int(x), int(v)) for y, x, v in zip(*draw.integers(0, 6, (2, 40)), draw.integers(0, 99, 40), strict=True)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.tile_stream(spark, str(tmp_path / "in"), schema, 1)
    ingest.ingest_max(stream, str(tmp_path / "out"), str(tmp_path / "check"), ["t", "y", "x"]).awaitTermination()
    want = sorted(pixels.append_max(spark.read.parquet(str(tmp_path / "in")), pixel=["t", "y", "x"]).collect())
    assert sorted(ingest.read_layers(spark, str(tmp_path / "out"), ["t", "y", "x"]).collect()) == want
    live = ingest.stream_max(ingest.tile_stream(spark, str(tmp_path / "in"), schema), ["t", "y", "x"])
    q = live.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("live").collect()) == want


def tiff(m: np.ndarray) -> bytes:
    """A baseline file of one gray strip."""
    h, w = m.shape
    tags = [(256, 3, w), (257, 3, h), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, h), (279, 4, h * w)]
    data = m.astype(np.uint8).tobytes().ljust(h * w + h * w % 2, b"\0")
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHIHH" if k == 3 else "<HHII", n, k, 1, *((v, 0) if k == 3 else (v,))) for n, k, v in tags) + bytes(4)


def test_image_files(spark, tmp_path):
    from tessella.sources import images

    draw = np.random.default_rng(1)
    made = {f"{n}.png": draw.integers(0, 255, (5, 7, n)).astype(np.uint8) for n in (1, 3, 4)}
    made["gray.tif"] = draw.integers(0, 255, (3, 4, 1))
    for name, m in made.items():
        (tmp_path / name).write_bytes(tiff(m[:, :, 0]) if name.endswith("tif") else images.encode(m))
    (tmp_path / "bad.png").write_bytes(b"junk")
    read = images.read_images(spark, str(tmp_path), "*.{png,tif}").withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
    rows = {r["name"]: r for r in read.collect()}
    assert set(rows) == {*made, "bad.png"} and rows["bad.png"]["data"] is None and rows["3.png"]["channels"] == 3
    found = {(r["name"], r["y"], r["x"], r["band"]): r["value"] for r in images.image_pixels(read, ["name"]).collect()}
    assert found == {(name, y, x, b): v for name, m in made.items() for (y, x, b), v in np.ndenumerate(m)}
    labels = np.array([[0, 1], [2, 1]])
    packed = spark.createDataFrame([(1, labels.ravel().tolist())], "t int, data array<int>")
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "a.png").write_bytes(bytes(images.encoded_images(packed, 2, 2, [c.palette_color for c in K.LAND_COVER]).first()["png"]))
    again = images.label_pixels(images.read_images(spark, str(tmp_path / "labels")), ["path"], K.to_df(spark, K.LAND_COVER)).collect()
    assert {(r["y"], r["x"]): r["label"] for r in again} == dict(np.ndenumerate(labels))


def test_fetching_mosaics_and_granules(spark, tmp_path):
    from tessella.sources import images

    (tmp_path / "bad.png").write_bytes(b"junk")
    px = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 1)], "y int, x int, value int")
    urls = spark.createDataFrame([(f"file://{tmp_path}/bad.png",), ("nothing",), (None,)], "url string")
    assert sorted(bytes(r["content"]) if r["content"] else b"" for r in images.fetch_images(urls).collect()) == [b"", b"", b"junk"]
    assert all((r["content"] is None) != (r["error"] is None) for r in images.fetch_images(urls).collect())
    assert {r["error"] for r in images.fetch_images(urls, most=3).collect() if r["content"] is None} >= {"TooLong"}
    both = images.virtual_mosaic(px.withColumn("value", F.lit(0)), px)
    assert {r["value"] for r in pixels.mosaic(both, ["y", "x"]).collect()} == {0, 1, 2}
    boxes = spark.createDataFrame([("g1", 0.0, 0.0, 1.0, 1.0), ("g2", 5.0, 5.0, 6.0, 6.0)], "granule string, west double, south double, east double, north double")
    assert [r["granule"] for r in images.granules_of_tiles(boxes.drop("granule").limit(1), boxes).collect()] == ["g1"]


def test_traced_regions_against_flood_fill():
    draw = np.random.default_rng(4)
    grids = draw.integers(0, 3, (40, 7, 9))
    grids[0], grids[1], grids[2] = 0, 1, np.pad(np.zeros((3, 5), int), 2, constant_values=2)
    region, area, offsets, x, y = vector.traced(grids)
    n, h, w = grids.shape
    label = -np.ones(grids.shape, int)
    for start in np.ndindex(*grids.shape):
        if grids[start] and label[start] < 0:
            label[start], todo = np.ravel_multi_index(start, grids.shape), [start]
            while todo:
                t, a, b = todo.pop()
                for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                    if 0 <= c < h and 0 <= d < w and grids[t, c, d] == grids[start] and label[t, c, d] < 0:
                        label[t, c, d] = label[start]
                        todo.append((t, c, d))
    assert (vector.regions(grids) == label).all()
    inside = {}  # pixel centres by crossings of the rings' upright sides
    for i, r in enumerate(region):
        xs, ys = x[offsets[i] : offsets[i + 1]], y[offsets[i] : offsets[i + 1]]
        assert (xs[0], ys[0]) == (xs[-1], ys[-1]) and all((a == b) != (c == d) for a, b, c, d in zip(xs, xs[1:], ys, ys[1:], strict=False))
        grid = inside.setdefault(int(r), np.zeros((h, w), int))
        for x0, y0, y1 in zip(xs[:-1], ys[:-1], ys[1:], strict=True):
            grid[int(min(y0, y1)) : int(max(y0, y1)), int(x0) :] += 1
    assert set(inside) == set(np.unique(label[label >= 0]))
    for r, grid in inside.items():
        assert ((grid % 2 == 1) == (label[r // (h * w)] == r)).all()
        assert sum(area[region == r]) == (label == r).sum() and (area[region == r] > 0).sum() == 1


@pytest.mark.parametrize(("kernel", "weight"), [("cubic", lambda d: 1.25 * d**3 - 2.25 * d**2 + 1 if d <= 1 else -0.75 * d**3 + 3.75 * d**2 - 6 * d + 3 if d < 2 else 0), ("lanczos", lambda d: float(np.sinc(d) * np.sinc(d / 4)) if d < 4 else 0)])
def test_resizing_by_kernel(spark, kernel, weight):
    m = np.random.default_rng(2).integers(0, 255, (6, 9))
    px = spark.createDataFrame([(1, y, x, int(v)) for (y, x), v in np.ndenumerate(m)], "t int, y int, x int, value int")

    def axis(n, k):
        out = np.zeros((k, n))
        for d in range(k):
            place = (d + 0.5) * n / k - 0.5
            for s in range(math.floor(place) - 3, math.floor(place) + 5):
                out[d, min(max(s, 0), n - 1)] += weight(abs(place - s))
        return out / out.sum(1, keepdims=True)

    for w, h in ((4, 11), (9, 6), (18, 3)):
        want = axis(6, h) @ m @ axis(9, w).T
        got = {(r["y"], r["x"]): r["value"] for r in pixels.resize_by_kernel(px, ["t"], (9, 6), (w, h), kernel).collect()}
        assert got == pytest.approx(dict(np.ndenumerate(want)))


def test_readers_of_tiles_insist_on_one_class_and_one_file(spark):
    files = spark.createDataFrame([("ImagePixelTile", "a", "x.png"), ("ImagePixelTile", "b", "y.png"), ("ImagePixelTile", "b", "z.png")], "tile_class string, raster_name string, tile_path string")
    assert readers.the_tile_class(files).first()[0] == "ImagePixelTile"
    keys = spark.createDataFrame([("a",), ("c",)], "raster_name string")
    assert {tuple(r) for r in readers.files_of_tiles(keys, files.where("raster_name = 'a'"), ["raster_name"]).collect()} == {("a", "x.png"), ("c", None)}
    for broken in (lambda: readers.files_of_tiles(files.select("raster_name"), files, ["raster_name"]).collect(), lambda: readers.the_tile_class(files.withColumn("tile_class", F.col("tile_path"))).collect()):
        with pytest.raises(Exception, match="several files|one class"):
            broken()


def test_buffers_against_distances(spark):
    """Pixels of a square and a slanted triangle within a distance, by measuring every pixel."""
    rings = {1: [(5.0, 4.0), (12.0, 4.0), (12.0, 9.0), (5.0, 9.0), (5.0, 4.0)], 2: [(2.0, 12.5), (14.0, 15.0), (4.5, 19.0), (2.0, 12.5)]}
    features = spark.createDataFrame([(i, [[{"x": x, "y": y} for x, y in r]]) for i, r in rings.items()], "feature_id int, rings array<array<struct<x:double,y:double>>>")
    inside = {tuple(r) for r in vector.burnt_pixels(features, ["feature_id"], 24, 24).select("feature_id", "y", "x").collect()}

    def distance(i, y, x):
        best, p = math.inf, np.array([x + 0.5, y + 0.5])
        for a, b in zip(map(np.array, rings[i]), map(np.array, rings[i][1:]), strict=False):
            t = min(1, max(0, (p - a) @ (b - a) / ((b - a) @ (b - a))))
            best = min(best, float(np.hypot(*(p - a - t * (b - a)))))
        return best

    cells = [(i, y, x) for i in rings for y in range(24) for x in range(24)]
    grown = {tuple(r) for r in vector.buffered_pixels(features, ["feature_id"], 2.2, 24, 24).select("feature_id", "y", "x").collect()}
    assert grown == {c for c in cells if c in inside or distance(*c) <= 2.2}
    shrunk = {tuple(r) for r in vector.buffered_pixels(features, ["feature_id"], -1.2, 24, 24).select("feature_id", "y", "x").collect()}
    assert shrunk == {c for c in cells if c in inside and distance(*c) >= 1.2}
