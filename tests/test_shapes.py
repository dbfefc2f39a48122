"""Whole regions, graphs, validity of polygons, joins of boxes of any size and kernels against plain computations."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import graphs, stages
from tessella.functions import exprs as X
from tessella.operators import georeference, regions, spatial, validity, warping
from tessella.sources import adapters as A
from tessella.sources import readers

# graphs


def test_components_and_cycles(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40) if i not in (9, 30)] + [(50, 60), (60, 70), (50, 70), (5, 22)]
    root = {n: n for pair in links for n in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = graphs.components(spark.createDataFrame(links, "u int, v int"))
    assert {r["node"]: r["label"] for r in found.collect()} == root

    nodes, wanted, at = [], {}, 0
    for size in (1, 2, 3, 8, 9, 33):
        cycle = list(range(at, at + size))
        rng.shuffle(cycle)
        at += size
        nodes += list(zip(cycle, cycle[1:] + cycle[:1], strict=True))
        lead = cycle.index(min(cycle))
        wanted |= {n: (min(cycle), (lead - i) % size) for i, n in enumerate(cycle)}
    ranked = graphs.ranked_cycles(spark.createDataFrame(nodes, "node int, next int"))
    assert {r["node"]: (r["lead"], r["steps"]) for r in ranked.collect()} == wanted


# regions


def plain_regions(cells):
    """(value, first, rings) of {(y, x): value} by flood and by walking each side; rings from their least corner."""
    found, seen = [], set()
    for start in sorted(cells):
        if start in seen:
            continue
        todo, region = [start], {start}
        while todo:
            y, x = todo.pop()
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if n not in region and cells.get(n) == cells[start]:
                    region.add(n)
                    todo.append(n)
        seen |= region
        ahead = {}  # corner -> sides that begin there, as (own cell, direction)
        for y, x in region:
            for d, (n, corner) in enumerate((((y - 1, x), (y, x)), ((y, x + 1), (y, x + 1)), ((y + 1, x), (y + 1, x + 1)), ((y, x - 1), (y + 1, x)))):
                if n not in region:
                    ahead.setdefault(corner, {})[d] = (y, x)
        rings = []
        while any(ahead.values()):
            corner = min(c for c, s in ahead.items() if s)
            d, points, walk = min(ahead[corner]), [], []
            first = (corner, d)
            while True:
                walk.append((corner, d))
                del ahead[corner][d]
                corner = (corner[0] + (0, 1, 0, -1)[d], corner[1] + (1, 0, -1, 0)[d])
                turns = [t for t in ((d + 1) % 4, d, (d - 1) % 4) if t in ahead.get(corner, {}) or (corner, t) == first]
                d = turns[0]
                if (corner, d) == first:
                    break
            for i, (c, side) in enumerate(walk):
                if walk[i - 1][1] != side:
                    points.append(c)
            least = points.index(min(points))
            points = points[least:] + points[:least]
            area = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(points, points[1:] + points[:1], strict=True))
            rings.append((area < 0, tuple(points)))
        found.append((cells[start], start, tuple(p for _, p in sorted(rings))))
    return set(found)


def regions_of(df, *names):
    return {tuple(r[n] for n in names) + ((r["first_y"], r["first_x"]), tuple(tuple((int(p["y"]), int(p["x"])) for p in ring[:-1]) for ring in r["rings"] if ring[0] == ring[-1])) for r in df.collect()}


@pytest.mark.parametrize("patch", [4, 64])
def test_regions_over_patches(spark, patch):
    rng = np.random.default_rng(patch)
    grid = (rng.random((19, 26)) < 0.62) * rng.integers(1, 3, (19, 26))
    cells = {(int(y) - 7, int(x) - 9): int(v) for (y, x), v in np.ndenumerate(grid) if v}
    px = spark.createDataFrame([("a", y, x, v) for (y, x), v in cells.items()] + [("b", 0, 0, 5), ("b", 1, 1, 5)], "k string, y int, x int, value int")
    found = regions_of(regions.whole_regions(px, ["k"], patch=patch), "k", "value")
    assert found == {("a", *r) for r in plain_regions(cells)} | {("b", *r) for r in plain_regions({(0, 0): 5, (1, 1): 5})}


def test_a_region_of_many_patches_with_holes(spark):
    size = 30
    cells = {(y, x): 1 for y in range(size) for x in range(size) if not (y % 7 == 3 and x % 5 == 2) and not (8 <= y < 20 and 12 <= x < 17)}
    px = spark.createDataFrame(list(cells), "y int, x int").withColumns({"k": F.lit(1), "value": F.lit(1)})
    found = regions_of(regions.whole_regions(px, ["k"], patch=6), "value")
    wanted = plain_regions(cells)
    assert found == wanted and len(wanted) == 1 and len(next(iter(wanted))[2]) > 15


def test_regions_of_nothing_and_of_one_cell(spark):
    empty = spark.createDataFrame([], "k int, y int, x int, value int")
    assert regions.whole_regions(empty, ["k"]).count() == 0
    one = regions.whole_cover(spark.createDataFrame([(3, 5, -2), (3, 5, -2)], "z int, x int, y int"))
    assert regions_of(one, "z") == {(3, (-2, 5), (((-2, 5), (-2, 6), (-1, 6), (-1, 5)),))}


def test_no_task_holds_more_than_a_patch(spark):
    """What a patch's row holds is bounded by its cells and those around it."""
    px = spark.range(100 * 100).select(F.lit(0).alias("k"), (F.col("id") / 100).cast("int").alias("y"), (F.col("id") % 100).cast("int").alias("x"), F.lit(1).alias("value"))
    rows = regions._patch_rows(px, ["k"], "value", 8).selectExpr("max(size(_at)) most", "count(*) n").first()
    assert rows["most"] <= 100 and rows["n"] >= 13 * 13


# validity


def test_problems_of_each_shape(spark, sf):
    found = validity.polygon_validity(A.odd_polygons(spark, sf), ["feature_id", "shape"]).groupBy("shape").agg(F.collect_set(F.array_join("problems", ",")).alias("problems")).collect()
    wanted = {0: "", 1: "self_contact", 2: "self_contact,spike", 3: "hole_outside", 4: "nested_holes", 5: "", 6: "inside_apart", 7: "rings_cross", 8: "inside_apart,rings_cross", 9: "open_ring", 10: "", 11: "inside_apart,rings_cross", 12: "", 13: "few_points,spike"}
    assert {r["shape"]: r["problems"] for r in found} == {k: [v] for k, v in wanted.items()}


def polygons(spark, *shapes):
    rows = [(i, None if s is None else [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in s]) for i, s in enumerate(shapes)]
    return spark.createDataFrame(rows, "id int, rings array<array<struct<x:double,y:double>>>")


def closed(*points):
    return [*points, points[0]]


def test_problems_of_polygons(spark):
    square = closed((0, 0), (30, 0), (30, 30), (0, 30))
    ring_of_holes = [closed((10, 10), (20, 10), (15, 13)), closed((20, 10), (18, 20), (17, 15)), closed((10, 10), (12, 15), (18, 20))]  # touch in a circle
    chain_of_holes = ring_of_holes[:2]
    long = [closed(*[(1e5 * np.cos(t), 1e5 * np.sin(t)) for t in np.linspace(0, 2 * np.pi, 2000, endpoint=False)])]
    twisted = [list(long[0])]
    twisted[0][700], twisted[0][701] = twisted[0][701], twisted[0][700]
    tiny = [closed((0, 0), (1e-4, 0), (1e-4, 1e-4), (0, 1e-4))]
    found = {r["id"]: (r["valid"], r["problems"]) for r in validity.polygon_validity(polygons(spark, [square, *ring_of_holes], [square, *chain_of_holes], long, twisted, None, [], [square, []], tiny, [square, square]), ["id"]).collect()}
    assert found[0] == (False, ["inside_apart"]) and found[1] == (True, []) and found[2] == (True, []) and found[3] == (False, ["self_contact"])
    assert found[4] == found[5] == (False, ["empty"]) and "empty" in found[6][1]
    assert found[7] == (True, []) and "rings_cross" in found[8][1]


def test_few_and_many_sides_are_judged_alike(spark, sf, monkeypatch):
    """Rows of few sides are judged in their row, without a join of sides; by grids the same comes out."""
    odd = A.odd_polygons(spark, sf)
    square = closed((0, 0), (30, 0), (30, 30), (0, 30))
    rings = [closed((10, 10), (20, 10), (15, 13)), closed((20, 10), (18, 20), (17, 15)), closed((10, 10), (12, 15), (18, 20))]
    more = polygons(spark, [square, *rings], [square, *rings[:2]], None, [], [square, []], [square, square], [square, closed((0, 0), (9, 1), (9, 9))], [closed((1, 1), (9, 1), (9, 9)), square])
    found = []
    for few in (64, 0):
        monkeypatch.setattr(validity, "FEW", few)
        a, b = validity.polygon_validity(odd, ["feature_id"]), validity.polygon_validity(more, ["id"])
        found.append([sorted(map(tuple, df.collect())) for df in (a, b)])
    assert found[0] == found[1] and len({tuple(r[2]) for r in found[0][0]}) > 8


def test_few_sides_meet_without_a_join(spark, sf, monkeypatch):
    monkeypatch.setattr(validity, "sized_overlap_join", None)
    assert validity.polygon_validity(A.odd_polygons(spark, sf), ["feature_id"]).where("valid").count() > 0


def test_orientation_is_exact(spark):
    """Points that differ from a line by one part in 10**17, far beyond what doubles tell."""
    whole = lambda v: F.lit(v).cast("bigint")
    n = 10**16 - 1
    row = spark.range(1).select(*[validity._orientation(*map(whole, (0, 0, n, n - 1, n - 2, n - 3 + d))).alias(f"d{d + 1}") for d in (-1, 0, 1)]).first()
    exact = [(n * (n - 3 + d) - (n - 1) * (n - 2)) for d in (-1, 0, 1)]
    assert [row[0], row[1], row[2]] == [(v > 0) - (v < 0) for v in exact]


def test_long_rings_meet_few_sides(spark):
    pairs = []
    for n in (1000, 4000):
        ring = closed(*[(1e5 * np.cos(t), 1e5 * np.sin(t)) for t in np.linspace(0, 2 * np.pi, n, endpoint=False)])
        whole = stages.staged(polygons(spark, [ring]).select("id", validity._on_grid("rings", 1e6).alias("_whole")))
        sides = validity.ring_sides(whole, ["id"])
        box = lambda p: sides.select("id", *[F.least(f"a{c}", f"b{c}").cast("double").alias(f"{c}0") for c in "xy"], *[F.greatest(f"a{c}", f"b{c}").cast("double").alias(f"{c}1") for c in "xy"], F.col("side").alias(f"{p}_side"))  # noqa: E731, B023
        met = spatial.sized_overlap_join(box("p"), box("q"), ["id"], 1024.0)
        pairs.append(met.count())
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert pairs[1] < 5 * pairs[0] and pairs[0] < 10 * 1000


@pytest.mark.parametrize("cell", [1.0, 0.01, 500.0])
def test_boxes_of_any_size_meet(spark, cell):
    rng = random.Random(1)

    def boxes(n):
        out = []
        for i in range(n):
            x, y, w, h = rng.uniform(-300, 300), rng.uniform(-300, 300), rng.choice([0, 0.5, 3, 80, 900]), rng.choice([0, 0.5, 3, 80, 900])
            out.append((i % 2, x, y, x + w, y + h, i))
        return out

    a, b = boxes(60), boxes(70)
    schema = "k int, x0 double, y0 double, x1 double, y1 double, {0} int"
    met = spatial.sized_overlap_join(spark.createDataFrame(a, schema.format("i")), spark.createDataFrame(b, schema.format("j")), ["k"], cell)
    found = [(r["i"], r["j"]) for r in met.select("i", "j").collect()]
    wanted = {(p[5], q[5]) for p in a for q in b if p[0] == q[0] and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(found) == len(set(found)) and set(found) == wanted


# warping


def plain_value(grid, y, x, resampling):
    weight, reach = warping.RESAMPLING[resampling]
    inside = lambda j, i: 0 <= j < grid.shape[0] and 0 <= i < grid.shape[1] and not np.isnan(grid[j, i])
    if not inside(int(np.floor(y)), int(np.floor(x))):
        return -1.0
    low_y, low_x = int(np.floor(y - 0.5)), int(np.floor(x - 0.5))
    taps = [(float(weight(np.array(abs(y - 0.5 - j))) * weight(np.array(abs(x - 0.5 - i)))), grid[j, i]) for j in range(low_y - reach + 1, low_y + reach + 1) for i in range(low_x - reach + 1, low_x + reach + 1) if inside(j, i)]
    return sum(w * v for w, v in taps) / sum(w for w, _ in taps)


@pytest.mark.parametrize("resampling", sorted(warping.RESAMPLING))
def test_kernels_across_blocks(spark, resampling):
    rng = np.random.default_rng(7)
    grid = rng.normal(100, 30, (21, 33))
    grid[5:8, 10:13] = np.nan
    px = spark.createDataFrame([("r", int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(grid) if not np.isnan(v)], "raster_name string, y int, x int, value double")
    places = [("r", i // 20, i % 20, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-2, 23, 380), rng.uniform(-2, 35, 380), strict=True))] + [("r", 50, 0, 7.5, 15.5), ("r", 50, 1, None, 3.0), ("none", 50, 2, 3.0, 3.0)]
    df = spark.createDataFrame(places, "raster_name string, y int, x int, sy double, sx double")
    found = {(r["raster_name"], r["y"], r["x"]): r["value"] for r in warping.sampled(px, df, ["raster_name"], [], resampling, block=8, fill=-1.0).collect()}
    wanted = {(n, y, x): -1.0 if sy is None or n == "none" else plain_value(grid, sy, sx, resampling) for n, y, x, sy, sx in places}
    assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(v, abs=1e-9) for k, v in wanted.items())


def test_warping_does_not_depend_on_the_block(spark):
    px = spark.range(1600).select(F.lit("r").alias("raster_name"), (F.col("id") / 40).cast("int").alias("y"), (F.col("id") % 40).cast("int").alias("x"), (F.col("id") * 37 % 101).alias("value"))
    rasters = px.select("raster_name").distinct().withColumn("transform", X.affine(0.1, 0, 10.0, 0, -0.1, 52.0))
    grids = rasters.select("raster_name", X.affine(4000.0, 0, 1105000.0, 0, -4000.0, 6810000.0).alias("grid"), F.lit(60).alias("width"), F.lit(50).alias("height"))
    by = [{(r["y"], r["x"]): round(r["value"], 9) for r in georeference.warp(px, rasters, grids, 4326, 3857, resampling="cubic", block=b).collect()} for b in (7, 64)]
    assert by[0] == by[1] and len(by[0]) == 3000 and len(set(by[0].values())) > 1000


def test_unknown_tile_classes_are_an_error(spark):
    px = spark.createDataFrame([("r", 0, 0, 1)], "raster_name string, y int, x int, value int")
    rasters = px.select("raster_name", F.lit(1).alias("width"), F.lit(1).alias("height"), X.affine(1.0, 0, 0.0, 0, -1.0, 0.0).alias("transform"))
    tile = "tile_class string, raster_name string, z int, x int, y int, x_off int, y_off int, src_w int, src_h int"
    good = spark.createDataFrame([("ImagePixelTile", "r", None, None, None, 0, 0, 1, 1)], tile)
    assert {r["value"] for r in readers.read_tiles(rasters, px, good, 2).collect()} == {1}
    with pytest.raises(Exception, match="no such tile class: Other"):
        readers.read_tiles(rasters, px, good.withColumn("tile_class", F.lit("Other")), 2).collect()


def test_extents_of_tiles(spark):
    tile = spark.createDataFrame([(3, 5, 40, 30)], "x_off int, y_off int, src_w int, src_h int")
    corners = georeference.local_pixel_corners()
    width, height = georeference.tile_extent(corners)
    metres = georeference.tile_extent(corners, 0.5, 0.25)
    found = tile.select(*[c.alias(f"c{i}") for i, c in enumerate(corners)], width.alias("w"), height.alias("h"), metres[0].alias("mw"), metres[1].alias("mh")).first()
    assert [tuple(found[f"c{i}"]) for i in range(4)] == [(5, 3), (5, 43), (35, 43), (35, 3)]
    assert (found["w"], found["h"], found["mw"], found["mh"]) == (40.0, 30.0, 20.0, 7.5)
