"""Files by windows, lazy runs, sidecars, granules over JDBC, checked writes and projections against plain computations."""

from __future__ import annotations

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessella.functions import exprs as X
from tessella.functions import projections, stages
from tessella.operators import assertions
from tessella.sources import images, lazy, sidecars, tiff

PACKED = "name string, width int, height int, data array<int>, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>, epsg int"
AT = {"a": 0.5, "b": 0.0, "c": 10.0, "d": 0.0, "e": -0.5, "f": 50.0}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tiff"))
    rng = np.random.default_rng(1)
    found = {f"r{i}": rng.integers(0, 200, (37, 23, 3)) for i in range(3)}
    rows = [(k, 23, 37, v.ravel().tolist(), AT, 32633) for k, v in found.items()]
    tiff.write_rasters(spark.createDataFrame(rows, PACKED), path, kind="uint8", strip="5")
    return path, found


def test_files_come_back_whole(spark, stored):
    path, images_ = stored
    assert sorted(os.listdir(path)) == ["r0.tif", "r1.tif", "r2.tif"]
    found = {(r["path"][-6:-4], r["y"], r["x"], r["band"]): r["value"] for r in tiff.read_pixels(spark, path, share="300").collect()}
    assert found == {(k, y, x, b): float(v[y, x, b]) for k, v in images_.items() for y, x, b in np.ndindex(v.shape)}
    about = {(r["width"], r["height"], r["bands"], r["kind"], tuple(r["transform"]), r["epsg"], r["nodata"]) for r in tiff.read_rasters(spark, path).collect()}
    assert about == {(23, 37, 3, "uint8", (0.5, 0.0, 10.0, 0.0, -0.5, 50.0), 32633, None)}
    # Spark's own image source, in the JVM, reads them too.
    own = {(r["width"], r["height"], r["nChannels"]) for r in spark.read.format("image").load(path).select("image.*").collect()}
    assert own == {(23, 37, 3)}


def test_only_strips_of_the_window_are_read(spark, stored, tmp_path):
    path, images_ = stored
    with open(f"{path}/r1.tif", "rb") as file:
        raw = bytearray(file.read())
    header = tiff.read_header(fs.LocalFileSystem().open_input_file(f"{path}/r1.tif"))
    for number, (at, size) in enumerate(zip(header.tags[tiff.STRIPS], header.tags[tiff.STRIP_BYTES], strict=True)):
        if number not in (2, 3):  # rows 10 to 19
            raw[at : at + size] = b"\xff" * size  # no longer to be unpacked
    (tmp_path / "r1.tif").write_bytes(raw)
    window = tiff.read_pixels(spark, str(tmp_path)).where("y between 10 and 14 and x > 3 and x <= 9 and band = 1")
    assert {(r["y"], r["x"]): r["value"] for r in window.collect()} == {(y, x): float(images_["r1"][y, x, 1]) for y in range(10, 15) for x in range(4, 10)}
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "y#" in plan and ">= 10" not in plan  # the bounds were taken by the source
    with pytest.raises(Exception, match="Error -3|incorrect header"):
        tiff.read_pixels(spark, str(tmp_path)).where("y < 3").collect()


def test_filters_that_are_pushed(tmp_path):
    reader = tiff.Reader({"path": str(tmp_path)})
    g, eq = tiff.GreaterThan(("y",), 4), tiff.EqualTo(("value",), 3.0)
    assert list(reader.pushFilters([g, eq, tiff.LessThanOrEqual(("x",), 9), tiff.In(("path",), ("a", "b"))])) == [eq]
    assert reader.low == {"y": 5} and reader.high == {"x": 9} and reader.paths == {"a", "b"}


def test_tiles_planes_predictors_and_large_files(spark, tmp_path):
    """A big-endian BigTIFF of two planes in tiles of 16, deflated with the horizontal predictor."""
    image = np.random.default_rng(2).integers(-3000, 3000, (20, 35, 2)).astype(">i2")
    blocks = []
    for plane in range(2):
        for r in range(2):
            for c in range(3):
                tile = np.zeros((16, 16), ">i2")
                part = image[16 * r : 16 * r + 16, 16 * c : 16 * c + 16, plane]
                tile[: part.shape[0], : part.shape[1]] = part
                blocks.append(zlib.compress(np.diff(tile.astype(np.int16), axis=1, prepend=np.int16(0)).astype(">i2").tobytes()))
    starts = np.cumsum([16, *map(len, blocks)])
    tags = {256: ("H", [35]), 257: ("H", [20]), 258: ("H", [16, 16]), 259: ("H", [8]), 277: ("H", [2]), 284: ("H", [2]), 317: ("H", [2]), 322: ("H", [16]), 323: ("H", [16]), 324: ("Q", starts[:-1].tolist()), 325: ("I", list(map(len, blocks))), 339: ("H", [2, 2]), 42113: ("s", b"-9999\0"), 33550: ("d", [2.0, 3.0, 0.0]), 33922: ("d", [1.0, 1.0, 0.0, 100.0, 200.0, 0.0])}
    at, beyond, entries = int(starts[-1]), b"", b""
    after = at + 8 + 20 * len(tags) + 8
    for tag in sorted(tags):
        letter, values = tags[tag]
        data = values if letter == "s" else struct.pack(f">{len(values)}{letter}", *values)
        spot = data.ljust(8, b"\0") if len(data) <= 8 else struct.pack(">Q", after + len(beyond))
        beyond += data if len(data) > 8 else b""
        entries += struct.pack(">HHQ", tag, {"H": 3, "I": 4, "Q": 16, "s": 2, "d": 12}[letter], len(values)) + spot
    (tmp_path / "t.tif").write_bytes(struct.pack(">2sHHHQ", b"MM", 43, 8, 0, at) + b"".join(blocks) + struct.pack(">Q", len(tags)) + entries + bytes(8) + beyond)
    found = {(r["y"], r["x"], r["band"]): r["value"] for r in tiff.read_pixels(spark, str(tmp_path), share="200").collect()}
    assert found == {(y, x, b): float(image[y, x, b]) for y, x, b in np.ndindex(image.shape)}
    about = tiff.read_rasters(spark, str(tmp_path)).first()
    assert (about["kind"], about["nodata"], tuple(about["transform"])) == ("int16", -9999.0, (2.0, 0.0, 98.0, 0.0, -3.0, 203.0))


def test_a_failed_task_leaves_no_file_and_a_rerun_writes_the_same(spark, stored, tmp_path):
    _, images_ = stored
    rows = [(k, 23, 37, v.ravel().tolist(), AT, 32633) for k, v in images_.items()]
    good = spark.createDataFrame(rows, PACKED).repartition(3)
    bad = good.withColumn("height", F.when(F.col("name") == "r2", 36).otherwise(F.col("height")))
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="reshape"):
        tiff.write_rasters(bad, path)
    assert not os.path.exists(path) or os.listdir(path) == []
    tiff.write_rasters(good, path, kind="uint8")
    first = {n: (tmp_path / "out" / n).read_bytes() for n in os.listdir(path)}
    assert sorted(first) == ["r0.tif", "r1.tif", "r2.tif"]
    with pytest.raises(Exception, match="there already"):
        tiff.write_rasters(good, path, kind="uint8")
    tiff.write_rasters(good.coalesce(1), path, "overwrite", kind="uint8")
    assert {n: (tmp_path / "out" / n).read_bytes() for n in os.listdir(path)} == first
    tiff.write_rasters(good.where("name = 'r1'"), path, "overwrite", kind="uint8")
    assert os.listdir(path) == ["r1.tif"]
    with pytest.raises(Exception, match="one name"):
        tiff.write_rasters(good.withColumn("name", F.lit("same")), path, "overwrite")
    assert os.listdir(path) == ["r1.tif"]


def test_lazy_runs_make_only_what_is_missing(spark, tmp_path):
    path, asked = str(tmp_path), []

    def make(todo):
        asked.append(sorted(r["k"] for r in todo.collect()))
        return todo.where("k <> 3").withColumn("value", F.col("k") * 10)

    plan = spark.createDataFrame([(k,) for k in (1, 2, 2, 3)], "k int")
    assert lazy.run(plan, make, path, ["k"]) is not None
    assert lazy.run(plan, make, path, ["k"]) is None  # 3 is made, without a row

    def broken(todo):
        raise RuntimeError("stopped")

    more = spark.range(1, 7).selectExpr("int(id) k")
    with pytest.raises(RuntimeError):
        lazy.run(more, broken, path, ["k"])
    # A run that wrote its rows but not its entry is not read.
    spark.createDataFrame([(5, -1, "lost")], "k int, value int, run string").write.mode("append").partitionBy("run").parquet(f"{path}/made")
    lazy.run(more, make, path, ["k"])
    assert asked == [[1, 2, 3], [4, 5, 6]]
    assert sorted((r["k"], r["value"]) for r in lazy.made(spark, path, ["k"]).collect()) == [(1, 10), (2, 20), (4, 40), (5, 50), (6, 60)]
    lazy.run(plan.where("k = 2"), lambda todo: todo.withColumn("value", F.lit(0)), path, ["k"], again=True)
    assert sorted((r["k"], r["value"]) for r in lazy.made(spark, path, ["k"]).collect()) == [(1, 10), (2, 0), (4, 40), (5, 50), (6, 60)]


def test_sidecars_go_out_and_come_back(spark, tmp_path):
    t = lambda *v: Row(**dict(zip("abcdef", v, strict=True)))
    schema = "path string, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>, crs string"
    rows = [("x/1.png", t(0.1, 0.0, 1e6 + 1 / 3, 0.0, -0.1, 5.0), "EPSG:32633"), ("x/2.png", None, "a <odd> & name"), ("x/3.png", None, None), ("x/4.png", t(2.0, 1e-17, 3.0, 4.0, 5.0, 6.0), None)]
    df = spark.createDataFrame(rows, schema)
    texts = df.select(F.concat("path", F.lit(".aux.xml")).alias("path"), sidecars.sidecar_xml().alias("text"))
    found = {r["path"]: (r["transform"], r["crs"]) for r in sidecars.sidecars(texts).collect()}
    assert found == {p: (g, c) for p, g, c in rows}
    odd = ["<PAMDataset><GeoTransform>1, 2, 3</GeoTransform></PAMDataset>", "no xml", None, "<PAMDataset/>", "<PAMDataset><SRS>  </SRS><GeoTransform>1,2,3,4,5,x</GeoTransform></PAMDataset>"]
    files = spark.createDataFrame([(f"{i}.aux.xml", v) for i, v in enumerate(odd)] + [("7.png", "x")], "path string, text string")
    assert {(r["path"], r["transform"], r["crs"]) for r in sidecars.sidecars(files).collect()} == {(str(i), None, None) for i in range(5)}
    default = t(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    bare = spark.createDataFrame([("x/1.png", None, None), ("x/4.png", default, "EPSG:1"), ("x/2.png", rows[0][1], None), ("x/9.png", None, None)], schema)
    merged = {r["path"]: (r["transform"], r["crs"]) for r in sidecars.with_sidecars(bare, sidecars.sidecars(texts)).collect()}
    assert merged == {"x/1.png": rows[0][1:], "x/4.png": (rows[3][1], "EPSG:1"), "x/2.png": (rows[0][1], "a <odd> & name"), "x/9.png": (None, None)}
    (tmp_path / "r.tif.aux.xml").write_text("<PAMDataset>\n  <SRS>EPSG:3857</SRS>\n  <GeoTransform> 1.0, 2, 3, 4, 5, 6e0</GeoTransform>\n</PAMDataset>\n")
    (tmp_path / "r.tif").write_text("no raster")
    one = sidecars.read_sidecars(spark, str(tmp_path)).collect()
    sidecars.write_sidecars(df, f"{tmp_path}/out")
    assert {r["path"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"x/1.png.aux.xml", "x/2.png.aux.xml", "x/4.png.aux.xml"}
    assert [(r["path"].rsplit("/", 1)[1], tuple(r["transform"]), r["crs"]) for r in one] == [("r.tif", (2.0, 3.0, 1.0, 5.0, 6.0, 4.0), "EPSG:3857")]


def test_granules_are_filtered_in_the_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rng = random.Random(3)
    rows = [(f"g{i}", x, y, x + w, y + w) for i in range(4000) for x, y, w in [(rng.uniform(-170, 170), rng.uniform(-80, 80), rng.uniform(0.1, 9))]]
    granules = spark.createDataFrame(rows, "granule string, w double, s double, e double, n double")
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    granules.write.jdbc(url, "granules", properties=driver)
    tiles = spark.createDataFrame([(x, y, x + 1.0, y + 1.0) for x, y in ((3.0, 4.0), (4.0, 4.0), (60.0, -30.0), (61.5, -31.0), (-120.0, 45.0))], "west double, south double, east double, north double")
    bounds, driver = ('"w"', '"s"', '"e"', '"n"'), driver | {"ident": '"granule"'}
    found = images.read_granules(spark, url, "granules", tiles=tiles, bounds=bounds, most=16, **driver)
    assert 3 <= found.rdd.getNumPartitions() <= 16
    assert 0 < found.select("granule").distinct().count() < 400  # the others never leave the database
    boxes = [tuple(r) for r in tiles.collect()]
    meets = lambda r, t: r[1] <= t[2] and r[3] >= t[0] and r[2] <= t[3] and r[4] >= t[1]
    wanted = {r[0] for r in rows if any(meets(r, t) for t in boxes)}
    assert {r["granule"] for r in images.granules_of_tiles(tiles, found).collect()} == wanted != set()
    assert images.read_granules(spark, url, "granules", tiles=tiles.limit(0), bounds=bounds, **driver).count() == 0
    assert images.read_granules(spark, url, "granules", bounds=bounds, **driver).count() == 4000


def test_checked_writes(spark, tmp_path):
    rows = spark.range(20).withColumns({"own": X.affine(1.0, 0, F.col("id").cast("double"), 0, -1.0, 0.0), "expected": X.affine(1.0, 0, F.col("id") + F.when(F.col("id") == 7, 1.0).otherwise(0.0), 0, -1.0, 0.0)})
    tracker, group = spark.sparkContext.statusTracker(), "checked"
    spark.sparkContext.setJobGroup(group, "")
    out = assertions.checked_write(rows.where("id < 5"), lambda df: df.write.parquet(f"{tmp_path}/a"), wrong=assertions.wrong_transform("own", "expected"))
    assert out == {"rows": 5, "wrong": 0} and len(tracker.getJobIdsForGroup(group)) == 1  # one pass
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(assertions.Broken) as e:
        assertions.checked_write(rows, lambda df: df.write.parquet(f"{tmp_path}/b"), wrong=assertions.wrong_transform("own", "expected"))
    assert e.value.metrics == {"wrong": 1}
    with pytest.raises(assertions.Broken) as e:
        assertions.checked_write(rows.where("id > 99"), lambda df: df.write.parquet(f"{tmp_path}/c"))
    assert e.value.metrics == {"rows": 0}


def test_staged_tables_go_at_the_end(spark):
    with stages.scratch(spark):
        kept = stages.staged(spark.range(5))
        assert kept.count() == 5
        where = kept.staged_at.removeprefix("file:")
        assert os.path.isdir(where)
    assert not os.path.exists(where)


# Published worked examples.
CLARKE_FEET, CLARKE = projections.Ellipsoid(20925832.16, 294.97870), projections.Ellipsoid(6378206.4, 294.978698)
EXAMPLES = [
    (projections.LambertConformal(27 + 50 / 60, -99.0, 28 + 23 / 60, 30 + 17 / 60, 2000000.0, 0.0, CLARKE_FEET), (-96.0, 28.5), (2963503.91, 254759.80), 0.02),
    (projections.PolarStereographic(-71.0, 70.0, 6000000.0, 6000000.0), (120.0, -75.0), (7255380.79, 7053389.56), 0.02),
    (projections.AlbersEqualArea(23.0, -96.0, 29.5, 45.5, 0.0, 0.0, CLARKE), (-75.0, 35.0), (1885472.7, 1535925.0), 0.1),
]


@pytest.mark.parametrize("projection, place, wanted, within", EXAMPLES)
def test_projections_of_published_examples(spark, projection, place, wanted, within):
    x, y = projection.forward(F.lit(place[0]), F.lit(place[1]))
    found = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert found["x"] == pytest.approx(wanted[0], abs=within) and found["y"] == pytest.approx(wanted[1], abs=within)


@pytest.mark.parametrize("code", [*projections.KNOWN, 3857, 32633, projections.LambertConformal(-30.0, 175.0, -20.0, -40.0), projections.AlbersEqualArea(10.0, -170.0, 20.0, 20.0), projections.PolarStereographic(90.0, 10.0)])
def test_projections_come_back(spark, code):
    centre = {2154: (3, 46), 3034: (10, 52), 5070: (-96, 38), 3577: (134, -26), 3995: (0, 80), 3031: (0, -80), 3857: (0, 0), 32633: (15, 40)}.get(code) if isinstance(code, int) else {projections.LambertConformal: (175, -30), projections.AlbersEqualArea: (-170, 20), projections.PolarStereographic: (10, 80)}[type(code)]
    reach = 3 if code == 32633 else 12
    df = spark.range(400).select((centre[0] + (F.col("id") % 20 - 9.5) / 10 * reach).alias("lon"), (centre[1] + (F.floor(F.col("id") / 20) - 9.5) / 12 * (9 if abs(centre[1]) == 80 else 12)).alias("lat"))
    x, y = projections.point_transformer(4326, code)(F.col("lon"), F.col("lat"))
    lon, lat = projections.point_transformer(code, 4326)(F.col("x"), F.col("y"))
    turn = F.abs(F.pmod(lon - F.col("lon") + 180, F.lit(360.0)) - 180)
    worst = df.withColumns({"x": x, "y": y}).select(F.max(F.greatest(turn * F.cos(F.radians("lat")), F.abs(lat - F.col("lat"))))).first()[0]
    assert worst < 1e-6
    with pytest.raises(ValueError, match="not known"):
        projections.point_transformer(4326, 999)


def test_bounds_follow_bent_sides(spark):
    box = F.struct(F.lit(-2.0).alias("left"), F.lit(45.0).alias("bottom"), F.lit(8.0).alias("right"), F.lit(49.0).alias("top"))
    found = spark.range(1).select(projections.densified_bounds(box, 4326, 2154).alias("b")).select("b.*").first()
    move = projections.point_transformer(4326, 2154)
    rng = np.random.default_rng(1)
    inside = spark.createDataFrame([(float(x), float(y)) for x, y in zip(rng.uniform(-2, 8, 500), rng.uniform(45, 49, 500), strict=True)], "lon double, lat double")
    x, y = move(F.col("lon"), F.col("lat"))
    r = inside.select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert found["left"] <= r[0] and r[1] <= found["right"] and found["bottom"] <= r[2] + 500 and r[3] <= found["top"] + 500
    # The middle of the lower side lies lower than its corners.
    corner = spark.range(1).select(move(F.lit(-2.0), F.lit(45.0))[1].alias("y")).first()["y"]
    assert found["bottom"] < corner - 1000
