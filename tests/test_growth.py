"""Queries over tables that grow: what the driver broadcasts, what one task holds, rows that do not fill a raster."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import stages
from tessella.operators import categories as K
from tessella.operators import georeference, tiling, vector
from tessella.operators.scheme import LocalScheme
from tessella.plans import registry
from tessella.sources import adapters as A
from tessella.sources import images, tiff
from tests.oracle import TABLES, rows, run_sql


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pixel_coordinates", "ratio_comment", "tile_bounds", "tile_bounds_json", "tile_count_closed_form", "tile_transform", "tiles_within_rasters", "tiling_statistics", "tiling_statistics_rollup"])
def test_tiles_carry_what_they_need_of_their_raster(spark, sf, name):
    assert "Join" not in _plan(registry.QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["ratio_comment", "tile_bounds", "tile_bounds_json", "tile_count_closed_form", "tile_transform", "tiles_within_rasters", "tiling_statistics"])
def test_no_task_holds_the_rows_of_most_rasters(spark, sf, name):
    """Rows are counted by the partition that they come out of, after the planner has merged those that it takes for small."""
    held = [r["count"] for r in registry.QUERIES[name](spark, sf).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) > 0 and max(held) <= sum(held) / 2


def test_rasters_are_dealt_out_before_they_become_tiles(spark, sf):
    tiles = tiling.local_tiles(A.rasters(spark, sf), LocalScheme((90, 90), (45, 45)), "width")
    assert tiles.columns == ["raster_name", "tile_ord", "x_off", "y_off", "src_w", "src_h", "width"]
    assert "REPARTITION_BY_NUM" in _plan(tiles)


@pytest.mark.parametrize("name", ["buffer_polygons"])
def test_pixels_of_polygons_meet_without_a_join(spark, sf, name):
    assert "Join" not in _plan(registry.QUERIES[name](spark, sf))


def test_polygons_are_not_broadcast_to_tiles(spark, sf):
    """What is broadcast is read from the tiles, not from the polygons' file."""
    lines = _plan(registry.QUERIES["rasterize_tiles"](spark, sf)).splitlines()
    assert lines
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            at = line.index("BroadcastExchange")
            inner = []
            for below in lines[i + 1 :]:
                if "- " in below and below.index("- ") < at:
                    break
                inner.append(below)
            assert "o_orderstatus" not in "".join(inner)


def test_tiles_json_is_dealt_out(spark, sf):
    assert "REPARTITION_BY_NUM" in _plan(registry.QUERIES["tile_json_roundtrip"](spark, sf))


@pytest.fixture(scope="module")
def uneven(spark, sf, tmp_path_factory):
    """Tables whose last raster has 15 of its 25 tiles, and a value below the usual ones."""
    d = str(tmp_path_factory.mktemp("uneven"))
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 156")
    low = F.when(F.col("vec_id") == 2, F.transform("embedding", lambda v: F.lit(-0.7).cast("float"))).otherwise(F.col("embedding"))
    vectors.withColumn("embedding", low).coalesce(1).toPandas().to_parquet(f"{d}/embeddings.parquet")
    for t in set(TABLES) - {"embeddings"}:
        os.symlink(f"{sf}/{t}.parquet", f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", ["tiff_georeferences", "tiff_windows", "converted_files"])
def test_rasters_that_tiles_do_not_fill(spark, uneven, name):
    found = rows(registry.QUERIES[name](spark, uneven).toPandas())
    assert found == rows(run_sql(registry.ORACLE_SQL[name], uneven)) and len(found[1]) > 1


@pytest.mark.parametrize("name", ["label_files", "fetched_files"])
def test_labels_below_zero_come_back_from_files(spark, uneven, name):
    found = rows(registry.QUERIES[name](spark, uneven).toPandas())
    assert found == rows(run_sql(registry.ORACLE_SQL[name], uneven)) and len(found[1]) > 1


def test_pixels_of_label_images_need_no_shuffle(spark):
    packed = spark.createDataFrame([(i, "a", 1, c, bytearray(b)) for i, c, b in ((0, 3, [0, 0, 255, 255, 0, 0]), (1, 4, [0, 255, 0, 9]), (2, 1, [255]), (3, 3, [7, 7, 7]))], "i int, name string, width int, channels int, data binary")
    found = images.label_pixels(packed, ["i", "name"], K.to_df(spark, K.LAND_COVER))
    assert sorted((r["i"], r["y"], r["x"], r["label"]) for r in found.collect()) == [(0, 0, 0, 0), (0, 1, 0, 1), (1, 0, 0, 2), (2, 0, 0, 0), (3, 0, 0, 0)]
    assert not any(x in _plan(found) for x in ("SortMergeJoin", "hashpartitioning(i", "hashpartitioning(_c"))


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"{i}.png").write_bytes(images.encode(np.zeros((1, 1), np.uint8)))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        assert images.read_images(spark, str(tmp_path)).rdd.getNumPartitions() >= 100
        with stages.many_small_files(spark):
            assert images.read_images(spark, str(tmp_path)).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_samples_that_do_not_fit_are_an_error(spark, tmp_path):
    raster = spark.createDataFrame([("a", 2, 1, [-1, 3])], "name string, width int, height int, data array<int>")
    with pytest.raises(Exception, match="do not fit"):
        tiff.write_rasters(raster, str(tmp_path / "t"), kind="uint8")


def test_nodata_is_written_and_read(spark, tmp_path):
    raster = spark.createDataFrame([("a", 2, 1, [1, 3], -9999.5)], "name string, width int, height int, data array<int>, nodata double")
    tiff.write_rasters(raster, str(tmp_path / "t"), kind="int16")
    assert tiff.read_rasters(spark, str(tmp_path / "t")).first()["nodata"] == -9999.5


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sums_of_control_points_are_taken_once(spark, sf):
    assert _optimized(registry.QUERIES["gcp_transform"](spark, sf)).count("aggregate(") <= 11


def test_sides_of_bounds_are_moved_once(spark, sf):
    assert _optimized(registry.QUERIES["projected_bounds"](spark, sf)).count("flatten(") == 1


def test_control_points_that_say_nothing(spark):
    point = "struct<row:int,col:int,x:double,y:double>"
    given = [("few", [(0, 0, 1.0, 1.0), (0, 5, 6.0, 1.0)]), ("line", [(0, 0, 1.0, 1.0), (1, 1, 2.0, 2.0), (2, 2, 3.0, 3.0)]), ("none", []), ("null", None)]
    found = spark.createDataFrame(given, f"name string, p array<{point}>").select("name", georeference.fitted_transform("p").alias("t")).collect()
    assert [r["t"] for r in found] == [None] * 4


def test_first_tiles_are_found_without_sorting(spark, sf):
    found = registry.QUERIES["debug_first_k_tiles"](spark, sf)
    assert not any(x in _plan(found) for x in ("Sort", "Window"))


def test_border_pixels_are_made_once(spark):
    tiles = spark.createDataFrame([("r", 0, 0, 4, 3), ("r", 0, 0, 4, 3), ("r", 8, 0, 4, 3)], "raster_name string, x_off int, y_off int, src_w int, src_h int")
    found = tiling.border_pixels(tiles, thickness=2)
    held = [(r["x_off"], r["x"], r["y"]) for r in found.collect()]
    spots = {(x, y) for o in (-1, 0, 1) for x, y in [(i, e + o) for i in range(4) for e in (0, 2)] + [(e + o, i) for i in range(3) for e in (0, 3)]}
    assert len(held) == len(set(held)) and set(held) == {(k, *s) for k in (0, 8) for s in spots}
    assert _plan(found.select("x", "y")).split("Generate explode(array_distinct")[0].count("Aggregate") == 0


def test_tracing_holds_few_cells_at_once():
    assert vector.CELLS_AT_ONCE * 400 < 100e6
