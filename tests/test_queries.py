"""Every registered query against its SQL, and plans that must not compare all pairs."""

from __future__ import annotations

import pytest

from tessella.plans import registry
from tests.oracle import rows, run_sql


#: Queries that trace regions or apply kernels by array operations, and those that read files by their own source.
TRACED = {
    "vectorize_stats", "vectorize_regions", "vectorize_rings", "dissolve_polygons", "mask_footprint", "project_polygons", "whole_cover", "whole_footprints", "whole_segments",
    "warp_bilinear", "warp_cubic", "warp_lanczos", "warp_lambert", "tiles_by_class", "tiff_windows", "tiff_georeferences", "label_files", "fetched_files", "converted_files", "category_features",
}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(run_sql(registry.ORACLE_SQL[name], sf))


def test_pairs_of_files_are_found(spark, sf):
    assert registry.QUERIES["paired_files"](spark, sf).count() > 0


def test_every_sql_has_its_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES


@pytest.mark.parametrize("name", ["overlap_pairs", "tile_polygon_candidates", "fuse_tiles", "windowed_read", "cover_semi_join"])
def test_no_nested_loop_joins(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - TRACED))
def test_no_python_in_the_plan(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_scans_read_only_their_columns(spark, sf):
    plan = registry.QUERIES["mercator_index"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint>" in plan


def test_every_predicted_pixel_is_compared(spark, sf):
    pixels = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("sum(size(embedding))").first()[0]
    assert registry.QUERIES["confusion_map"](spark, sf).count() == 7 * pixels


def test_tiles_of_every_raster_meet_polygons(spark, sf):
    found = registry.QUERIES["tile_polygon_candidates"](spark, sf)
    rasters = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("count(distinct floor(vec_id / 100))").first()[0]
    assert found.select("raster_name").distinct().count() == rasters > 1
    assert found.select("feature_id").distinct().count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_boxes_across_the_antimeridian_have_both_sides(spark, tmp_path):
    inverse = pow(7919, -1, 360000)
    keys = [100 * inverse % 360000, 359900 * inverse % 360000]  # longitudes -179.9 and 179.9
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    found = {(r["point_id"], r["x"]) for r in registry.QUERIES["mercator_tiles_of_bbox"](spark, str(tmp_path)).collect()}
    assert found == {(k, x) for k in keys for x in (0, 511)}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
