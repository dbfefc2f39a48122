"""The driver's tables in the shapes of the engine: rasters, tiles, pixels, points, polygons, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rasters(spark: SparkSession, d: str) -> DataFrame:
    """A raster catalog from supplier."""
    k = F.col("s_suppkey")
    gsd = F.lit(0.05) * (1 + k % 4)
    x, y = (500000 + k * 100).cast("double"), (5800000 - k * 50).cast("double")
    zero = F.lit(0.0)
    return _read(spark, d, "supplier").select(
        F.concat(F.lit("raster_"), k).alias("raster_name"), (600 + (k * 37) % 400).cast("int").alias("width"), (500 + (k * 53) % 300).cast("int").alias("height"), F.lit(3).alias("bands"),
        gsd.alias("gsd"), F.struct(gsd.alias("a"), zero.alias("b"), x.alias("c"), zero.alias("d"), (-gsd).alias("e"), y.alias("f")).alias("transform"), F.lit("EPSG:32633").alias("crs"),
    )


def tile_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping 8x8 tiles (10x10 a raster, 4 apart) in long form from embeddings: val 0 to 5, u8 0 to 255."""
    rows = _read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    v = F.col("v").cast("double") + 0.6
    return rows.select(
        "vec_id", F.concat(F.lit("r"), F.floor(F.col("vec_id") / 100)).alias("raster_name"), (F.col("vec_id") % 10 * 4).cast("int").alias("x_off"), (F.floor(F.col("vec_id") / 10) % 10 * 4).cast("int").alias("y_off"),
        F.lit(8).alias("src_w"), F.lit(8).alias("src_h"), F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"),
        F.least(F.floor(v * 5), F.lit(5)).cast("int").alias("val"), F.greatest(F.least(F.floor(v * 212), F.lit(255)), F.lit(0)).cast("int").alias("u8"),
    )


def predicted_pixels(spark: SparkSession, d: str) -> DataFrame:
    """tile_pixels with a prediction that is wrong at some pixels."""
    wrong = (F.col("vec_id") + F.col("y") * 3 + F.col("x") * 5) % 7 == 0
    return tile_pixels(spark, d).withColumn("pred", F.when(wrong, (F.col("val") + 1) % 6).otherwise(F.col("val")))


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return _read(spark, d, "customer").select(k.alias("point_id"), (((k * 7919) % 360000).cast("double") / 1000 - 180).alias("lon"), (((k * 104729) % 170000).cast("double") / 1000 - 85).alias("lat"))


def triangles(spark: SparkSession, d: str) -> DataFrame:
    """Polygons in pixel space from orders: feature_id, rings, category_index."""
    x, y = (F.col("o_orderkey") % 40).cast("double"), (F.col("o_custkey") % 40).cast("double")
    point = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    kind = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("feature_id"), F.array(F.array(point(0.0, 0.0), point(7.0, 1.0), point(2.0, 6.0), point(0.0, 0.0))).alias("rings"), kind.alias("category_index"))


#: Polygons by what is right or wrong with them; rings of points (x, y).
ODD_SHAPES = (
    [[(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)], [(4, 4), (4, 8), (8, 8), (8, 4), (4, 4)]],
    [[(0, 0), (20, 20), (20, 0), (0, 20), (0, 0)]],
    [[(0, 0), (20, 0), (20, 20), (20, 30), (20, 20), (0, 20), (0, 0)]],
    [[(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)], [(24, 4), (24, 8), (28, 8), (28, 4), (24, 4)]],
    [[(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)], [(2, 2), (2, 18), (18, 18), (18, 2), (2, 2)], [(6, 6), (6, 9), (9, 9), (9, 6), (6, 6)]],
    [[(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)], [(4, 4), (4, 8), (8, 8), (8, 4), (4, 4)], [(8, 8), (8, 12), (12, 12), (12, 8), (8, 8)]],
    [[(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)], [(4, 10), (16, 10), (10, 16), (4, 10)], [(4, 10), (10, 4), (16, 10), (10, 7), (4, 10)]],
    [[(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)], [(15, 5), (15, 9), (25, 9), (25, 5), (15, 5)]],
    [[(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)], [(20, 5), (14, 5), (14, 9), (20, 9), (20, 5)]],
    [[(0, 0), (20, 0), (20, 20), (0, 20)]],
    [[(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)], [(10, 0), (6, 6), (14, 6), (10, 0)]],
    [[(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)], [(5, 20), (10, 25), (15, 20), (10, 15), (5, 20)]],
    [[(0, 0), (20, 0), (20, 0), (20, 20), (0, 20), (0, 0)]],
    [[(0, 0), (20, 0), (0, 0)]],
)


def odd_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Polygons of ODD_SHAPES from orders, moved about: feature_id, shape, rings."""
    # A constant, where text would be parsed anew for every row.
    point = lambda p: F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y"))
    listed = F.array(*[F.array(*[F.array(*map(point, ring)) for ring in shape]) for shape in ODD_SHAPES])
    shape = F.element_at(listed, (F.col("o_orderkey") % len(ODD_SHAPES) + 1).cast("int"))
    dx, dy = (F.col("o_custkey") % 500) * 1000, F.col("o_custkey") % 7 - 3
    rings = F.transform(shape, lambda r: F.transform(r, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))))
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("feature_id"), (F.col("o_orderkey") % len(ODD_SHAPES)).cast("int").alias("shape"), rings.alias("rings"))


def layered_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of up to five rasters over four 32x32 tiles from lineitem: tile_id, y, x, band, raster_ord, value."""
    value = F.when(F.col("l_returnflag") == "N", 0).otherwise(F.col("l_quantity").cast("int"))
    keys = [
        F.concat(F.lit("l"), F.col("l_suppkey") % 4).alias("tile_id"), (F.col("l_partkey") % 32).cast("int").alias("y"), (F.col("l_orderkey") % 32).cast("int").alias("x"),
        (F.col("l_linenumber") % 3).cast("int").alias("band"), (F.col("l_suppkey") % 5).cast("int").alias("raster_ord"),
    ]
    return _read(spark, d, "lineitem").groupBy(*keys).agg(F.max(value).alias("value"))


def cover(spark: SparkSession, d: str) -> DataFrame:
    """Mercator tiles at zoom 10 from events, as they come: z, x, y."""
    lon = ((F.col("user_id") * 7919) % 360000) / 1000.0 - 180
    return _read(spark, d, "events").select(F.lit(10).alias("z"), F.floor(lon / 360.0 * 1024 + 512).cast("int").alias("x"), (F.col("user_id") % 1024).cast("int").alias("y"))


def geojson(spark: SparkSession, d: str) -> DataFrame:
    """A GeoJSON feature a row from orders."""
    at = lambda c, n: (F.col(c) % 40 + n).cast("string")
    pair = lambda a, b: F.concat(F.lit("["), at("o_orderkey", a), F.lit(","), at("o_custkey", b), F.lit("]"))
    ring = F.concat_ws(",", pair(0, 0), pair(7, 1), pair(2, 6), pair(0, 0))
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[['), ring, F.lit("]]}}")).alias("feature_json"))


def tile_files(spark: SparkSession, d: str) -> DataFrame:
    """Paths of tile files from documents, two to a tile; every third tile has a sidecar for its second."""
    k = F.col("doc_id")
    n = F.floor(k / 2)
    path = F.concat(F.lit("image_pixel_tiles/r"), n % 7, F.lit("/width_height_900_900/width_offset_"), (n % 13) * 450 - 150, F.lit("/height_offset_"), (n % 11) * 450 - 150, F.when(k % 6 == 1, ".png.aux.xml").otherwise(".png"))
    return _read(spark, d, "documents").select(k.alias("file_id"), path.alias("tile_path"))
