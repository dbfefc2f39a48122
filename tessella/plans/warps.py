"""Queries: rasters read through kernels, on grids in another CRS and as tiles of both classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import exprs as X
from tessella.operators import georeference
from tessella.plans import rasters as R
from tessella.plans.files import OFF_HALVES
from tessella.sources import readers

#: Rasters of 40 x 40 pixels go in blocks of so many each way.
BLOCK = 16


def _rasters(px: DataFrame) -> DataFrame:
    return px.select("raster_name").distinct().select("raster_name", F.lit(40).alias("width"), F.lit(40).alias("height"), X.affine(0.1, 0, 10.0, 0, -0.1, 52.0).alias("transform"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round(F.col("value") + OFF_HALVES, 6))


def _warped(spark: SparkSession, d: str, resampling: str) -> DataFrame:
    px = R._base_raster_pixels(spark, d)
    rasters = _rasters(px)
    grids = rasters.select("raster_name", X.affine(13000.0, 0, 1100000.0, 0, -13000.0, 6820000.0).alias("grid"), F.lit(37).alias("width"), F.lit(45).alias("height"))
    return _rounded(georeference.warp(px, rasters, grids, 4326, 3857, resampling=resampling, block=BLOCK))


def warp_bilinear(spark: SparkSession, d: str) -> DataFrame:
    """Rasters in EPSG:4326 on a grid in EPSG:3857, four source pixels each."""
    return _warped(spark, d, "bilinear")


def warp_cubic(spark: SparkSession, d: str) -> DataFrame:
    """As warp_bilinear, sixteen source pixels each."""
    return _warped(spark, d, "cubic")


def warp_lanczos(spark: SparkSession, d: str) -> DataFrame:
    """As warp_bilinear, thirty-six source pixels each."""
    return _warped(spark, d, "lanczos")


def tiles_by_class(spark: SparkSession, d: str) -> DataFrame:
    """A mercator tile and an overhanging pixel tile of each raster, each read as its class asks."""
    px = R._base_raster_pixels(spark, d)
    rasters = _rasters(px)
    tile = lambda kind, **at: F.struct(F.lit(kind).alias("tile_class"), *[F.lit(at.get(k)).cast("int").alias(k) for k in ("z", "x", "y", "x_off", "y_off", "src_w", "src_h")])
    both = F.array(tile("MercatorTile", z=8, x=136, y=84), tile("ImagePixelTile", x_off=-5, y_off=20, src_w=30, src_h=24))
    tiles = rasters.select("raster_name", F.explode(both).alias("t")).select("raster_name", "t.*")
    return _rounded(readers.read_tiles(rasters, px, tiles, 18, resampling="bilinear", block=BLOCK))


QUERIES = {f.__name__: f for f in (warp_bilinear, warp_cubic, warp_lanczos, tiles_by_class)}

#: Weights of |d|, and the reach, of each kernel.
_KERNELS = {
    "bilinear": ("greatest(0, 1 - {d})", 1),
    "cubic": ("case when {d} <= 1 then (1.5::double * {d} - 2.5::double) * {d} * {d} + 1 when {d} < 2 then ((2.5::double - 0.5::double * {d}) * {d} - 4) * {d} + 2 else 0 end", 2),
    "lanczos": ("case when {d} = 0 then 1 when {d} < 3 then sin(pi() * {d}) / (pi() * {d}) * sin(pi() * {d} / 3) / (pi() * {d} / 3) else 0 end", 3),
}


def _sampled_sql(kernel: str) -> str:
    """taken (all of spot, and value) for spot (raster_name, n, sy, sx): every source pixel in reach of each place, by the formula."""
    weight, reach = _KERNELS[kernel]
    return f"""tap as (select a.*, r.val, {weight.format(d='abs(a.sy - 0.5 - r.y)')} * {weight.format(d='abs(a.sx - 0.5 - r.x)')} w
            from spot a join generate_series({1 - reach}, {reach}) j(j) on true join generate_series({1 - reach}, {reach}) i(i) on true
            join ras r on r.raster_name = a.raster_name and r.y = floor(a.sy - 0.5) + j.j and r.x = floor(a.sx - 0.5) + i.i),
        sums as (select raster_name, n, sum(w * val) / sum(w) as value from tap group by 1, 2),
        taken as (select a.*, round(case when floor(a.sy) between 0 and 39 and floor(a.sx) between 0 and 39 then s.value else 0 end + {OFF_HALVES:.7f}::double, 6) as value from spot a left join sums s on s.raster_name = a.raster_name and s.n = a.n)"""


def _warped_sql(kernel: str) -> str:
    return f"""with {R._FULL}, t as (select distinct raster_name from ras),
        spot as (select raster_name, i.i * 1000 + j.i n, i.i::int y, j.i::int x, (52 - degrees(2 * atan(exp((6820000 - 13000 * (i.i + 0.5::double)) / 6378137)) - pi() / 2)) * 10 sy, (degrees((1100000 + 13000 * (j.i + 0.5::double)) / 6378137) - 10) * 10 sx
               from t cross join generate_series(0, 44) i(i) cross join generate_series(0, 36) j(i)), {_sampled_sql(kernel)}
        select raster_name, y, x, value from taken"""


ORACLE_SQL = {
    "warp_bilinear": _warped_sql("bilinear"),
    "warp_cubic": _warped_sql("cubic"),
    "warp_lanczos": _warped_sql("lanczos"),
    "tiles_by_class": f"""with {R._FULL}, t as (select distinct raster_name from ras),
        grid as (select raster_name, i.i::int "row", j.i::int col from t cross join generate_series(0, 17) i(i) cross join generate_series(0, 17) j(i)),
        spot as (select raster_name, "row" * 100 + col n, 'MercatorTile' tile_class, 8 z, 136 tile_x, 84 tile_y, null::int x_off, null::int y_off, null::int src_w, null::int src_h, "row", col,
                 (52 - degrees(atan(sinh(pi() * (1 - 2 * (84 + ("row" + 0.5::double) / 18) / 256))))) * 10 sy, ((136 + (col + 0.5::double) / 18) / 256 * 360 - 190) * 10 sx from grid
               union all select raster_name, 10000 + "row" * 100 + col, 'ImagePixelTile', null, null, null, -5, 20, 30, 24, "row", col, 20 + ("row" + 0.5::double) * 24 / 18, -5 + (col + 0.5::double) * 30 / 18 from grid), {_sampled_sql("bilinear")}
        select tile_class, raster_name, z, tile_x, tile_y, x_off, y_off, src_w, src_h, "row", col, value from taken""",
}
