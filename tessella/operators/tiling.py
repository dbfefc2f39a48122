"""Enumeration of tiles over raster catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import exprs as X
from tessella.operators.scheme import LocalScheme


def tile_count(area: Column, stride: Column, size: Column, overhang: bool) -> Column:
    """Tiles along an axis: the last may overhang, or must be inside."""
    n = (area + stride - size) / stride
    return F.greatest((F.ceil(n) if overhang else F.floor(n)).cast("int"), F.lit(0))


def axis_layout(length: Column, size: Column, stride: Column, scheme: LocalScheme) -> Column:
    """struct(origin, negative, positive, offsets) of an axis of a raster of the given length.

    Tiles start at an origin and go from it in both directions; offsets hold
    the negative side first, outwards, then the positive one.
    """
    size_px = size.cast("int")
    base_stride = stride * F.greatest(F.rint(size / stride), F.lit(1.0)) if scheme.align_to_base else stride
    n = tile_count(length, base_stride, size_px, scheme.overhang)
    covered = n * base_stride + size_px - base_stride
    origin = {"centered_to_image": F.floor(length / 2), "optimized": F.floor((length - covered) / 2), "aligned_to_image_border": F.lit(0)}[scheme.alignment].cast("int")
    right = length - origin
    left = origin + F.least(size_px - stride, right)
    positive = tile_count(right, stride, size_px, scheme.overhang)
    negative = tile_count(left, stride, size_px, scheme.overhang)
    # A sequence from 1 to 0 would run backwards, hence the filter.
    steps = lambda count: F.filter(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: i <= count)
    before = F.transform(steps(negative), lambda i: (origin - F.floor(i * stride)).cast("int"))
    after = F.transform(steps(positive), lambda i: (origin + F.floor((i - 1) * stride)).cast("int"))
    return F.struct(origin.alias("origin"), negative.alias("negative"), positive.alias("positive"), F.concat(before, after).alias("offsets"))


def _in_pixels(scheme: LocalScheme) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """Size and stride as columns in source pixels."""
    if scheme.unit == "pixel":
        return tuple(F.lit(float(v)) for v in scheme.size), tuple(F.lit(float(v)) for v in scheme.stride)
    gx, gy = F.abs(F.col("transform.a")), F.abs(F.col("transform.e"))
    return (F.lit(float(scheme.size[0])) / gx, F.lit(float(scheme.size[1])) / gy), (F.lit(float(scheme.stride[0])) / gx, F.lit(float(scheme.stride[1])) / gy)


def raster_tilings(rasters: DataFrame, scheme: LocalScheme) -> DataFrame:
    """A row for each raster: its columns, src_w, src_h, stride_x, stride_y and the layouts of both axes."""
    (w, h), (sx, sy) = _in_pixels(scheme)
    return rasters.withColumns(
        {
            "src_w": w.cast("int"), "src_h": h.cast("int"), "stride_x": sx, "stride_y": sy,
            "layout_x": axis_layout(F.col("width"), w, sx, scheme), "layout_y": axis_layout(F.col("height"), h, sy, scheme),
        }
    )


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over as many tasks as a shuffle has (and at least one a core): for small files whose rows each make much work.

    The number is stated, so that the planner does not merge partitions that are small before they grow.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def local_tiles(rasters: DataFrame, scheme: LocalScheme, *keep: str | Column) -> DataFrame:
    """raster_name, tile_ord, x_off, y_off, src_w, src_h, keep: x goes outermost.

    keep: columns of raster_tilings that each tile carries along. A join of tiles with their rasters
    would do the same, but the planner takes tiles for as small as the catalog and may broadcast them.
    Rasters alone are shuffled, tiles are not.
    """
    t = raster_tilings(dealt(rasters, "raster_name"), scheme)
    x = t.select("raster_name", "src_w", "src_h", "layout_y", F.struct(*keep).alias("_keep") if keep else F.lit(None).alias("_keep"), F.posexplode("layout_x.offsets").alias("ix", "x_off"))
    y = x.select("raster_name", "src_w", "src_h", "_keep", "ix", "x_off", F.size("layout_y.offsets").alias("ny"), F.posexplode("layout_y.offsets").alias("iy", "y_off"))
    return y.select("raster_name", (F.col("ix") * F.col("ny") + F.col("iy")).alias("tile_ord"), "x_off", "y_off", "src_w", "src_h", *(["_keep.*"] if keep else []))


def first_local_tiles(rasters: DataFrame, scheme: LocalScheme, k: int) -> DataFrame:
    """The first k of local_tiles of each raster: they are numbered from 0 on, so nothing is sorted."""
    return local_tiles(rasters, scheme).where(F.col("tile_ord") < k)


def with_georeference(tiles: DataFrame, disk_w: int, disk_h: int) -> DataFrame:
    """tiles that carry their raster's transform with their own in its place, and bounds (left, bottom, right, top) in the raster's CRS."""
    own = X.tile_transform("transform", "x_off", "y_off", "src_w", "src_h", F.lit(disk_w), F.lit(disk_h))
    bounds = X.corner_bounds("transform", F.col("x_off"), F.col("y_off"), F.col("x_off") + F.col("src_w"), F.col("y_off") + F.col("src_h"))
    return tiles.withColumns({"transform": own, "bounds": bounds})


def neighbours(tiles: DataFrame, x: str, y: str, dx="1", dy="1") -> DataFrame:
    """The eight neighbours of each tile: its columns, pos (row by row), nx, ny. dx, dy: a column or number apart."""
    spots = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i, j) != (0, 0)]
    step_x, step_y = F.expr(str(dx)), F.expr(str(dy))
    places = F.array(*[F.struct((F.col(x) + i * step_x).cast("int").alias("nx"), (F.col(y) + j * step_y).cast("int").alias("ny")) for i, j in spots])
    return tiles.select("*", F.posexplode(places).alias("pos", "_n")).select(*tiles.columns, "pos", "_n.nx", "_n.ny")


def surrounded(tiles: DataFrame, group: list[str], x: str, y: str, dx="1", dy="1") -> DataFrame:
    """The keys (group, x, y) of tiles whose eight neighbours are all there."""
    keys = tiles.select(*group, x, y).distinct()
    there = keys.select(*group, F.col(x).alias("nx"), F.col(y).alias("ny"))
    near = neighbours(keys.withColumns({"_dx": F.expr(str(dx)), "_dy": F.expr(str(dy))}), x, y, "_dx", "_dy")
    return near.join(there, [*group, "nx", "ny"], "left_semi").groupBy(*group, x, y).agg(F.count(F.lit(1)).alias("n")).where("n = 8").drop("n")


def border_pixels(tiles: DataFrame, src_w: str = "src_w", src_h: str = "src_h", thickness: int = 1, keys: list[str] | None = None) -> DataFrame:
    """keys, x, y of the lines along a tile's sides, thickness - 1 pixels to either side (also outside the tile)."""
    keys = keys or ["raster_name", "x_off", "y_off"]
    sizes = tiles.groupBy(*keys).agg(F.collect_set(F.struct(F.col(src_w).alias("w"), F.col(src_h).alias("h"))).alias("_sizes"))
    along = lambda n: F.sequence(F.lit(0), n - 1)
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))

    def sides(s: Column, o: Column) -> Column:
        w, h = s["w"], s["h"]
        return F.concat(
            F.transform(along(w), lambda i: point(i, o)), F.transform(along(w), lambda i: point(i, h - 1 + o)), F.transform(along(h), lambda i: point(o, i)), F.transform(along(h), lambda i: point(w - 1 + o, i))
        )

    off = F.sequence(F.lit(1 - thickness), F.lit(thickness - 1))
    lines = F.flatten(F.transform("_sizes", lambda s: F.flatten(F.transform(off, lambda o: sides(s, o)))))
    # Doubles can only be of one tile, so they go before rows are made of them.
    return sizes.select(*keys, F.explode(F.array_distinct(lines)).alias("_p")).select(*keys, "_p.x", "_p.y")
