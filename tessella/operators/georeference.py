"""Georeferences: control points, bounds in another CRS, tile sizes, warping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import exprs as X
from tessella.functions.projections import Projection, point_transformer
from tessella.operators.warping import sampled

#: Points along each side of bounds that are moved to another CRS.
STEPS = 21


def transformer(source: int, target: int) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Functions of x and y between EPSG codes."""
    if source == target:
        return (lambda x: x), (lambda y: y)
    if (source, target) == (4326, 3857):
        return X.lon_to_3857, X.lat_to_3857
    if (source, target) == (3857, 4326):
        return X.x_3857_to_lon, X.y_3857_to_lat
    raise ValueError(f"no transformation from {source} to {target}")


def reprojected_bounds(bounds, source: int, target: int) -> Column:
    """struct(left, bottom, right, top) around the moved sides, each of STEPS points."""
    b = X.col(bounds)
    fx, fy = transformer(source, target)
    steps = F.sequence(F.lit(0), F.lit(STEPS - 1))
    xs = F.transform(steps, lambda i: fx(b["left"] + (b["right"] - b["left"]) * i / (STEPS - 1)))
    ys = F.transform(steps, lambda i: fy(b["bottom"] + (b["top"] - b["bottom"]) * i / (STEPS - 1)))
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("bottom"), F.array_max(xs).alias("right"), F.array_max(ys).alias("top"))


def fitted_transform(points) -> Column:
    """The affine transform of control points (row, col, x, y) by least squares; null for fewer than three or if they lie in a line."""

    def total(p: Column, f) -> Column:
        return F.aggregate(p, F.lit(0.0), lambda s, q: s + f(q))

    def means(p: Column) -> Column:
        return F.struct(*[(total(p, lambda q, k=k: q[k].cast("double")) / F.size(p).cast("double")).alias(k) for k in ("col", "row", "x", "y")])

    # Centred on the means, so that large coordinates lose no digits.
    def products(p: Column, m: Column) -> Column:
        pairs = {"cc": ("col", "col"), "rr": ("row", "row"), "cr": ("col", "row"), "cx": ("col", "x"), "rx": ("row", "x"), "cy": ("col", "y"), "ry": ("row", "y")}
        return F.struct(*[total(p, lambda q, i=i, j=j: (q[i] - m[i]) * (q[j] - m[j])).alias(n) for n, (i, j) in pairs.items()])

    def fit(m: Column, s: Column) -> Column:
        det = s["cc"] * s["rr"] - s["cr"] * s["cr"]

        def one(k: str) -> tuple[Column, Column, Column]:
            a, b = (s[f"c{k}"] * s["rr"] - s[f"r{k}"] * s["cr"]) / det, (s[f"r{k}"] * s["cc"] - s[f"c{k}"] * s["cr"]) / det
            return a, b, m[k] - a * m["col"] - b * m["row"]

        return F.when(F.abs(det) > 1e-9, X.affine(*one("x"), *one("y")))

    return X.let(X.col(points), lambda p: F.when(F.size(p) >= 3, X.let(means(p), lambda m: X.let(products(p, m), lambda s: fit(m, s)))))


def resolved_transform(transform, points) -> Column:
    """The matrix if it says anything, else the control points' transform, else null."""
    return F.when(X.col(transform).isNotNull() & ~X.is_default_transform(transform), X.col(transform)).otherwise(fitted_transform(points))


def tile_size_in_pixels(transform, x, y, zoom) -> tuple[Column, Column]:
    """Width and height of a mercator tile in pixels of a raster in EPSG:4326: means of opposite sides."""
    inv = X.inverse(transform)
    corners = [(X.tile_west(X.col(x) + i, zoom), X.tile_north(X.col(y) + j, zoom)) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]
    at = [(X.apply_x(inv, lon, lat), X.apply_y(inv, lon, lat)) for lon, lat in corners]
    side = lambda a, b: F.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1])
    return (side(0, 1) + side(3, 2)) / 2, (side(0, 3) + side(1, 2)) / 2


def tile_pixel_corners(transform, x, y, zoom, crs: int | Projection = 4326) -> list[Column]:
    """struct(row, col) of a mercator tile's corners in a raster's whole pixels: left top, right top, right bottom, left bottom. crs is the raster's."""
    inv, move = X.inverse(transform), point_transformer(4326, crs)
    out = []
    for i, j in ((0, 0), (1, 0), (1, 1), (0, 1)):
        px, py = move(X.tile_west(X.col(x) + i, zoom), X.tile_north(X.col(y) + j, zoom))
        out.append(F.struct(F.floor(X.apply_y(inv, px, py)).cast("int").alias("row"), F.floor(X.apply_x(inv, px, py)).cast("int").alias("col")))
    return out


def local_pixel_corners(x_off="x_off", y_off="y_off", src_w="src_w", src_h="src_h") -> list[Column]:
    """struct(row, col) of a pixel tile's corners, in the order of tile_pixel_corners."""
    left, top = X.col(x_off), X.col(y_off)
    right, bottom = left + X.col(src_w), top + X.col(src_h)
    return [F.struct(r.alias("row"), c.alias("col")) for r, c in ((top, left), (top, right), (bottom, right), (bottom, left))]


def tile_extent(corners: list[Column], pixel_x=1.0, pixel_y=1.0) -> tuple[Column, Column]:
    """Width and height of a tile by its corners, means of opposite sides: in pixels, or in the units of the pixels' size (pixel_x along a row)."""
    size = lambda v: v if isinstance(v, Column) else F.lit(v)
    side = lambda a, b: F.hypot((corners[a]["row"] - corners[b]["row"]) * size(pixel_y), (corners[a]["col"] - corners[b]["col"]) * size(pixel_x))
    return (side(0, 1) + side(3, 2)) / 2, (side(0, 3) + side(1, 2)) / 2


def tile_to_raster_matrix(transform, x, y, zoom, disk: int) -> Column:
    """The affine transform from a mercator tile's pixels (disk x disk, evenly over its bounds) to pixels of a raster in EPSG:4326."""
    own = X.from_bounds(X.tile_west(x, zoom), X.tile_north(X.col(y) + 1, zoom), X.tile_west(X.col(x) + 1, zoom), X.tile_north(y, zoom), F.lit(disk), F.lit(disk))
    return X.compose(X.inverse(transform), own)


def default_grid(rasters: DataFrame, source: int, target: int) -> DataFrame:
    """raster_name, grid, width, height: the grid in another CRS on which a raster keeps its resolution along the diagonal.

    rasters: raster_name, transform, width, height. Bounds are those of the
    moved sides; a pixel is as long as the moved diagonal is in source pixels.
    """
    fx, fy = transformer(source, target)
    zero, w, h = F.lit(0), F.col("width"), F.col("height")
    bounds = reprojected_bounds(X.corner_bounds("transform", zero, zero, w, h), source, target)
    at = lambda c, r: (fx(X.apply_x("transform", c, r)), fy(X.apply_y("transform", c, r)))
    (x0, y0), (x1, y1) = at(zero, zero), at(w, h)
    placed = rasters.select("raster_name", bounds.alias("_b"), (F.hypot(x1 - x0, y1 - y0) / F.hypot(w, h)).alias("_p"))
    cells = lambda low, high: F.greatest(F.lit(1), F.floor((F.col(f"_b.{high}") - F.col(f"_b.{low}")) / F.col("_p") + 0.5)).cast("int")
    return placed.select("raster_name", X.affine(F.col("_p"), 0, F.col("_b.left"), 0, -F.col("_p"), F.col("_b.top")).alias("grid"), cells("left", "right").alias("width"), cells("bottom", "top").alias("height"))


def places_of_grids(rasters: DataFrame, grids: DataFrame, source: int | Projection, target: int | Projection) -> DataFrame:
    """raster_name, y, x, sy, sx: every pixel of grids in another CRS, and where its centre lies in the raster's pixels."""
    cells = grids.select("raster_name", "grid", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    t = cells.join(rasters.select("raster_name", X.inverse("transform").alias("_inv")), "raster_name")
    gx, gy = point_transformer(target, source)(X.apply_x("grid", F.col("x") + 0.5, F.col("y") + 0.5), X.apply_y("grid", F.col("x") + 0.5, F.col("y") + 0.5))
    return t.select("raster_name", "y", "x", X.apply_y("_inv", gx, gy).alias("sy"), X.apply_x("_inv", gx, gy).alias("sx"))


def warp(px: DataFrame, rasters: DataFrame, grids: DataFrame, source: int | Projection, target: int | Projection, value: str = "value", resampling: str = "nearest", block: int = 256) -> DataFrame:
    """raster_name, y, x, value of rasters on grids in another CRS, 0 outside.

    rasters: raster_name, transform. grids: raster_name, grid (the target's
    transform), width, height. source and target: EPSG codes or projections
    (see projections). Every target pixel's centre is mapped back; the nearest
    source pixel is met by an equi-join, other kernels (see
    warping.RESAMPLING) work within blocks of source pixels.
    """
    places = places_of_grids(rasters, grids, source, target)
    if resampling != "nearest":
        return sampled(px, places, ["raster_name"], [], resampling, block, value)
    at = places.select("raster_name", "y", "x", F.floor("sx").cast("int").alias("_x"), F.floor("sy").cast("int").alias("_y"))
    there = px.select("raster_name", F.col("x").alias("_x"), F.col("y").alias("_y"), value)
    return at.join(there, ["raster_name", "_x", "_y"], "left").select("raster_name", "y", "x", F.coalesce(value, F.lit(0)).alias(value))
