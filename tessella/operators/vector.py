"""Polygons: bounds, rasterising, vectorising, buffering.

rings: array of rings, each an array of points (x, y); the first is the outer
ring, the others are holes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.spatial import sized_overlap_join
from tessella.operators.tiling import dealt


def polygon_bounds(rings="rings") -> Column:
    """struct(left, bottom, right, top) of the outer ring."""
    outer = F.element_at(F.col(rings) if isinstance(rings, str) else rings, 1)
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("bottom"), F.array_max(xs).alias("right"), F.array_max(ys).alias("top"))


def map_points(rings, fx: Callable[[Column, Column], Column], fy: Callable[[Column, Column], Column]) -> Column:
    """rings with every point moved: reprojection, or a change to pixel space."""
    move = lambda p: F.struct(fx(p["x"], p["y"]).alias("x"), fy(p["x"], p["y"]).alias("y"))
    return F.transform(F.col(rings) if isinstance(rings, str) else rings, lambda r: F.transform(r, move))


def is_valid_polygon(rings="rings") -> Column:
    """Every ring is closed and has at least four points; there is an outer one."""
    r = F.col(rings) if isinstance(rings, str) else rings
    good = F.forall(r, lambda ring: (F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1)))
    return (F.size(r) >= 1) & good


def polygon_edges(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ex0, ey0, ex1, ey1: the sides of all rings."""
    ring = features.select(*keys, F.explode("rings").alias("_r"))
    side = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_r") - 1, F.lit(1))), lambda i: F.struct(F.try_element_at("_r", i).alias("p"), F.try_element_at("_r", i + 1).alias("q")))
    s = ring.select(*keys, F.explode(side).alias("_s")).where("_s.q is not null")
    return s.select(*keys, F.col("_s.p.x").alias("ex0"), F.col("_s.p.y").alias("ey0"), F.col("_s.q.x").alias("ex1"), F.col("_s.q.y").alias("ey1"))


def tile_candidates(tiles: DataFrame, features: DataFrame, on: Sequence[str], cell: tuple[float, float], stage_left: bool = False) -> DataFrame:
    """Pairs of tiles (x0, y0, x1, y1) and features whose bounds meet; feature columns follow. Features may be far larger than tiles; cell is a tile's size."""
    b = polygon_bounds()
    boxed = features.withColumns({"_b": b}).withColumns({"x0": F.col("_b.left"), "y0": F.col("_b.bottom"), "x1": F.col("_b.right"), "y1": F.col("_b.top")}).drop("_b")
    return sized_overlap_join(tiles, boxed, on, float(max(cell)), stage_left)


def burnt_pixels(features: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """keys, y, x: the pixels of a width x height grid whose centres lie inside (even-odd rule).

    A side crosses the rows between its ends; each row's crossings, sorted,
    pair up into the spans that lie inside. Rows come from the sides
    themselves, so the work follows the polygons' outlines and areas only.
    """
    e = polygon_edges(features, keys).where("ey0 <> ey1")
    first = F.greatest(F.ceil(F.least("ey0", "ey1") - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil(F.greatest("ey0", "ey1") - 0.5) - 1, F.lit(height - 1)).cast("int")
    rows = e.withColumns({"_a": first, "_b": last}).where("_a <= _b").select("*", F.explode(F.sequence("_a", "_b")).alias("y"))
    at = F.col("ex0") + (F.col("y") + 0.5 - F.col("ey0")) / (F.col("ey1") - F.col("ey0")) * (F.col("ex1") - F.col("ex0"))
    spans = rows.select(*keys, "y", at.alias("_at")).groupBy(*keys, "y").agg(F.array_sort(F.collect_list("_at")).alias("_c"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size("_c") / 2).cast("int"), F.lit(1))), lambda i: F.struct(F.try_element_at("_c", 2 * i - 1).alias("a"), F.try_element_at("_c", 2 * i).alias("b")))
    each = spans.select(*keys, "y", F.explode(pairs).alias("_p")).where("_p.b is not null")
    # A centre x + 0.5 is inside if it is right of an odd number of crossings: a < centre <= b.
    x0 = F.greatest(F.floor(F.col("_p.a") - 0.5) + 1, F.lit(0)).cast("int")
    x1 = F.least(F.floor(F.col("_p.b") - 0.5), F.lit(width - 1)).cast("int")
    return each.withColumns({"_x0": x0, "_x1": x1}).where("_x0 <= _x1").select(*keys, "y", F.explode(F.sequence("_x0", "_x1")).alias("x"))


def rasterize(features: DataFrame, width: int, height: int, value: str, group: Sequence[str] = ()) -> DataFrame:
    """group, y, x, value: the union of the polygons; of several values the largest (0 is not burnt)."""
    burnt = burnt_pixels(features.where(F.col(value) != 0), [*group, "feature_id", value], width, height)
    return burnt.groupBy(*group, "y", "x").agg(F.max(value).alias(value))


def pixels_near_edges(features: DataFrame, keys: Sequence[str], distance: float, width: int, height: int) -> DataFrame:
    """keys, y, x, distance: the pixels whose centre is at most a distance from a side, once for each such side.

    A side names the rows that it comes near to, and in each row the columns
    around the part of it that is near, so the work follows the outline's length.
    """
    e = polygon_edges(features, keys)
    first = F.greatest(F.ceil(F.least("ey0", "ey1") - distance - 0.5), F.lit(0)).cast("int")
    last = F.least(F.floor(F.greatest("ey0", "ey1") + distance - 0.5), F.lit(height - 1)).cast("int")
    rows = e.withColumns({"_a": first, "_b": last}).where("_a <= _b").select("*", F.explode(F.sequence("_a", "_b")).alias("y"))
    dx, dy = F.col("ex1") - F.col("ex0"), F.col("ey1") - F.col("ey0")
    # Where along the side the rows y + 0.5 - distance and y + 0.5 + distance cross it; the whole side if it is level.
    at = lambda d: F.when(dy == 0, F.lit(None)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("y") + 0.5 + d - F.col("ey0")) / dy)))
    one, two = F.col("ex0") + F.coalesce(at(-distance), F.lit(0.0)) * dx, F.col("ex0") + F.coalesce(at(distance), F.lit(1.0)) * dx
    left = F.greatest(F.ceil(F.least(one, two) - distance - 0.5), F.lit(0)).cast("int")
    right = F.least(F.floor(F.greatest(one, two) + distance - 0.5), F.lit(width - 1)).cast("int")
    near = rows.withColumns({"_a": left, "_b": right}).where("_a <= _b").select(*keys, "ex0", "ey0", "ex1", "ey1", "y", F.explode(F.sequence("_a", "_b")).alias("x"))
    x, y = F.col("x") + 0.5, F.col("y") + 0.5
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("ex0")) * dx + (y - F.col("ey0")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
    d = F.hypot(x - F.col("ex0") - t * dx, y - F.col("ey0") - t * dy)
    return near.select(*keys, "y", "x", d.alias("distance")).where(F.col("distance") <= distance)


def pixels_about(features: DataFrame, keys: Sequence[str], distance: float, width: int, height: int) -> DataFrame:
    """keys, y, x, inside, distance: the pixels inside polygons or at most a distance from their sides; distance: to the nearest side, null beyond.

    Both kinds meet in one aggregation: a join of them would be sized by the
    polygons' file, which says nothing about the number of pixels. Polygons are
    dealt out by keys, so that their pixels need no shuffle of their own.
    """
    f = dealt(features, *keys)
    inside = burnt_pixels(f, keys, width, height).select(*keys, "y", "x", F.lit(True).alias("inside"), F.lit(None).cast("double").alias("distance"))
    near = pixels_near_edges(f, keys, distance, width, height).select(*keys, "y", "x", F.lit(False).alias("inside"), "distance")
    return inside.unionByName(near).groupBy(*keys, "y", "x").agg(F.max("inside").alias("inside"), F.min("distance").alias("distance"))


def stays_in(distance: float) -> Column:
    """Over pixels_about: the pixel is of the polygon grown (distance > 0) or shrunk (< 0) by at most the distance asked for there."""
    if distance < 0:
        return F.col("inside") & (F.col("distance").isNull() | (F.col("distance") >= -distance))
    return F.col("inside") | (F.col("distance") <= distance)


def buffered_pixels(features: DataFrame, keys: Sequence[str], distance: float, width: int, height: int) -> DataFrame:
    """keys, y, x: the pixels of the polygons grown (distance > 0) or shrunk (< 0) by a distance in pixels."""
    return pixels_about(features, keys, abs(distance), width, height).where(stays_in(distance)).select(*keys, "y", "x")


#: Steps (y, x) to the cell ahead on the right and ahead on the left of a side walked with its own cell on the right: top east, right south, bottom west, left north.
_RIGHT = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])
_LEFT = np.array([(-1, 1), (1, 1), (1, -1), (-1, -1)])
#: The cell across a side, and the corner at which its walk begins.
_ACROSS = np.array([(-1, 0), (0, 1), (1, 0), (0, -1)])
_START = np.array([(0, 0), (0, 1), (1, 1), (1, 0)])


def regions(grids: np.ndarray) -> np.ndarray:
    """The 4-connected regions of equal values but 0 in grids (n, height, width): for each cell the least cell number of its region, -1 for 0."""
    n, h, w = grids.shape
    label = np.arange(grids.size).reshape(n, h, w)
    down, right = (grids[:, :-1] == grids[:, 1:]) & (grids[:, 1:] != 0), (grids[:, :, :-1] == grids[:, :, 1:]) & (grids[:, :, 1:] != 0)
    pairs = np.concatenate([np.stack([label[:, :-1][down], label[:, 1:][down]]), np.stack([label[:, :, :-1][right], label[:, :, 1:][right]])], axis=1)
    root = label.ravel().copy()
    while True:
        a, b = root[pairs[0]], root[pairs[1]]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return np.where(grids.ravel() == 0, -1, root).reshape(n, h, w)


def traced(grids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rings of the regions of grids (n, height, width): (region, area) of each ring, offsets of its points, x, y.

    Sides between a region and what is
    not of it are walked with the region on the right. Where two of its cells
    touch at a corner only, the walk keeps to its own cell, so it turns right
    whenever the cell ahead on the right is not of the region. Each side thus
    knows the next; rings are the cycles, found and ranked by doubling steps.
    Corners only are kept, in order, the first repeated at the end.
    """
    n, h, w = grids.shape
    region = np.full((n, h + 2, w + 2), -1, np.int64)
    region[:, 1:-1, 1:-1] = regions(grids)
    tile, y, x, side = np.nonzero(np.stack([(region[:, 1 + i : h + 1 + i, 1 + j : w + 1 + j] != region[:, 1:-1, 1:-1]) & (region[:, 1:-1, 1:-1] >= 0) for i, j in _ACROSS], axis=-1))
    own = region[tile, y + 1, x + 1]
    number = np.full((n, h + 2, w + 2, 4), -1, np.int64)
    number[tile, y + 1, x + 1, side] = np.arange(len(tile))
    ahead = lambda steps: (y + 1 + steps[side, 0], x + 1 + steps[side, 1])
    (ry, rx), (ly, lx) = ahead(_RIGHT), ahead(_LEFT)
    turns_right = region[tile, ry, rx] != own
    turns_left = ~turns_right & (region[tile, ly, lx] == own)
    follow = np.where(turns_right, number[tile, y + 1, x + 1, (side + 1) % 4], np.where(turns_left, number[tile, ly, lx, (side - 1) % 4], number[tile, ry, rx, side]))
    # The least side of each cycle leads it; the distance to the leader, going on, orders the others.
    lead, jump = np.arange(len(tile)), follow.copy()
    for _ in range(max(1, len(tile)).bit_length()):
        lead, jump = np.minimum(lead, lead[jump]), jump[jump]
    ends = lead[follow] == follow
    left, jump = np.where(ends, 0, 1), np.where(ends, np.arange(len(tile)), follow)
    for _ in range(max(1, len(tile)).bit_length()):
        left, jump = left + left[jump], jump[jump]
    came = np.empty(len(tile), np.int64)
    came[follow] = side
    order = np.lexsort((-left, lead))
    order = order[came[order] != side[order]]
    px, py = (x + _START[side, 1])[order].astype(float), (y + _START[side, 0])[order].astype(float)
    first = np.flatnonzero(np.diff(lead[order], prepend=-1))
    size = np.diff(np.append(first, len(order)))
    spot = np.arange(len(order)) + np.repeat(np.arange(len(first)), size)
    offsets = np.append(first + np.arange(len(first)), len(order) + len(first))
    xs, ys = np.empty(offsets[-1]), np.empty(offsets[-1])
    xs[spot], ys[spot] = px, py
    xs[offsets[1:] - 1], ys[offsets[1:] - 1] = px[first], py[first]
    cross = np.append(xs[:-1] * ys[1:] - xs[1:] * ys[:-1], 0.0)
    cross[offsets[1:] - 1] = 0.0
    area = np.add.reduceat(cross, offsets[:-1]) / 2 if len(first) else np.empty(0)
    return own[order][first], area, offsets, xs, ys


#: Cells of tiles that are traced together: some hundred bytes each, in every Python worker of an executor.
CELLS_AT_ONCE = 1 << 16
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def vectorize(px: DataFrame, keys: Sequence[str], width: int, height: int, value: str = "value") -> DataFrame:
    """keys, value, part, rings: the regions of each value but 0, tile by tile; part counts a tile's regions of a value in the order of their first pixels.

    A tile is packed by one aggregation; many tiles at once are traced by array
    operations, without a loop over tiles, pixels or sides.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in px.select(*keys, value).schema) + ", part int, rings array<array<struct<x:double,y:double>>>"
    tiles = px.where(F.col(value) != 0).groupBy(*keys).agg(F.collect_list((F.col("y") * width + F.col("x")).cast("int")).alias("_at"), F.collect_list(value).alias("_value"))

    def polygons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS_AT_ONCE // (width * height))
        for batch in (whole.slice(start, step) for whole in batches for start in range(0, whole.num_rows, step)):
            at, values = batch.column("_at"), batch.column("_value")
            tile = np.repeat(np.arange(batch.num_rows), at.value_lengths().to_numpy())
            grids = np.zeros((batch.num_rows, height * width), values.type.value_type.to_pandas_dtype())
            grids[tile, at.flatten().to_numpy()] = values.flatten().to_numpy()
            region, area, offsets, x, y = traced(grids.reshape(-1, height, width))
            # Rings of a region stand together, the outer one (the only one of positive area) first.
            order = np.lexsort((-area, region))
            size = np.diff(offsets)[order]
            points = np.repeat(offsets[:-1][order] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            rings = pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), pa.StructArray.from_arrays([x[points], y[points]], fields=list(_POINT)))
            start = np.flatnonzero(np.diff(region[order], prepend=-1))
            found = region[order][start]
            polygon = pa.ListArray.from_arrays(np.append(start, len(order)).astype(np.int32), rings)
            owner, number = found // (height * width), grids.ravel()[found]
            by_value = np.lexsort((found, number, owner))
            head = np.flatnonzero(np.diff(owner[by_value], prepend=-1).astype(bool) | np.diff(number[by_value], prepend=number[by_value][:1] - 1).astype(bool))
            part = np.empty(len(found), np.int32)
            part[by_value] = np.arange(len(found)) - np.repeat(head, np.diff(np.append(head, len(found))))
            columns = [batch.column(k).take(pa.array(owner)) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number, values.type.value_type), pa.array(part), polygon], names=[*keys, value, "part", "rings"])

    return tiles.mapInArrow(polygons, schema)


def dissolved_polygons(tiles: DataFrame, group: Sequence[str] = ("z",), patch: int = 64) -> DataFrame:
    """group, patch_x, patch_y, part, rings: a set of unit cells (x, y) as polygons in cell coordinates, patch by patch.

    Cells of a patch, patch x patch of them, dissolve into its regions; a
    region that goes on beyond a patch is cut at its border, so that no task
    ever holds more than a patch.
    """
    at = lambda c: F.floor(F.col(c) / patch).cast("int")
    cells = tiles.select(*group, at("x").alias("patch_x"), at("y").alias("patch_y"), F.pmod("x", F.lit(patch)).alias("x"), F.pmod("y", F.lit(patch)).alias("y"), F.lit(1).alias("_one"))
    found = vectorize(cells, [*group, "patch_x", "patch_y"], patch, patch, "_one")
    return found.select(*group, "patch_x", "patch_y", "part", moved_rings("rings", F.col("patch_x") * patch, F.col("patch_y") * patch).alias("rings"))


def moved_rings(rings: str, dx: Column, dy: Column) -> Column:
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))))


def mask_footprint(px: DataFrame, valid: Column, keys: Sequence[str] = ("raster_name",), patch: int = 64) -> DataFrame:
    """keys, patch_x, patch_y, part, rings: the valid pixels of rasters as polygons in pixel coordinates, patch by patch."""
    return dissolved_polygons(px.where(valid).select(*keys, "x", "y"), keys, patch)


def ring_length(rings="rings") -> Column:
    """The length of all rings together, for sides along the axes or not."""
    r = F.col(rings) if isinstance(rings, str) else rings
    side = lambda ring: F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda s, i: s + F.hypot(F.element_at(ring, i + 1)["x"] - F.element_at(ring, i)["x"], F.element_at(ring, i + 1)["y"] - F.element_at(ring, i)["y"]))
    return F.aggregate(r, F.lit(0.0), lambda s, ring: s + side(ring))


def ring_corners(rings="rings") -> Column:
    """The number of corners of all rings together; the point that closes a ring does not count again."""
    return F.aggregate(F.col(rings) if isinstance(rings, str) else rings, F.lit(0), lambda s, ring: s + F.size(ring) - 1)


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring."""
    doubled = F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda s, i: s + F.element_at(ring, i)["x"] * F.element_at(ring, i + 1)["y"] - F.element_at(ring, i + 1)["x"] * F.element_at(ring, i)["y"])
    return doubled / 2


def polygon_area(rings="rings") -> Column:
    """Area of the outer ring less its holes."""
    r = F.col(rings) if isinstance(rings, str) else rings
    first = F.abs(ring_area(F.element_at(r, 1)))
    holes = F.aggregate(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(1))), F.lit(0.0), lambda s, x: s + F.abs(ring_area(x)))
    return first - F.when(F.size(r) > 1, holes).otherwise(0.0)
