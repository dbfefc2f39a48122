"""Whole regions of pixels or cells as polygons, over any number of patches.

A patch of cells, with the cells around it, is one row; its regions get local
labels, and the sides between a region and what is not of it become runs that
end where the outline leaves the patch. Every run knows the run that follows it
in another patch, because the cells around the patch decide where an outline
turns. So what crosses patches is small: labels that meet over a border unite
as components of a graph, and runs are ordered into rings by ranking cycles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.graphs import components, ranked_cycles
from tessella.functions.stages import staged
from tessella.operators.vector import _ACROSS, _LEFT, _RIGHT, _START, CELLS_AT_ONCE, _POINT, regions, ring_area

RING, RUN, LINK, DOOR = range(4)
_NUMBERS = ("kind", "label_y", "label_x", "head_y", "head_x", "head_side", "next_y", "next_x", "next_side", "tail_side")




def runs(grids: np.ndarray) -> dict[str, np.ndarray]:
    """The outlines of grids (n, height + 2, width + 2), whose outermost cells belong to others, as closed rings and open runs.

    Of each run: tile, the cell that it begins at (y, x, side), the cell after
    its end (-1 sides: a closed ring), its last side, and its corners. A side
    has its own cell on the right; top is 0, then right, bottom, left.
    """
    own = grids[:, 1:-1, 1:-1]
    n, h, w = own.shape
    tile, y, x, side = np.nonzero(np.stack([(grids[:, 1 + i : h + 1 + i, 1 + j : w + 1 + j] != own) & (own != 0) for i, j in _ACROSS], axis=-1))
    y, x, count = y + 1, x + 1, len(tile)
    number = np.full((n, h + 2, w + 2, 4), -1, np.int64)
    number[tile, y, x, side] = np.arange(count)
    value = grids[tile, y, x]
    ahead = lambda steps: (y + steps[side, 0], x + steps[side, 1])
    (ry, rx), (ly, lx) = ahead(_RIGHT), ahead(_LEFT)
    right = grids[tile, ry, rx] != value
    left = ~right & (grids[tile, ly, lx] == value)
    to_y, to_x = np.where(right, y, np.where(left, ly, ry)), np.where(right, x, np.where(left, lx, rx))
    to_side = np.where(right, (side + 1) % 4, np.where(left, (side - 1) % 4, side))
    follow = number[tile, to_y, to_x, to_side]
    inside = follow >= 0

    # Closed rings are those sides from which doubled steps never come to a side that leaves the patch.
    rounds = max(1, count).bit_length()
    here = np.arange(count)
    jump = np.where(inside, follow, here)
    for _ in range(rounds):
        jump = jump[jump]
    closed = inside[jump]
    lead, jump = here.copy(), np.where(closed, follow, here)
    for _ in range(rounds):
        lead, jump = np.minimum(lead, lead[jump]), jump[jump]
    # Each ring is cut before its least side; then all are runs, ordered by the steps that are left.
    ends = ~inside | (closed & (lead[np.where(inside, follow, 0)] == np.where(inside, follow, -1)))
    steps, jump = np.where(ends, 0, 1), np.where(ends, here, follow)
    for _ in range(rounds):
        steps, jump = steps + steps[jump], jump[jump]
    came = np.full(count, -1)
    came[follow[inside]] = side[inside]
    order = np.lexsort((-steps, jump))
    head = np.flatnonzero(np.diff(jump[order], prepend=-1))
    first, tail = order[head], order[np.append(head[1:], count) - 1] if count else order
    # A side's begin is a corner if the side before it has another direction, or stands in another patch.
    corner = came[order] != side[order]
    points = np.cumsum(np.append(0, corner))[np.append(head, count)]
    at = order[corner]
    shut = closed[first]
    return {
        "tile": tile[first], "y": y[first] - 1, "x": x[first] - 1, "side": side[first], "closed": shut, "next_y": to_y[tail] - 1, "next_x": to_x[tail] - 1, "next_side": to_side[tail], "tail_side": side[tail],
        "offsets": points, "px": x[at] - 1 + _START[side[at], 1], "py": y[at] - 1 + _START[side[at], 0],
    }


def _patch_rows(px: DataFrame, keys: Sequence[str], value: str, patch: int) -> DataFrame:
    """keys, patch_y, patch_x and the cells of each patch and around it, packed."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    of = lambda c: F.array_distinct(F.transform(near, lambda d: F.floor((F.col(c) + d) / patch).cast("int")))
    cells = px.where(F.col(value) != 0).select(*keys, "y", "x", value, F.explode(of("y")).alias("patch_y")).select("*", F.explode(of("x")).alias("patch_x"))
    place = ((F.col("y") - F.col("patch_y") * patch + 1) * (patch + 2) + F.col("x") - F.col("patch_x") * patch + 1).cast("int")
    return cells.groupBy(*keys, "patch_y", "patch_x").agg(F.collect_list(place).alias("_at"), F.collect_list(value).alias("_value"))


def _outlined(px: DataFrame, keys: Sequence[str], value: str, patch: int) -> DataFrame:
    """keys, value, _NUMBERS and points: rings, runs, links from cells at a border to the cell beyond, and the labels of cells that such links lead to."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in px.select(*keys, value).schema) + "".join(f", {c} int" for c in _NUMBERS) + ", points array<struct<x:double,y:double>>"
    side = patch + 2

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS_AT_ONCE // side**2)
        for batch in (whole.slice(start, step) for whole in batches for start in range(0, whole.num_rows, step)):
            at, values = batch.column("_at"), batch.column("_value")
            tile = np.repeat(np.arange(batch.num_rows), at.value_lengths().to_numpy())
            grids = np.zeros((batch.num_rows, side * side), values.type.value_type.to_pandas_dtype())
            grids[tile, at.flatten().to_numpy()] = values.flatten().to_numpy()
            grids = grids.reshape(-1, side, side)
            top, left = (batch.column(c).to_numpy() * patch for c in ("patch_y", "patch_x"))
            label = regions(np.ascontiguousarray(grids[:, 1:-1, 1:-1])) % patch**2
            found = runs(grids)
            parts = [_ring_rows(found, label, patch), *_border_rows(grids, label, patch)]
            rows = {c: np.concatenate([p[c] for p in parts]) for c in ("tile", "value_y", "value_x", *_NUMBERS)}
            of = rows["tile"]
            for c in _NUMBERS:
                rows[c] = rows[c] + (top[of] if c.endswith("_y") else left[of] if c.endswith("_x") else 0)
            spots, n = found["offsets"], len(of)
            per_run = np.repeat(found["tile"], np.diff(spots))
            corners = pa.StructArray.from_arrays([(found["px"] + left[per_run]).astype(float), (found["py"] + top[per_run]).astype(float)], fields=list(_POINT))
            lists = pa.ListArray.from_arrays(np.append(spots, np.full(n - len(found["tile"]), spots[-1])).astype(np.int32), corners)
            number = grids[of, rows["value_y"] + 1, rows["value_x"] + 1]
            columns = [batch.column(k).take(pa.array(of)) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number, values.type.value_type), *[pa.array(rows[c].astype(np.int32)) for c in _NUMBERS], lists], names=[*keys, value, *_NUMBERS, "points"])

    return _patch_rows(px, keys, value, patch).mapInArrow(outlines, schema)


def _rows(label: np.ndarray, patch: int, tile: np.ndarray, y: np.ndarray, x: np.ndarray, **given: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of rows about the cells (tile, y, x); those not given are 0."""
    own = label[tile, y, x]
    known = {"tile": tile, "value_y": y, "value_x": x, "label_y": own // patch, "label_x": own % patch} | given
    return {c: np.broadcast_to(known.get(c, 0), tile.shape) for c in ("tile", "value_y", "value_x", *_NUMBERS)}


def _ring_rows(found: dict[str, np.ndarray], label: np.ndarray, patch: int) -> dict[str, np.ndarray]:
    kind = np.where(found["closed"], RING, RUN)
    rest = {c: found[c] for c in ("next_y", "next_x", "next_side", "tail_side")}
    return _rows(label, patch, found["tile"], found["y"], found["x"], kind=kind, head_y=found["y"], head_x=found["x"], head_side=found["side"], **rest)


def _border_rows(grids: np.ndarray, label: np.ndarray, patch: int) -> Iterator[dict[str, np.ndarray]]:
    """Links to the cells below and on the right of a patch, doors at its top and left: each border is looked at from one side only."""
    own = grids[:, 1:-1, 1:-1]
    for kind, edge, beyond in ((LINK, patch - 1, patch + 1), (DOOR, 0, 0)):
        across = 1 if kind == LINK else -1
        tile, x = np.nonzero((own[:, edge, :] != 0) & (own[:, edge, :] == grids[:, beyond, 1:-1]))
        y = np.full(len(tile), edge)
        yield _rows(label, patch, tile, y, x, kind=np.full(len(tile), kind), head_y=y, head_x=x, next_y=y + across, next_x=x)
        tile, y = np.nonzero((own[:, :, edge] != 0) & (own[:, :, edge] == grids[:, 1:-1, beyond]))
        x = np.full(len(tile), edge)
        yield _rows(label, patch, tile, y, x, kind=np.full(len(tile), kind), head_y=y, head_x=x, next_y=y, next_x=x + across)


def from_least_corner(points: Column) -> Column:
    """A ring of corners, turned so that its topmost, then leftmost one comes first, and closed. Only one run of an outline comes by that corner."""
    keyed = F.transform(points, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x")))
    at = F.array_position(keyed, F.array_min(keyed)).cast("int")
    return F.concat(F.slice(points, at, F.size(points)), F.slice(points, F.lit(1), at))


def whole_regions(px: DataFrame, keys: Sequence[str], value: str = "value", patch: int = 64) -> DataFrame:
    """keys, value, first_y, first_x, rings: every 4-connected region of equal values but 0 as one polygon, in pixel coordinates.

    first_y, first_x: the region's first pixel by row and column, which names
    it. The outer ring comes first, then the holes by their first corner; rings
    begin at their topmost, then leftmost corner. A task holds one patch of
    patch x patch cells; only a finished ring is ever held whole. px: keys, y,
    x, value, one row a pixel.
    """
    found = staged(_outlined(px, keys, value, patch))
    cell = lambda y, x: F.struct(*keys, F.col(y).alias("y"), F.col(x).alias("x"))
    label = cell("label_y", "label_x")
    doors = found.where(F.col("kind") == DOOR).select(cell("head_y", "head_x").alias("door"), label.alias("v"))
    links = found.where(F.col("kind") == LINK).select(cell("next_y", "next_x").alias("beyond"), label.alias("u")).join(doors, F.col("beyond") == F.col("door")).select("u", "v").distinct()
    joined = components(links)

    side = lambda p: F.struct(*keys, *[F.col(f"{p}_{c}").alias(c) for c in ("y", "x", "side")])
    open_ = found.where(F.col("kind") == RUN).select(*keys, value, label.alias("own"), side("head").alias("node"), side("next").alias("next"), "head_side", "tail_side", "points")
    ranked = ranked_cycles(open_.select("node", "next")).withColumnRenamed("node", "ranked")
    turn = F.when(F.col("steps") == 0, F.lit(-(1 << 62))).otherwise(-F.col("steps"))
    ordered = open_.join(ranked, F.col("node") == F.col("ranked")).groupBy(*keys, value, "lead").agg(F.min("own").alias("own"), F.array_sort(F.collect_list(F.struct(turn.alias("turn"), "head_side", "tail_side", "points"))).alias("runs"))
    # Where a run goes straight on from the one before it, its first point is no corner.
    before = lambda i: F.element_at("runs", F.when(i == 0, F.size("runs")).otherwise(i).cast("int"))["tail_side"]
    corners = F.flatten(F.transform("runs", lambda r, i: F.when(r["head_side"] == before(i), F.slice(r["points"], F.lit(2), F.size(r["points"]))).otherwise(r["points"])))
    rings = ordered.select(*keys, value, "own", corners.alias("points")).unionByName(found.where(F.col("kind") == RING).select(*keys, value, label.alias("own"), "points"))

    named = rings.select(*keys, value, "own", from_least_corner(F.col("points")).alias("ring")).join(joined, F.col("own") == F.col("node"), "left").withColumn("region", F.coalesce("label", "own"))
    corner = F.element_at("ring", 1)
    entry = F.struct((ring_area(F.col("ring")) < 0).alias("hole"), corner["y"].alias("y"), corner["x"].alias("x"), F.col("ring"))
    whole = named.groupBy(*keys, value, "region").agg(F.array_sort(F.collect_list(entry)).alias("rings"))
    return whole.select(*keys, value, F.col("region.y").alias("first_y"), F.col("region.x").alias("first_x"), F.transform("rings", lambda r: r["ring"]).alias("rings"))


def whole_cover(tiles: DataFrame, group: Sequence[str] = ("z",), patch: int = 64) -> DataFrame:
    """group, first_y, first_x, rings: the regions of a cover's tiles (x, y), each one polygon in tile coordinates. Tiles may repeat."""
    cells = tiles.select(*group, "x", "y").distinct().withColumn("_one", F.lit(1))
    return whole_regions(cells, group, "_one", patch).drop("_one")


def raster_footprints(px: DataFrame, valid: Column, keys: Sequence[str] = ("raster_name",), patch: int = 64) -> DataFrame:
    """keys, first_y, first_x, rings: where rasters have data, each region one polygon in pixel coordinates."""
    cells = px.where(valid).select(*keys, "y", "x", F.lit(1).alias("_one"))
    return whole_regions(cells, keys, "_one", patch).drop("_one")
