"""Covers: sets of mercator tiles (z, x, y)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import exprs as X
from tessella.functions.ranking import shuffled_position

KEY = ["z", "x", "y"]


def tiles_of_bounds(df: DataFrame, west, south, east, north, zoom: int) -> DataFrame:
    """df's rows with each tile (z, x, y) that its bounds touch; a box across the antimeridian (west > east) gives both parts."""
    w, s, e, n = map(X.col, (west, south, east, north))
    zoom = F.lit(zoom)
    last = X.mercator_x(e - 1e-11, zoom)
    xs = F.when(w <= e, F.sequence(X.mercator_x(w, zoom), F.greatest(last, X.mercator_x(w, zoom)))).otherwise(F.concat(F.sequence(X.mercator_x(w, zoom), X.mercator_x(F.lit(179.999999), zoom)), F.sequence(F.lit(0), last)))
    top = X.mercator_y(n, zoom)
    ys = F.sequence(top, F.greatest(X.mercator_y(s + 1e-11, zoom), top))
    return df.select("*", zoom.alias("z"), F.explode(xs).alias("x")).select("*", F.explode(ys).alias("y"))


def union_distinct(*covers: DataFrame) -> DataFrame:
    out = covers[0].select(*KEY)
    for c in covers[1:]:
        out = out.unionByName(c.select(*KEY))
    return out.distinct()


def at_zoom(cover: DataFrame, zoom: int) -> DataFrame:
    """The tiles of another zoom that cover the same area, each once. Whole-number arithmetic, so edges are exact."""
    up = F.lit(zoom) - F.col("z")
    side = F.pow(F.lit(2.0), F.greatest(up, F.lit(0))).cast("int")
    drop = F.pow(F.lit(2.0), F.greatest(-up, F.lit(0)))
    parts = lambda c: F.sequence(F.col(c) * side, F.col(c) * side + side - 1)
    split = cover.select("z", "y", F.explode(parts("x")).alias("sx")).select("z", "sx", F.explode(parts("y")).alias("sy"))
    return split.select(F.lit(zoom).alias("z"), F.floor(F.col("sx") / drop).cast("int").alias("x"), F.floor(F.col("sy") / drop).cast("int").alias("y")).distinct()


def extent(cover: DataFrame) -> DataFrame:
    """One row: west, south, north, east of all tiles."""
    one = F.lit(1)
    return cover.agg(
        F.min(X.tile_west("x", "z")).alias("west"), F.min(X.tile_north(F.col("y") + one, "z")).alias("south"), F.max(X.tile_north("y", "z")).alias("north"), F.max(X.tile_west(F.col("x") + one, "z")).alias("east")
    )


def extent_text(cover: DataFrame) -> DataFrame:
    return extent(cover).select(F.format_string("%.8f,%.8f,%.8f,%.8f", "west", "south", "north", "east").alias("value"))


def split(cover: DataFrame, percents: Sequence[int], seed: int = 0) -> DataFrame:
    """Distinct tiles with their split (from 0), in hash-random order.

    Sizes are floor(n p / 100); if the percents make 100 and n is over 100 the
    first split takes what is left over, else that is dropped.
    """
    if min(percents) < 0 or sum(percents) > 100:
        raise ValueError("percents must be at least 0 and make at most 100")
    key = F.concat_ws(",", *KEY, F.lit(str(seed)))
    placed = shuffled_position(cover.select(*KEY).distinct(), key, "_place", "_n")
    sizes = [F.floor(F.col("_n") * p / 100) for p in percents]
    rest = F.when((F.col("_n") > 100) & F.lit(sum(percents) == 100), F.col("_n") - sum(sizes[1:], sizes[0])).otherwise(0)
    upto, which = F.lit(0), F.lit(None).cast("int")
    bounds: list[Column] = []
    for i, size in enumerate(sizes):
        upto = upto + size + (rest if i == 0 else 0)
        bounds.append(upto)
    for i in reversed(range(len(bounds))):
        which = F.when(F.col("_place") <= bounds[i], i).otherwise(which)
    return placed.select(*KEY, which.alias("split")).where("split is not null")


def keep_covered(tiles: DataFrame, cover: DataFrame, keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """The tiles that a cover holds."""
    return tiles.join(cover.select(*keys), list(keys), "left_semi")


def dissolved_edges(tiles: DataFrame, group: Sequence[str] = ("z",)) -> DataFrame:
    """The outline of a set of unit cells: edges (x0, y0, x1, y1) that only one cell has."""
    x, y = F.col("x"), F.col("y")
    edge = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    edges = tiles.select(*group, "x", "y").distinct().select(*group, F.explode(F.array(edge(x, y, x + 1, y), edge(x, y + 1, x + 1, y + 1), edge(x, y, x, y + 1), edge(x + 1, y, x + 1, y + 1))).alias("e"))
    return edges.groupBy(*group, "e").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(*group, "e.*")
