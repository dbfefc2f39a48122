"""Overlap joins of rectangles by grid cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.stages import staged


def _cells(low: Column, high: Column, cell: float) -> Column:
    """The cells that the inclusive range low to high touches (floor, so also right below 0)."""
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], cell: tuple[float, float]) -> DataFrame:
    """Pairs of rows whose rectangles meet: x0, y0, x1, y1 inclusive on both sides.

    Rectangles are dealt to the grid cells that they touch and joined by cell,
    an equi-join that Spark can shuffle and split; a range condition alone
    would compare all pairs. A pair is kept in one cell only, that of the
    intersection's lower corner, so no distinct is needed. Columns of left and
    right other than `on` must differ; the rectangles are named l_x0 and so on.
    """
    box = ["x0", "y0", "x1", "y1"]

    def dealt(df: DataFrame, side: str) -> DataFrame:
        named = df.select(*on, *[F.col(c).alias(f"{side}_{c}") for c in box], *[c for c in df.columns if c not in (*on, *box)])
        x = named.withColumn("_cx", F.explode(_cells(F.col(f"{side}_x0"), F.col(f"{side}_x1"), cell[0])))
        return x.withColumn("_cy", F.explode(_cells(F.col(f"{side}_y0"), F.col(f"{side}_y1"), cell[1])))

    c = F.col
    meets = (c("l_x0") <= c("r_x1")) & (c("r_x0") <= c("l_x1")) & (c("l_y0") <= c("r_y1")) & (c("r_y0") <= c("l_y1"))
    home = (F.floor(F.greatest("l_x0", "r_x0") / cell[0]) == c("_cx")) & (F.floor(F.greatest("l_y0", "r_y0") / cell[1]) == c("_cy"))
    return dealt(left, "l").join(dealt(right, "r"), [*on, "_cx", "_cy"]).where(meets & home).drop("_cx", "_cy")


def sized_overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], cell: float = 1.0, stage_left: bool = False) -> DataFrame:
    """As overlap_join, for rectangles of any size: none is dealt to more than four cells of a grid.

    Grids have cells of cell * 2**level. A rectangle stands on the least level
    whose cells are as wide and as high as itself, and looks for others on its
    own level and on the coarser ones that are in use under its `on`.
    stage_left: what left looks for is written first, for a left far smaller than
    right. Otherwise the planner takes it for the product of left and levels, and may broadcast right.
    """
    box, c = ["x0", "y0", "x1", "y1"], F.col
    extent = lambda s: F.greatest(c(f"{s}_x1") - c(f"{s}_x0"), c(f"{s}_y1") - c(f"{s}_y0"))
    size = lambda level: cell * F.pow(F.lit(2.0), level)

    def leveled(df: DataFrame, side: str) -> DataFrame:
        named = df.select(*on, *[c(k).alias(f"{side}_{k}") for k in box], *[k for k in df.columns if k not in (*on, *box)])
        return named.withColumn(f"_{side}", F.when(extent(side) <= cell, 0).otherwise(F.ceil(F.log2(extent(side) / cell))).cast("int"))

    def dealt(df: DataFrame, side: str) -> DataFrame:
        cells = lambda low, high: F.sequence(F.floor(c(f"{side}_{low}") / size(c("_level"))), F.floor(c(f"{side}_{high}") / size(c("_level"))))
        return df.withColumn("_cx", F.explode(cells("x0", "x1"))).withColumn("_cy", F.explode(cells("y0", "y1")))

    def looking(df: DataFrame, side: str, others: DataFrame, other: str, own: bool) -> DataFrame:
        used = others.groupBy(*on).agg(F.collect_set(f"_{other}").alias("_used"))
        fit = lambda n: n >= c(f"_{side}") if own else n > c(f"_{side}")
        return dealt(df.join(used, list(on)).withColumn("_level", F.explode(F.filter("_used", fit))).drop("_used"), side)

    a, b = leveled(left, "l"), leveled(right, "r")
    by = [*on, "_level", "_cx", "_cy"]
    finding = looking(a, "l", b, "r", True)
    fine_left = (staged(finding, narrow=True) if stage_left else finding).join(dealt(b.withColumn("_level", c("_r")), "r"), by)
    fine_right = looking(b, "r", a, "l", False).join(dealt(a.withColumn("_level", c("_l")), "l"), by)
    meets = (c("l_x0") <= c("r_x1")) & (c("r_x0") <= c("l_x1")) & (c("l_y0") <= c("r_y1")) & (c("r_y0") <= c("l_y1"))
    home = (F.floor(F.greatest("l_x0", "r_x0") / size(c("_level"))) == c("_cx")) & (F.floor(F.greatest("l_y0", "r_y0") / size(c("_level"))) == c("_cy"))
    return fine_left.unionByName(fine_right).where(meets & home).drop("_level", "_cx", "_cy", "_l", "_r")


def tile_boxes(tiles: DataFrame) -> DataFrame:
    """tiles with the inclusive rectangle of their source pixels."""
    return tiles.withColumns({"x0": F.col("x_off"), "y0": F.col("y_off"), "x1": F.col("x_off") + F.col("src_w") - 1, "y1": F.col("y_off") + F.col("src_h") - 1})
