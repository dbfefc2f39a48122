"""Expectations of a result that are counted while it is written, without a second pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessella.functions import exprs as X


class Broken(AssertionError):
    """What a written result does not hold; metrics: the counts."""

    def __init__(self, metrics: dict[str, int]):
        self.metrics = metrics
        super().__init__(", ".join(f"{k}: {v}" for k, v in metrics.items()))


def checked_write(df: DataFrame, write: Callable[[DataFrame], None], least: int = 1, **wrong: Column) -> dict[str, int]:
    """Writes df and gives its counts: rows, and for each name of wrong the rows where that condition holds.

    Raises Broken afterwards if there are fewer than `least` rows, or any wrong
    one. Counting goes along with the write. A condition that is null does not
    hold. What was written stays where it is, for the caller to look at or drop.
    """
    seen = Observation()
    counts = [F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("long")), F.lit(0)).alias(name) for name, condition in wrong.items()]
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts))
    found = {k: int(v) for k, v in seen.get.items()}
    broken = {k: v for k, v in found.items() if k != "rows" and v}
    if found["rows"] < least:
        broken["rows"] = found["rows"]
    if broken:
        raise Broken(broken)
    return found


def wrong_transform(transform="transform", expected="expected", tolerance: float = 1e-9) -> Column:
    """A transform that differs from the expected one by more than tolerance (relative to the larger number), or is missing."""
    t, e = X.col(transform), X.col(expected)
    off = [F.abs(t[k] - e[k]) > tolerance * F.greatest(F.abs(t[k]), F.abs(e[k]), F.lit(1.0)) for k in "abcdef"]
    differs = off[0]
    for o in off[1:]:
        differs = differs | o
    return F.coalesce(differs, e.isNotNull())


def outside_raster(width="width", height="height") -> Column:
    """A tile (x_off, y_off, src_w, src_h) that has no pixel in its raster."""
    return (F.col("x_off") >= X.col(width)) | (F.col("y_off") >= X.col(height)) | (F.col("x_off") + F.col("src_w") <= 0) | (F.col("y_off") + F.col("src_h") <= 0)
