"""Comparison of segmentations and images, pixel by pixel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Index of each outcome; callers may renumber.
OUTCOMES = {"tp": 1, "fp": 2, "fn": 3, "tn": 4}
MOST_CLASSES = 256


def confusion_map(px: DataFrame, categories: DataFrame, label: str, mask: str, outcomes: Mapping[str, int] = OUTCOMES) -> DataFrame:
    """px without label and mask, for each active category that is not ignored: name and outcome.

    categories (name, palette_index, is_active, is_ignore) is a short list: its
    rows are the classes of one segmentation, at most MOST_CLASSES as palette
    indices are bytes. They stand in the plan as constants, so nothing is joined
    or moved.
    """
    if set(outcomes) != set(OUTCOMES):
        raise ValueError(f"outcomes must name {sorted(OUTCOMES)}")
    active = categories.where("is_active and not is_ignore").select("name", "palette_index")
    is_label, is_mask = F.col(label) == F.col("palette_index"), F.col(mask) == F.col("palette_index")
    outcome = F.when(is_label & is_mask, outcomes["tp"]).when(~is_label & is_mask, outcomes["fp"]).when(is_label & ~is_mask, outcomes["fn"]).otherwise(outcomes["tn"])
    kept = [c for c in px.columns if c not in (label, mask)]
    classes = active.limit(MOST_CLASSES + 1).collect()
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"a segmentation has at most {MOST_CLASSES} classes")
    listed = F.array(*[F.struct(F.lit(c["name"]).alias("name"), F.lit(c["palette_index"]).alias("palette_index")) for c in classes]) if classes else F.array().cast("array<struct<name:string,palette_index:int>>")
    each = px.select(*kept, label, mask, F.explode(listed).alias("_class"))
    return each.select(*kept, label, mask, "_class.name", "_class.palette_index").select(*kept, "name", outcome.alias("outcome"))


def confusion_counts(px: DataFrame, categories: DataFrame, label: str, mask: str, group: Sequence[str] = ()) -> DataFrame:
    """group, name, tp, fp, fn, tn. Pixels are first counted by (label, mask), so few rows meet the categories."""
    pairs = px.groupBy(*group, label, mask).agg(F.count(F.lit(1)).alias("_n"))
    mapped = confusion_map(pairs, categories, label, mask)
    return mapped.groupBy(*group, "name").agg(*[F.coalesce(F.sum(F.when(F.col("outcome") == i, F.col("_n"))), F.lit(0)).alias(n) for n, i in OUTCOMES.items()])


def joined_tiles(fused: DataFrame, original: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """fused with the original's value at each pixel; a pixel that the original lacks is an error."""
    other = original.select(*key, F.col(value).alias("original"), F.lit(True).alias("_there"))
    joined = fused.join(other, list(key), "left")
    return joined.withColumn("original", F.when(F.col("_there"), F.col("original")).otherwise(F.raise_error("fused tile without original").cast("int"))).drop("_there")


def difference_map(a: DataFrame, b: DataFrame, pixel: Sequence[str], index: int, value: str = "value") -> DataFrame:
    """pixel, value: index where any band of a and b differs, else 0."""
    both = a.select(*pixel, "band", F.col(value).alias("_a")).join(b.select(*pixel, "band", F.col(value).alias("_b")), [*pixel, "band"])
    return both.groupBy(*pixel).agg(F.when(F.bool_or(F.col("_a") != F.col("_b")), index).otherwise(0).alias(value))
