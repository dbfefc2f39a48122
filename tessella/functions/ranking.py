"""Global positions without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the hash that name a range: 4,096 ranges.
RANGE_DIGITS = 3


def shuffled_position(df: DataFrame, key: Column, name: str = "position", total: str = "total") -> DataFrame:
    """df with the place (from 1) of each row in the order of md5(key), and the number of rows.

    The hash's leading digits cut the order into ranges that are sorted apart;
    the ranges' counts, 4,096 at most, give their offsets. Rows that tie in
    their key take places next to each other in no stated order.
    """
    keyed = df.withColumn("_key", F.md5(key)).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    counts = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias(total))
    inside = Window.partitionBy("_range").orderBy("_key")
    placed = keyed.join(offsets, "_range").withColumn(name, F.col("_before") + F.row_number().over(inside))
    return placed.drop("_key", "_range", "_before")
