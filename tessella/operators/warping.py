"""Values of rasters at places between their pixels, block by block.

Source pixels are packed into blocks with a halo as wide as the kernel reaches.
A place belongs to the block that holds its kernel's middle, so places and
blocks meet by an equi-join, and all that a kernel needs is in one row. Places
are packed too, at most a target block for each row, so that an enlargement
does not pile up in one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _linear(d: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - d)


def _cubic(d: np.ndarray) -> np.ndarray:
    near, far = (1.5 * d - 2.5) * d * d + 1, ((-0.5 * d + 2.5) * d - 4) * d + 2
    return np.where(d <= 1, near, np.where(d < 2, far, 0.0))


def _lanczos(d: np.ndarray) -> np.ndarray:
    return np.where(d < 3, np.sinc(d) * np.sinc(d / 3), 0.0)


#: Weight by distance in source pixels, and how many pixels it reaches to either side.
RESAMPLING = {"bilinear": (_linear, 1), "cubic": (_cubic, 2), "lanczos": (_lanczos, 3)}


def _values(grid: np.ndarray, sy: np.ndarray, sx: np.ndarray, resampling: str) -> np.ndarray:
    """The kernel's values at places (in pixels of grid, whose missing ones are NaN); NaN where the pixel that holds the place is missing."""
    weight, reach = RESAMPLING[resampling]
    low_y, low_x = np.floor(sy - 0.5).astype(int), np.floor(sx - 0.5).astype(int)
    fy, fx = sy - 0.5 - low_y, sx - 0.5 - low_x
    total, norm = np.zeros(len(sy)), np.zeros(len(sy))
    for j in range(1 - reach, reach + 1):
        wy = weight(np.abs(fy - j))
        for i in range(1 - reach, reach + 1):
            w, v = wy * weight(np.abs(fx - i)), grid[low_y + j, low_x + i]
            there = ~np.isnan(v)
            total[there] += (w * v)[there]
            norm[there] += w[there]
    held = ~np.isnan(grid[np.floor(sy).astype(int), np.floor(sx).astype(int)])
    return np.where(held & (norm > 1e-9), total / np.where(norm > 1e-9, norm, 1.0), np.nan)


def sampled(px: DataFrame, places: DataFrame, source: Sequence[str], target: Sequence[str], resampling: str, block: int = 256, value: str = "value", fill: float = 0.0) -> DataFrame:
    """source and target keys, y, x, value (double) of every row of places.

    px: source keys, y, x, value. places: source and target keys, y, x (the
    target's pixel) and sy, sx (where it lies in the source, pixel centres at
    halves). Weights of pixels that are there add up to 1; a place whose own
    source pixel is missing, or which is null, gets fill.
    """
    reach = RESAMPLING[resampling][1]
    side, c = block + 2 * reach, F.col
    span = lambda at: F.sequence(F.floor((c(at) - reach) / block).cast("int"), F.floor((c(at) + reach) / block).cast("int"))
    spread = px.select(*source, "y", "x", c(value).cast("double").alias("_v"), F.explode(span("y")).alias("_by")).select("*", F.explode(span("x")).alias("_bx"))
    place = ((c("y") - c("_by") * block + reach) * side + c("x") - c("_bx") * block + reach).cast("int")
    blocks = spread.groupBy(*source, "_by", "_bx").agg(F.collect_list(place).alias("_at"), F.collect_list("_v").alias("_values"))
    within = lambda s: F.coalesce(F.floor((F.floor(c(s) - 0.5)) / block), F.lit(0)).cast("int")
    keyed = places.select(*source, *target, "y", "x", F.coalesce("sy", F.lit(float("nan"))).alias("sy"), F.coalesce("sx", F.lit(float("nan"))).alias("sx"), within("sy").alias("_by"), within("sx").alias("_bx"))
    listed = keyed.groupBy(*source, *target, "_by", "_bx", F.floor(c("y") / block).alias("_ty"), F.floor(c("x") / block).alias("_tx")).agg(*[F.collect_list(k).alias(f"_{k}s") for k in ("y", "x", "sy", "sx")])
    joined = listed.join(blocks, [*source, "_by", "_bx"], "left").select(*source, *target, "_by", "_bx", "_ys", "_xs", "_sys", "_sxs", "_at", "_values")
    keys = [*source, *target]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*keys).schema) + ", y int, x int, value double"

    def resampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            flat = lambda name: row.column(name).flatten().to_numpy(zero_copy_only=False)  # noqa: E731, B023
            sy, sx = (flat(f"_s{k}s") - row.column(f"_b{k}")[0].as_py() * block + reach for k in "yx")
            found = np.full(len(sy), fill)
            if row.column("_at")[0].is_valid:
                grid = np.full(side * side, np.nan)
                grid[flat("_at")] = flat("_values")
                known = ~np.isnan(sy) & ~np.isnan(sx)
                values = _values(grid.reshape(side, side), sy[known], sx[known], resampling)
                found[known] = np.where(np.isnan(values), fill, values)
            names = [row.column(k).take(pa.array(np.zeros(len(sy), np.int64))) for k in keys]
            yield pa.RecordBatch.from_arrays([*names, pa.array(flat("_ys"), pa.int32()), pa.array(flat("_xs"), pa.int32()), pa.array(found)], names=[*keys, "y", "x", "value"])

    return joined.mapInArrow(resampled, schema).withColumnRenamed("value", value)
