"""Pixels in long form: nodata, mosaics, labels, palettes, resizing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nodata_statistics(px: DataFrame, tile: Sequence[str], width: int, height: int, value: str = "value", nodata: int = 0) -> DataFrame:
    """tile, n_nodata, n_values, empty_border: whether any of the four border lines has only nodata in all bands."""
    empty = F.col(value) == nodata
    lines = [F.col("y") == 0, F.col("y") == height - 1, F.col("x") == 0, F.col("x") == width - 1]
    border = F.lit(False)
    for line in lines:
        border = border | F.coalesce(F.bool_and(F.when(line, empty)), F.lit(False))
    return px.groupBy(*tile).agg(F.count_if(empty).alias("n_nodata"), F.count(F.lit(1)).alias("n_values"), border.alias("empty_border"))


def is_nodata(threshold: float, keep_borders: bool) -> Column:
    """Over nodata_statistics: the tile counts as empty. A threshold of 0 empties every tile."""
    full = F.col("n_nodata") >= F.col("n_values") * F.lit(threshold / 100.0)
    return full if keep_borders else F.col("empty_border") | full


def kept_tiles(statistics: DataFrame, threshold: float = 100, keep_borders: bool = False, labels: bool = False, n_rasters: str | None = None) -> DataFrame:
    """Label tiles always stay; image tiles if they are not empty or several rasters share them."""
    keep = F.lit(labels) | ~is_nodata(threshold, keep_borders)
    return statistics.where(keep | (F.col(n_rasters) > 1) if n_rasters else keep)


def tile_rasters(px: DataFrame, tile: Sequence[str], raster: str = "raster_ord") -> DataFrame:
    """tile, rasters (in order), n_rasters."""
    seen = px.select(*tile, raster).distinct()
    return seen.groupBy(*tile).agg(F.array_sort(F.collect_list(raster)).alias("rasters")).withColumn("n_rasters", F.size("rasters"))


def shared_counts(tile_to_rasters: DataFrame) -> DataFrame:
    """raster, non_shared, shared: tiles that only this raster has, or others too."""
    each = tile_to_rasters.select(F.explode("rasters").alias("raster"), "n_rasters")
    return each.groupBy("raster").agg(F.count_if(F.col("n_rasters") == 1).alias("non_shared"), F.count_if(F.col("n_rasters") > 1).alias("shared"))


def mosaic(px: DataFrame, pixel: Sequence[str], order: str = "raster_ord", value: str = "value") -> DataFrame:
    """For each pixel and band the first raster's value that is not 0; 0 if there is none."""
    return px.groupBy(*pixel).agg(F.coalesce(F.min_by(F.when(F.col(value) != 0, F.col(value)), F.when(F.col(value) != 0, F.col(order))), F.lit(0)).alias(value))


def append_max(*layers: DataFrame, pixel: Sequence[str], value: str = "value") -> DataFrame:
    """Layers written over each other: the larger value of a pixel stays. Order and repeats do not matter."""
    out = layers[0].select(*pixel, value)
    for layer in layers[1:]:
        out = out.unionByName(layer.select(*pixel, value))
    return out.groupBy(*pixel).agg(F.max(value).alias(value))


def bands_wide(px: DataFrame, pixel: Sequence[str], bands: Sequence[int], names: Sequence[str], value: str = "value") -> DataFrame:
    """Bands as columns; a missing band is 0."""
    return px.where(F.col("band").isin(*bands)).groupBy(*pixel).agg(*[F.coalesce(F.max(F.when(F.col("band") == b, F.col(value))), F.lit(0)).alias(n) for b, n in zip(bands, names, strict=True)])


def with_alpha(px: DataFrame, pixel: Sequence[str], band: int, value: str = "value", opaque: int = 255) -> DataFrame:
    """px with one band more, opaque everywhere."""
    alpha = px.select(*pixel).distinct().select(*pixel, F.lit(band).alias("band"), F.lit(opaque).alias(value))
    return px.select(*pixel, "band", value).unionByName(alpha)


def colors_to_labels(px: DataFrame, categories: DataFrame, channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """px with label: the palette index of the category whose label values hold the colour.

    All channels must be equal; the later category wins; others are 0.
    categories: ord, palette_index, label_values.
    """
    look = categories.select("ord", "palette_index", F.explode("label_values").alias("_color")).groupBy("_color").agg(F.max_by("palette_index", "ord").alias("label"))
    color = F.array(*[F.col(c).cast("int") for c in channels])
    return px.withColumn("_color", color).join(look, "_color", "left").withColumn("label", F.coalesce("label", F.lit(0))).drop("_color")


def colored(px: DataFrame, categories: DataFrame, value: str, default: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """px with r, g, b of its palette index; missing ones take the default colour."""
    palette = categories.select(F.col("palette_index").alias(value), F.col("palette_color").alias("_c"))
    joined = px.join(palette, value, "left")
    return joined.select(*px.columns, *[F.coalesce(F.col("_c")[i], F.lit(default[i])).alias(n) for i, n in enumerate("rgb")])


def inverse_palette(categories: DataFrame) -> DataFrame:
    """r, g, b, palette_index: of categories of one colour the last index."""
    c = F.col("palette_color")
    return categories.groupBy(c[0].alias("r"), c[1].alias("g"), c[2].alias("b")).agg(F.max_by("palette_index", "ord").alias("palette_index"))


def unique_colors(px: DataFrame, channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    return px.groupBy(*channels).agg(F.count(F.lit(1)).alias("n"))


def resize_nearest(px: DataFrame, tile: Sequence[str], src: tuple[int, int], disk: tuple[int, int], value: str = "value") -> DataFrame:
    """tile, y, x, value at disk size. Each source pixel names its own targets, so nothing is shuffled."""

    def targets(at: str, n: int, m: int) -> Column:
        """All d with floor(d n / m) = at."""
        first, last = F.ceil(F.col(at) * m / n).cast("int"), (F.ceil((F.col(at) + 1) * m / n) - 1).cast("int")
        return F.filter(F.sequence(first, F.greatest(first, last)), lambda d: d <= last)

    rows = px.select(*tile, "y", value, F.explode(targets("x", src[0], disk[0])).alias("dx"))
    return rows.select(*tile, F.explode(targets("y", src[1], disk[1])).alias("y"), F.col("dx").alias("x"), value)


def resize_bilinear(px: DataFrame, tile: Sequence[str], src: tuple[int, int], disk: tuple[int, int], value: str = "value") -> DataFrame:
    """tile, y, x, value (double) at disk size: pixel centres, edges clamped.

    Each source pixel adds its weighted part to the targets that it touches;
    the sums combine before the shuffle.
    """

    def parts(at: str, n: int, m: int) -> Column:
        """Targets (d, weight) of a source place."""
        spread = F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - 1) * m / n).cast("int") - 1), F.least(F.lit(m - 1), F.ceil((F.col(at) + 2) * m / n).cast("int")))

        def of(d: Column) -> Column:
            place = (d + 0.5) * n / m - 0.5
            low = F.floor(place)
            f = place - low
            lower, upper = F.greatest(F.lit(0), F.least(low, F.lit(n - 1))), F.greatest(F.lit(0), F.least(low + 1, F.lit(n - 1)))
            weight = F.when(lower == F.col(at), 1 - f).otherwise(0.0) + F.when(upper == F.col(at), f).otherwise(0.0)
            return F.struct(d.alias("d"), weight.alias("w"))

        return F.filter(F.transform(spread, of), lambda p: p["w"] > 0)

    rows = px.select(*tile, "y", value, F.explode(parts("x", src[0], disk[0])).alias("px"))
    rows = rows.select(*tile, value, "px", F.explode(parts("y", src[1], disk[1])).alias("py"))
    weighted = F.col(value) * F.col("px.w") * F.col("py.w")
    return rows.groupBy(*tile, F.col("py.d").alias("y"), F.col("px.d").alias("x")).agg(F.sum(weighted).alias(value))


def _cubic(d: Column) -> Column:
    a = -0.75
    return F.when(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1).when(d < 2, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a).otherwise(0.0)


def _lanczos(d: Column) -> Column:
    sinc = lambda v: F.when(v == 0, 1.0).otherwise(F.sin(math.pi * v) / (math.pi * v))
    return F.when(d < 4, sinc(d) * sinc(d / 4)).otherwise(0.0)


#: Weight of a source place by its distance from the target's place, and how many places reach to either side.
KERNELS = {"cubic": (_cubic, 2), "lanczos": (_lanczos, 4)}


def resize_by_kernel(px: DataFrame, tile: Sequence[str], src: tuple[int, int], disk: tuple[int, int], kernel: str = "cubic", value: str = "value") -> DataFrame:
    """tile, y, x, value (double) at disk size: pixel centres, edges clamped, weights of a target made to add up to 1.

    As in resize_bilinear each source pixel adds its parts to its targets. The
    parts of each source row and column are computed once: two tables of at
    most a few entries for each pixel along a tile's sides, which are broadcast.
    """
    weight, reach = KERNELS[kernel]

    def parts(at: str, n: int, m: int) -> DataFrame:
        spread = F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - reach) * m / n).cast("int") - 1), F.least(F.lit(m - 1), F.ceil((F.col(at) + reach + 1) * m / n).cast("int")))

        def of(d: Column) -> Column:
            place = (d + 0.5) * n / m - 0.5
            taps = F.transform(F.sequence(F.lit(1 - reach), F.lit(reach)), lambda k: F.struct(F.greatest(F.lit(0), F.least(F.floor(place) + k, F.lit(n - 1))).alias("s"), weight(F.abs(place - F.floor(place) - k)).alias("w")))
            total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, t: s + t["w"])
            return F.struct(d.alias("d"), (total(F.filter(taps, lambda t: t["s"] == F.col(at))) / total(taps)).alias("w"))

        places = px.sparkSession.range(n).select(F.col("id").cast("int").alias(at))
        return F.broadcast(places.select(at, F.explode(F.filter(F.transform(spread, of), lambda p: p["w"] != 0)).alias(f"p{at}")))

    rows = px.join(parts("x", src[0], disk[0]), "x").join(parts("y", src[1], disk[1]), "y")
    return rows.groupBy(*tile, F.col("py.d").alias("y"), F.col("px.d").alias("x")).agg(F.sum(F.col(value) * F.col("px.w") * F.col("py.w")).alias(value))


def overviews(px: DataFrame, group: Sequence[str], factors: Sequence[int], value: str = "value") -> DataFrame:
    """group, factor, y, x, value: rounded means of factor x factor blocks."""
    each = px.select(*group, "y", "x", value, F.explode(F.array(*map(F.lit, factors))).alias("factor"))
    down = lambda c: F.floor(F.col(c) / F.col("factor")).cast("int")
    return each.groupBy(*group, "factor", down("y").alias("y"), down("x").alias("x")).agg(F.rint(F.avg(value)).cast("int").alias(value))


def packed(px: DataFrame, tile: Sequence[str], value: str = "value") -> DataFrame:
    """One row a tile: its values, row by row."""
    return px.groupBy(*tile).agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", value))), lambda p: p[value]).alias("data"))


def unpacked(tiles: DataFrame, tile: Sequence[str], width: int, value: str = "value") -> DataFrame:
    rows = tiles.select(*tile, F.posexplode("data").alias("_p", value))
    return rows.select(*tile, F.floor(F.col("_p") / width).cast("int").alias("y"), (F.col("_p") % width).cast("int").alias("x"), value)


def metatile(px: DataFrame, group: Sequence[str], size: int, value: str = "value") -> DataFrame:
    """group, x_off, y_off, y, x, value: each tile with a margin of size // 4 from its neighbours, 0 where there is none.

    Pixels come from the tiles of the same grid (size apart): each tile sends
    the pixels near its sides to the neighbours that show them.
    """
    b, side = size // 4, size + 2 * (size // 4)
    around = F.array(*map(F.lit, (-1, 0, 1)))
    sent = px.select(*group, "x_off", "y_off", "y", "x", value, F.explode(around).alias("i")).select("*", F.explode(around).alias("j"))
    sent = sent.select(*group, (F.col("x_off") + F.col("i") * size).alias("x_off"), (F.col("y_off") + F.col("j") * size).alias("y_off"), (F.col("y") - F.col("j") * size + b).cast("int").alias("y"), (F.col("x") - F.col("i") * size + b).cast("int").alias("x"), value)
    sent = sent.where(F.col("y").between(0, side - 1) & F.col("x").between(0, side - 1))
    every = F.sequence(F.lit(0), F.lit(side - 1))
    tiles = px.select(*group, "x_off", "y_off").distinct()
    blank = tiles.select("*", F.explode(every).alias("y")).select("*", F.explode(every).alias("x"))
    return blank.join(sent, [*group, "x_off", "y_off", "y", "x"], "left").withColumn(value, F.coalesce(value, F.lit(0)))
