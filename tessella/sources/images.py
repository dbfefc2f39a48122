"""Image files of tiles as pixels, and pixels as PNG files; fetching tiles; other databases.

Files are read by Spark's image source (PNG, TIFF, JPEG, GIF, BMP), so they
are decoded in the JVM, file by file. Palette images give colours; labels come
back by the inverse palette of their categories. Pixels leave as packed rows,
one a tile.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HEAD = b"\x89PNG\r\n\x1a\n"


def encode(image: np.ndarray, palette: Sequence[Sequence[int]] | None = None) -> bytes:
    """A PNG file of (height, width, channels) or (height, width) of 8 bits."""
    image = image.reshape(*image.shape[:2], -1).astype(np.uint8)
    height, width, n = image.shape
    kind = 3 if palette else {1: 0, 2: 4, 3: 2, 4: 6}[n]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1)
    colors = chunk(b"PLTE", bytes(c for rgb in palette for c in rgb)) if palette else b""
    return _HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + colors + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def read_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """path, width, height, channels, data of every file; data: row by row, channels together, blue first; nulls where a file cannot be read."""
    files = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    good = F.col("image.nChannels") > 0
    kept = lambda field, name: F.when(good, F.col(f"image.{field}")).alias(name)
    return files.select(F.col("image.origin").alias("path"), kept("width", "width"), kept("height", "height"), kept("nChannels", "channels"), kept("data", "data"))


def image_pixels(images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, y, x, band, value in long form; band 0 is red or gray, 3 alpha. Images that could not be read have no rows."""
    # One character a byte, so that the bytes are parted once and not cut out one by one.
    cells = images.where("data is not null").select(*keys, "width", "channels", F.posexplode(F.split(F.decode("data", "ISO-8859-1"), "")).alias("_p", "_c"))
    place, channel = F.floor(F.col("_p") / F.col("channels")), F.pmod("_p", F.col("channels"))
    band = F.when((F.col("channels") < 3) | (channel == 3), channel).otherwise(2 - channel)
    return cells.select(*keys, F.floor(place / F.col("width")).cast("int").alias("y"), F.pmod(place, F.col("width")).cast("int").alias("x"), band.cast("int").alias("band"), F.ascii("_c").alias("value"))


def label_pixels(images: DataFrame, keys: Sequence[str], categories: DataFrame) -> DataFrame:
    """keys, y, x, label of palette images: the index of each colour in the categories' palette, 0 for other colours."""
    from tessella.operators.pixels import inverse_palette

    # A pixel's bytes as one text of hexadecimal digits, so that its bands need not meet again.
    texts = F.regexp_extract_all(F.hex("data"), F.concat(F.lit(".{"), (F.col("channels") * 2).cast("string"), F.lit("}")), F.lit(0))
    cells = images.where("data is not null").select(*keys, "width", "channels", F.posexplode(texts).alias("_p", "_c"))
    color = F.when(F.col("channels") > 2, F.substring("_c", 1, 6)).when(F.col("channels") == 2, F.concat(F.lit("00"), F.substring("_c", 3, 2), F.substring("_c", 1, 2))).otherwise(F.concat(F.lit("0000"), "_c"))
    # At most 256 rows: a palette's index is one byte.
    known = inverse_palette(categories).select(F.concat(*[F.lpad(F.hex(c), 2, "0") for c in ("b", "g", "r")]).alias("_c"), "palette_index")
    found = cells.withColumn("_c", color).join(F.broadcast(known), "_c", "left")
    return found.select(*keys, F.floor(F.col("_p") / F.col("width")).cast("int").alias("y"), F.pmod("_p", F.col("width")).cast("int").alias("x"), F.coalesce("palette_index", F.lit(0)).alias("label"))


def encoded_images(packed: DataFrame, width: int, height: int, palette: Sequence[Sequence[int]] | None = None, data: str = "data") -> DataFrame:
    """packed (data: array of values, row by row) with png: the file of each row."""
    colors = [list(c) for c in palette] if palette else None

    @F.pandas_udf(T.BinaryType())
    def files(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for many in batches:
            yield pd.Series([encode(np.asarray(v, np.uint8).reshape(height, width, -1), colors) for v in many], dtype=object)

    return packed.withColumn("png", files(data))


def fetch_images(urls: DataFrame, url: str = "url", timeout: float = 10.0, most: int = 16 << 20) -> DataFrame:
    """urls with content, what each URL gives, and error, the name of what went wrong; one of both is null. For tile servers.

    An answer of over `most` bytes is an error, TooLong.
    """

    @F.pandas_udf("struct<content:binary,error:string>")
    def fetched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from urllib.request import urlopen

        for many in batches:
            out = []
            for u in many:
                try:
                    with urlopen(u, timeout=timeout) as answer:  # noqa: S310
                        content = answer.read(most + 1)
                    out.append((content, None) if len(content) <= most else (None, "TooLong"))
                except (OSError, ValueError, AttributeError) as e:
                    out.append((None, type(e).__name__))
            yield pd.DataFrame(out, columns=["content", "error"])

    return urls.withColumn("_found", fetched(url)).select("*", "_found.content", "_found.error").drop("_found")


def virtual_mosaic(*rasters: DataFrame, order: Sequence[int] | None = None) -> DataFrame:
    """Pixels of several rasters under one another, with raster_ord: a view, nothing is written."""
    numbers = order or range(len(rasters))
    out = None
    for n, r in zip(numbers, rasters, strict=True):
        layer = r.withColumn("raster_ord", F.lit(n))
        out = layer if out is None else out.unionByName(layer)
    return out


#: The bounds of a granule in a spatial database, by the name of its geometry.
SPATIAL_BOUNDS = ("st_xmin({0})", "st_ymin({0})", "st_xmax({0})", "st_ymax({0})")


def cover_predicates(tiles: DataFrame, bounds: Sequence[str], most: int = 64) -> list[str]:
    """SQL conditions on bounds (west, south, east, north), one for each cell of a coarse grid that tiles (west, south, east, north) touch.

    Cells are as fine as at most `most` of them allow, so the driver gets a
    bounded list; each cell's condition is narrowed to what the tiles in it
    span. A granule may meet several.
    """
    span = tiles.agg(*[F.min(c).alias(c) for c in ("west", "south")], *[F.max(c).alias(c) for c in ("east", "north")]).first()
    if span["west"] is None:
        return []
    per_side = max(1, int(most**0.5))
    wide, high = ((span[b] - span[a]) / per_side or 1.0 for a, b in (("west", "east"), ("south", "north")))
    cell = lambda c, low, size: F.least(F.floor((F.col(c) - low) / size), F.lit(per_side - 1))
    found = tiles.groupBy(cell("west", span["west"], wide).alias("_x"), cell("south", span["south"], high).alias("_y")).agg(*[F.min(c).alias(c) for c in ("west", "south")], *[F.max(c).alias(c) for c in ("east", "north")])
    w, s, e, n = bounds
    return [f"{w} <= {r['east']!r} and {e} >= {r['west']!r} and {s} <= {r['north']!r} and {n} >= {r['south']!r}" for r in found.orderBy("_x", "_y").collect()]


def read_granules(spark: SparkSession, url: str, table: str, geometry: str = "geom", ident: str = "granule", tiles: DataFrame | None = None, bounds: Sequence[str] = SPATIAL_BOUNDS, most: int = 64, **options: str) -> DataFrame:
    """granule, west, south, east, north from a spatial database over JDBC, for the overlap join with tiles.

    bounds: SQL of a granule's west, south, east and north; {0} is the
    geometry. tiles: the database gives only granules near these, a partition
    for each condition of cover_predicates; granules may come more than once.
    """
    w, s, e, n = own = [b.format(geometry) for b in bounds]
    names = ("west", "south", "east", "north")
    query = f"(select {ident} as granule, {', '.join(f'{b} as {name}' for b, name in zip(own, names, strict=True))} from {table}) granules"
    if tiles is None:
        found = spark.read.format("jdbc").options(url=url, dbtable=query, **options).load()
    else:
        found = spark.read.jdbc(url, query, predicates=cover_predicates(tiles, names, most) or ["1 = 0"], properties=options)
    return found.toDF("granule", *names)


def granules_of_tiles(tiles: DataFrame, granules: DataFrame) -> DataFrame:
    """Distinct granules whose bounds meet those of tiles (both: west, south, east, north)."""
    from tessella.operators.spatial import sized_overlap_join

    box = {"x0": "west", "y0": "south", "x1": "east", "y1": "north"}
    named = lambda df, *cols: df.select(F.lit(1).alias("_k"), *cols, *[F.col(c).alias(k) for k, c in box.items()])
    return sized_overlap_join(named(tiles), named(granules, "granule"), ["_k"], 1.0).select("granule").distinct()
