"""Column expressions of tiles, transforms, mercator maths and strings. No UDFs."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half the circumference of the earth in EPSG:3857, its radius, the latitude where the square ends.
HALF_WORLD = 20037508.342789244
RADIUS = 6378137.0
LAT_LIMIT = 85.051129


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_even(x) -> Column:
    """Rounds halves to the even neighbour."""
    return F.rint(col(x))


def trunc(x) -> Column:
    """Cuts towards zero."""
    return col(x).cast("int")


# mercator


def mercator_x(lon, zoom) -> Column:
    n = F.pow(F.lit(2.0), col(zoom))
    return F.least(F.greatest(F.floor((col(lon) / 360.0 + 0.5 + 1e-14) * n), F.lit(0)), n - 1).cast("int")


def mercator_y(lat, zoom) -> Column:
    n = F.pow(F.lit(2.0), col(zoom))
    s = F.sin(F.radians(F.greatest(F.least(col(lat), F.lit(LAT_LIMIT)), F.lit(-LAT_LIMIT))))
    return F.least(F.greatest(F.floor((F.lit(0.5) - F.log((1 + s) / (1 - s)) * 0.25 / math.pi + 1e-14) * n), F.lit(0)), n - 1).cast("int")


def tile_west(x, zoom) -> Column:
    """The longitude of a tile's west edge; its east edge is that of x + 1."""
    return col(x) / F.pow(F.lit(2.0), col(zoom)) * 360.0 - 180.0


def tile_north(y, zoom) -> Column:
    """The latitude of a tile's north edge; its south edge is that of y + 1."""
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * col(y) / F.pow(F.lit(2.0), col(zoom))))))


def tile_left_3857(x, zoom) -> Column:
    return col(x) / F.pow(F.lit(2.0), col(zoom)) * (2 * HALF_WORLD) - HALF_WORLD


def tile_top_3857(y, zoom) -> Column:
    return HALF_WORLD - col(y) / F.pow(F.lit(2.0), col(zoom)) * (2 * HALF_WORLD)


def lon_to_3857(lon) -> Column:
    return F.radians(col(lon)) * RADIUS


def lat_to_3857(lat) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(col(lat)) / 2)) * RADIUS


def x_3857_to_lon(x) -> Column:
    return F.degrees(col(x) / RADIUS)


def y_3857_to_lat(y) -> Column:
    return F.degrees(2 * F.atan(F.exp(col(y) / RADIUS)) - math.pi / 2)


def utm(lon, lat, zone: int, north: bool = True) -> tuple[Column, Column]:
    """UTM easting and northing (WGS 84) by the Krueger series, to about a millimetre within a zone."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(col(lat)), F.radians(col(lon) - (6 * zone - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * radius * x, (0 if north else 10_000_000) + 0.9996 * radius * y


def utm_inverse(easting, northing, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Longitude and latitude of UTM coordinates, by the series of the way back."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (col(northing) - (0 if north else 10_000_000)) / (0.9996 * radius)
    eta = (col(easting) - 500000) / (0.9996 * radius)
    x, y = eta, xi
    for j, c in enumerate(beta, 1):
        x = x - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    chi = F.asin(F.sin(y) / F.cosh(x))
    phi = chi
    for j, c in enumerate(delta, 1):
        phi = phi + c * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(x), F.cos(y))) + (6 * zone - 183), F.degrees(phi)


# affine transforms: a struct (a, b, c, d, e, f) with x = a col + b row + c, y = d col + e row + f


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), value being computed once a row however often it is used there."""
    return F.transform(F.array(value), of)[0]


def affine(a, b, c, d, e, f) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("double").alias(n) for n, x in zip("abcdef", (a, b, c, d, e, f), strict=True)])


def apply_x(t, column, row) -> Column:
    t = col(t)
    return t["a"] * col(column) + t["b"] * col(row) + t["c"]


def apply_y(t, column, row) -> Column:
    t = col(t)
    return t["d"] * col(column) + t["e"] * col(row) + t["f"]


def inverse(t) -> Column:
    t = col(t)
    det = t["a"] * t["e"] - t["b"] * t["d"]
    return affine(t["e"] / det, -t["b"] / det, (t["b"] * t["f"] - t["e"] * t["c"]) / det, -t["d"] / det, t["a"] / det, (t["d"] * t["c"] - t["a"] * t["f"]) / det)


def compose(outer, inner) -> Column:
    """First inner, then outer."""
    p, q = col(outer), col(inner)
    return affine(p["a"] * q["a"] + p["b"] * q["d"], p["a"] * q["b"] + p["b"] * q["e"], p["a"] * q["c"] + p["b"] * q["f"] + p["c"], p["d"] * q["a"] + p["e"] * q["d"], p["d"] * q["b"] + p["e"] * q["e"], p["d"] * q["c"] + p["e"] * q["f"] + p["f"])


def from_bounds(west, south, east, north, width, height) -> Column:
    west, south, east, north = map(col, (west, south, east, north))
    return affine((east - west) / col(width), 0, west, 0, (south - north) / col(height), north)


def tile_transform(t, x_off, y_off, src_w, src_h, disk_w, disk_h) -> Column:
    """A tile's pixel-to-CRS transform: the raster's moved to the tile, pixel sizes scaled (shear is not)."""
    t = col(t)
    return affine(t["a"] * col(src_w) / col(disk_w), t["b"], apply_x(t, x_off, y_off), t["d"], t["e"] * col(src_h) / col(disk_h), apply_y(t, x_off, y_off))


def corner_bounds(t, x0, y0, x1, y1) -> Column:
    """struct(left, bottom, right, top) of a pixel rectangle in the CRS."""
    xs = [apply_x(t, x, y) for x in (x0, x1) for y in (y0, y1)]
    ys = [apply_y(t, x, y) for x in (x0, x1) for y in (y0, y1)]
    return F.struct(F.least(*xs).alias("left"), F.least(*ys).alias("bottom"), F.greatest(*xs).alias("right"), F.greatest(*ys).alias("top"))


def is_default_transform(t, tolerance: float = 1e-5) -> Column:
    """The identity, up to tolerance: no georeference."""
    t = col(t)
    gaps = [F.abs(t[n] - want) <= tolerance for n, want in zip("abcdef", (1, 0, 0, 0, 1, 0), strict=True)]
    out = gaps[0]
    for g in gaps[1:]:
        out = out & g
    return out


def gsd(tags, transform) -> tuple[Column, Column]:
    """Metres a pixel in x and y: the tag GSD, one number or "(x,y)", else the transform's pixel sizes."""
    found = F.regexp_extract_all(F.try_element_at(col(tags), F.lit("GSD")), F.lit(r"([-+0-9.eE]+)"), 1)
    x, y = (F.try_element_at(found, F.lit(i)).cast("double") for i in (1, 2))
    return F.coalesce(x, F.abs(col(transform)["a"])), F.coalesce(y, x, F.abs(col(transform)["e"]))


def normalized_uint8(value, dtype) -> Column:
    """Samples of wider types as 0 to 255; negative int16 become 0."""
    v, kind = col(value), col(dtype)
    scaled = F.when(kind == "uint16", F.floor(v / 256)).when(kind == "uint32", F.floor(v / 65536)).when(kind == "int16", F.greatest(F.lit(0), F.floor(v / 10000 * 256))).otherwise(v)
    return F.pmod(scaled.cast("long"), F.lit(256)).cast("int")


# tiles


def source_to_disk_ratio(src, disk) -> Column:
    return col(src) / col(disk)


def disk_center(width, height) -> tuple[Column, Column]:
    return col(width) / 2, col(height) / 2


def pixel_coord(t, column, row, dx: float = 0.5, dy: float = 0.5) -> tuple[Column, Column]:
    """CRS coordinates of a pixel's centre, or of another spot in it."""
    return apply_x(t, col(column) + dx, col(row) + dy), apply_y(t, col(column) + dx, col(row) + dy)


def end_coord(offset, size) -> Column:
    return col(offset) + col(size) - 1


def disk_shift(aux_offset, base_offset, disk, src) -> Column:
    """An offset between two tiles in disk pixels."""
    return F.rint((col(aux_offset) - col(base_offset)) * col(disk) / col(src)).cast("int")


def reliable_half(stride, disk, src) -> Column:
    """Half the side of the window around a tile's centre that is trusted, in disk pixels."""
    return F.ceil(col(stride) * col(disk) / col(src) / 2).cast("int")


# strings


def rgb_hex(r, g, b) -> Column:
    return F.format_string("#%02x%02x%02x", col(r), col(g), col(b))


def local_tile_path(raster, x_off, y_off, w, h, ext: str = ".png") -> Column:
    return F.concat(F.lit("image_pixel_tiles/"), col(raster), F.lit("/width_height_"), col(w), F.lit("_"), col(h), F.lit("/width_offset_"), col(x_off), F.lit("/height_offset_"), col(y_off), F.lit(ext))


def mercator_tile_path(x, y, zoom, ext: str = ".png") -> Column:
    return F.concat(F.lit("spherical_mercator_tiles/z_"), col(zoom), F.lit("/x_"), col(x), F.lit("/y_"), col(y), F.lit(ext))


def parsed_tile_path(path) -> list[Column]:
    """tile_class, raster_name, x_off, y_off, src_w, src_h, x, y, z of a tile's path; null where it has none."""
    p = col(path)
    local = r"image_pixel_tiles/([^/]+)/width_height_(-?\d+)_(-?\d+)/width_offset_(-?\d+)/height_offset_(-?\d+)\."
    web = r"spherical_mercator_tiles/z_(\d+)/x_(\d+)/y_(\d+)\."
    kind = F.when(p.rlike(local), "ImagePixelTile").when(p.rlike(web), "MercatorTile")
    part = lambda pattern, i: F.when(p.rlike(pattern), F.regexp_extract(p, pattern, i))
    ints = [("x_off", local, 4), ("y_off", local, 5), ("src_w", local, 2), ("src_h", local, 3), ("z", web, 1), ("x", web, 2), ("y", web, 3)]
    return [kind.alias("tile_class"), part(local, 1).alias("raster_name"), *[part(q, i).cast("int").alias(n) for n, q, i in ints]]


def normalised_tile_path(path, root: str) -> Column:
    """A tile's path under another root: its parent folder and its name."""
    parts = F.split(col(path), "/")
    return F.concat(F.lit(f"{root}/"), F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1))


def rerooted_path(path, old: str, new: str) -> Column:
    """A path with its leading folder exchanged; others stay."""
    p = col(path)
    return F.when(F.startswith(p, F.lit(old)), F.concat(F.lit(new), F.substring(p, F.lit(len(old) + 1), F.length(p)))).otherwise(p)


def quantity(text) -> Column:
    """struct(values, unit) of "[a b] unit" or "a unit"."""
    t = col(text)
    return F.struct(F.transform(F.regexp_extract_all(t, F.lit(r"([-+]?\d[\d.eE+-]*)"), 1), lambda x: x.cast("double")).alias("values"), F.regexp_extract(t, r"([A-Za-z_]+)\s*$", 1).alias("unit"))


def int_list(text) -> Column:
    return F.transform(F.split(col(text), ","), lambda x: F.trim(x).cast("int"))


def padded_line(name, value, width: int = 40) -> Column:
    """A name without leading underscores, padded, then the value."""
    n = F.ltrim(col(name), F.lit("_"))
    return F.concat(n, F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(n))), col(value))


def natural_key(path) -> Column:
    """A key that sorts digit runs by value."""
    return F.regexp_replace(F.regexp_replace(col(path), r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")


def ratio_comment(value) -> Column:
    v = col(value)
    return F.when(v < 0.5, "ratio below 0.5: most source pixels are lost").when(v > 1, "ratio above 1: tiles are blurred").otherwise("")


def is_valid_box(west, south, east, north) -> Column:
    """A box in degrees with west < east and south < north, within the world; false if a side is null or not a number."""
    w, s, e, n = map(col, (west, south, east, north))
    known = [c.isNotNull() & ~F.isnan(c) for c in (w, s, e, n)]
    return F.coalesce(known[0] & known[1] & known[2] & known[3] & (w < e) & (s < n) & w.between(-180, 180) & e.between(-180, 180) & s.between(-90, 90) & n.between(-90, 90), F.lit(False))
