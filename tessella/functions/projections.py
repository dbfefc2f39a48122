"""Families of map projections on the ellipsoid as column expressions, by their parameters.

Each projection gives (x, y) of (lon, lat) in degrees and back. The way back of
the conformal ones solves for the latitude by a series in the eccentricity, so
no expression iterates.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


@dataclass(frozen=True)
class Ellipsoid:
    a: float = 6378137.0
    inverse_flattening: float = 298.257223563

    @property
    def e2(self) -> float:
        f = 1 / self.inverse_flattening
        return f * (2 - f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)


# The ellipsoids of EPSG 7030 and 7019.
WGS84, GRS80 = Ellipsoid(), Ellipsoid(6378137.0, 298.257222101)


def _wrapped(degrees: Column) -> Column:
    """Longitudes from -180 to 180."""
    return degrees - 360.0 * F.floor((degrees + 180.0) / 360.0)


def _conformal(phi: Column, e: float) -> Column:
    """The half-angle function t of the conformal projections."""
    s = e * F.sin(phi)
    return F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))


def _t(phi: float, e: float) -> float:
    s = e * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)


def _m(phi: float, e2: float) -> float:
    return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)


def _latitude(t: Column, e2: float) -> Column:
    """The latitude that _conformal gives t for."""
    chi = math.pi / 2 - 2 * F.atan(t)
    e4, e6, e8 = e2**2, e2**3, e2**4
    terms = (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520, 7 * e6 / 120 + 81 * e8 / 1120, 4279 * e8 / 161280)
    out = chi
    for k, c in enumerate(terms, 1):
        out = out + c * F.sin(2 * k * chi)
    return out


@dataclass(frozen=True)
class LambertConformal:
    """Lambert's conformal conic projection with two standard parallels (or one: both alike)."""

    lat_0: float
    lon_0: float
    lat_1: float
    lat_2: float
    x_0: float = 0.0
    y_0: float = 0.0
    ellipsoid: Ellipsoid = WGS84

    def _cone(self) -> tuple[float, float, float]:
        """The cone's constant, its scale, and the radius of the origin's parallel."""
        p0, p1, p2 = (math.radians(v) for v in (self.lat_0, self.lat_1, self.lat_2))
        e2, e = self.ellipsoid.e2, self.ellipsoid.e
        m1, m2, t0, t1, t2 = _m(p1, e2), _m(p2, e2), _t(p0, e), _t(p1, e), _t(p2, e)
        n = math.sin(p1) if math.isclose(p1, p2) else (math.log(m1) - math.log(m2)) / (math.log(t1) - math.log(t2))
        scale = self.ellipsoid.a * m1 / (n * t1**n)
        return n, scale, scale * t0**n

    def forward(self, lon: Column, lat: Column) -> Point:
        n, scale, rho_0 = self._cone()
        rho = scale * F.pow(_conformal(F.radians(lat), self.ellipsoid.e), F.lit(n))
        theta = n * F.radians(_wrapped(lon - self.lon_0))
        return self.x_0 + rho * F.sin(theta), self.y_0 + rho_0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> Point:
        n, scale, rho_0 = self._cone()
        dx, dy, sign = x - self.x_0, rho_0 - (y - self.y_0), math.copysign(1.0, n)
        theta = F.atan2(sign * dx, sign * dy)
        t = F.pow(F.hypot(dx, dy) / abs(scale), F.lit(1 / n))
        return _wrapped(F.degrees(theta / n) + self.lon_0), F.degrees(_latitude(t, self.ellipsoid.e2))


@dataclass(frozen=True)
class AlbersEqualArea:
    """Albers' equal-area conic projection with two standard parallels."""

    lat_0: float
    lon_0: float
    lat_1: float
    lat_2: float
    x_0: float = 0.0
    y_0: float = 0.0
    ellipsoid: Ellipsoid = WGS84

    def _q(self, phi: float) -> float:
        e, s = self.ellipsoid.e, math.sin(phi)
        return (1 - e * e) * (s / (1 - e * e * s * s) + math.atanh(e * s) / e)

    def _cone(self) -> tuple[float, float, float]:
        p0, p1, p2 = (math.radians(v) for v in (self.lat_0, self.lat_1, self.lat_2))
        m1, m2 = _m(p1, self.ellipsoid.e2), _m(p2, self.ellipsoid.e2)
        n = math.sin(p1) if math.isclose(p1, p2) else (m1**2 - m2**2) / (self._q(p2) - self._q(p1))
        c = m1**2 + n * self._q(p1)
        return n, c, self.ellipsoid.a * math.sqrt(c - n * self._q(p0)) / n

    def forward(self, lon: Column, lat: Column) -> Point:
        n, c, rho_0 = self._cone()
        e = self.ellipsoid.e
        s = F.sin(F.radians(lat))
        q = (1 - e * e) * (s / (1 - e * e * s * s) + F.atanh(e * s) / e)
        rho = self.ellipsoid.a * F.sqrt(F.greatest(c - n * q, F.lit(0.0))) / n
        theta = n * F.radians(_wrapped(lon - self.lon_0))
        return self.x_0 + rho * F.sin(theta), self.y_0 + rho_0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> Point:
        n, c, rho_0 = self._cone()
        dx, dy, sign = x - self.x_0, rho_0 - (y - self.y_0), math.copysign(1.0, n)
        q = (c - F.pow(F.hypot(dx, dy) * n / self.ellipsoid.a, F.lit(2.0))) / n
        beta = F.asin(F.greatest(F.least(q / self._q(math.pi / 2), F.lit(1.0)), F.lit(-1.0)))
        e2 = self.ellipsoid.e2
        e4, e6 = e2**2, e2**3
        lat = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
        return _wrapped(F.degrees(F.atan2(sign * dx, sign * dy) / n) + self.lon_0), F.degrees(lat)


@dataclass(frozen=True)
class PolarStereographic:
    """The polar stereographic projection, true to scale at the parallel lat_ts, whose sign names the pole."""

    lat_ts: float
    lon_0: float
    x_0: float = 0.0
    y_0: float = 0.0
    ellipsoid: Ellipsoid = WGS84

    def _scale(self) -> float:
        e, phi = self.ellipsoid.e, math.radians(abs(self.lat_ts))
        if math.isclose(phi, math.pi / 2):
            return 2 * self.ellipsoid.a / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        return self.ellipsoid.a * _m(phi, e * e) / _t(phi, e)

    def forward(self, lon: Column, lat: Column) -> Point:
        pole = math.copysign(1.0, self.lat_ts)
        rho = self._scale() * _conformal(F.radians(pole * lat), self.ellipsoid.e)
        theta = F.radians(_wrapped(lon - self.lon_0))
        return self.x_0 + rho * F.sin(theta), self.y_0 - pole * rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> Point:
        pole = math.copysign(1.0, self.lat_ts)
        dx, dy = x - self.x_0, y - self.y_0
        lat = _latitude(F.hypot(dx, dy) / self._scale(), self.ellipsoid.e2)
        return _wrapped(F.degrees(F.atan2(dx, -pole * dy)) + self.lon_0), pole * F.degrees(lat)


Projection = LambertConformal | AlbersEqualArea | PolarStereographic

# Parameters of EPSG codes.
KNOWN: dict[int, Projection] = {
    2154: LambertConformal(46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0, GRS80),
    3034: LambertConformal(52.0, 10.0, 35.0, 65.0, 4000000.0, 2800000.0, GRS80),
    5070: AlbersEqualArea(23.0, -96.0, 29.5, 45.5, 0.0, 0.0, GRS80),
    3577: AlbersEqualArea(0.0, 132.0, -18.0, -36.0, 0.0, 0.0, GRS80),
    3995: PolarStereographic(71.0, 0.0),
    3031: PolarStereographic(-71.0, 0.0),
}


def point_transformer(source: int | Projection, target: int | Projection) -> Callable[[Column, Column], Point]:
    """A function of (x, y) between CRS: EPSG codes 4326, 3857, UTM (326xx, 327xx), those of KNOWN, or projections by their parameters."""
    from tessella.functions import exprs as X

    def utm_zone(code: int) -> tuple[int, bool] | None:
        return (code % 100, code < 32700) if code // 100 in (326, 327) and 1 <= code % 100 <= 60 else None

    def to_lonlat(crs: int | Projection) -> Callable[[Column, Column], Point]:
        if crs == 4326:
            return lambda x, y: (x, y)
        if crs == 3857:
            return lambda x, y: (X.x_3857_to_lon(x), X.y_3857_to_lat(y))
        if isinstance(crs, int) and (zone := utm_zone(crs)):
            return lambda x, y: X.utm_inverse(x, y, *zone)
        return _named(crs).inverse

    def from_lonlat(crs: int | Projection) -> Callable[[Column, Column], Point]:
        if crs == 4326:
            return lambda x, y: (x, y)
        if crs == 3857:
            return lambda x, y: (X.lon_to_3857(x), X.lat_to_3857(y))
        if isinstance(crs, int) and (zone := utm_zone(crs)):
            return lambda x, y: X.utm(x, y, *zone)
        return _named(crs).forward

    if source == target:
        return lambda x, y: (x, y)
    back, on = to_lonlat(source), from_lonlat(target)
    return lambda x, y: on(*back(x, y))


def _named(crs: int | Projection) -> Projection:
    if isinstance(crs, int):
        if crs not in KNOWN:
            raise ValueError(f"EPSG:{crs} is not known; give its projection by parameters")
        return KNOWN[crs]
    return crs


def densified_bounds(bounds, source: int | Projection, target: int | Projection, steps: int = 21) -> Column:
    """struct(left, bottom, right, top) in another CRS around the four sides, each of so many points: sides may bend there.

    A pole inside the bounds is not looked for.
    """
    from tessella.functions import exprs as X

    b, move = X.col(bounds), point_transformer(source, target)
    part = lambda low, high, i: b[low] + (b[high] - b[low]) * i / (steps - 1)
    sides = [lambda i: (part("left", "right", i), b["bottom"]), lambda i: (part("left", "right", i), b["top"]), lambda i: (b["left"], part("bottom", "top", i)), lambda i: (b["right"], part("bottom", "top", i))]
    every = F.sequence(F.lit(0), F.lit(steps - 1))
    point = lambda at: X.let(F.struct(at[0].alias("lon"), at[1].alias("lat")), lambda q: F.struct(*[c.alias(n) for c, n in zip(move(q["lon"], q["lat"]), "xy", strict=True)]))
    along = lambda side: F.transform(every, lambda i: point(side(i)))
    moved = F.flatten(F.array(*map(along, sides)))
    of = lambda m, k: F.transform(m, lambda p: p[k])
    return X.let(moved, lambda m: F.struct(F.array_min(of(m, "x")).alias("left"), F.array_min(of(m, "y")).alias("bottom"), F.array_max(of(m, "x")).alias("right"), F.array_max(of(m, "y")).alias("top")))
