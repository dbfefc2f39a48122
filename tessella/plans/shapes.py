"""Queries: whole regions over patches, validity of polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import regions, validity
from tessella.plans import bases as B
from tessella.plans import files as P
from tessella.plans import rasters as R
from tessella.sources import adapters as A


def _corners(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each corner of each ring; the point that closes a ring is left out."""
    ring = polygons.select(*keys, "first_y", "first_x", F.posexplode("rings").alias("ring", "_r"))
    corner = ring.select(*keys, "first_y", "first_x", "ring", F.posexplode(F.slice("_r", F.lit(1), F.size("_r") - 1)).alias("corner", "p"))
    return corner.select(*keys, "first_y", "first_x", "ring", "corner", F.col("p.y").alias("y"), F.col("p.x").alias("x"))


def whole_cover(spark: SparkSession, d: str) -> DataFrame:
    """The regions of a cover at zoom 5, which go over many patches, corner by corner."""
    tiles = A.cover(spark, d).select(F.lit(5).alias("z"), F.shiftright("x", 5).alias("x"), F.shiftright("y", 5).alias("y"))
    return _corners(regions.whole_cover(tiles, ["z"], patch=4), ["z"])


def whole_footprints(spark: SparkSession, d: str) -> DataFrame:
    """Where rasters have data, as polygons over many patches, corner by corner."""
    return _corners(regions.raster_footprints(R.project_pixels(spark, d), F.col("value") != 2, patch=16), ["raster_name"])


def whole_segments(spark: SparkSession, d: str) -> DataFrame:
    """The regions of every value of whole rasters: area, holes and corners."""
    found = regions.whole_regions(R.project_pixels(spark, d), ["raster_name"], patch=16)
    corners = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r) - 1)
    return found.select("raster_name", "value", "first_y", "first_x", (F.size("rings") - 1).alias("holes"), corners.alias("corners"))


def polygon_problems(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with polygons of many kinds."""
    found = validity.polygon_validity(A.odd_polygons(spark, d), ["feature_id"])
    return found.select("feature_id", "valid", F.array_join("problems", ",").alias("problems"))


QUERIES = {f.__name__: f for f in (whole_cover, whole_footprints, whole_segments, polygon_problems)}

#: Cells (k, v, y, x) and regions (g): sides with their cell on the right, the side that follows each, and the ring from each topmost, then leftmost corner.
_RINGS = """
    side as (select r.k, r.v, r.g, d, y + (d in (2, 3))::int sy, x + (d in (1, 2))::int sx, y + (d in (1, 2))::int ey, x + (d in (0, 1))::int ex
             from region r, (values (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1)) t(d, dy, dx)
             where not exists (select 1 from cell c where c.k = r.k and c.v = r.v and c.y = r.y + dy and c.x = r.x + dx)),
    nxt as (select s.*, t.sy ny, t.sx nx, t.d nd from side s join side t on t.k = s.k and t.v = s.v and t.sy = s.ey and t.sx = s.ex and (t.d - s.d + 4) % 4 <> 2
            qualify row_number() over (partition by s.k, s.v, s.sy, s.sx, s.d order by case (t.d - s.d + 4) % 4 when 1 then 0 when 0 then 1 else 2 end) = 1),
    walk(k, v, g, y0, x0, d0, i, sy, sx, d, pd) as (
        select k, v, g, sy, sx, d, 0, sy, sx, d, -1 from nxt where d in (0, 1)
        union all
        select w.k, w.v, w.g, y0, x0, d0, i + 1, n.ny, n.nx, n.nd, w.d from walk w join nxt n on n.k = w.k and n.v = w.v and n.sy = w.sy and n.sx = w.sx and n.d = w.d
        where (w.i = 0 or (w.sy, w.sx, w.d) <> (y0, x0, d0)) and (n.ny, n.nx) >= (y0, x0)),
    round as (select k, v, g, y0, x0, d0, max(i) as n, max(pd) filter (where i > 0 and (sy, sx, d) = (y0, x0, d0)) as came from walk group by all having count(*) filter (where i > 0 and (sy, sx, d) = (y0, x0, d0)) = 1),
    ring as (select *, row_number() over (partition by k, v, g order by d0, y0, x0) - 1 as ring from round where came <> d0),
    corner as (select r.k, r.v, r.g, ring, row_number() over (partition by r.k, r.v, r.g, ring order by i) - 1 as corner, sy, sx
               from ring r join walk w on w.k = r.k and w.v = r.v and w.y0 = r.y0 and w.x0 = r.x0 and w.d0 = r.d0 and w.i < r.n where w.i = 0 or w.pd <> w.d)"""
_POINTS = "(g // 100000)::int first_y, (g % 100000)::int first_x, ring::int ring, corner::int corner, sy::double y, sx::double x from corner"

_SHAPES = ", ".join(f"({n}, {r}, {i}, {x}, {y})" for n, shape in enumerate(A.ODD_SHAPES) for r, ring in enumerate(shape) for i, (x, y) in enumerate(p for k, p in enumerate(ring) if not k or p != ring[k - 1]))
#: Every side with every other one of its polygon, and every corner with every other ring.
_PROBLEMS = f"""with pts as (select o_orderkey f, r, i, x + (o_custkey % 500) * 1000 x, y + o_custkey % 7 - 3 y from orders join (values {_SHAPES}) v(n, r, i, x, y) on n = o_orderkey % {len(A.ODD_SHAPES)}),
    side as (select *, max(i) over (partition by f, r) m from (select f, r, i, x ax, y ay, lead(x) over w bx, lead(y) over w as "by" from pts window w as (partition by f, r order by i)) where bx is not null),
    met as (select p.f, p.r pr, q.r qr, p.r = q.r and (q.i - p.i = 1 or (p.i = 0 and q.i = p.m)) as near,
        sign((p.bx - p.ax) * (q.ay - p.ay) - (p.by - p.ay) * (q.ax - p.ax)) oa, sign((p.bx - p.ax) * (q.by - p.ay) - (p.by - p.ay) * (q.bx - p.ax)) ob,
        sign((q.bx - q.ax) * (p.ay - q.ay) - (q.by - q.ay) * (p.ax - q.ax)) oc, sign((q.bx - q.ax) * (p.by - q.ay) - (q.by - q.ay) * (p.bx - q.ax)) od,
        {', '.join(f"case when {s}.{e}x between least({t}.ax, {t}.bx) and greatest({t}.ax, {t}.bx) and {s}.{e}y between least({t}.ay, {t}.by) and greatest({t}.ay, {t}.by) then {{'x': {s}.{e}x, 'y': {s}.{e}y}} end {s}{e}" for s, t in ('qp', 'pq') for e in 'ab')}
        from side p join side q on p.f = q.f and (p.r, p.i) < (q.r, q.i)),
    on_ as (select *, list_distinct(list_filter([case when oa = 0 then qa end, case when ob = 0 then qb end, case when oc = 0 then pa end, case when od = 0 then pb end], lambda t: t is not null)) spots, oa * ob < 0 and oc * od < 0 as cut from met),
    touch as (select distinct f, pr, qr, spots[1] spot from on_ where pr <> qr and len(spots) = 1),
    free as (select p.*, exists (select 1 from touch t where t.f = p.f and p.r in (t.pr, t.qr) and (t.spot.x, t.spot.y) = (p.x, p.y)) as held from pts p),
    within as (select p.f, p.r, p.i, p.y, p.x, s.r as ring, count(*) filter (where (s.ay <= p.y) <> (s.by <= p.y) and sign((s.bx - s.ax) * (p.y - s.ay) - (s.by - s.ay) * (p.x - s.ax)) = case when s.by > s.ay then 1 else -1 end) % 2 = 1 as inn
        from free p join side s on s.f = p.f and s.r <> p.r where not held group by all),
    bad as (select f, 'open_ring' problem from pts group by f, r having arg_min(x, i) <> arg_max(x, i) or arg_min(y, i) <> arg_max(y, i)
        union select f, 'few_points' from pts group by f, r having count(distinct (x, y)) < 3
        union select f, case when near then 'spike' when pr = qr then 'self_contact' else 'rings_cross' end from on_ where case when near then len(spots) > 1 when pr = qr then cut or len(spots) > 0 else cut or len(spots) > 1 end
        union select f, 'rings_cross' from within group by f, r, ring having bool_or(inn) and not bool_and(inn)
        union select f, 'hole_outside' from within where ring = 0 group by f, r having not arg_min(inn, (y, x))
        union select f, 'nested_holes' from within where ring > 0 and r > 0 group by f, r, ring having arg_min(inn, (y, x))
        union select f, 'inside_apart' from touch group by f, pr, qr having count(distinct spot) > 1)
    select o_orderkey feature_id, count(problem) = 0 as valid, coalesce(string_agg(distinct problem, ',' order by problem), '') problems from orders left join bad on f = o_orderkey group by 1"""

ORACLE_SQL = {
    "polygon_problems": _PROBLEMS,
    "whole_cover": f"with recursive {B.COVER}, cell as (select distinct 5 k, y // 32 y, x // 32 x, 1 v from cov), {P._REACH}, {_RINGS} select k z, {_POINTS}",
    "whole_footprints": f"with recursive {R._CANVAS}, cell as (select raster_name k, y, x, 1 v from cv where value <> 2), {P._REACH}, {_RINGS} select k raster_name, {_POINTS}",
    "whole_segments": f"""with recursive {R._CANVAS}, cell as (select raster_name k, y, x, value v from cv where value <> 0), {P._REACH}, {_RINGS}
        select k raster_name, v as value, (g // 100000)::int first_y, (g % 100000)::int first_x, max(ring)::int holes, count(*)::int corners from corner group by k, v, g""",
}
