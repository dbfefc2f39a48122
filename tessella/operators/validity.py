"""Whether polygons are valid: simple closed rings, holes within their shell, one connected inside.

Points are put on a grid of 1 / scale and all tests on it are exact (whole
numbers, decimal ones where they are large). Polygons of few sides are judged
in their own row, where each side meets those after it. Sides of larger ones
meet other sides of their polygon by the cells of grids that fit their length,
so a long ring costs in proportion to its sides and to the pairs whose boxes
meet.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.graphs import components
from tessella.functions.stages import staged
from tessella.operators.spatial import sized_overlap_join
from tessella.operators.tiling import dealt

#: What can be wrong, as `polygon_validity` names it.
PROBLEMS = ("empty", "open_ring", "few_points", "self_contact", "spike", "rings_cross", "hole_outside", "nested_holes", "inside_apart")
#: Whole coordinates have 17 digits at most, so that products of differences fit a decimal number of 38.
_WHOLE, _SHORT = "bigint", 1 << 30
#: Polygons of at most so many sides are judged row by row.
FEW = 64
_SIDE = "struct<ring:int,side:int,sides:int,ax:bigint,ay:bigint,bx:bigint,by:bigint>"


def _turn(ax, ay, bx, by) -> Column:
    """1, 0 or -1: to which side the direction b lies of a, in long integers where products fit them, else in decimal numbers."""
    fits = F.greatest(*[F.abs(v) for v in (ax, ay, bx, by)]) < _SHORT
    wide = [v.cast("decimal(18,0)") for v in (ax, ay, bx, by)]
    return F.when(fits, F.signum(ax * by - ay * bx)).otherwise(F.signum(wide[0] * wide[3] - wide[1] * wide[2])).cast("int")


def _once(**columns: Column) -> Column:
    """Columns that are made once, however often they are used."""
    return F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))


def _orientation(ax, ay, bx, by, cx, cy) -> Column:
    """1, 0 or -1: on which side of the line from a to b the point c lies."""
    return _turn(bx - ax, by - ay, cx - ax, cy - ay)


def _on_grid(rings: str, scale: float) -> Column:
    """Rings as arrays of whole points, a point that repeats the one before it left out; the closing point is kept."""
    whole = lambda v: F.round(v * scale).cast(_WHOLE)
    points = lambda ring: F.transform(ring, lambda p: F.struct(whole(p["x"]).alias("x"), whole(p["y"]).alias("y")))
    kept = lambda ring: F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
    return F.transform(F.transform(rings, points), kept)


def _sides_of() -> Column:
    """The sides of all whole rings (column _whole) in an array, numbered; sides: their number in the ring."""
    side = lambda r, i: lambda j: F.struct(
        i.cast("int").alias("ring"), j.cast("int").alias("side"), (F.size(r) - 1).alias("sides"),
        F.get(r, j)["x"].alias("ax"), F.get(r, j)["y"].alias("ay"), F.get(r, j + 1)["x"].alias("bx"), F.get(r, j + 1)["y"].alias("by"),
    )
    none = F.array().cast(f"array<{_SIDE}>")
    return F.coalesce(F.flatten(F.transform("_whole", lambda r, i: F.when(F.size(r) > 1, F.transform(F.sequence(F.lit(0), F.size(r) - 2), side(r, i))).otherwise(none))), none)


def ring_sides(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ring, side, sides, ax, ay, bx, by: the sides of all whole rings (column _whole) as rows."""
    return features.select(*keys, F.inline(_sides_of()))


def _met_by_grids(sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, p_ and q_ columns of the pairs of sides whose boxes meet, p before q."""
    boxed = lambda p: sides.select(
        *keys, *[F.least(f"a{c}", f"b{c}").cast("double").alias(f"{c}0") for c in "xy"], *[F.greatest(f"a{c}", f"b{c}").cast("double").alias(f"{c}1") for c in "xy"],
        *[F.col(c).alias(f"{p}_{c}") for c in ("ring", "side", "sides", "ax", "ay", "bx", "by")],
    )
    c = F.col
    first = (c("p_ring") < c("q_ring")) | ((c("p_ring") == c("q_ring")) & (c("p_side") < c("q_side")))
    return sized_overlap_join(boxed("p"), boxed("q"), keys, 1024.0).where(first)


def _met_in_rows(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As _met_by_grids, from the array _sides of each row."""
    names = ("ring", "side", "sides", "ax", "ay", "bx", "by")
    one = features.select(*keys, "_sides", F.posexplode("_sides").alias("_i", "_p"))
    two = one.select(*keys, "_p", F.explode(F.slice("_sides", F.col("_i") + 2, F.size("_sides"))).alias("_q"))
    low, high = (lambda s, c: F.least(f"{s}_a{c}", f"{s}_b{c}")), (lambda s, c: F.greatest(f"{s}_a{c}", f"{s}_b{c}"))
    met = two.select(*keys, *[F.col(f"_{s}.{n}").alias(f"{s}_{n}") for s in "pq" for n in names])
    for c in "xy":
        met = met.where((low("p", c) <= high("q", c)) & (low("q", c) <= high("p", c)))
    return met


def _contacts(met: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, the rings of two sides that meet (p_ring <= q_ring), how (kind) and, if at one point of two rings, where (x, y)."""
    c = F.col
    p, q = ([c(f"{s}_{k}") for k in ("ax", "ay", "bx", "by")] for s in "pq")
    o = {"a": _orientation(*p, *q[:2]), "b": _orientation(*p, *q[2:]), "c": _orientation(*q, *p[:2]), "d": _orientation(*q, *p[2:])}
    # Generated columns: as plain ones, the planner would write them out anew wherever they are used, and again in what it infers from filters.
    met = met.select("*", _once(**{f"o_{k}": v for k, v in o.items()}))
    within = lambda s, x, y: x.between(F.least(s[0], s[2]), F.greatest(s[0], s[2])) & y.between(F.least(s[1], s[3]), F.greatest(s[1], s[3]))
    ends = {"a": (p, q[0], q[1]), "b": (p, q[2], q[3]), "c": (q, p[0], p[1]), "d": (q, p[2], p[3])}
    touch = {k: (c(f"o_{k}") == 0) & within(*v) for k, v in ends.items()}
    # The ends that lie on the other side; two different ones mean that sides on one line overlap.
    points = F.array_distinct(F.filter(F.array(*[F.when(touch[k], F.struct(x.alias("x"), y.alias("y"))) for k, (_, x, y) in ends.items()]), lambda t: t.isNotNull()))
    crosses = (c("o_a") * c("o_b") < 0) & (c("o_c") * c("o_d") < 0)
    next_ = (c("p_ring") == c("q_ring")) & ((c("q_side") - c("p_side") == 1) | ((c("p_side") == 0) & (c("q_side") == c("p_sides") - 1)))
    n = F.size("_points")
    kind = (
        F.when(next_, F.when(n > 1, "spike"))
        .when(c("p_ring") == c("q_ring"), F.when(crosses | (n > 0), "self_contact"))
        .when(crosses | (n > 1), "rings_cross")
        .when(n == 1, "touch")
    )
    found = met.select(*keys, "p_ring", "q_ring", *[f"{s}_side" for s in "pq"], "p_sides", *[f"o_{k}" for k in "abcd"], _once(_points=points)).select(*keys, "p_ring", "q_ring", "_points", _once(kind=kind)).where("kind is not null")
    return found.select(*keys, "p_ring", "q_ring", "kind", F.get("_points", F.lit(0))["x"].alias("x"), F.get("_points", F.lit(0))["y"].alias("y"))


def _at_spot(s: Callable[[str], Column], x: Column, y: Column) -> Column:
    """The side s goes through the point, or ends there."""
    ends = ((s("ax") == x) & (s("ay") == y)) | ((s("bx") == x) & (s("by") == y))
    between = x.between(F.least(s("ax"), s("bx")), F.greatest(s("ax"), s("bx"))) & y.between(F.least(s("ay"), s("by")), F.greatest(s("ay"), s("by")))
    return ends | (between & (_orientation(s("ax"), s("ay"), s("bx"), s("by"), x, y) == 0))


def _spot_sides(touches: DataFrame, sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, x, y, ring, ax, ay, bx, by: the sides of touching rings at the points where they touch."""
    spots = touches.select(*keys, "x", "y", F.explode(F.array("p_ring", "q_ring")).alias("ring")).distinct()
    return sides.join(spots, [*keys, "ring"]).where(_at_spot(F.col, F.col("x"), F.col("y"))).select(*keys, "x", "y", "ring", "ax", "ay", "bx", "by")


def _spot_sides_in_rows(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As _spot_sides, from the arrays _sides and _touches of each row."""
    spot = lambda r: F.transform("_touches", lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), t[r].alias("ring")))
    each = judged.where("size(_touches) > 0").select(*keys, "_sides", F.explode(F.array_union(spot("p_ring"), spot("q_ring"))).alias("_t"))
    here = F.filter("_sides", lambda s: (s["ring"] == F.col("_t.ring")) & _at_spot(lambda k: s[k], F.col("_t.x"), F.col("_t.y")))
    return each.select(*keys, "_t.x", "_t.y", F.inline(here)).select(*keys, "x", "y", "ring", "ax", "ay", "bx", "by")


def _crossing_rings(spot_sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys of polygons with rings that change sides at points where they touch, or that meet there along both ways round.

    At a point that two rings have in common each of them has two directions;
    they cross if one direction of the second lies on each side of the first.
    """
    c, at = F.col, [*keys, "x", "y"]
    ray = lambda x, y, ring: F.struct((c(x) - c("x")).alias("dx"), (c(y) - c("y")).alias("dy")).alias(ring)
    rays = spot_sides.select(*at, "ring", F.explode(F.array(ray("ax", "ay", "d"), ray("bx", "by", "d"))).alias("d")).where("d.dx <> 0 or d.dy <> 0")
    two = rays.groupBy(*at, "ring").agg(F.collect_list("d").alias("d")).where("size(d) = 2")
    held = two.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("ring", "d"))).alias("_r")).where("size(_r) > 1")
    one = held.select(*keys, "_r", F.posexplode("_r").alias("_i", "_p"))
    pair = one.select(*keys, "_p", F.explode(F.slice("_r", c("_i") + 2, F.size("_r"))).alias("_q"))
    both = pair.select(*keys, c("_p.d").alias("p_d"), c("_q.d").alias("q_d"))

    def cross(a: Column, b: Column) -> Column:
        return _turn(a["dx"], a["dy"], b["dx"], b["dy"])

    def between(d: Column, a: Column, b: Column) -> Column:
        """d lies on the way from a to b, turning left."""
        convex = (cross(a, d) > 0) & (cross(d, b) > 0)
        reflex = (cross(a, d) > 0) | (cross(d, b) > 0)
        straight = (cross(a, b) > 0) | ((cross(a, b) == 0) & (_turn(a["dx"], a["dy"], -b["dy"], b["dx"]) > 0))
        return F.when(straight, convex).otherwise(reflex)

    a, b = F.get("p_d", F.lit(0)), F.get("p_d", F.lit(1))
    sides_of = [between(F.get("q_d", F.lit(i)), a, b) for i in (0, 1)]
    return both.where(sides_of[0] != sides_of[1]).select(*keys).distinct()


def _inside(sides: DataFrame, touches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ring, within: the rings that one point of each ring, which touches no other, lies in."""
    c = F.col
    spots = touches.select(*keys, F.explode(F.array("p_ring", "q_ring")).alias("ring"), c("x").alias("ax"), c("y").alias("ay")).distinct()
    free = sides.select(*keys, "ring", "ax", "ay").join(spots, [*keys, "ring", "ax", "ay"], "left_anti")
    point = free.groupBy(*keys, "ring").agg(F.min(F.struct("ay", "ax")).alias("_p")).select(*keys, "ring", c("_p.ax").alias("px"), c("_p.ay").alias("py"))
    # A ray to the right: a point meets the sides over its height, in one dimension.
    level = lambda y: c(y).cast("double")
    zero = F.lit(0.0)
    rays = point.select(*keys, zero.alias("x0"), zero.alias("x1"), level("py").alias("y0"), level("py").alias("y1"), "ring", "px", "py")
    spans = sides.where("ay <> by").select(*keys, zero.alias("x0"), zero.alias("x1"), F.least(level("ay"), level("by")).alias("y0"), F.greatest(level("ay"), level("by")).alias("y1"), c("ring").alias("within"), "ax", "ay", "bx", "by")
    met = sized_overlap_join(rays, spans, keys, 1024.0).where("ring <> within and (ay <= py) <> (by <= py)")
    right = _orientation(c("ax"), c("ay"), c("bx"), c("by"), c("px"), c("py")) == F.when(c("by") > c("ay"), 1).otherwise(-1)
    return met.where(right).groupBy(*keys, "ring", "within").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select(*keys, "ring", "within")


def _inside_in_rows() -> Column:
    """Of _whole, _sides and _touches of a row: an array of ring, shell, hole for each ring; the ring lies in the shell, in a hole other than itself."""
    touched = lambda s: F.exists("_touches", lambda t: ((t["p_ring"] == s["ring"]) | (t["q_ring"] == s["ring"])) & (t["x"] == s["ax"]) & (t["y"] == s["ay"]))
    start = lambda s: F.struct(s["ay"].alias("y"), s["ax"].alias("x"))
    points = F.transform(F.sequence(F.lit(0), F.size("_whole") - 1), lambda r: F.struct(r.alias("ring"), F.array_min(F.transform(F.filter("_sides", lambda s: (s["ring"] == r) & ~touched(s)), start)).alias("p")))

    def odd(r: Column, within: Column) -> Column:
        x, y = r["p"]["x"], r["p"]["y"]
        right = lambda s: _orientation(s["ax"], s["ay"], s["bx"], s["by"], x, y) == F.when(s["by"] > s["ay"], 1).otherwise(-1)
        return F.size(F.filter("_sides", lambda s: (s["ring"] == within) & ((s["ay"] <= y) != (s["by"] <= y)) & right(s))) % 2 == 1

    some = lambda test: F.coalesce(test, F.lit(False))
    others = F.sequence(F.lit(0), F.size("_whole") - 1)
    held = lambda r: F.struct(
        r["ring"].alias("ring"), some(r["p"].isNotNull() & odd(r, F.lit(0))).alias("shell"),
        some(r["p"].isNotNull() & F.exists(others, lambda k: (k > 0) & (k != r["ring"]) & odd(r, k))).alias("hole"),
    )
    return F.transform(F.filter(points, lambda r: r["ring"] > 0), held)


def _apart(touches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys of polygons whose rings touch in a cycle of rings and points, so that the inside falls apart."""
    ring = lambda r: F.struct(*keys, F.col(r).cast(_WHOLE).alias("x"), F.lit(None).cast(_WHOLE).alias("y"))
    spot = F.struct(*keys, "x", "y")
    ends = touches.select(*keys, F.explode(F.array(ring("p_ring"), ring("q_ring"))).alias("u"), spot.alias("v")).distinct()
    ends = staged(ends, narrow=True)
    parts = components(ends.select("u", "v"))
    nodes = parts.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))
    edges = ends.join(parts, F.col("u") == F.col("node")).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("edges"))
    return edges.join(nodes.withColumnRenamed("label", "_label"), F.col("label") == F.col("_label")).where("edges >= nodes").select(*keys).distinct()


def polygon_validity(features: DataFrame, keys: Sequence[str], rings: str = "rings", scale: float = 1e6) -> DataFrame:
    """keys, valid, problems (those of PROBLEMS, sorted) for every row of features; keys name a row.

    Rings are closed and have three different points at least. A ring meets
    itself nowhere (self_contact), and does not turn back on itself (spike).
    Two rings may touch at single points, but neither cross nor run along each
    other (rings_cross). Holes lie within the shell (hole_outside) and not in
    each other (nested_holes). Rings that touch in a cycle leave no connected
    inside (inside_apart). A null or empty polygon is empty. Coordinates are
    rounded to 1 / scale; a million units with the default scale are well
    within reach.
    """
    whole = staged(dealt(features, *keys).select(*keys, _on_grid(rings, scale).alias("_whole"))).withColumn("_sides", _sides_of())
    sides = F.coalesce(F.aggregate("_whole", F.lit(0), lambda n, r: n + F.greatest(F.coalesce(F.size(r), F.lit(0)) - 1, F.lit(0))), F.lit(0))
    short = lambda r: F.size(F.array_distinct(r)) < 3
    open_ = lambda r: F.element_at(r, 1) != F.element_at(r, -1)
    some = lambda test: F.exists("_whole", lambda r: (F.size(r) > 0) & test(r))
    nothing = F.col("_whole").isNull() | (F.size("_whole") == 0) | F.exists("_whole", lambda r: r.isNull() | (F.size(r) == 0))
    by_form = F.array(F.when(nothing, "empty"), F.when(some(open_), "open_ring"), F.when(some(short), "few_points"))
    few = _judged_in_rows(whole.where(sides <= FEW), by_form, keys)
    many = staged(whole.where(sides > FEW))
    out = few if many.isEmpty() else few.unionByName(_judged_by_grids(many, by_form, keys))
    return out.select(*keys, (F.size("problems") == 0).alias("valid"), "problems")


def _judged_in_rows(whole: DataFrame, by_form: Column, keys: Sequence[str]) -> DataFrame:
    """keys, problems of polygons of few sides. Those that touch in longer cycles alone, or whose rings touch at all, leave their row."""
    c = F.col
    touch = F.when(c("kind") == "touch", F.struct("p_ring", "q_ring", "x", "y"))
    met = _contacts(_met_in_rows(whole, keys), keys).groupBy(*keys).agg(F.collect_set(F.when(c("kind") != "touch", c("kind"))).alias("_kinds"), F.collect_set(touch).alias("_touches"))
    held = whole.join(met.withColumn("_met", F.lit(True)), list(keys), "left")
    none = lambda k, t: F.when(c("_met"), c(k)).otherwise(F.array().cast(f"array<{t}>")).alias(k)
    judged = staged(held.select(*keys, "_whole", "_sides", none("_kinds", "string"), none("_touches", "struct<p_ring:int,q_ring:int,x:bigint,y:bigint>")))

    inside = F.when(F.size("_whole") > 1, _inside_in_rows())
    placed = judged.withColumn("_in", inside)
    by_place = F.array(F.when(F.exists("_in", lambda r: ~r["shell"]), "hole_outside"), F.when(F.exists("_in", lambda r: r["hole"]), "nested_holes"))
    pairs = F.array_distinct(F.transform("_touches", lambda t: F.struct(t["p_ring"], t["q_ring"])))
    twice = F.size(pairs) < F.size("_touches")
    known = F.concat(F.filter(F.concat(by_form, by_place, F.array(F.when(twice, "inside_apart"))), lambda p: p.isNotNull()), "_kinds")

    crossing = _crossing_rings(_spot_sides_in_rows(judged, keys), keys).withColumn("problem", F.lit("rings_cross"))
    # Two rings that touch twice are a cycle; any other has three rings and two points at least.
    ends = [F.col("_touches")[k] for k in ("p_ring", "q_ring")]
    spots = F.array_distinct(F.transform("_touches", lambda t: F.struct(t["x"], t["y"])))
    longer = staged(judged.where(~twice & (F.size(F.array_union(*ends)) > 2) & (F.size(spots) > 1)).select(*keys, F.inline("_touches")), narrow=True)
    more = crossing if longer.isEmpty() else crossing.unionByName(_apart(longer, keys).withColumn("problem", F.lit("inside_apart")))
    more = more.groupBy(*keys).agg(F.collect_set("problem").alias("_more"))
    both = placed.select(*keys, known.alias("_known")).join(more, list(keys), "left")
    return both.select(*keys, F.array_sort(F.array_union("_known", F.coalesce("_more", F.array().cast("array<string>")))).alias("problems"))


def _judged_by_grids(whole: DataFrame, by_form: Column, keys: Sequence[str]) -> DataFrame:
    """keys, problems of polygons of many sides, whose sides are rows."""
    formed = whole.select(*keys, F.explode(F.filter(by_form, lambda p: p.isNotNull())).alias("problem"))
    sides = staged(ring_sides(whole, keys))
    contacts = staged(_contacts(_met_by_grids(sides, keys), keys))
    touches = contacts.where("kind = 'touch'")
    crossing = _crossing_rings(_spot_sides(touches, sides, keys), keys).select(*keys, F.lit("rings_cross").alias("problem"))
    crossed = contacts.where("kind <> 'touch'").select(*keys, F.col("kind").alias("problem"))
    inside = staged(_inside(sides, touches, keys), narrow=True)
    nested = inside.where("ring > 0 and within > 0").select(*keys, F.lit("nested_holes").alias("problem"))
    holes = whole.select(*keys, F.explode(F.filter(F.sequence(F.lit(0), F.greatest(F.size("_whole") - 1, F.lit(0))), lambda i: i > 0)).alias("ring"))
    outside = holes.join(inside.where("within = 0"), [*keys, "ring"], "left_anti").select(*keys, F.lit("hole_outside").alias("problem"))
    apart = _apart(touches, keys).select(*keys, F.lit("inside_apart").alias("problem"))
    every = formed
    for more in (crossed, crossing, nested, outside, apart):
        every = every.unionByName(more)
    listed = every.groupBy(*keys).agg(F.array_sort(F.collect_set("problem")).alias("problems"))
    none = F.array().cast("array<string>")
    return whole.select(*keys).join(listed, list(keys), "left").select(*keys, F.coalesce("problems", none).alias("problems"))
