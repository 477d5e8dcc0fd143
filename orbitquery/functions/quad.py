"""Four-cornered polygons and boxes as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]
#: Gates of the router: below the first is rejected, above the second accepted.
CANDIDATE, ACCEPTED = 0.4, 0.9


def shoelace(points: Sequence[Point]) -> Column:
    total = None
    for (x0, y0), (x1, y1) in zip(points, [*points[1:], points[0]], strict=True):
        term = x0 * y1 - x1 * y0
        total = term if total is None else total + term
    return F.abs(total) / 2.0


def bounds(points: Sequence[Point]) -> list[Column]:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def _side(a: Point, b: Point, p: Point) -> Column:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _cross(a: Point, b: Point, c: Point, d: Point) -> Column:
    return (_side(a, b, c) * _side(a, b, d) < 0) & (_side(c, d, a) * _side(c, d, b) < 0)


def is_simple(points: Sequence[Point]) -> Column:
    """False for bow-ties: one of the two pairs of opposite edges crosses."""
    a, b, c, d = points
    return ~(_cross(a, b, c, d) | _cross(b, c, d, a))


def rectangularity(points: Sequence[Point]) -> Column:
    """Area over the area of the bounding box."""
    x0, y0, x1, y1 = bounds(points)
    return shoelace(points) / ((x1 - x0) * (y1 - y0) + 1e-10)


def box_intersection(a: Sequence[Column], b: Sequence[Column]) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_area(a: Sequence[Column]) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def box_iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    shared = box_intersection(a, b)
    return shared / (box_area(a) + box_area(b) - shared + 1e-10)


def overlaps(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Closed boxes: touching counts."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def route(score: Column) -> Column:
    return F.when(score > ACCEPTED, "accepted").when(score > CANDIDATE, "candidate").otherwise("rejected")


def ring_of(points: Sequence[Point]) -> Column:
    """Corners as an array of (x, y)."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signed_area(ring: Column) -> Column:
    """Area of an open ring of any length, positive if it turns from x to y; 0 for fewer than three points."""

    def area(r: Column) -> Column:
        def add(total: Column, k: Column) -> Column:
            a, b = F.get(r, k), F.get(r, (k + 1) % F.size(r))
            return total + a["x"] * b["y"] - b["x"] * a["y"]

        return F.when(F.size(r) > 2, F.aggregate(F.sequence(F.lit(0), F.size(r) - 1), F.lit(0.0), add) / 2.0).otherwise(0.0)

    return _let(ring, area)


def non_empty(ring: Column) -> Column:
    """True for a ring that encloses something; null rings are empty."""
    return F.coalesce(F.abs(signed_area(ring)) > 0, F.lit(False))


_RING = "array<struct<x:double,y:double>>"


def clipped(subject: Column, window: Column) -> Column:
    """The part of an open ring that lies in a convex one: cut along each of the window's edges in turn.

    Touching counts as inside.  A result without area may have points left.
    """
    none = F.array().cast(_RING)

    def cut(ring: Column, edge: Column) -> Column:
        """The points on the inner side of an edge (ax, ay, dx, dy), and where the ring crosses it."""

        def side(p: Column) -> Column:
            return edge["dx"] * (p["y"] - edge["ay"]) - edge["dy"] * (p["x"] - edge["ax"])

        def kept(s: Column) -> Column:
            here, before, now, last = (s[c] for c in ("here", "before", "now", "last"))
            share = last / F.nullif(last - now, F.lit(0.0))
            crossing = F.struct((before["x"] + share * (here["x"] - before["x"])).alias("x"), (before["y"] + share * (here["y"] - before["y"])).alias("y"))
            crossed = F.when((now < 0) != (last < 0), F.array(crossing)).otherwise(none)
            return F.concat(crossed, F.when(now >= 0, F.array(here)).otherwise(none))

        behind = F.concat(F.slice(ring, F.size(ring), F.lit(1)), F.slice(ring, F.lit(1), F.size(ring) - 1))
        steps = F.zip_with(ring, behind, lambda p, q: F.struct(p.alias("here"), q.alias("before"), side(p).alias("now"), side(q).alias("last")))
        return F.when(F.size(ring) > 0, F.flatten(F.transform(steps, kept))).otherwise(none)

    def edges(w: Column) -> Column:
        def edge(turn: Column) -> Column:
            def of(a: Column, k: Column) -> Column:
                b = F.get(w, (k + 1) % F.size(w))
                return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), (turn * (b["x"] - a["x"])).alias("dx"), (turn * (b["y"] - a["y"])).alias("dy"))

            return F.transform(w, of)

        return _let(F.signum(signed_area(w)), edge)

    return F.aggregate(_let(window, edges), subject.cast(_RING), cut)


def polygon_iou(a: Column, b: Column) -> Column:
    """Shared over united area of two rings, the second convex."""
    sizes = F.struct(F.abs(signed_area(clipped(a, b))).alias("shared"), (F.abs(signed_area(a)) + F.abs(signed_area(b))).alias("both"))
    return _let(sizes, lambda s: s["shared"] / (s["both"] - s["shared"] + 1e-10))
