"""Polygons as array<array<double>> and boxes, as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import rings


def _xs(p: Column) -> Column:
    return F.transform(p, lambda q: F.element_at(q, 1))


def _ys(p: Column) -> Column:
    return F.transform(p, lambda q: F.element_at(q, 2))


def area(p: Column) -> Column:
    """Shoelace; 0 below three points."""
    n = F.size(p)
    rotated = F.concat(F.slice(p, F.lit(2), n), F.slice(p, 1, 1))
    cross = F.zip_with(p, rotated, lambda a, b: F.element_at(a, 1) * F.element_at(b, 2) - F.element_at(b, 1) * F.element_at(a, 2))
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2)


def box_xyxy(p: Column) -> Column:
    return F.array(F.array_min(_xs(p)), F.array_min(_ys(p)), F.array_max(_xs(p)), F.array_max(_ys(p)))


def box_xywh(p: Column) -> Column:
    return F.array(F.array_min(_xs(p)), F.array_min(_ys(p)), F.array_max(_xs(p)) - F.array_min(_xs(p)), F.array_max(_ys(p)) - F.array_min(_ys(p)))


def flat(p: Column) -> Column:
    return F.flatten(p)


def roi_valid(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Numeric, finite, 0 <= x1 < x2 <= width, 0 <= y1 < y2 <= height; anything else is false."""
    v = [c.try_cast("double") for c in (x1, y1, x2, y2, width, height)]
    finite = ~F.isnan(v[0])
    for c in v:
        finite = finite & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    a, b, c, d, w, h = v
    return F.coalesce(finite & (a >= 0) & (a < c) & (c <= w) & (b >= 0) & (b < d) & (d <= h), F.lit(False))


def clamped_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """Half-even rounding, clamped to the image, at least one pixel: left, top, right, bottom."""
    left = F.least(F.greatest(F.bround(x1).cast("int"), F.lit(0)), width - 1)
    top = F.least(F.greatest(F.bround(y1).cast("int"), F.lit(0)), height - 1)
    right = F.least(F.greatest(F.bround(x2).cast("int"), left + 1), width)
    bottom = F.least(F.greatest(F.bround(y2).cast("int"), top + 1), height)
    return [left, top, right, bottom]


def outer_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """Floor and ceiling, clamped; an empty box is null in all places."""
    left, top = F.greatest(F.floor(x1), F.lit(0)), F.greatest(F.floor(y1), F.lit(0))
    right, bottom = F.least(F.ceil(x2), width), F.least(F.ceil(y2), height)
    full = (right > left) & (bottom > top)
    return [F.when(full, c).cast("int") for c in (left, top, right, bottom)]


def shifted(p: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """The polygon in a box's coordinates, clamped to [0, w - 1] x [0, h - 1]."""
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), (n - 1).cast("double"))
    return F.transform(p, lambda q: F.array(clamp(F.element_at(q, 1) - left, width), clamp(F.element_at(q, 2) - top, height)))


def clipped_at(p: Column, axis: int, bound: Column, keep_above: bool) -> Column:
    """One step of clipping a polygon to a rectangle: against one edge, points inside stay and crossings are added."""
    n = F.size(p)
    before = F.concat(F.slice(p, n, F.lit(1)), F.slice(p, F.lit(1), n - 1))
    inside = (lambda q: F.element_at(q, axis) >= bound) if keep_above else (lambda q: F.element_at(q, axis) <= bound)

    def crossing(a, b):
        t = (bound - F.element_at(a, axis)) / (F.element_at(b, axis) - F.element_at(a, axis))
        other = F.element_at(a, 3 - axis) + t * (F.element_at(b, 3 - axis) - F.element_at(a, 3 - axis))
        return F.array(bound, other) if axis == 1 else F.array(other, bound)

    none = F.expr("cast(array() as array<array<double>>)")
    parts = F.zip_with(before, p, lambda a, b: F.when(inside(b), F.when(inside(a), F.array(b)).otherwise(F.array(crossing(a, b), b))).when(inside(a), F.array(crossing(a, b))).otherwise(none))
    return F.when(n > 0, F.flatten(parts)).otherwise(none)


def letterbox(width: Column, height: Column, size: int) -> dict[str, Column]:
    """Scale, new size and offsets of an image in a square of ``size``."""
    scale = F.least(F.lit(size) / width, F.lit(size) / height)
    new_w = F.greatest(F.lit(1), F.bround(width * scale).cast("int"))
    new_h = F.greatest(F.lit(1), F.bround(height * scale).cast("int"))
    half = lambda x: F.floor(x / 2).cast("int")
    return {"scale": scale, "new_width": new_w, "new_height": new_h, "left": half(F.lit(size) - new_w), "top": half(F.lit(size) - new_h)}


def _of_rings(returned: str, make, find):
    """A column function of polygons: ``find`` gives the values of many rings of as many points; null stays null."""

    def run(polygons: pa.Array) -> pa.Array:
        out, known = make(len(polygons)), np.zeros(len(polygons), dtype=bool)
        for rows, points in rings.rings(polygons):
            out[rows], known[rows] = find(points), True
        return pa.array(out, mask=~known)

    called = F.arrow_udf(run, returned)
    return lambda p: called(p.cast("array<array<double>>"))


def self_crossing(p: Column) -> Column:
    """Whether two edges without a common point cross each other. Edges that only touch don't count."""
    return _of_rings("boolean", lambda n: np.zeros(n, dtype=bool), rings.crossing)(p)


def without_repeats(p: Column) -> Column:
    """The ring without points that equal the one before, its last one being before its first."""
    n = F.size(p)
    return F.filter(p, lambda x, i: (x != F.element_at(p, F.when(i > 0, i).otherwise(n))) | ((n == 1) & (i == 0)))


def self_touching(p: Column) -> Column:
    """Whether a ring comes back to one of its own points without two edges crossing each other there: edges that aren't neighbours have
    a point in common, or an edge goes back over its neighbour."""
    return _of_rings("boolean", lambda n: np.zeros(n, dtype=bool), lambda q: rings.touching(q) & ~rings.crossing(q))(p)


def ring_kind(p: Column) -> Column:
    """``simple``, ``touching`` or ``crossing``; null under three points or without an extent."""
    kind = _of_rings("tinyint", lambda n: np.zeros(n, dtype=np.int8), rings.kinds)(p)
    return F.when(kind == 3, "crossing").when(kind == 2, "touching").when(kind == 1, "simple")


def originally_valid(p: Column) -> Column:
    """At least three points, an area, and edges that meet only their neighbours, at the ends they share."""
    return F.coalesce(_of_rings("boolean", lambda n: np.zeros(n, dtype=bool), lambda q: (rings.shoelace(q) > 0) & (rings.kinds(q) == 1))(p), F.lit(False))


def _edges(p: Column) -> Column:
    """Edges that aren't level."""
    n = F.size(p)
    own = F.zip_with(p, F.concat(F.slice(p, F.lit(2), n), F.slice(p, 1, 1)), lambda a, b: F.struct(F.element_at(a, 1).alias("x1"), F.element_at(a, 2).alias("y1"), F.element_at(b, 1).alias("x2"), F.element_at(b, 2).alias("y2")))
    return F.filter(own, lambda e: e["y1"] != e["y2"])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _crossing_heights(edges: Column) -> Column:
    """Heights at which two edges cross or touch."""

    def crossing(u, v):
        ux, uy, vx, vy = u["x2"] - u["x1"], u["y2"] - u["y1"], v["x2"] - v["x1"], v["y2"] - v["y1"]
        dx, dy, turn = v["x1"] - u["x1"], v["y1"] - u["y1"], ux * vy - uy * vx
        along, other = F.try_divide(dx * vy - dy * vx, turn), F.try_divide(dx * uy - dy * ux, turn)
        return F.when((along > 0) & (along < 1) & (other >= 0) & (other <= 1), u["y1"] + along * uy)

    return F.array_compact(F.flatten(F.transform(edges, lambda u: F.transform(edges, lambda v: crossing(u, v)))))


def _inside(edges: Column, y: Column) -> Column:
    """Spans of a scan line inside by the even-odd rule."""
    met = F.filter(edges, lambda e: (e["y1"] <= y) != (e["y2"] <= y))
    xs = F.array_sort(F.transform(met, lambda e: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
    return _let(xs, lambda xs: F.filter(F.transform(xs, lambda x, i: F.struct(x.alias("lo"), F.try_element_at(xs, i + 2).alias("hi"), (i % 2 == 0).alias("own"))), lambda s: s["own"]))


def common_area(a: Column, b: Column) -> Column:
    """Exact area inside both polygons, each by the even-odd rule; 0 where one has fewer than three points.

    Between two heights where corners or crossings lie, the common width is linear, so its middle gives the area."""

    def area_of(edges_a, edges_b):
        both = F.concat(edges_a, edges_b)
        ys = F.array_sort(F.array_distinct(F.flatten(F.array(F.transform(both, lambda e: e["y1"]), F.transform(both, lambda e: e["y2"]), _crossing_heights(both)))))
        slabs = _let(ys, lambda ys: F.filter(F.transform(ys, lambda y, i: F.struct(y.alias("y"), F.try_element_at(ys, i + 2).alias("z"))), lambda s: s["z"].isNotNull()))

        def width(y):
            met = lambda t, u, v: t + F.greatest(F.lit(0.0), F.least(u["hi"], v["hi"]) - F.greatest(u["lo"], v["lo"]))
            return _let(_inside(edges_b, y), lambda right: F.aggregate(_inside(edges_a, y), F.lit(0.0), lambda t, u: F.aggregate(right, t, lambda s, v: met(s, u, v))))

        return F.aggregate(slabs, F.lit(0.0), lambda t, s: t + (s["z"] - s["y"]) * width((s["y"] + s["z"]) / 2))

    found = _let(_edges(a), lambda edges_a: _let(_edges(b), lambda edges_b: area_of(edges_a, edges_b)))
    return F.when((F.size(a) >= 3) & (F.size(b) >= 3), F.coalesce(found, F.lit(0.0))).otherwise(0.0)


def repaired_area(p: Column) -> Column:
    """Area after repair of a ring that crosses or touches itself: what the even-odd rule takes for inside."""
    return _of_rings("double", np.zeros, rings.repaired)(p)
