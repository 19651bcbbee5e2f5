"""Geometry measures and predicates as columns.

A ring is array<struct<x,y>> without a repeated last corner; a box is x0, y0, x1, y1.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from hotspark.functions import kernels


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    def p(a, b):
        return F.struct(a.alias("x"), b.alias("y"))

    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it, also for each element of an array."""
    return F.transform(F.array(value), body)[0]


def _next(ring: Column) -> Column:
    """The ring moved on by one corner."""
    return F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))


def _sides(ring: Column, f) -> Column:
    return _let(ring, lambda r: F.zip_with(r, _next(r), f))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _from_first(ring: Column) -> Column:
    """Corners relative to the first one, so products stay small and exact."""
    return _let(ring, lambda r: _let(r[0], lambda o: F.transform(r, lambda p: F.struct((p.x - o.x).alias("x"), (p.y - o.y).alias("y")))))


def signed_area(ring: Column) -> Column:
    return _sum(_sides(_from_first(ring), lambda p, q: p.x * q.y - q.x * p.y)) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def length(ring: Column) -> Column:
    return _sum(_sides(ring, lambda p, q: F.sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))))


def centroid(ring: Column) -> Column:
    def sums(rel: Column) -> Column:
        cx = _sum(_sides(rel, lambda p, q: (p.x + q.x) * (p.x * q.y - q.x * p.y)))
        cy = _sum(_sides(rel, lambda p, q: (p.y + q.y) * (p.x * q.y - q.x * p.y)))
        a6 = _sum(_sides(rel, lambda p, q: p.x * q.y - q.x * p.y)) / 2 * 6
        return F.struct(cx.alias("x"), cy.alias("y"), a6.alias("a6"))

    def place(r: Column) -> Column:
        return _let(_let(_from_first(r), sums), lambda s: F.struct((r[0].x + s.x / s.a6).alias("x"), (r[0].y + s.y / s.a6).alias("y")))

    return _let(ring, place)


def bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")
    )


def side_distance(x: Column, y: Column, p: Column, q: Column) -> Column:
    def along(s: Column) -> Column:
        n2 = F.greatest(s.dx * s.dx + s.dy * s.dy, F.lit(1e-30))
        return _let(F.least(F.greatest((s.ax * s.dx + s.ay * s.dy) / n2, F.lit(0.0)), F.lit(1.0)), lambda t: away(s, t))

    def away(s: Column, t: Column) -> Column:
        return _let(F.struct((s.ax - t * s.dx).alias("x"), (s.ay - t * s.dy).alias("y")), lambda e: F.sqrt(e.x * e.x + e.y * e.y))

    parts = {"dx": q.x - p.x, "dy": q.y - p.y, "ax": x - p.x, "ay": y - p.y}
    return _let(F.struct(*(v.alias(n) for n, v in parts.items())), along)


def boundary_distance(x: Column, y: Column, ring: Column) -> Column:
    return F.array_min(_sides(ring, lambda p, q: side_distance(x, y, p, q)))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test; points on the boundary may fall either way."""
    hits = _sides(
        ring,
        lambda p, q: F.when(
            ((p.y <= y) != (q.y <= y)) & (x < p.x + (y - p.y) * (q.x - p.x) / F.when(q.y == p.y, None).otherwise(q.y - p.y)), 1
        ).otherwise(0),
    )
    return F.aggregate(hits, F.lit(0), lambda a, v: a + v) % 2 == 1


def contains_with_holes(ring: Column, holes: Column, x: Column, y: Column) -> Column:
    """Inside the outer ring and in none of the holes (array of rings)."""
    return contains(ring, x, y) & ~F.exists(holes, lambda h: contains(h, x, y))


def area_with_holes(ring: Column, holes: Column) -> Column:
    return area(ring) - F.aggregate(holes, F.lit(0.0), lambda s, h: s + area(h))


def covers(ring: Column, x: Column, y: Column) -> Column:
    return contains(ring, x, y) | (boundary_distance(x, y, ring) == 0)


def distance(ring: Column, x: Column, y: Column) -> Column:
    """0 inside, else distance to the boundary."""
    return F.when(contains(ring, x, y), F.lit(0.0)).otherwise(boundary_distance(x, y, ring))


def within_buffer(ring: Column, x: Column, y: Column, reach: float) -> Column:
    """The buffer test without building the buffer."""
    return distance(ring, x, y) <= reach


def mean_min_distance(a: Column, b: Column) -> Column:
    """Mean over the corners of a (closed ring) of the distance to the nearest corner of b."""
    def gap(p: Column, q: Column) -> Column:
        return _let(F.struct((p.x - q.x).alias("x"), (p.y - q.y).alias("y")), lambda e: F.sqrt(e.x * e.x + e.y * e.y))

    def near(a: Column, b: Column) -> Column:
        return F.transform(F.concat(a, F.slice(a, 1, 1)), lambda p: F.array_min(F.transform(b, lambda q: gap(p, q))))

    found = _let(a, lambda a: _let(b, lambda b: near(a, b)))
    return _let(found, lambda n: _sum(n) / F.size(n))


def densify(ring: Column, parts: int = 5) -> Column:
    steps = F.array(*[F.lit(i / parts) for i in range(parts)])
    return F.flatten(
        _sides(
            ring,
            lambda p, q: F.transform(
                steps, lambda f: F.struct((p.x + f * (q.x - p.x)).alias("x"), (p.y + f * (q.y - p.y)).alias("y"))
            ),
        )
    )


def stride(points: Column, limit: int) -> Column:
    """Every k-th vertex, at most `limit` of them: for display, never for a measure."""
    def thin(pts: Column) -> Column:
        return _let(F.ceil(F.size(pts) / F.lit(limit)).cast("int"), lambda step: F.filter(pts, lambda p, i: i % step == 0))

    # the points may be made by an expression, which would be worked out again for each of them
    return _let(points, thin)


def polygonal_parts(parts: Column) -> Column:
    """Of array<struct<kind, ring>>, keep the polygons."""
    return F.filter(parts, lambda p: p.kind == "Polygon")


def oriented(ring: Column) -> Column:
    """Counter-clockwise order."""
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


# --- boxes -----------------------------------------------------------------


def c(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}")


def box_area(s: str) -> Column:
    return (c(s, "x1") - c(s, "x0")) * (c(s, "y1") - c(s, "y0"))


def box_overlap(a: str, b: str) -> Column:
    w = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    h = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_distance(a: str, b: str) -> Column:
    gx = F.greatest(c(b, "x0") - c(a, "x1"), c(a, "x0") - c(b, "x1"), F.lit(0.0))
    gy = F.greatest(c(b, "y0") - c(a, "y1"), c(a, "y0") - c(b, "y1"), F.lit(0.0))
    return F.sqrt(gx * gx + gy * gy)


def box_center_distance(a: str, b: str) -> Column:
    dx = (c(a, "x0") + c(a, "x1") - c(b, "x0") - c(b, "x1")) / 2
    dy = (c(a, "y0") + c(a, "y1") - c(b, "y0") - c(b, "y1")) / 2
    return F.sqrt(dx * dx + dy * dy)


# --- exact overlap, Arrow batches -----------------------------


def _corners(value: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners (m, 2) of a column of arrays of rings, corners of each ring, and rings of each row."""
    rings = value.flatten()
    points = rings.flatten()
    xy = np.column_stack([points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy"])
    return xy, *(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for v in (rings, value))


def _segments_of(xy: np.ndarray, corners: np.ndarray, rings: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments (m, 4) around the rows' base points, and the row of each; rings of less than three corners have none."""
    ends = np.cumsum(corners)
    nxt = np.arange(1, len(xy) + 1)
    nxt[ends[corners > 0] - 1] = (ends - corners)[corners > 0]
    row = np.repeat(np.repeat(np.arange(len(rings)), rings), corners)
    near = xy - base[row]
    kept = np.repeat(corners >= 3, corners)
    return np.hstack([near, near[nxt]])[kept], row[kept]


@F.arrow_udf(T.DoubleType())
def overlap_area(a: pa.Array, b: pa.Array) -> pa.Array:
    """Common area of two polygons given as arrays of rings (holes by even-odd); all pairs of a batch together."""
    one, other = _corners(a), _corners(b)
    base = np.zeros((len(a), 2))
    begin = np.flatnonzero(one[2] > 0)
    ring = (np.cumsum(one[2]) - one[2])[begin]
    begin, ring = begin[one[1][ring] > 0], ring[one[1][ring] > 0]
    base[begin] = one[0][(np.cumsum(one[1]) - one[1])[ring]]
    return pa.array(kernels.overlap_areas(*_segments_of(*one, base), *_segments_of(*other, base), len(a)))


# --- hexagons on the projected plane --------------------------------------------


def hex_cell(x: Column, y: Column, edge: float) -> Column:
    """Axial id (q, r) of the pointy-top hexagon that holds the point."""
    q = (x * (math.sqrt(3) / 3) - y / 3) / edge
    r = y * (2 / 3) / edge
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    hq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    hr = F.when((dr >= dq) & (dr > ds), -rq - rs).otherwise(rr)
    return F.struct(hq.cast("long").alias("q"), hr.cast("long").alias("r"))


def hex_ring(cell: Column, edge: float) -> Column:
    cx = edge * math.sqrt(3) * (cell.q + cell.r / 2)
    cy = edge * 1.5 * cell.r
    corner = [(math.sin(k * math.pi / 3) * edge, math.cos(k * math.pi / 3) * edge) for k in range(6)]
    return F.array(*[F.struct((cx + a).alias("x"), (cy + b).alias("y")) for a, b in reversed(corner)])


# --- GeoJSON -----------------------------------------------------------------


def geojson_polygon(ring: Column, properties: Column, z: float | None = None, holes: Column | None = None) -> Column:
    """One GeoJSON Feature as text; rings are closed, the outer one counter-clockwise, holes the other way."""
    def closed(r: Column) -> Column:
        return F.concat(r, F.slice(r, 1, 1))

    point = (lambda p: F.array(p.x, p.y)) if z is None else (lambda p: F.array(p.x, p.y, F.lit(z)))
    rings = F.array(F.transform(closed(oriented(ring)), point))
    if holes is not None:
        rings = F.concat(rings, F.transform(holes, lambda h: F.transform(closed(F.reverse(oriented(h))), point)))
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            properties.alias("properties"),
            F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"),
        )
    )
