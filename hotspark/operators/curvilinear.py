"""Curvilinear grids: cells between nodes, places within cells, power and values shared by area.

A grid is a table of nodes (i, j, x, y); cell (i, j) lies between the nodes (i, j),
(i + 1, j), (i + 1, j + 1) and (i, j + 1). Cells meet points and shapes by tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hotspark.functions import geom
from hotspark.operators import predicates as P
from hotspark.operators.overlay import SNAP, polygon_edges
from hotspark.operators.tiles import box_pairs, points_in_boxes
from hotspark.session import materialize, spread

#: The corners of a cell around its lower left node, in order.
AROUND = ((0, 0), (1, 0), (1, 1), (0, 1))
#: Shares of a cell that are no more than the rounding of places millions of metres from the origin.
NOISE = 1e-12
#: Metres by which the rounding of places far from the origin may move a bound.
HAIR = 1e-3


def cells(nodes: DataFrame, values: list[str] | None = None) -> DataFrame:
    """(i, j, ring, x0, y0, x1, y1, and for each value column an array of the four corners' values).

    A cell needs all four nodes with coordinates; of nodes told twice the one with the largest (x, y) counts.
    """
    values = values or []
    known = nodes.where("i is not null and j is not null and x is not null and y is not null")
    node = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *values)
    corner = F.explode(F.array(*[F.struct((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.lit(k).alias("k")) for k, (di, dj) in enumerate(AROUND)]))
    at = known.select(node.alias("n"), corner.alias("c")).select("c.i", "c.j", "c.k", "n")
    quads = at.groupBy("i", "j").agg(*(F.max(F.when(F.col("k") == k, F.col("n"))).alias(f"n{k}") for k in range(4))).dropna(subset=[f"n{k}" for k in range(4)])
    ring = F.array(*(F.struct(F.col(f"n{k}.x").alias("x"), F.col(f"n{k}.y").alias("y")) for k in range(4)))
    box = geom.bbox(F.col("ring"))
    return quads.withColumn("ring", ring).select(
        "i", "j", "ring", *(box[c].alias(c) for c in ("x0", "y0", "x1", "y1")), *(F.array(*(F.col(f"n{k}.{v}") for k in range(4))).alias(v) for v in values))


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once: long formulas that use their parts many times stay short."""
    return F.transform(F.array(value), body)[0]


def _place(ring: Column, x: Column, y: Column) -> Column:
    """Struct (u, v) of a point in a convex cell, by the inverse of the bilinear map of its corners; null where there is none."""
    a, b, c, d = (ring[k] for k in range(4))
    sides = {"ex": b.x - a.x, "ey": b.y - a.y, "fx": d.x - a.x, "fy": d.y - a.y, "gx": a.x - b.x + c.x - d.x, "gy": a.y - b.y + c.y - d.y, "hx": x - a.x, "hy": y - a.y}

    def cross(s: Column, p: str, q: str) -> Column:
        return s[p + "x"] * s[q + "y"] - s[p + "y"] * s[q + "x"]

    def factors(s: Column) -> Column:
        turn = F.signum(cross(s, "e", "f"))  # grids may be told clockwise
        k = {"k2": turn * cross(s, "g", "f"), "k1": turn * (cross(s, "e", "f") + cross(s, "h", "g")), "k0": turn * cross(s, "h", "e")}
        return _let(F.struct(*(v.alias(n) for n, v in k.items())), lambda k: up(s, k))

    def up(s: Column, k: Column) -> Column:
        root = k.k1 * k.k1 - k.k2 * k.k0 * 4
        # the root at which the map keeps its direction, in the form that loses no digits
        v = _let(F.when(root >= 0, F.sqrt(root)), lambda w: F.when(k.k1 >= 0, F.try_divide(k.k0 * -2, k.k1 + w)).otherwise(F.try_divide(w - k.k1, k.k2 * 2)))
        return _let(v, lambda v: _let(F.struct((s.ex + s.gx * v).alias("x"), (s.ey + s.gy * v).alias("y")), lambda d: across(s, v, d)))

    def across(s: Column, v: Column, d: Column) -> Column:
        u = F.when(F.abs(d.x) >= F.abs(d.y), F.try_divide(s.hx - s.fx * v, d.x)).otherwise(F.try_divide(s.hy - s.fy * v, d.y))
        return F.struct(u.alias("u"), v.alias("v"))

    return _let(F.struct(*(v.alias(n) for n, v in sides.items())), factors)


#: Cells in a row of the grid that points meet as one before they meet them singly.
BLOCK = 64


def _bounded(quads: DataFrame) -> DataFrame:
    """Cells with their run `bi` of `BLOCK` cells of a row, and their bounds lo and hi along the run's direction (nx, ny).

    That direction stands at right angles to a side across the run, so a slanting cell is narrow in it, however long its box.
    """
    runs = quads.withColumn("bi", F.floor(F.col("i") / BLOCK).cast("long"))
    a, d = F.col("ring")[0], F.col("ring")[3]
    side = F.struct("i", (d.y - a.y).alias("nx"), (a.x - d.x).alias("ny"), F.hypot(d.x - a.x, d.y - a.y).alias("n"))
    first = runs.groupBy("bi", "j").agg(F.min(side).alias("s"))
    # a side without length gives no direction, and then the bounds are those along the first axis
    unit = [F.when(F.col("s.n") > 0, F.col(f"s.{c}") / F.col("s.n")).otherwise(o).alias(c) for c, o in (("nx", 1.0), ("ny", 0.0))]
    place = [F.col("ring")[k].x * F.col("nx") + F.col("ring")[k].y * F.col("ny") for k in range(4)]
    return runs.join(first.select("bi", "j", *unit), ["bi", "j"]).withColumns({"lo": F.least(*place) - HAIR, "hi": F.greatest(*place) + HAIR})


def _blocks(bounded: DataFrame) -> DataFrame:
    """(bi, j, nx, ny, x0, y0, x1, y1, lo, hi): runs of cells with their box and their bounds along (nx, ny)."""
    ends = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max, "lo": F.min, "hi": F.max}
    return bounded.groupBy("bi", "j", "nx", "ny").agg(*(end(c).alias(c) for c, end in ends.items()))


def locate(points: DataFrame, quads: DataFrame, base: float) -> DataFrame:
    """Rows of points (x, y and others) with their cell's columns and the place (u, v) in it, each at least 0 and under 1.

    Points outside the grid, on its far rims, or without coordinates have no row. `base` is about a cell's width.
    Points meet runs of cells first, then the cells of the runs that may hold them. Only JVM functions are used.
    """
    bounded = materialize(_bounded(quads), "quads")
    blocks = materialize(_blocks(bounded), "blocks")
    along = F.col("x") * F.col("nx") + F.col("y") * F.col("ny")
    here = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    near = points_in_boxes(points, blocks, base, here & along.between(F.col("lo"), F.col("hi")))
    near = near.select(*points.columns, F.col("bi").alias("_bi"), F.col("j").alias("_j"), along.alias("_along"))
    # the bounds first: they are cheap, and outside the box the roots mean nothing
    met = near.join(bounded.drop("nx", "ny"), (F.col("_bi") == F.col("bi")) & (F.col("_j") == F.col("j")) & F.col("_along").between(F.col("lo"), F.col("hi")) & here)
    # roots are taken of the rows that are left, not within the join
    at = F.filter(F.array(_place(F.col("ring"), F.col("x"), F.col("y"))), lambda p: (p.u >= 0) & (p.u < 1) & (p.v >= 0) & (p.v < 1))
    found = met.withColumn("_at", F.explode(at))
    return found.withColumns({"u": F.col("_at.u"), "v": F.col("_at.v")}).drop("x0", "y0", "x1", "y1", "lo", "hi", "bi", "_bi", "_j", "_along", "_at")


def interpolate(points: DataFrame, nodes: DataFrame, value: str, base: float) -> DataFrame:
    """Points with their cell (i, j) and the nodes' `value` read between its four corners; null corners give null."""
    found = locate(points, cells(nodes, [value]), base)
    weights = [(1 - F.col("u")) * (1 - F.col("v")), F.col("u") * (1 - F.col("v")), F.col("u") * F.col("v"), (1 - F.col("u")) * F.col("v")]
    read = sum((F.col(value)[k] * w for k, w in enumerate(weights)), F.lit(0.0))
    return found.withColumn(value, read).drop("ring", "u", "v")


def _share_within(p: Column, q: Column, ring: Column) -> Column:
    """Share of the line p-q that lies in a convex cell, by the half planes of its four sides."""
    turn = F.signum((ring[1].x - ring[0].x) * (ring[3].y - ring[0].y) - (ring[1].y - ring[0].y) * (ring[3].x - ring[0].x))

    def side(k: int) -> Column:
        a, b = ring[k], ring[(k + 1) % 4]
        start, stop = ((b.x - a.x) * (s.y - a.y) - (b.y - a.y) * (s.x - a.x) for s in (p, q))
        return F.struct((turn * start).alias("start"), (turn * (stop - start)).alias("rise"))

    def share(sides: Column) -> Column:
        at = [F.try_divide(-sides[k].start, sides[k].rise) for k in range(4)]
        # a line along a side lies in the cell that the side begins: sides 0 and 3 keep it, 1 and 2 do not
        out = [(sides[k].rise == 0) & ((sides[k].start < 0) if k in (0, 3) else (sides[k].start <= 0)) for k in range(4)]
        lo = F.greatest(F.lit(0.0), *(F.when(sides[k].rise > 0, at[k]).when(out[k], 2.0) for k in range(4)))
        hi = F.least(F.lit(1.0), *(F.when(sides[k].rise < 0, at[k]) for k in range(4)))
        return F.greatest(hi - lo, F.lit(0.0))

    return _let(F.array(*(side(k) for k in range(4))), share)


def share_power(events: DataFrame, nodes: DataFrame, keys: list[str], id_col: str, tile: float, base: float, snap: float = SNAP) -> DataFrame:
    """(keys, i, j, frp): power of events with corners in `ring` spread over the cells of a curvilinear grid.

    Three corners or more are a polygon, weighed by common areas; two a line, by common lengths; one a point, all in
    its cell. What lies outside the grid does not count, so an event partly outside gives all its power to the cells
    inside. `keys` and `id_col` tell an event; repeated rows of one event add their power, and the largest of their shapes counts.
    Events without corners or power give nothing. No shape is repeated a cell: areas are summed over tiles.
    """
    quads = cells(nodes)
    told = events.where("frp is not null and size(ring) > 0").groupBy(*keys, id_col).agg(F.sum("frp").alias("frp"), F.max("ring").alias("ring"))
    named = told.select(F.struct(*keys, id_col).alias("event"), "frp", "ring", F.size("ring").alias("_n"))
    grid = quads.select(F.struct("i", "j").alias("cell"), "ring")
    shapes = P.edge_index(polygon_edges(named.where("_n > 2"), ["event"], 0, F.col("ring")), "event", tile, snap)
    index = P.edge_index(polygon_edges(grid, ["cell"], 0, F.col("ring")), "cell", tile, snap)
    areas = P.overlaps(shapes, "event", index, "cell", tile, snap).select("event", "cell", F.col("area").alias("part"))
    box = geom.bbox(F.col("ring"))
    lines = named.where("_n = 2").select("event", "ring", *(box[c].alias(c) for c in ("x0", "y0", "x1", "y1")))
    part = _share_within(F.col("a.ring")[0], F.col("a.ring")[1], F.col("b.ring"))
    lengths = box_pairs(lines, quads, base).select("a.event", F.struct("b.i", "b.j").alias("cell"), part.alias("part"))
    dots = named.where("_n = 1").select("event", F.col("ring")[0].x.alias("x"), F.col("ring")[0].y.alias("y"))
    points = locate(dots, quads, base).select("event", F.struct("i", "j").alias("cell"), F.lit(1.0).alias("part"))
    parts = areas.unionByName(lengths.where("part > 0")).unionByName(points)
    whole = parts.groupBy("event").agg(F.sum("part").alias("_whole"))
    shared = parts.join(whole, "event").join(named.select("event", "frp"), "event")
    return shared.groupBy(*(F.col(f"event.{k}").alias(k) for k in keys), "cell").agg(
        F.sum(F.col("frp") * F.col("part") / F.col("_whole")).alias("frp")).select(*keys, "cell.i", "cell.j", "frp")


def area_in_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Common area of a simple ring and a box: below each side, between the box's borders, with the side's direction as sign."""
    wide, high = x1 - x0, y1 - y0

    def climbed(y: Column) -> Column:
        return F.when(y <= 0, 0.0).when(y < high, y * y / 2).otherwise(high * high / 2 + high * (y - high))

    n = F.size(ring)

    def below(p: Column, q: Column) -> Column:
        slope = F.try_divide(q.y - p.y, q.x - p.x)
        ends = F.struct(*(F.least(F.greatest(s.x - x0, F.lit(0.0)), wide).alias(c) for c, s in (("p", p), ("q", q))), (p.y - y0 + slope * (x0 - p.x)).alias("y"), slope.alias("m"))
        return _let(ends, lambda e: _let(F.struct(e.p.alias("px"), e.q.alias("qx"), (e.y + e.m * e.p).alias("py"), (e.y + e.m * e.q).alias("qy")), under))

    def under(e: Column) -> Column:
        level = F.least(F.greatest((e.py + e.qy) / 2, F.lit(0.0)), high)
        mean = F.when(F.abs(e.qy - e.py) < 1e-6, level).otherwise(F.try_divide(climbed(e.qy) - climbed(e.py), e.qy - e.py))
        return F.when(e.px == e.qx, 0.0).otherwise((e.px - e.qx) * mean)

    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, k: s + below(ring[k], ring[(k + 1) % n])))


#: Pairs of cell and square worked on in one numpy call.
PAIRS = 1 << 16
#: Columns of cells that a task takes together: neighbours meet the same squares.
NEIGHBOURS = 32


def _runs(counts: np.ndarray):
    """(owner, place) of the items of groups of the given sizes, one after the other, at most `PAIRS` at a time."""
    ends = np.cumsum(counts)
    for a in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        item = np.arange(a, min(a + PAIRS, int(ends[-1])))
        owner = np.searchsorted(ends, item, side="right")
        yield owner, item - (ends - counts)[owner]


def _reach_in_band(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """West and east end of each ring within the heights low to high; west lies east of east where there is nothing."""
    west, east = np.full(len(x), np.inf), np.full(len(x), -np.inf)
    for k in range(4):
        px, py, qx, qy = x[:, k], y[:, k], x[:, (k + 1) % 4], y[:, (k + 1) % 4]
        met = (np.minimum(py, qy) <= high) & (np.maximum(py, qy) >= low)
        rise = qy - py
        slant = np.divide(qx - px, rise, out=np.zeros_like(rise), where=rise != 0)
        for ex, ey in ((px, py), (qx, qy)):
            # an end outside the band is moved along the side to its border
            at = np.where(rise != 0, ex + slant * (np.clip(ey, low, high) - ey), ex)
            west, east = np.where(met, np.minimum(west, at), west), np.where(met, np.maximum(east, at), east)
    return west, east


def _areas_in_squares(x: np.ndarray, y: np.ndarray, x0: np.ndarray, y0: np.ndarray, size: float) -> np.ndarray:
    """`area_in_box` of many rings of four corners, each with one square."""
    total = np.zeros(len(x0))

    def climbed(h):
        c = np.clip(h, 0.0, size)
        return c * c / 2 + size * np.maximum(h - size, 0.0)

    for k in range(4):
        px, py, qx, qy = x[:, k], y[:, k], x[:, (k + 1) % 4], y[:, (k + 1) % 4]
        run = qx - px
        slope = np.divide(qy - py, run, out=np.zeros_like(run), where=run != 0)
        p, q = np.clip(px - x0, 0.0, size), np.clip(qx - x0, 0.0, size)
        start = py - y0 + slope * (x0 - px)
        low, high = start + slope * p, start + slope * q
        rise = high - low
        flat = np.abs(rise) < 1e-6
        mean = np.where(flat, np.clip((low + high) / 2, 0.0, size), (climbed(high) - climbed(low)) / np.where(flat, 1.0, rise))
        total += np.where(p == q, 0.0, (p - q) * mean)
    return np.abs(total)


def _square_sums(x: np.ndarray, y: np.ndarray, value: np.ndarray, size: float):
    """(i, j, sum of value by share, sum of shares) of the squares that rings of four corners meet, in parts of bounded size."""
    low = np.floor(y.min(axis=1) / size).astype(np.int64)
    rows = np.ceil(y.max(axis=1) / size).astype(np.int64) - low
    for ring, up in _runs(np.maximum(rows, 0)):
        j = low[ring] + up
        west, east = _reach_in_band(x[ring], y[ring], j * size, (j + 1) * size)
        found = west <= east
        ring, j = ring[found], j[found]
        first = np.floor((west[found] - HAIR) / size).astype(np.int64)
        columns = np.floor((east[found] + HAIR) / size).astype(np.int64) + 1 - first
        for pair, right in _runs(columns):
            r, pj, pi = ring[pair], j[pair], first[pair] + right
            w = _areas_in_squares(x[r], y[r], pi * size, pj * size, size) / (size * size)
            kept = w > NOISE
            if not kept.any():
                continue
            w, v, pi, pj = w[kept], value[r[kept]], pi[kept], pj[kept]
            i0, j0 = pi.min(), pj.min()
            high = int(pj.max() - j0) + 1
            key, place = np.unique((pi - i0) * high + (pj - j0), return_inverse=True)
            yield key // high + i0, key % high + j0, np.bincount(place, v * w), np.bincount(place, w)


def resample_area(nodes: DataFrame, field: DataFrame, value: str, cell: float) -> DataFrame:
    """(i, j, value, coverage) of the regular cells that a field on a curvilinear grid covers.

    `field` has (i, j, value) of curvilinear cells; a null value covers nothing. `value` is the sum of the values by
    their shares of the regular cell, as `raster.resample_area` gives it; shares up to `NOISE` are none. Each height of
    squares is met only where the cell lies in it; the pairs of cell and square stay in the task, which gives its sums.
    """
    known = field.where(F.col(value).isNotNull()).select("i", "j", F.col(value).cast("double").alias("v"))
    quads = cells(nodes).join(known, ["i", "j"]).select("j", "i", "ring", "v", F.floor(F.col("i") / NEIGHBOURS).alias("_near"))
    corner = [F.col("ring")[k][c].alias(f"{c}{k}") for c in "xy" for k in range(4)]
    near = spread(quads, "_near").sortWithinPartitions("_near", "j", "i").select("v", *corner)

    def run(batches):
        for d in batches:
            v, *at = (c.to_numpy(zero_copy_only=False) for c in d.columns)
            if len(v):
                for found in _square_sums(np.column_stack(at[:4]), np.column_stack(at[4:]), v, float(cell)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["i", "j", "value", "coverage"])

    parts = near.mapInArrow(run, "i long, j long, value double, coverage double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"), F.sum("coverage").alias("coverage"))
