"""Nearest-neighbour joins of boxes and of shapes, and distance-class joins of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hotspark.functions.geom import box_distance, c
from hotspark.operators.predicates import edge_index, points_in_polygons
from hotspark.operators.tiles import box_pairs
from hotspark.session import materialize

# Reach (m) by vegetation class; class = category + fragmentation class.
CLASS_REACH = [2400.0, 1200.0, 800.0, 600.0, 480.0, 400.0, 343.0]


def nearest_box(a: DataFrame, a_id: str, b: DataFrame, b_id: str, halo: float) -> DataFrame:
    """Per a the nearest b within `halo` (ties: lowest id); a partial aggregate over tile pairs."""
    near = box_pairs(a, b, halo, halo).select(c("a", a_id).alias(a_id), c("b", b_id).alias(b_id), box_distance("a", "b").alias("dist"))
    best = near.where(F.col("dist") <= halo).groupBy(a_id).agg(F.min(F.struct("dist", b_id)).alias("m"))
    return best.select(a_id, f"m.{b_id}", "m.dist")


def buffer_classes(fuel: DataFrame, fuel_id: str, around: DataFrame, around_id: str) -> DataFrame:
    """Fuel shapes that meet the buffer of a shape, with the buffer of the fuel's class.

    Needs `category` (0, 1, ...) and `frag` on the fuel side: above 0.9, above 0, else.
    """
    frag_class = F.when(F.col("frag") > 0.9, 0).when(F.col("frag") > 0, 1).otherwise(2)
    reach = F.element_at(F.array(*[F.lit(v) for v in CLASS_REACH]), (F.col("category") + frag_class + 1).cast("int"))
    pairs = box_pairs(fuel.withColumn("reach", reach), around, max(CLASS_REACH), max(CLASS_REACH))
    hit = pairs.where(box_distance("a", "b") <= F.col("a.reach"))
    return hit.select(c("a", fuel_id).alias(fuel_id), c("b", around_id).alias(around_id), F.col("a.reach").alias("reach"))


_ENDS = ("x0", "y0", "x1", "y1")


def _pieces(edges: DataFrame, reach: float) -> DataFrame:
    """Edges in equal pieces of at most `reach`."""
    along = F.greatest(F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / reach), F.lit(1))
    cut = edges.withColumn("_n", along).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))

    def at(axis: str, i: Column) -> Column:
        lo, hi = F.col(f"{axis}0"), F.col(f"{axis}1")
        return F.when(i == 0, lo).when(i == F.col("_n"), hi).otherwise(lo + (hi - lo) * (i / F.col("_n")))

    ends = {f"{axis}{k}": at(axis, F.col("_i") + k) for axis in "xy" for k in (0, 1)}
    return cut.select(*[F.col(k) for k in edges.columns if k not in _ENDS], *[ends[e].alias(e) for e in _ENDS])


def _point_to_segment(p: str, a: str) -> Column:
    """Squared distance of an end of one piece (such as "l.x0,l.y0") to the other piece."""
    px, py = (F.col(v) for v in p.split(","))
    ax, ay, bx, by = (F.col(f"{a}.{e}") for e in _ENDS)
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / size))).otherwise(0.0)
    ox, oy = px - ax - t * dx, py - ay - t * dy
    return ox * ox + oy * oy


def segment_distance() -> Column:
    """Distance of the segments l and r (x0, y0, x1, y1): nothing if they cross, else the least from an end."""

    def side(a: str, p: str, k: int) -> Column:
        return (F.col(f"{a}.x1") - F.col(f"{a}.x0")) * (F.col(f"{p}.y{k}") - F.col(f"{a}.y0")) - (F.col(f"{a}.y1") - F.col(f"{a}.y0")) * (
            F.col(f"{p}.x{k}") - F.col(f"{a}.x0"))

    cross = (side("l", "r", 0) * side("l", "r", 1) < 0) & (side("r", "l", 0) * side("r", "l", 1) < 0)
    ends = [_point_to_segment(f"{p}.x{k},{p}.y{k}", a) for a, p in (("l", "r"), ("r", "l")) for k in (0, 1)]
    return F.when(cross, 0.0).otherwise(F.sqrt(F.least(*ends)))


def nearest_shapes(a: DataFrame, a_key: str, b: DataFrame, b_key: str, start: float, halo: float, tile: float | None = None) -> DataFrame:
    """(a_key, b_key, dist, met): for each shape of `a` the nearest of `b` within `halo`, by the distance of the shapes themselves.

    Both sides are edges (key, x0, y0, x1, y1), as polygon_edges gives them. Shapes that
    share ground or touch have distance 0; with `tile` (of their edge index) that holds
    for a shape inside another, too, else only outlines count. Distances are rounded to
    millimetres, ties go to the lowest key, shapes without one in reach are left out.

    The search widens: in a round all pairs of edge pieces within its reach are met, so a
    shape that found something is done, and the others go on with twice the reach. A
    shape in a dense layer meets only what lies within `start`, or within twice its
    distance; `met` says how many pieces that were. Equal edges of `b` stand for one.
    """
    if a_key == b_key:
        raise ValueError("the keys of the two sides need different names")
    ends = [F.col(e) for e in _ENDS]
    some = " and ".join(f"{e} is not null" for e in _ENDS)
    a = materialize(a.select(a_key, *ends).where(f"{a_key} is not null and {some}"), "nearest-a")
    # an edge between two shapes runs both ways, and copies of a shape have the same edges
    turn = (F.col("x0") > F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") > F.col("y1")))
    flip = {e: F.when(turn, F.col(f)).otherwise(F.col(e)) for e, f in zip(_ENDS, ("x1", "y1", "x0", "y0"))}
    seen = b.where(f"{b_key} is not null and {some}").select(b_key, *[flip[e].alias(e) for e in _ENDS])
    seen = materialize(seen.groupBy(*_ENDS).agg(F.min(b_key).alias(b_key)), "nearest-b")

    found = []
    if tile:
        inner = points_in_polygons(a.select(a_key, F.col("x0").alias("x"), F.col("y0").alias("y")), edge_index(b.select(b_key, *ends).where(f"{b_key} is not null"), b_key, tile), tile)
        outer = points_in_polygons(b.select(b_key, F.col("x0").alias("x"), F.col("y0").alias("y")).where(f"{b_key} is not null"), edge_index(a, a_key, tile), tile)
        inside = inner.select(a_key, b_key).unionByName(outer.select(a_key, b_key)).groupBy(a_key).agg(F.min(b_key).alias("_in"))
        inside = materialize(inside, "nearest-inside")
    else:
        inside = a.select(a_key).limit(0).withColumn("_in", F.lit(None).cast(b.schema[b_key].dataType))
    left, reach = a, min(start, halo)
    while True:
        near, far = _pieces(left, reach), _pieces(seen, reach)

        def tiles(lo: str, hi: str) -> Column:
            # a piece of `far` is keyed by its middle, at most half a reach from its ends
            wide = F.lit(1.5 * reach)
            return F.sequence(F.floor((F.least(lo, hi) - wide) / reach), F.floor((F.greatest(lo, hi) + wide) / reach))

        keyed = near.withColumn("tx", F.explode(tiles("x0", "x1"))).withColumn("ty", F.explode(tiles("y0", "y1")))
        middle = {f"t{axis}": F.floor((F.col(f"{axis}0") + F.col(f"{axis}1")) / 2 / reach) for axis in "xy"}
        met = keyed.alias("l").join(far.withColumns(middle).alias("r"), (F.col("l.tx") == F.col("r.tx")) & (F.col("l.ty") == F.col("r.ty")))
        close = met.select(F.col(f"l.{a_key}").alias(a_key), F.col(f"r.{b_key}").alias(b_key), F.round(segment_distance(), 3).alias("dist"))
        best = close.groupBy(a_key).agg(F.min(F.when(F.col("dist") <= reach, F.struct("dist", b_key))).alias("m"), F.count("*").alias("met"))
        best = best.join(inside, a_key, "full")
        # something inside or around a shape has no distance; an outline that crosses it may have the lower key
        zero = F.when(F.col("m.dist") == 0, F.least(F.col(f"m.{b_key}"), F.col("_in"))).otherwise(F.coalesce("_in", F.col(f"m.{b_key}")))
        best = best.select(a_key, zero.alias(b_key), F.when(F.col("_in").isNotNull(), 0.0).otherwise(F.col("m.dist")).alias("dist"), F.coalesce("met", F.lit(0).cast("long")).alias("met"))
        best = materialize(best, "nearest-round")
        found.append(best)
        if reach >= halo:
            break
        done = best.where("dist is not null").select(a_key)
        left = materialize(left.join(done, a_key, "left_anti"), "nearest-left")
        inside = inside.limit(0)
        if left.isEmpty():
            break
        reach = min(2 * reach, halo)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    met = F.sum("met").alias("met")
    out = every.groupBy(a_key).agg(F.min(F.when(F.col("dist").isNotNull(), F.struct("dist", b_key))).alias("m"), met).where("m is not null")
    return out.select(a_key, f"m.{b_key}", "m.dist", "met")
