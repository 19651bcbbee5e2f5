"""Speed of a front between two contours, as joins of corners, links and sides.

A link joins a corner of the newer contour to a corner of the older one inside it. It
counts if it runs inside the newer contour, outside the older one, meets no contour on
its way, and is not faster than a limit. Which side a link leaves its corners on
follows from the two sides that meet there; what lies between is found by walking the
link through tiles and meeting only the sides in those. No contour is in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hotspark.operators.overlay import SNAP, _PIECE, tiled, corners
from hotspark.operators.predicates import _areas
from hotspark.session import materialize

#: Layers of the sides: the older contour, the newer one, and further contours that links may not cross.
OLDER, NEWER, OTHER = 0, 1, 2
#: Metres within which a link counts as running along a side, or as only ending there.
TOUCH = 1e-3


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def _walk(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each tile of width `_t` that the line (x0, y0)-(x1, y1) passes; touched corners may add some."""
    lo_x, hi_x = F.least("x0", "x1"), F.greatest("x0", "x1")
    columns = df.withColumn("tx", F.explode(F.sequence(F.floor(lo_x / F.col("_t")), F.floor(hi_x / F.col("_t")))))
    # the part of the line within a column of tiles, a touch wider so that rounding loses no tile
    slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))

    def height(x: Column) -> Column:
        return F.when(F.col("x1") == F.col("x0"), F.col("y0")).otherwise(F.col("y0") + slope * (x - F.col("x0")))

    left, right = F.greatest(lo_x, F.col("tx") * F.col("_t")), F.least(hi_x, (F.col("tx") + 1) * F.col("_t"))
    steep = F.col("x1") == F.col("x0")
    bottom = F.when(steep, F.least("y0", "y1")).otherwise(F.least(height(left), height(right))) - TOUCH
    top = F.when(steep, F.greatest("y0", "y1")).otherwise(F.greatest(height(left), height(right))) + TOUCH
    return columns.withColumn("ty", F.explode(F.sequence(F.floor(bottom / F.col("_t")), F.floor(top / F.col("_t"))))).select(*keep, "tx", "ty")


def contained(sides: DataFrame, key: str, tile: float, snap: float = SNAP) -> DataFrame:
    """(key) whose older contour lies within the newer one, but for slivers as narrow as the lattice step.

    Ground of the older contour outside the newer one touches a side, so only tiles with sides are looked at.
    """
    pieces = materialize(tiled(sides.where(F.col("layer").isin(OLDER, NEWER)), [key], tile, snap), "front-pieces")
    # both lists are told as layer 0, for the areas take each on its own
    of = {n: F.collect_list(F.when(F.col("layer") == layer, F.struct(F.lit(0).alias("layer"), "ax", "ay", "bx", "by", "w"))) for n, layer in (("pa", OLDER), ("pb", NEWER))}
    listed = pieces.groupBy(key, "tx", "ty").agg(*(c.cast(_PIECE).alias(n) for n, c in of.items()))
    size = 2 * round(tile / snap)
    rows = listed.join(corners(pieces, [key], size), [key, "tx", "ty"])
    out = _areas(rows, [key], size, "only_a").groupBy(key).agg((F.sum(F.col("twice").cast("decimal(38,0)")).cast("double") * (snap * snap / 8)).alias("out"))
    rim = sides.where(F.col("layer") == OLDER).groupBy(key).agg(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("rim"))
    return out.join(rim, key).where(F.col("out") <= F.col("rim") * snap).select(key)


def _corners(sides: DataFrame, key: str, parts: int) -> DataFrame:
    """(key, layer, x, y, ix, iy, ox, oy): corners of the sides cut in `parts`, with the unit directions in and out."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    unit = sides.withColumns({"ux": (F.col("x1") - F.col("x0")) / length, "uy": (F.col("y1") - F.col("y0")) / length})
    before = unit.select(key, "layer", F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("ux").alias("ix"), F.col("uy").alias("iy"))
    real = unit.join(before, [key, "layer", "x0", "y0"]).select(key, "layer", F.col("x0").alias("x"), F.col("y0").alias("y"), "ix", "iy", F.col("ux").alias("ox"), F.col("uy").alias("oy"))
    if parts < 2:
        return real
    cut = unit.withColumn("_f", F.explode(F.array(*[F.lit(k / parts) for k in range(1, parts)])))
    at = {c: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col("_f") for c in "xy"}
    between = cut.select(key, "layer", at["x"].alias("x"), at["y"].alias("y"), F.col("ux").alias("ix"), F.col("uy").alias("iy"), F.col("ux").alias("ox"), F.col("uy").alias("oy"))
    return real.unionByName(between)


def _leaves_inside(s: str, dx: Column, dy: Column) -> Column:
    """Whether a way from a corner of `s` leads strictly to the left of its contour."""
    left_in, left_out = (_cross(F.col(f"{s}.{d}x"), F.col(f"{s}.{d}y"), dx, dy) > 2 * TOUCH for d in "io")
    convex = _cross(F.col(f"{s}.ix"), F.col(f"{s}.iy"), F.col(f"{s}.ox"), F.col(f"{s}.oy")) >= 0
    return F.when(convex, left_in & left_out).otherwise(left_in | left_out)


def _leaves_outside(s: str, dx: Column, dy: Column) -> Column:
    right_in, right_out = (_cross(F.col(f"{s}.{d}x"), F.col(f"{s}.{d}y"), dx, dy) < -2 * TOUCH for d in "io")
    convex = _cross(F.col(f"{s}.ix"), F.col(f"{s}.iy"), F.col(f"{s}.ox"), F.col(f"{s}.oy")) >= 0
    return F.when(convex, right_in | right_out).otherwise(right_in & right_out)


def front_links(sides: DataFrame, key: str, seconds: DataFrame, tile: float, top_speed: float = 10.0, parts: int = 5) -> DataFrame:
    """(key, dt, fx, fy, tx, ty, dist): the links of every pair of contours that nothing stands in the way of.

    `sides` has (key, layer, x0, y0, x1, y1) as polygon_edges gives them, simple contours with their polygon on the
    left; `seconds` has (key, dt). Each side is cut in `parts`, and all corners count. A pair whose older contour is
    not within the newer one, or whose time is null or not positive, has no links; neither has a null key. Two
    contours that are equal have none either. Repeated sides are one, and the longest of repeated times counts.
    """
    times = seconds.where("dt > 0").groupBy(key).agg(F.max("dt").cast("double").alias("dt"))
    clean = sides.select(key, "layer", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    clean = clean.dropna().where("x0 <> x1 or y0 <> y1").distinct()
    held = contained(clean.join(times.select(key), key, "left_semi"), key, tile)
    # links go no farther than the reach; tiles of their walk lie between the reach and the sides' own length
    scale = clean.groupBy(key).agg(F.avg(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("_side"),
                                   F.hypot(F.max("x0") - F.min("x0"), F.max("y0") - F.min("y0")).alias("_wide"))
    reach = F.least(F.col("dt") * top_speed, F.col("_wide") + TOUCH)
    known = times.join(held, key).join(scale, key).select(key, "dt", reach.alias("_reach"), F.sqrt(reach * F.col("_side")).alias("_t"))
    own = materialize(clean.join(known, key), "front-sides")
    points = _corners(own.where(F.col("layer").isin(OLDER, NEWER)).drop("_t", "_reach", "dt"), key, parts).join(known, key)
    points = materialize(points.withColumns({f"c{c}": F.floor(F.col(c) / F.col("_reach")) for c in "xy"}), "front-corners")
    near = points.where(F.col("layer") == OLDER)
    for c in "xy":
        near = near.withColumn(f"c{c}", F.explode(F.array(*[F.col(f"c{c}") + d for d in (-1, 0, 1)])))
    o, p = points.where(F.col("layer") == NEWER).alias("o"), near.alias("p")
    dx, dy = F.col("p.x") - F.col("o.x"), F.col("p.y") - F.col("o.y")
    dist = F.sqrt(dx * dx + dy * dy)
    met = o.join(p, [F.col(f"o.{c}") == F.col(f"p.{c}") for c in (key, "cx", "cy")] + [
        (dist > 0) & (dist / F.col("o.dt") <= top_speed), _leaves_inside("o", dx, dy), _leaves_outside("p", -dx, -dy)])
    links = met.select(
        F.col(f"o.{key}").alias(key), F.col("o.dt").alias("dt"), F.col("o._t").alias("_t"), F.col("o.x").alias("x0"), F.col("o.y").alias("y0"),
        F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), dist.alias("dist"))
    links = materialize(links.withColumn("link", F.monotonically_increasing_id()), "front-links")
    ends = ["x0", "y0", "x1", "y1"]
    way = _walk(links, [key, "link", "dist", *ends]).alias("l")
    walls = _walk(own, [key, *ends]).alias("s")
    rx, ry, sx, sy, wx, wy = (F.col(f"{a}") - F.col(f"{b}") for a, b in (
        ("l.x1", "l.x0"), ("l.y1", "l.y0"), ("s.x1", "s.x0"), ("s.y1", "s.y0"), ("s.x0", "l.x0"), ("s.y0", "l.y0")))
    den = _cross(rx, ry, sx, sy)
    t, u = F.try_divide(_cross(wx, wy, sx, sy), den), F.try_divide(_cross(wx, wy, rx, ry), den)
    end = TOUCH / F.greatest(F.col("l.dist"), F.lit(TOUCH))
    blocked = (den != 0) & (t > end) & (t < 1 - end) & (u >= 0) & (u <= 1)
    stopped = way.join(walls, [F.col(f"l.{c}") == F.col(f"s.{c}") for c in (key, "tx", "ty")] + [blocked], "left_semi").select("link").distinct()
    free = links.join(stopped, "link", "left_anti")
    return free.select(key, "dt", F.col("x0").alias("fx"), F.col("y0").alias("fy"), F.col("x1").alias("tx"), F.col("y1").alias("ty"), "dist")


def front_speed(sides: DataFrame, key: str, seconds: DataFrame, tile: float, top_speed: float = 10.0, parts: int = 5) -> DataFrame:
    """(key, links, speed, speed_std, fx, fy, tx, ty): mean and spread of the speed, and the mean link's ends.

    The mean link leads from the older contour (fx, fy) to the newer one (tx, ty). Pairs without links have no row.
    """
    free = front_links(sides, key, seconds, tile, top_speed, parts).withColumn("v", F.col("dist") / F.col("dt"))
    return free.groupBy(key).agg(
        F.count("*").alias("links"), F.avg("v").alias("speed"), F.stddev_pop("v").alias("speed_std"),
        F.avg("tx").alias("fx"), F.avg("ty").alias("fy"), F.avg("fx").alias("tx"), F.avg("fy").alias("ty"))
