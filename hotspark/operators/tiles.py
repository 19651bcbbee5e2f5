"""Spatial joins as equi-joins on tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A shape is keyed at the level whose tiles are at least as large as it is, so it
# covers at most 2 x 2 of them, whether it is a roof or a country.


def level_of(width: Column, height: Column, base: float) -> Column:
    size = F.greatest(width, height) / F.lit(float(base))
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1.0))))).cast("int")


def _tile(value: Column, base: float, level: Column) -> Column:
    return F.floor(value / (F.lit(float(base)) * F.pow(F.lit(2.0), level))).cast("long")


def cover(boxes: DataFrame, base: float, grow: float = 0.0) -> DataFrame:
    """One row per (box, tile at the box's level); needs x0, y0, x1, y1."""
    g = F.lit(float(grow))
    sized = boxes.withColumn("lvl", level_of(F.col("x1") - F.col("x0") + 2 * g, F.col("y1") - F.col("y0") + 2 * g, base))

    def span(lo: str, hi: str) -> Column:
        return F.sequence(_tile(F.col(lo) - g, base, F.col("lvl")), _tile(F.col(hi) + g, base, F.col("lvl")))

    return sized.withColumn("tx", F.explode(span("x0", "x1"))).withColumn("ty", F.explode(span("y0", "y1")))


def levels_in(boxes: DataFrame, base: float, grow: float = 0.0) -> list[int]:
    """Levels in use: a handful of small integers, whatever the number of boxes."""
    g = 2 * grow
    lv = level_of(F.col("x1") - F.col("x0") + g, F.col("y1") - F.col("y0") + g, base)
    return sorted(r[0] for r in boxes.select(lv.alias("lvl")).distinct().collect())


def key_points(points: DataFrame, base: float, levels: list[int]) -> DataFrame:
    """One row per (point, level) with the tile of the point."""
    if len(levels) == 1:
        lv = F.lit(levels[0])
    else:
        lv = F.explode(F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>"))
    return (
        points.withColumn("lvl", lv)
        .withColumn("tx", _tile(F.col("x"), base, F.col("lvl")))
        .withColumn("ty", _tile(F.col("y"), base, F.col("lvl")))
    )


def in_box(x: str = "x", y: str = "y") -> Column:
    return (
        (F.col(x) >= F.col("x0")) & (F.col(x) <= F.col("x1")) & (F.col(y) >= F.col("y0")) & (F.col(y) <= F.col("y1"))
    )


def points_in_boxes(points: DataFrame, boxes: DataFrame, base: float, test: Column | None = None) -> DataFrame:
    """Inner join of points with the boxes that hold them (`test` replaces the box test)."""
    keyed = key_points(points, base, levels_in(boxes, base))
    return keyed.join(cover(boxes, base), ["lvl", "tx", "ty"]).where(in_box() if test is None else test).drop(
        "lvl", "tx", "ty"
    )


def split_by_mask(points: DataFrame, mask: DataFrame, base: float, keep: bool, test: Column | None = None) -> DataFrame:
    """Points outside every mask box (`keep`) or inside at least one.

    One semi or anti join per level in use, each on the points that no earlier level
    took, so a point that stands in the table twice comes out twice. The points are
    never multiplied, and a tile that holds a large share of them can be split, since
    the mask is the other side.
    """
    test = in_box() if test is None else test
    levels = levels_in(mask, base)
    covers = cover(mask, base)
    out, inside = points, []
    for lv in levels:
        keyed = key_points(out, base, [lv])
        side = covers.where(F.col("lvl") == lv).drop("lvl")
        cond = (keyed.tx == side.tx) & (keyed.ty == side.ty) & test
        if not keep:
            inside.append(keyed.join(side, cond, "left_semi").drop("lvl", "tx", "ty"))
        out = keyed.join(side, cond, "left_anti").drop("lvl", "tx", "ty")
    if keep:
        return out
    if not inside:
        return points.limit(0)
    hit = inside[0]
    for more in inside[1:]:
        hit = hit.unionByName(more)
    return hit


def box_candidates(a: DataFrame, b: DataFrame, base: float, grow: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """Rows a, b with their boxes ak, bk that share a tile (lvl, tx, ty).

    A pair is met at the coarser of its two levels: boxes at their own level meet the
    other side's boxes of that level or a finer one, which are keyed there too. Two
    boxes are therefore never brought together in a tile that is coarser than both.
    """
    keys = keys or []
    ga = a.selectExpr("struct(*) as a", f"x0 - {grow} as x0", f"y0 - {grow} as y0", f"x1 + {grow} as x1", f"y1 + {grow} as y1")
    gb = b.selectExpr("struct(*) as b", "x0", "y0", "x1", "y1")
    levels_a, levels_b = levels_in(ga, base), levels_in(gb, base)

    def keyed(df: DataFrame, side: str, level: Column) -> DataFrame:
        own = level_of(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), base)
        out = df.withColumn("own", own).withColumn("lvl", level)
        for axis in ("x", "y"):
            out = out.withColumn(
                f"t{axis}",
                F.explode(F.sequence(_tile(F.col(f"{axis}0"), base, F.col("lvl")), _tile(F.col(f"{axis}1"), base, F.col("lvl")))),
            )
        box = F.struct(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias(f"{side}k")
        return out.select(side, box, "lvl", "tx", "ty", *[F.col(f"{side}.{k}").alias(k) for k in keys])

    def at(levels: list[int], test) -> Column:
        every = F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")
        return F.explode(F.filter(every, test))

    own, on = F.col("own"), ["lvl", "tx", "ty", *keys]
    met = keyed(ga, "a", own).join(keyed(gb, "b", at(levels_a, lambda v: v >= own)), on)
    finer = [v for v in levels_b if v > min(levels_a, default=v)]
    if finer:
        met = met.unionByName(keyed(ga, "a", at(finer, lambda v: v > own)).join(keyed(gb, "b", own), on))
    return met


def box_pairs(a: DataFrame, b: DataFrame, base: float, grow: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """Pairs of boxes (columns a.*, b.*) whose boxes, a's grown by `grow`, meet.

    Of the tiles a pair shares only the one with the lower-left corner of the overlap
    reports it, so no distinct follows. `keys` are further columns that must be equal.
    """
    meets = (
        (F.col("ak.x0") <= F.col("bk.x1")) & (F.col("bk.x0") <= F.col("ak.x1"))
        & (F.col("ak.y0") <= F.col("bk.y1")) & (F.col("bk.y0") <= F.col("ak.y1"))
    )
    corner = (F.col("tx") == _tile(F.greatest("ak.x0", "bk.x0"), base, F.col("lvl"))) & (
        F.col("ty") == _tile(F.greatest("ak.y0", "bk.y0"), base, F.col("lvl"))
    )
    return box_candidates(a, b, base, grow, keys).where(meets & corner).select("a", "b")
