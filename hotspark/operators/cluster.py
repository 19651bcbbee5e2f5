"""Distance pairs and distance-connected clusters of points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from hotspark.operators.components import components
from hotspark.operators.ranking import number_rows
from hotspark.session import materialize

# Half of the 3 x 3 neighbourhood: each unordered pair of cells is met once.
HALF_NEIGHBOURS = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def cell_col(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")


def offsets(pairs: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(a).cast("long").alias("dx"), F.lit(b).cast("long").alias("dy")) for a, b in pairs])


def pack_cell(cx: Column, cy: Column) -> Column:
    """One long for a cell; cy must fit in 32 bits."""
    return F.shiftleft(cx, 32) + cy + F.lit(1 << 31)


def distance_pairs(points: DataFrame, eps: float, id_col: str = "id") -> DataFrame:
    """All pairs (a, b), a < b, of points at most `eps` apart, with `dist`.

    An equi-join on grid cells of side eps; one side is replicated to half the
    neighbour cells. Points of one cell can be many, so the cell key carries a
    salt: the probing side takes one of `salts` values, the other side all of
    them, where `salts` grows with the number of points in the cell.
    """
    base = points.select(
        F.col(id_col).alias("id"), "x", "y", cell_col(F.col("x"), eps).alias("cx"), cell_col(F.col("y"), eps).alias("cy")
    )
    probe = base.select(F.col("id").alias("ia"), F.col("x").alias("xa"), F.col("y").alias("ya"), "cx", "cy")
    build = (
        base.withColumn("o", F.explode(offsets(HALF_NEIGHBOURS)))
        .select(
            F.col("id").alias("ib"),
            F.col("x").alias("xb"),
            F.col("y").alias("yb"),
            (F.col("cx") + F.col("o.dx")).alias("cx"),
            (F.col("cy") + F.col("o.dy")).alias("cy"),
            ((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).alias("own"),
        )
    )
    d2 = (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (
        F.col("ya") - F.col("yb")
    )
    met = salted_join(probe, build, ["cx", "cy"])
    return (
        met.where((d2 <= eps * eps) & (~F.col("own") | (F.col("ia") < F.col("ib"))))
        .select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), F.sqrt(d2).alias("dist"))
    )


def salted_join(probe: DataFrame, build: DataFrame, keys: list[str], per_salt: int = 200_000) -> DataFrame:
    """Inner equi-join for keys that may be heavy on both sides.

    Keys with more than `per_salt` probe rows are split into as many salts as
    needed. There are at most rows / per_salt of them, so the key list is small
    against the data and is left to the planner to broadcast or shuffle.
    """
    heavy = (
        probe.groupBy(*keys)
        .count()
        .where(F.col("count") > per_salt)
        .select(*keys, F.ceil(F.col("count") / F.lit(per_salt)).cast("int").alias("_salts"))
    )
    heavy = materialize(heavy, "heavy")
    if heavy.isEmpty():
        return probe.join(build, keys)
    spread = probe.join(heavy, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*[probe[c] for c in probe.columns]), F.coalesce("_salts", F.lit(1))).cast("int")
    )
    copies = build.join(heavy, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    return spread.drop("_salts").join(copies.drop("_salts"), [*keys, "_salt"]).drop("_salt")


# Offsets whose cells can hold a pair within eps when the cell diagonal is eps.
_REACH = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if dy > 0 or (dy == 0 and dx > 0)]

_BOX = ["x0", "y0", "x1", "y1"]

# Cells on a side of the tiles in which neighbour cells meet: a cell goes to three of them, not to each of the twelve places of `_REACH`.
MEET_CELLS = 4


def _towards(cells: DataFrame) -> DataFrame:
    """Cells once for each tile (tx, ty) that holds a cell they can reach, by `_REACH`."""
    def tiles(c: str, low: int) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) + low) / MEET_CELLS), F.floor((F.col(c) + 2) / MEET_CELLS)))

    return cells.withColumn("tx", tiles("cx", -2)).withColumn("ty", tiles("cy", 0))


def _neighbours(cells: DataFrame) -> DataFrame:
    """Pairs of cells (a, b) with their boxes, b at one of the places of `_REACH` from a; each pair once."""
    a = _towards(cells.select("cx", "cy", *_BOX)).alias("a")
    b = cells.select("cx", "cy", *_BOX).withColumns({f"t{c}": F.floor(F.col(f"c{c}") / MEET_CELLS) for c in "xy"}).alias("b")
    dx, dy = (F.col(f"b.c{c}") - F.col(f"a.c{c}") for c in "xy")
    ahead = ((dy > 0) & (dy <= 2) & (dx >= -2) & (dx <= 2)) | ((dy == 0) & (dx > 0) & (dx <= 2))
    return a.join(b, (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty")) & ahead)


def _boxes(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        F.max("x").alias("x1"),
        F.max("y").alias("y1"),
        F.min(F.struct("x", "y")).alias("first_site"),
        F.count("*").alias("n"),
    )


def _verdict(a: str, b: str, eps: float) -> Column:
    """true: every pair is within eps; false: none is; null: boxes cannot tell."""

    def c(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    far_x = F.greatest(F.abs(c(a, "x1") - c(b, "x0")), F.abs(c(b, "x1") - c(a, "x0")))
    far_y = F.greatest(F.abs(c(a, "y1") - c(b, "y0")), F.abs(c(b, "y1") - c(a, "y0")))
    gap_x = F.greatest(c(b, "x0") - c(a, "x1"), c(a, "x0") - c(b, "x1"), F.lit(0.0))
    gap_y = F.greatest(c(b, "y0") - c(a, "y1"), c(a, "y0") - c(b, "y1"), F.lit(0.0))
    r2 = F.lit(eps * eps)
    return F.when(far_x * far_x + far_y * far_y <= r2, F.lit(True)).when(gap_x * gap_x + gap_y * gap_y > r2, F.lit(False))


def _side(eps: float) -> float:
    # a hair below eps / sqrt(2), so that rounding never joins two points of one cell wrongly
    return eps / math.sqrt(2.0) * (1.0 - 1e-9)


def label_cells(points: DataFrame, eps: float, numbered: bool = True) -> DataFrame:
    """(cell, cluster) for every occupied cell of `points` (columns x, y).

    Cells have diagonal eps, so the points of a cell always share a cluster and a
    cell counts as one vertex however many points it holds. Neighbour cells are
    compared by the tight boxes of their points. Where boxes cannot decide, both
    cells are cut 4 x 4 and only the parts that still matter are compared again,
    so a dense pair of cells costs at most 256 comparisons a level and never all
    pairs of its points.

    With `numbered` clusters are 1, 2, ... by their smallest (x, y) point, else
    the number is the id of some cell of the cluster.
    """
    side = _side(eps)
    # written once: every level below reads these four columns, not the input again
    pts = materialize(points.select("x", "y", cell_col(F.col("x"), side).alias("cx"), cell_col(F.col("y"), side).alias("cy")), "sites")
    boxed = _boxes(pts, "cx", "cy")
    # the first sites only serve to number the clusters
    cells = materialize(boxed if numbered else boxed.select("cx", "cy", *_BOX), "cells")
    met = _neighbours(cells).select(
        F.col("a.cx").alias("ax"),
        F.col("a.cy").alias("ay"),
        F.col("b.cx").alias("bx"),
        F.col("b.cy").alias("by"),
        _verdict("a", "b", eps).alias("near"),
    )
    met = materialize(met.where("near is null or near"), "met")
    edges = met.where("near")
    open_pairs = met.where("near is null").drop("near").selectExpr("*", "ax as fax", "ay as fay", "bx as fbx", "by as fby")
    scale = 1
    while not open_pairs.isEmpty():
        scale *= 4
        wanted = (
            open_pairs.select(F.col("ax").alias("cx"), F.col("ay").alias("cy"))
            .unionByName(open_pairs.select(F.col("bx").alias("cx"), F.col("by").alias("cy")))
            .distinct()
        )
        parts = _boxes(
            pts.join(wanted, ["cx", "cy"], "left_semi")
            .withColumn("px", cell_col(F.col("x"), side / scale))
            .withColumn("py", cell_col(F.col("y"), side / scale)),
            "px",
            "py",
        ).select("px", "py", F.floor(F.col("px") / 4).alias("ux"), F.floor(F.col("py") / 4).alias("uy"), *_BOX)
        parts = materialize(parts, "parts")
        tried = (
            open_pairs.alias("q")
            .join(parts.alias("a"), (F.col("q.fax") == F.col("a.ux")) & (F.col("q.fay") == F.col("a.uy")))
            .join(parts.alias("b"), (F.col("q.fbx") == F.col("b.ux")) & (F.col("q.fby") == F.col("b.uy")))
            .select(
                "ax", "ay", "bx", "by",
                F.col("a.px").alias("fax"),
                F.col("a.py").alias("fay"),
                F.col("b.px").alias("fbx"),
                F.col("b.py").alias("fby"),
                _verdict("a", "b", eps).alias("near"),
            )
            .where("near is null or near")
        )
        tried = materialize(tried, "tried")
        found = tried.where("near").select("ax", "ay", "bx", "by").distinct()
        edges = edges.select("ax", "ay", "bx", "by").unionByName(found)
        open_pairs = tried.where("near is null").drop("near").join(found, ["ax", "ay", "bx", "by"], "left_anti")
        open_pairs = materialize(open_pairs, "open")
    roots = components(cell_edges(edges))
    site = ["first_site"] if numbered else []
    vertices = cells.select(pack_cell(F.col("cx"), F.col("cy")).alias("cell"), *site)
    rooted = vertices.join(roots, vertices.cell == roots.id, "left").select(
        "cell", F.coalesce("root", "cell").alias("root"), *site
    )
    if not numbered:
        return rooted.select("cell", F.col("root").alias("cluster"))
    rooted = materialize(rooted, "rooted")
    firsts = (
        rooted.groupBy("root")
        .agg(F.min("first_site").alias("s"))
        .select("root", F.col("s.x").alias("_x"), F.col("s.y").alias("_y"))
    )
    numbers = number_rows(firsts, ["_x", "_y"], "cluster").select("root", "cluster")
    return rooted.join(numbers, "root").select("cell", "cluster")


# Cells on a side of a tile; 4096 cells bound the work of one tile.
TILE_CELLS = 64


def cell_edges(pairs: DataFrame) -> DataFrame:
    """Edge table of cell pairs (ax, ay) - (bx, by), with the tile that holds both, if one does."""
    ta = [F.floor(F.col(c) / TILE_CELLS) for c in ("ax", "ay")]
    tb = [F.floor(F.col(c) / TILE_CELLS) for c in ("bx", "by")]
    return pairs.select(
        pack_cell(F.col("ax"), F.col("ay")).alias("src"),
        pack_cell(F.col("bx"), F.col("by")).alias("dst"),
        F.when((ta[0] == tb[0]) & (ta[1] == tb[1]), pack_cell(ta[0].cast("long"), ta[1].cast("long"))).alias("tile"),
    )


def cell_of_point(eps: float) -> Column:
    side = _side(eps)
    return pack_cell(cell_col(F.col("x"), side), cell_col(F.col("y"), side))


def cluster_points(points: DataFrame, eps: float, out: str = "cluster", numbered: bool = True) -> DataFrame:
    """`points` plus the number of the distance-connected cluster of each row."""
    labels = label_cells(points, eps, numbered).withColumnRenamed("cluster", out)
    return points.withColumn("cell", cell_of_point(eps)).join(labels, "cell").drop("cell")
