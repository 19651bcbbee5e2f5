"""Operators on long-form grids: rows (i, j, value), nodata cells absent."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from hotspark.functions.kernels import multiquadric_fill
from hotspark.operators.cluster import HALF_NEIGHBOURS, cell_edges, offsets, pack_cell
from hotspark.operators.components import components
from hotspark.session import materialize, spread

AROUND8 = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
AROUND9 = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def send(grid: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Each cell's row sent to the cells that see it at the given offsets (dx, dy).

    The receiving cell is (i, j) again; one shuffle of the following groupBy brings
    a neighbourhood together, with partial aggregation on the way.
    """
    return (
        grid.withColumn("o", F.explode(offsets(pairs)))
        .withColumn("i", F.col("i") - F.col("o.dx"))
        .withColumn("j", F.col("j") - F.col("o.dy"))
        .withColumn("dx", F.col("o.dx")).withColumn("dy", F.col("o.dy"))
        .drop("o")
    )


def gather(grid: DataFrame, value: str, pairs: list[tuple[int, int]], keep: list[str] | None = None) -> DataFrame:
    """Cells that exist, with the neighbour values as columns n_{dx}_{dy} (m for minus)."""
    every = pairs if (0, 0) in pairs else [(0, 0), *pairs]
    own = (F.col("dx") == 0) & (F.col("dy") == 0)
    cols = [
        F.max(F.when((F.col("dx") == a) & (F.col("dy") == b), F.col(value))).alias(name_of(a, b)) for a, b in every
    ]
    kept = [F.max(F.when(own, F.col(c))).alias(c) for c in keep or []]
    here = F.max(F.when(own, F.lit(1))).alias("_here")
    return send(grid, every).groupBy("i", "j").agg(*cols, *kept, here).where("_here = 1").drop("_here")


def name_of(a: int, b: int) -> str:
    return f"n_{a}_{b}".replace("-", "m")


def extent(grid: DataFrame) -> DataFrame:
    """One row: the index range of the grid."""
    return grid.agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))


def with_extent(df: DataFrame, ext: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(ext))  # `ext` is one row


def block_shrink(grid: DataFrame, value: str, factor: int) -> DataFrame:
    """Sum, max, min, mean over the valid cells of factor x factor blocks."""
    return grid.groupBy(F.floor(F.col("i") / factor).alias("bi"), F.floor(F.col("j") / factor).alias("bj")).agg(
        F.sum(value).alias("sum"), F.max(value).alias("max"), F.min(value).alias("min"), F.avg(value).alias("average"),
        F.count(value).alias("valid"),
    )


def neighbour_mean(grid: DataFrame, value: str, ext: DataFrame) -> DataFrame:
    """Mean of the eight neighbours; cells outside the grid do not count, nodata counts as 0."""
    own = (F.col("dx") == 0) & (F.col("dy") == 0)
    g = send(grid.select("i", "j", value), AROUND9).groupBy("i", "j").agg(
        F.sum(F.when(~own, F.col(value))).alias("s"), F.max(F.when(own, F.lit(1))).alias("here")
    )
    g = with_extent(g.where("here = 1"), ext)

    def span(c: str, lo: str, hi: str) -> Column:
        return 1 + (F.col(c) > F.col(lo)).cast("int") + (F.col(c) < F.col(hi)).cast("int")

    n = span("i", "i0", "i1") * span("j", "j0", "j1") - 1
    return g.select("i", "j", (F.coalesce("s", F.lit(0.0)) / n).alias("mean8"))


def neighbour_stats(grid: DataFrame, value: str, size: int) -> DataFrame:
    """Min, max and mean over the size x size window (valid cells)."""
    if size % 2 == 0:
        raise ValueError("window size must be odd")
    h = size // 2
    pairs = [(a, b) for a in range(-h, h + 1) for b in range(-h, h + 1)]
    own = (F.col("dx") == 0) & (F.col("dy") == 0)
    g = send(grid.select("i", "j", value), pairs).groupBy("i", "j").agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.max(F.when(own, F.lit(1))).alias("here")
    )
    return g.where("here = 1").drop("here")


def gradient(grid: DataFrame, value: str, ext: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Central differences; one-sided beside nodata, 0 between two nodata cells and on the rim."""
    g = with_extent(gather(grid, value, AROUND9, keep), ext)

    def along(lo: str, hi: str, rim: Column) -> Column:
        z, a, b = F.col("n_0_0"), F.col(lo), F.col(hi)
        inner = (
            F.when(a.isNull() & b.isNull(), F.lit(0.0)).when(b.isNull(), z - a).when(a.isNull(), b - z).otherwise((b - a) * 0.5)
        )
        return F.when(rim, F.lit(0.0)).otherwise(inner)

    rim_i = (F.col("i") == F.col("i0")) | (F.col("i") == F.col("i1"))
    rim_j = (F.col("j") == F.col("j0")) | (F.col("j") == F.col("j1"))
    return g.withColumn("gx", along("n_m1_0", "n_1_0", rim_i)).withColumn("gy", along("n_0_m1", "n_0_1", rim_j))


# Share of a cell that the samples lie ahead and behind.
REACH = 0.75


def rate_of_spread(grid: DataFrame, arrival: str, terrain: str, cell: float, ext: DataFrame, top: float = 10.0) -> DataFrame:
    """Front speed and direction from an arrival-time grid.

    Time and terrain are read 0.75 cell ahead and behind along the gradient
    (bilinear over the four cells around); the distance follows the terrain.
    A side counts when it took longer than the fastest allowed front would. Samples
    that touch nodata or lie on the outer two rings of the grid are undefined.
    """
    t = gradient(grid, arrival, ext, [terrain])
    h = gather(grid, terrain, AROUND9).select("i", "j", *[F.col(name_of(a, b)).alias("h" + name_of(a, b)) for a, b in AROUND9])
    g = t.join(h, ["i", "j"])
    norm = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    g = g.withColumn("norm", norm)
    g = g.withColumn("nx", F.when(F.col("norm") > 0, F.col("gx") / F.col("norm")).otherwise(0.0))
    g = g.withColumn("ny", F.when(F.col("norm") > 0, F.col("gy") / F.col("norm")).otherwise(0.0))

    def sample(prefix: str, sign: int) -> Column:
        u, v = sign * REACH * F.col("nx"), sign * REACH * F.col("ny")
        out = F.lit(0.0)
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                wa = F.greatest(F.lit(0.0), 1 - F.abs(u - a))
                wb = F.greatest(F.lit(0.0), 1 - F.abs(v - b))
                w = wa * wb
                out = out + F.when(w > 0, w * F.col(prefix + name_of(a, b))).otherwise(0.0)
        return out

    inner = (
        (F.col("i") >= F.col("i0") + 2) & (F.col("i") <= F.col("i1") - 2)
        & (F.col("j") >= F.col("j0") + 2) & (F.col("j") <= F.col("j1") - 2)
    )
    step = REACH * cell
    g = g.withColumn("dist", F.lit(step) * F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny")))
    for side, sign in (("f", 1), ("b", -1)):
        g = g.withColumn(f"t{side}", F.when(inner, sign * (sample("", sign) - F.col("n_0_0"))))
        g = g.withColumn(f"h{side}", F.abs(sample("h", sign) - F.col("hn_0_0")))
        g = g.withColumn(f"d{side}", F.sqrt(F.col("dist") * F.col("dist") + F.col(f"h{side}") * F.col(f"h{side}")))
    limit = math.sqrt(2.0) * step / top
    vf, vb = F.col("df") / F.col("tf"), F.col("db") / F.col("tb")
    okf, okb = F.col("tf") > limit, F.col("tb") > limit
    known = F.col("tf").isNotNull() & F.col("tb").isNotNull()
    ros = (
        F.when(F.col("norm") == 0, F.lit(0.0)).when(~known, F.lit(None).cast("double"))
        .when(okf & okb, 0.5 * (vf + vb)).when(okf, vf).when(okb, vb).otherwise(F.lit(top))
    )
    quality = F.when(F.col("norm") == 0, 1).when(known & ~okf & ~okb, -1).when(known, 1)
    return g.select("i", "j", "nx", "ny", ros.alias("ros"), quality.cast("int").alias("quality"))


def front_cells(grid: DataFrame, arrival: str) -> DataFrame:
    """Cells with an 8-neighbour that burns later or never."""
    g = gather(grid, arrival, AROUND9)
    later = [F.coalesce(F.col(name_of(a, b)) > F.col("n_0_0"), F.lit(True)).cast("int") for a, b in AROUND8]
    total = later[0]
    for c in later[1:]:
        total = total + c
    return g.withColumn("open", total).where("open > 0").select("i", "j", F.col("n_0_0").alias("t"), "open")


def dense_cells(ext: DataFrame) -> DataFrame:
    """Every cell of the index range; the rows are made in parallel, one strip of j per i."""
    n = spread_rows(ext.withColumn("i", F.explode(F.sequence("i0", "i1"))), "i")
    return n.withColumn("j", F.explode(F.sequence("j0", "j1"))).select("i", "j")


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key)


def cell_components(cells: DataFrame) -> DataFrame:
    """Components of cells that touch by side or corner: (i, j, root)."""
    cells = materialize(cells.select("i", "j"), "cells")
    near = cells.withColumn("o", F.explode(offsets(HALF_NEIGHBOURS[1:]))).select(
        F.col("i").alias("ax"), F.col("j").alias("ay"), (F.col("i") + F.col("o.dx")).alias("bx"), (F.col("j") + F.col("o.dy")).alias("by")
    )
    met = near.join(cells, (near.bx == cells.i) & (near.by == cells.j)).select("ax", "ay", "bx", "by")
    roots = components(cell_edges(met))
    ids = cells.withColumn("cell", pack_cell(F.col("i"), F.col("j")))
    return ids.join(roots, ids.cell == roots.id, "left").select("i", "j", F.coalesce("root", "cell").alias("root"))


def fill_blocks(grid: DataFrame, value: str, size: int, ext: DataFrame) -> DataFrame:
    """Multiquadric fill of nodata cells, block by block with a margin of one block.

    Known cells go to their own and the eight blocks around; a task solves one
    block from at most (3 size)^2 cells. Blocks without any known cell stay empty.
    """
    known = grid.select("i", "j", F.col(value).alias("v"), F.floor(F.col("i") / size).alias("bi"), F.floor(F.col("j") / size).alias("bj"))
    shared = known.withColumn("o", F.explode(offsets(AROUND9))).select(
        "i", "j", "v", (F.col("bi") + F.col("o.dx")).alias("bi"), (F.col("bj") + F.col("o.dy")).alias("bj")
    )
    gaps = dense_cells(ext).join(grid, ["i", "j"], "left_anti").select(
        "i", "j", F.lit(None).cast("double").alias("v"), F.floor(F.col("i") / size).alias("bi"), F.floor(F.col("j") / size).alias("bj")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        have, need = pdf[pdf["v"].notna()], pdf[pdf["v"].isna()]
        if have.empty or need.empty:
            return pd.DataFrame({"i": [], "j": [], "filled": []})
        z = multiquadric_fill(have[["i", "j"]].to_numpy(float), have["v"].to_numpy(), need[["i", "j"]].to_numpy(float), 1.0)
        return pd.DataFrame({"i": need["i"], "j": need["j"], "filled": z})

    rows = spread(shared.unionByName(gaps), "bi", "bj")
    return rows.groupBy("bi", "bj").applyInPandas(run, "i long, j long, filled double")


def nearest_fill(grid: DataFrame, value: str, wanted: DataFrame, first_reach: int = 4) -> DataFrame:
    """Value of the nearest known cell for each wanted cell (ties: lowest i, then j).

    Searches within a reach and doubles it for the cells that found nothing, so the
    result is exact without a limit on the distance.
    """
    known = grid.select("i", "j", F.col(value).alias("v"))
    found = None
    todo = materialize(wanted.select("i", "j"), "todo")
    reach = first_reach
    if known.isEmpty():
        return wanted.select("i", "j", F.lit(None).cast("double").alias("v"))
    while not todo.isEmpty():
        step = reach
        k = known.select(
            F.col("i").alias("ki"), F.col("j").alias("kj"), "v", F.floor(F.col("i") / step).alias("bi"), F.floor(F.col("j") / step).alias("bj")
        )
        t = todo.withColumn("o", F.explode(offsets(AROUND9))).select(
            "i", "j", (F.floor(F.col("i") / step) + F.col("o.dx")).alias("bi"), (F.floor(F.col("j") / step) + F.col("o.dy")).alias("bj")
        )
        d2 = (F.col("i") - F.col("ki")) * (F.col("i") - F.col("ki")) + (F.col("j") - F.col("kj")) * (F.col("j") - F.col("kj"))
        near = t.join(k, ["bi", "bj"]).withColumn("d2", d2).where(F.col("d2") <= reach * reach)
        best = near.groupBy("i", "j").agg(F.min_by("v", F.struct("d2", "ki", "kj")).alias("v"))
        best = materialize(best, "nearest")
        found = best if found is None else found.unionByName(best)
        todo = materialize(todo.join(best, ["i", "j"], "left_anti"), "todo")
        reach *= 2
    return found


def gaussian_blur(dense: DataFrame, value: str, sigma: float, ext: DataFrame) -> DataFrame:
    """Gaussian blur of a full grid, mirrored at the rim, one axis after the other."""
    r = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-r, r + 1)]
    weights = F.array(*[F.struct(F.lit(o).cast("long").alias("o"), F.lit(w / sum(raw)).alias("w")) for o, w in zip(range(-r, r + 1), raw)])
    out = dense.select("i", "j", F.col(value).alias("v"))
    for axis in ("i", "j"):
        lo, hi = F.col(f"{axis}0"), F.col(f"{axis}1")
        here = F.col(axis)
        places = F.array(here, 2 * lo - 1 - here, 2 * hi + 1 - here)
        sent = with_extent(out, ext).withColumn("p", F.explode(places)).withColumn("k", F.explode(weights))
        sent = sent.withColumn("t", F.col("p") - F.col("k.o")).where((F.col("t") >= lo) & (F.col("t") <= hi))
        other = "j" if axis == "i" else "i"
        out = sent.groupBy(F.col("t").alias(axis), other).agg(F.sum(F.col("v") * F.col("k.w")).alias("v"))
    return out.select("i", "j", "v")


def consecutive(df: DataFrame, value: str, width: float) -> DataFrame:
    """Distinct values, each with the next larger one.

    Ordered inside buckets of `width`; across buckets only their first values are
    ordered, so no task sees all values.
    """
    v = df.select(F.col(value).alias("v")).distinct().withColumn("b", F.floor(F.col("v") / width))
    firsts = v.groupBy("b").agg(F.min("v").alias("first"))
    firsts = firsts.withColumn("following", F.lead("first").over(Window.orderBy("b"))).drop("first")
    inner = v.withColumn("next", F.lead("v").over(Window.partitionBy("b").orderBy("v")))
    return inner.join(firsts, "b").select("v", F.coalesce("next", "following").alias("next"))
