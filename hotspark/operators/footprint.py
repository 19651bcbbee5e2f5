"""Footprints as sets of grid cells; set algebra becomes equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def footprint(points: DataFrame, keys: list[str], size: float, x_org: float = 0.0, y_org: float = 0.0) -> DataFrame:
    """Distinct cells (cx, cy) used by the points of each key."""
    return points.select(
        *keys,
        F.floor((F.col("x") - x_org) / size).cast("long").alias("cx"),
        F.floor((F.col("y") - y_org) / size).cast("long").alias("cy"),
    ).distinct()


def box_cells(boxes: DataFrame, keys: list[str], size: float, x_org: float = 0.0, y_org: float = 0.0) -> DataFrame:
    """Cells whose centre lies in the box."""

    def span(lo: str, hi: str, org: float):
        first = F.ceil((F.col(lo) - org) / size - 0.5).cast("long")
        last = (F.ceil((F.col(hi) - org) / size - 0.5) - 1).cast("long")
        return F.when(last >= first, F.sequence(first, last))

    return boxes.withColumn("cx", F.explode(span("x0", "x1", x_org))).withColumn(
        "cy", F.explode(span("y0", "y1", y_org))
    ).select(*keys, "cx", "cy")


def cell_sizes(cells: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Cell count, area (ha) and length of the outer edge of each footprint.

    Every cell sends one row to each of its four sides; a side met twice is inside.
    """
    sides = F.array(
        F.struct(F.lit("v").alias("o"), F.col("cx").alias("a"), F.col("cy").alias("b")),
        F.struct(F.lit("v").alias("o"), (F.col("cx") + 1).alias("a"), F.col("cy").alias("b")),
        F.struct(F.lit("h").alias("o"), F.col("cx").alias("a"), F.col("cy").alias("b")),
        F.struct(F.lit("h").alias("o"), F.col("cx").alias("a"), (F.col("cy") + 1).alias("b")),
    )
    met = cells.select(*keys, F.explode(sides).alias("s")).groupBy(*keys, "s").agg(F.count("*").alias("n"))
    # each cell gives four sides, so the sides counted with multiplicity are four times the cells
    return met.groupBy(*keys).agg(
        (F.sum("n") / 4).cast("long").alias("cells"),
        (F.sum("n") / 4 * F.lit(size * size) / 1e4).alias("area_ha"),
        (F.count_if(F.col("n") == 1) * F.lit(size)).alias("perimeter_m"),
    )


def overlap_cells(a: DataFrame, ka: str, b: DataFrame, kb: str) -> DataFrame:
    """Shared cells of each pair of footprints, and their share of b."""
    nb = b.groupBy(kb).agg(F.count("*").alias("_nb"))
    shared = a.join(b, ["cx", "cy"]).groupBy(ka, kb).agg(F.count("*").alias("shared"))
    return shared.join(nb, kb).withColumn("ratio", F.col("shared") / F.col("_nb")).drop("_nb")


def union_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.select(*keys, "cx", "cy").distinct()


def subtract_cells(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "left_anti")


def dilate(cells: DataFrame, keys: list[str], reach: int = 1) -> DataFrame:
    """Cells within `reach` cells, diagonals included."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    return (
        cells.withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span))
        .select(*keys, (F.col("cx") + F.col("_dx")).alias("cx"), (F.col("cy") + F.col("_dy")).alias("cy"))
        .distinct()
    )
