"""Rasters from shapes: shared power, first arrival, masks, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hotspark.functions import geom
from hotspark.operators.footprint import dilate


def _span(lo: Column, hi: Column, cell: float) -> Column:
    first = F.floor(lo / cell).cast("long")
    last = F.greatest(F.ceil(hi / cell).cast("long") - 1, first)
    return F.sequence(first, last)


def covered_cells(boxes: DataFrame, cell: float) -> DataFrame:
    """One row per (box, grid cell it meets) with the common area; plain index arithmetic."""
    c = boxes.withColumn("i", F.explode(_span(F.col("x0"), F.col("x1"), cell))).withColumn(
        "j", F.explode(_span(F.col("y0"), F.col("y1"), cell))
    )
    w = F.least(F.col("x1"), (F.col("i") + 1) * cell) - F.greatest(F.col("x0"), F.col("i") * cell)
    h = F.least(F.col("y1"), (F.col("j") + 1) * cell) - F.greatest(F.col("y0"), F.col("j") * cell)
    return c.withColumn("part", F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)))


def share_power(events: DataFrame, cell: float, domain: tuple[float, float, float, float], keys: list[str]) -> DataFrame:
    """Power of box events spread over grid cells by common area; `keys` such as the time are kept.

    What lies outside the domain does not count, so an event partly outside gives
    all its power to the cells inside. The total common area is the area of the
    clipped box, so no window or second pass is needed.
    """
    west, south, east, north = domain
    x0, y0 = F.greatest(F.col("x0"), F.lit(west)), F.greatest(F.col("y0"), F.lit(south))
    x1, y1 = F.least(F.col("x1"), F.lit(east)), F.least(F.col("y1"), F.lit(north))
    # plain comparisons, so that the scan can skip what lies outside
    near = events.where((F.col("x1") > west) & (F.col("x0") < east) & (F.col("y1") > south) & (F.col("y0") < north))
    inside = near.select(*keys, "frp", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    inside = inside.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    whole = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    parts = covered_cells(inside, cell).where("part > 0")
    return parts.groupBy(*keys, "i", "j").agg(F.sum(F.col("frp") * F.col("part") / whole).alias("frp"))


def share_power_polygons(events: DataFrame, cell: float, domain: tuple[float, float, float, float], keys: list[str], id_col: str) -> DataFrame:
    """The same for events with corners in `ring`: three or more are a polygon, two a line, one a point.

    Polygons are weighed by exact common areas, lines by the common length, a point
    gives all to its cell. What lies outside the domain does not count. A shape is
    told by `keys` and `id_col` together, so an id that is seen at several times keeps
    the power of each.
    """
    west, south, east, north = domain
    box = geom.bbox(F.col("ring"))
    boxed = events.select(*keys, id_col, "frp", "ring", F.size("ring").alias("_n"), box.x0.alias("x0"), box.y0.alias("y0"), box.x1.alias("x1"), box.y1.alias("y1"))
    near = boxed.where((F.col("x1") >= west) & (F.col("x0") <= east) & (F.col("y1") >= south) & (F.col("y0") <= north) & (F.col("_n") > 0))
    clipped = near.withColumns({
        "x0": F.greatest("x0", F.lit(west)), "y0": F.greatest("y0", F.lit(south)), "x1": F.least("x1", F.lit(east)), "y1": F.least("y1", F.lit(north))})
    cells = covered_cells(clipped, cell).drop("part").repartition("i", "j")
    cx0, cy0 = F.greatest(F.col("i") * cell, F.lit(west)), F.greatest(F.col("j") * cell, F.lit(south))
    cx1, cy1 = F.least((F.col("i") + 1) * cell, F.lit(east)), F.least((F.col("j") + 1) * cell, F.lit(north))
    square = geom.box_ring(cx0, cy0, cx1, cy1)
    area = cells.where("_n > 2").withColumn("part", geom.overlap_area(F.array("ring"), F.array(square)))
    p, q = F.col("ring")[0], F.col("ring")[1]
    length = F.sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))
    line = cells.where("_n = 2").withColumn("part", length * _inside_share(p, q, cx0, cy0, cx1, cy1))
    # a point, or a line without length, lies in the cell of its lower-left corner
    here = (F.floor(p.x / cell) == F.col("i")) & (F.floor(p.y / cell) == F.col("j"))
    point = cells.where("_n = 1").withColumn("part", F.when(here, F.lit(1.0)).otherwise(F.lit(0.0)))
    parts = area.unionByName(line).unionByName(point).where("part > 0").drop("ring", "_n")
    whole = parts.groupBy(*keys, id_col).agg(F.sum("part").alias("_whole"))  # the cells of one shape at one time
    shared = parts.join(whole, [*keys, id_col])
    return shared.groupBy(*keys, "i", "j").agg(F.sum(F.col("frp") * F.col("part") / F.col("_whole")).alias("frp"))


def _inside_share(p: Column, q: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Share of the segment p-q that lies in a box (a side shared by two boxes goes to the upper or right one)."""
    lo, hi = F.lit(0.0), F.lit(1.0)
    for a, b, low, high in ((p.x, q.x, x0, x1), (p.y, q.y, y0, y1)):
        d = b - a
        t0, t1 = (low - a) / d, (high - a) / d
        flat = F.when((a >= low) & (a < high), F.lit(0.0)).otherwise(F.lit(2.0))
        lo = F.greatest(lo, F.when(d == 0, flat).otherwise(F.least(t0, t1)))
        hi = F.least(hi, F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(t0, t1)))
    return F.greatest(hi - lo, F.lit(0.0))


def first_arrival(boxes: DataFrame, key: str, ts: str, cell: float, x_org: float, y_org: float) -> DataFrame:
    """First time each cell of an event is covered, and the time since the observation before.

    `boxes` has one row per (event, time); observations per event are few, cells are
    aggregated with a partial minimum.
    """
    w = Window.partitionBy(key).orderBy(ts)
    timed = boxes.withColumn("prev", F.lag(ts).over(w)).withColumn("start", F.min(ts).over(Window.partitionBy(key)))
    moved = timed.select(
        key, ts, "prev", "start", (F.col("x0") - x_org).alias("x0"), (F.col("y0") - y_org).alias("y0"),
        (F.col("x1") - x_org).alias("x1"), (F.col("y1") - y_org).alias("y1"),
    )
    cells = covered_cells(moved, cell).where("part > 0")
    return cells.groupBy(key, "i", "j").agg(F.min(F.struct(ts, "prev", "start")).alias("m")).select(key, "i", "j", "m.*")


def static_mask(points: DataFrame, industry: DataFrame, cell: float, threshold: int) -> DataFrame:
    """Cells with more than `threshold` points or touched by an industry box, grown by one cell."""
    dense = (
        points.groupBy(F.floor(F.col("x") / cell).cast("long").alias("cx"), F.floor(F.col("y") / cell).cast("long").alias("cy"))
        .count().where(F.col("count") > threshold).select("cx", "cy")
    )
    touched = industry.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / cell).cast("long"), F.floor(F.col("x1") / cell).cast("long"))))
    touched = touched.withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / cell).cast("long"), F.floor(F.col("y1") / cell).cast("long"))))
    return dilate(dense.unionByName(touched.select("cx", "cy")), [])


def resample_area(grid: DataFrame, value: str, step: float, cell: float) -> DataFrame:
    """Area-weighted value and coverage of coarser or finer cells (both grids start at 0)."""
    boxes = grid.select(
        (F.col("i") * step).alias("x0"), (F.col("j") * step).alias("y0"), ((F.col("i") + 1) * step).alias("x1"),
        ((F.col("j") + 1) * step).alias("y1"), F.col(value).alias("v"),
    )
    parts = covered_cells(boxes, cell).where("part > 0").withColumn("w", F.col("part") / (cell * cell))
    return parts.groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("value"), F.sum("w").alias("coverage"))
