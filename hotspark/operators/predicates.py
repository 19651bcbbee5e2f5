"""Predicates between polygons, and of points in polygons, without a polygon in one row.

A polygon is a set of rows: one for each tile that its outline crosses, with the edges
there and whether the tile's corner lies inside, and one for each tile that it covers
whole. Rows of two layers meet by tile; areas of the parts are whole numbers and are
summed over the tiles, so a ring of a million corners is worked on by many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from hotspark.functions import arrangement as A
from hotspark.operators.overlay import SNAP, _PIECE, Pieces, calls, corners, tiled
from hotspark.session import materialize


def half_steps(value: Column, snap: float = SNAP) -> Column:
    """A coordinate on the lattice, in half steps."""
    return F.rint(value / F.lit(snap)).cast("long") * 2


def edge_index(edges: DataFrame, key: str, tile: float, snap: float = SNAP) -> DataFrame:
    """(key, tx, ty, wind, pieces, x0, y0, x1, y1): the tiles of every polygon; covered ones have no pieces.

    `edges` has (key, x0, y0, x1, y1), or what polygon_edges gives. `wind` says how often the polygon winds around
    the tile's lower left corner, and the box is the whole polygon's, in half steps of the lattice. The table is written.
    """
    size = 2 * round(tile / snap)
    flat = edges.withColumn("layer", F.lit(0))
    pieces = materialize(tiled(flat, [key], tile, snap), "pieces")
    listed = pieces.groupBy(key, "tx", "ty").agg(F.collect_list(F.struct("layer", "ax", "ay", "bx", "by", "w")).cast(_PIECE).alias("pieces"))
    rows = corners(pieces, [key], size).select(key, "tx", "ty", F.col("wa").alias("wind"))
    before = F.lag("tx").over(Window.partitionBy(key, "ty").orderBy("tx"))
    gaps = rows.withColumn("_from", before + 1).where("_from < tx and wind <> 0")
    # the tiles between two that the outline crosses lie inside or outside as a whole
    covered = gaps.select(key, F.explode(F.sequence(F.col("_from"), F.col("tx") - 1)).alias("tx"), "ty", "wind", F.array().cast(_PIECE).alias("pieces"))
    crossed = listed.join(rows, [key, "tx", "ty"]).select(key, "tx", "ty", "wind", "pieces")
    box = pieces.groupBy(key).agg(
        F.min(F.least("ax", "bx")).alias("x0"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.max(F.greatest("ay", "by")).alias("y1"))
    return materialize(crossed.unionByName(covered).join(box, key), "edge-index")


def _wind_at(px: Column, py: Column, size: int) -> Column:
    """Winding number of a polygon's row around a point of its tile: up the left border, then east to the point."""
    left = F.col("tx") * size + 1

    def add(total, s):
        border = F.when((s.ax == left) & (s.ay <= py), s.w).otherwise(0)
        up = s.by > s.ay
        lx, ly, hx, hy = (F.when(up, p).otherwise(q) for p, q in ((s.ax, s.bx), (s.ay, s.by), (s.bx, s.ax), (s.by, s.ay)))
        east = (ly <= py) & (py < hy) & ((hx - lx) * (py - ly) - (hy - ly) * (px - lx) < 0)
        return total + border + F.when(east, F.when(up, -s.w).otherwise(s.w)).otherwise(F.lit(0).cast("long"))

    return F.aggregate("pieces", F.col("wind"), add)


def points_in_polygons(points: DataFrame, index: DataFrame, tile: float, snap: float = SNAP) -> DataFrame:
    """Rows of points (columns x, y and others) with the polygons' key, once for each polygon around the point.

    Points on an outline may fall either way; null coordinates lie nowhere. Only JVM functions are used.
    """
    size = 2 * round(tile / snap)
    at = points.withColumns({"_px": half_steps(F.col("x"), snap), "_py": half_steps(F.col("y"), snap)})
    at = at.withColumns({f"t{c}": F.floor((F.col(f"_p{c}") - 1) / size).cast("long") for c in "xy"})
    met = at.join(index.drop("x0", "y0", "x1", "y1"), ["tx", "ty"])
    inside = (F.size("pieces") == 0) | (_wind_at(F.col("_px"), F.col("_py"), size) != 0)
    return met.where(inside).drop("tx", "ty", "_px", "_py", "pieces", "wind")


def _areas(rows: DataFrame, keys: list[str], size: int, operation: str) -> DataFrame:
    """Twice the area of a result in every row's tile, for rows with wa, wb and pieces of both layers."""
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("twice", T.StringType())])

    def run(batches):
        for d in batches:
            column = {n: d.column(k) for k, n in enumerate(d.schema.names)}
            tx, ty, wa, wb = (column[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tx", "ty", "wa", "wb"))
            first, second = Pieces(column["pa"]), Pieces(column["pb"])
            twice = np.full(len(tx), 2 * size * size, np.int64)
            for i, j in calls(first.count, second.count):
                a, b, w = first.edges(i, j, tx, ty, size)
                c, e, v = second.edges(i, j, tx, ty, size)
                found = A.region_areas(np.vstack([a, c]), np.vstack([b, e]), np.vstack([w, v[:, ::-1]]), np.column_stack([wa, wb])[i:j], size, operation)
                crossed = first.count[i:j] + second.count[i:j] > 0
                twice[i:j][crossed] = found[crossed]
            yield pa.RecordBatch.from_arrays([*(column[k] for k in keys), pa.array([str(t) for t in twice.tolist()], pa.string())], names=[*keys, "twice"])

    return rows.select(*keys, "tx", "ty", "wa", "wb", "pa", "pb").mapInArrow(run, schema)


def _metres(snap: float) -> Column:
    """Square metres of a sum of doubled areas in half steps."""
    return F.sum(F.col("twice").cast("decimal(38,0)")).cast("double") * (snap * snap / 8)


def areas(index: DataFrame, key: str, tile: float, snap: float = SNAP) -> DataFrame:
    """(key, area) of every polygon of an index."""
    none = F.array().cast(_PIECE)
    rows = index.select(key, "tx", "ty", F.col("wind").alias("wa"), F.lit(0).cast("long").alias("wb"), F.col("pieces").alias("pa"), none.alias("pb"))
    return _areas(rows, [key], 2 * round(tile / snap), "only_a").groupBy(key).agg(_metres(snap).alias("area"))


def overlaps(a: DataFrame, a_key: str, b: DataFrame, b_key: str, tile: float, snap: float = SNAP) -> DataFrame:
    """(a_key, b_key, area) of every pair of polygons of two indexes that share ground."""
    boxes = [F.col(f"l.{p}0") < F.col(f"r.{p}1") for p in "xy"] + [F.col(f"r.{p}0") < F.col(f"l.{p}1") for p in "xy"]
    met = a.alias("l").join(b.alias("r"), (F.col("l.tx") == F.col("r.tx")) & (F.col("l.ty") == F.col("r.ty")) & boxes[0] & boxes[1] & boxes[2] & boxes[3])
    rows = met.select(
        F.col(f"l.{a_key}").alias(a_key), F.col(f"r.{b_key}").alias(b_key), "l.tx", "l.ty", F.col("l.wind").alias("wa"), F.col("r.wind").alias("wb"),
        F.col("l.pieces").alias("pa"), F.col("r.pieces").alias("pb"))
    return _areas(rows, [a_key, b_key], 2 * round(tile / snap), "both").groupBy(a_key, b_key).agg(_metres(snap).alias("area")).where("area > 0")


def relations(a: DataFrame, a_key: str, b: DataFrame, b_key: str, tile: float, snap: float = SNAP) -> DataFrame:
    """(a_key, b_key, area, share_a, share_b, a_within_b, b_within_a) of every pair that shares ground.

    A polygon lies within another if no ground of it lies outside, to the lattice's exactness.
    """
    own_a, own_b = areas(a, a_key, tile, snap).withColumnRenamed("area", "_a"), areas(b, b_key, tile, snap).withColumnRenamed("area", "_b")
    both = overlaps(a, a_key, b, b_key, tile, snap).join(own_a, a_key).join(own_b, b_key)
    return both.select(
        a_key, b_key, "area", (F.col("area") / F.col("_a")).alias("share_a"), (F.col("area") / F.col("_b")).alias("share_b"),
        (F.col("area") == F.col("_a")).alias("a_within_b"), (F.col("area") == F.col("_b")).alias("b_within_a"))
