"""Spatio-temporal matching of two sets of dated shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hotspark.functions.geom import area, box_area, box_center_distance, box_overlap, box_ring, c, centroid, overlap_area
from hotspark.operators.tiles import box_pairs

# Fixed value: distance (m) beyond which the distance part of the score falls to zero.
FAR_M = 5000.0


def candidates(
    a: DataFrame, b: DataFrame, a_id: str, b_id: str, a_ts: str, b_ts: str, base: float, max_days: float = 10.0,
    max_km: float = 50.0, min_iou: float = 0.01, weights: tuple[float, float, float] = (0.4, 0.3, 0.3),
    dist_score: str = "literal", mode: str = "boxes",
) -> DataFrame:
    """All scored pairs that pass the distance, time and overlap limits.

    A positive overlap limit already means that the shapes meet, so the boxes are
    then joined without the max_km margin; the join key carries a time bucket of
    max_days, which cuts the pairs before any geometry is computed. `dist_score`
    'literal' is the published form, always 0; 'linear' falls with distance.
    `mode` 'exact' uses polygons in a column `ring`, 'boxes' treats shapes as boxes.
    """
    width = max_days * 86400e6
    day_a = F.floor(F.unix_micros(F.col(a_ts).cast("timestamp")) / width).cast("long")
    day_b = F.floor(F.unix_micros(F.col(b_ts).cast("timestamp")) / width).cast("long")
    left = a.where(F.col(a_ts).isNotNull()).withColumn("_bucket", day_a)
    right = b.where(F.col(b_ts).isNotNull()).withColumn("_bucket", F.explode(F.array(day_b - 1, day_b, day_b + 1)))
    grow = 0.0 if min_iou > 0 else max_km * 1000.0
    pairs = box_pairs(left, right, base, grow, ["_bucket"])
    days = F.abs(F.unix_micros(c("a", a_ts).cast("timestamp")) - F.unix_micros(c("b", b_ts).cast("timestamp"))) / 86400e6
    if mode == "exact":
        ca, cb = centroid(F.col("a.ring")), centroid(F.col("b.ring"))
        far_m = F.sqrt((ca.x - cb.x) * (ca.x - cb.x) + (ca.y - cb.y) * (ca.y - cb.y))
        area_a, area_b = area(F.col("a.ring")), area(F.col("b.ring"))
    else:
        far_m, area_a, area_b = box_center_distance("a", "b"), box_area("a"), box_area("b")
    near = pairs.withColumns({"dt_days": days, "dist_m": far_m, "_area_a": area_a, "_area_b": area_b})
    near = near.where((F.col("dt_days") <= max_days) & (F.col("dist_m") <= max_km * 1000.0))
    if mode == "exact":
        near = near.withColumn("inter", overlap_area(F.array("a.ring"), F.array("b.ring")))
    else:
        near = near.withColumn("inter", box_overlap("a", "b"))
    union = F.col("_area_a") + F.col("_area_b") - F.col("inter")
    near = near.withColumn("iou", F.when(union > 0, F.col("inter") / union).otherwise(0.0)).where(F.col("iou") >= min_iou)
    time_part = 1.0 - F.least(F.col("dt_days"), F.lit(max_days)) / max_days
    far = FAR_M if dist_score == "literal" else max_km * 1000.0
    dist_part = F.lit(0.0) if dist_score == "literal" else 1.0 - F.least(F.col("dist_m"), F.lit(far)) / far
    wi, wd, wt = weights
    score = wi * F.col("iou") + wd * dist_part + wt * time_part
    return near.select(
        c("a", a_id).alias("a_id"), c("b", b_id).alias("b_id"), score.alias("score"), "iou", "dist_m", "dt_days", "inter",
        F.col("_area_a").alias("area_a"), F.col("_area_b").alias("area_b"),
    )


def preference() -> Column:
    """Ascending order key: score and overlap high first, distance low first, then id."""
    return F.struct(
        (-F.col("score")).alias("s"), (-F.col("iou")).alias("i"), F.col("dist_m").alias("d"), F.col("b_id").alias("b")
    )


def best_per_a(scored: DataFrame) -> DataFrame:
    """The preferred b of each a, as a partial aggregate."""
    rest = [x for x in scored.columns if x != "a_id"]
    return scored.groupBy("a_id").agg(F.min_by(F.struct(*rest), preference()).alias("m")).select("a_id", "m.*")


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, their standard errors, and the correlation."""
    s = df.agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
        F.avg(x).alias("mx"), F.corr(x, y).alias("corr"),
    )
    s2 = (F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2)
    return s.select(
        "n", "slope", "intercept", F.sqrt(s2 / F.col("sxx")).alias("slope_err"),
        F.sqrt(s2 * (1 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx"))).alias("intercept_err"), "corr",
    )


def with_rings(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("ring", box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
