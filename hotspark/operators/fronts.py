"""Links between earlier and later front cells, and the times they give to cells between."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hotspark.operators.cluster import distance_pairs
from hotspark.operators.ranking import number_rows
from hotspark.session import materialize

# Shortest link (cells), tolerance on the shortest link, spread of directions (rad).
MIN_LINK = 2.0
LINK_SLACK = 1.2
MAX_SPREAD = 0.698


def _path(pairs: DataFrame) -> DataFrame:
    """Cells within half a cell of the segment (ai, aj) - (bi, bj) of each pair, ends included."""
    di, dj = F.col("bi") - F.col("ai"), F.col("bj") - F.col("aj")

    def span(d):
        return F.sequence(F.least(d, F.lit(0)), F.greatest(d, F.lit(0)))

    steps = pairs.withColumn("u", F.explode(span(di))).withColumn("v", F.explode(span(dj)))
    off = F.abs(di * F.col("v") - dj * F.col("u")) / F.col("dist")
    return steps.where(off <= 0.5).withColumn("i", F.col("ai") + F.col("u")).withColumn("j", F.col("aj") + F.col("v"))


def front_links(fronts: DataFrame, known: DataFrame, limit: float, min_step: float, cell: float) -> DataFrame:
    """Links (a earlier, b later) between front cells.

    A link is 2 to `limit` cells long, its cells in between have no time of their
    own, and it is among the shortest (within 1.2) of its later or of its earlier
    end. Links faster than the 99 % quantile are dropped.
    """
    f = materialize(fronts.select("i", "j", "t"), "fronts")
    pts = f.select(F.struct("i", "j", "t").alias("id"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"))
    near = distance_pairs(pts, limit).where(F.col("dist") >= MIN_LINK)
    forward = F.col("a.t") <= F.col("b.t")
    link = near.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("e"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("l"), "dist")
    link = link.where(F.col("l.t") - F.col("e.t") > min_step).select(
        F.col("e.i").alias("ai"), F.col("e.j").alias("aj"), F.col("e.t").alias("at"), F.col("l.i").alias("bi"), F.col("l.j").alias("bj"),
        F.col("l.t").alias("bt"), "dist",
    )
    link = materialize(link, "links")
    ends = ["ai", "aj", "bi", "bj"]
    inner = _path(link).where(
        ~((F.col("i") == F.col("ai")) & (F.col("j") == F.col("aj"))) & ~((F.col("i") == F.col("bi")) & (F.col("j") == F.col("bj")))
    )
    k = known.select("i", "j", F.lit(1).alias("hit"))
    # one row per link: how many cells lie between, and how many of them are taken
    tested = inner.join(k, ["i", "j"], "left").groupBy(*ends).agg(F.count("*").alias("cells"), F.count("hit").alias("taken"))
    clear = link.join(tested.where("taken = 0"), ends).drop("taken")
    clear = materialize(clear.withColumn("speed", F.lit(cell) * F.col("dist") / (F.col("bt") - F.col("at"))), "links")
    back = clear.groupBy("bi", "bj").agg((F.min("dist") * LINK_SLACK).alias("reach"))
    ahead = clear.groupBy("ai", "aj").agg((F.min("dist") * LINK_SLACK).alias("reach2"))
    kept = clear.join(back, ["bi", "bj"]).join(ahead, ["ai", "aj"]).where(
        (F.col("dist") < F.col("reach")) | (F.col("dist") < F.col("reach2"))
    )
    kept = materialize(kept.drop("reach", "reach2"), "links")
    # the exact quantile, from positions in a range sort
    placed = number_rows(kept.select("speed"), ["speed"], "_at")
    rank = F.greatest(F.lit(1), F.ceil(F.lit(0.99) * F.max("_at")))
    # one row each
    top = placed.join(F.broadcast(placed.agg(rank.alias("_rank"))), F.col("_at") == F.col("_rank")).select(F.col("speed").alias("_top"))
    return kept.crossJoin(F.broadcast(top)).where(F.col("speed") <= F.col("_top")).drop("_top")


def times_between(links: DataFrame) -> DataFrame:
    """Mean time of the cells crossed by links, where the directions of the links agree."""
    p = _path(links)
    along = F.sqrt((F.col("i") - F.col("ai")) * (F.col("i") - F.col("ai")) + (F.col("j") - F.col("aj")) * (F.col("j") - F.col("aj")))
    p = p.withColumn("t", F.col("at") + along / F.col("dist") * (F.col("bt") - F.col("at")))
    p = p.withColumn("ux", F.col("bi") - F.col("ai")).withColumn("uy", F.col("bj") - F.col("aj"))
    mean = p.groupBy("i", "j").agg(F.avg("t").alias("t"), F.count("*").alias("n"), F.avg("ux").alias("mx"), F.avg("uy").alias("my"))
    turn = p.select("i", "j", "ux", "uy", "dist").join(mean.where("n > 2 and mx * mx + my * my > 0"), ["i", "j"])
    cos = (F.col("ux") * F.col("mx") + F.col("uy") * F.col("my")) / (F.col("dist") * F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my")))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(cos, 9)))
    spread = turn.groupBy("i", "j").agg(F.stddev_pop(F.acos(cos)).alias("spread"))
    out = mean.join(spread, ["i", "j"], "left")
    return out.where(F.col("spread").isNull() | (F.col("spread") <= MAX_SPREAD)).select("i", "j", "t", "n", "spread")
