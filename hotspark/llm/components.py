"""Connected components by alternating star operations.

Each round points every vertex's larger neighbours, then its smaller ones, at the
smallest vertex it sees. The minima are partial aggregates and a vertex of any degree
only meets its one minimum in a join, so no group of neighbours is gathered. Every
round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hotspark.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node.

    Null ends, loops and repeated edges do no harm; no edges give no rows.
    """
    def settled(df):
        """Whether every vertex points at one smaller vertex, which points at none: then each star is a component."""
        again = df.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        chained = df.join(df.select(F.col("v").alias("_v")), F.col("u") == F.col("_v"), "left_semi").select("u")
        return again.union(chained).isEmpty()

    stars = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct(), "edges")
    while not settled(stars):
        # large star: all larger neighbours of a vertex go to the smallest of its neighbourhood
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialize(large, "large-star")
        # small star: a vertex and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        stars = materialize(small, "small-star")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
