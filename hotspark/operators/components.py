"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hotspark.session import materialize, spread


def _contract(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    """Edges between the parents of their ends, each once, loops dropped."""
    a = hooks.select(F.col("r").alias("src"), F.col("p").alias("_pa"))
    b = hooks.select(F.col("r").alias("dst"), F.col("p").alias("_pb"))
    moved = (
        edges.join(a, "src", "left")
        .join(b, "dst", "left")
        .select(F.coalesce("_pa", "src").alias("s"), F.coalesce("_pb", "dst").alias("d"))
        .where("s <> d")
    )
    return materialize(
        moved.select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).distinct(), "edges"
    )


def _lowest_label(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Smallest vertex number reachable from each of n vertices."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[src], label[dst])
        np.minimum.at(label, src, low)
        np.minimum.at(label, dst, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _join_inside(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, flat = np.unique(pdf[["src", "dst"]].to_numpy().ravel(), return_inverse=True)
    ends = flat.reshape(-1, 2)
    label = _lowest_label(ends[:, 0], ends[:, 1], len(ids))
    moved = label != np.arange(len(ids))
    return pd.DataFrame({"r": ids[moved], "p": ids[label[moved]]})


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each id that is not its own root; ids of a component share a root.

    Readers left-join it and take the id itself where nothing is found. `edges` has
    columns src, dst (long).

    An optional column `tile` marks edges whose two ends lie in the same tile.
    A tile must hold a bounded number of vertices (the callers use blocks of grid
    cells); its part of the graph is joined in one numpy call before the rounds.

    The rounds point every vertex's larger neighbours, then its smaller ones, at the
    smallest vertex it sees, until the graph is a set of stars; the number of rounds
    grows with the logarithm of the graph's size. Hubs are safe: minima are partial
    aggregates, and a vertex meets only its one minimum in a join. Every round is
    written out, so a lost executor never replays earlier rounds.
    """
    hooks = None
    if "tile" in edges.columns:
        inside = spread(edges.where("tile is not null"), "tile").groupBy("tile").applyInPandas(_join_inside, "r long, p long")
        hooks = materialize(inside, "hooks")
        # an edge inside a tile is settled; only the edges between tiles go on
        live = _contract(edges.where("tile is null").select("src", "dst"), hooks)
    else:
        live = edges.select("src", "dst")
    stars = _stars(live)
    if hooks is None:
        return stars.select(F.col("src").alias("id"), F.col("dst").alias("root"))
    later = stars.select(F.col("src").alias("_r2"), F.col("dst").alias("_p2"))
    moved = hooks.join(later, hooks.p == later._r2, "left").select("r", F.coalesce("_p2", "p").alias("p"))
    roots = moved.unionByName(stars.select(F.col("src").alias("r"), F.col("dst").alias("p")))
    return roots.select(F.col("r").alias("id"), F.col("p").alias("root"))


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex points at one smaller vertex, which points at none: then each star is a component."""
    again = edges.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").select("src")
    chained = edges.join(edges.select(F.col("dst").alias("_d")), F.col("src") == F.col("_d"), "left_semi").select("src")
    return again.union(chained).isEmpty()


def _stars(edges: DataFrame) -> DataFrame:
    """(src, dst): every vertex with the smallest vertex of its component, except that one itself."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src > dst")
    stars = materialize(down.distinct(), "edges")
    while not _settled(stars):
        both = stars.select("src", "dst").union(stars.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = materialize(large.where("src > dst").distinct(), "large-star")
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(low.select("src", F.col("m").alias("dst")))
        stars = materialize(small.where("src > dst").distinct(), "small-star")
    return stars
