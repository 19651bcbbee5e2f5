"""Outlines of point clusters: convex hull and alpha shape."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hotspark.functions.kernels import alpha_triangles, convex_hull, nearest_other, ring_area
from hotspark.operators.cluster import offsets
from hotspark.session import materialize, spread

# Points handed to one hull call; a larger group is reduced in several passes.
HULL_CHUNK = 20_000


#: Points that one call on many groups takes, about; a group is never cut.
CALL_POINTS = 1 << 13


def _by_group(rows: DataFrame, by: list[str], values: list[str], work, schema: str) -> DataFrame:
    """`work` on all groups of `rows`, many in a call.

    It is given (lists of the values, one array a group; columns of the groups) as flat
    arrays with the groups' sizes, and returns (group of each row, columns). A group is
    one row on the way, so small ones cost no data frame each.
    """
    names = [c for c in rows.columns if c in by]
    listed = spread(rows, *by).groupBy(*names).agg(F.collect_list(F.struct(*values)).alias("_rows"))
    fields = T._parse_datatype_string(schema).fields

    def run(batches):
        for d in batches:
            column = {n: d.column(k) for k, n in enumerate(d.schema.names)}
            count = column["_rows"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column["_rows"].flatten()
            value = {c: flat.field(c) for c in values}
            end = np.cumsum(count)
            block = (end - 1) // CALL_POINTS
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(count)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                part = slice(int(end[i] - count[i]), int(end[j - 1]))
                group, new = work({c: v[part] for c, v in value.items()}, count[i:j], {c: column[c][i:j] for c in names})
                at = pa.array(np.asarray(group, np.int64) + i)
                out = {f.name: new[f.name] if f.name in new else column[f.name].take(at) for f in fields}
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names=list(out))

    return listed.mapInArrow(run, schema)


def _points(value: dict, count: np.ndarray) -> list[np.ndarray]:
    """The places of each group."""
    xy = np.column_stack([value[c].to_numpy(zero_copy_only=False) for c in "xy"])
    return np.split(xy, np.cumsum(count)[:-1])


def _partial_hull(value: dict, count: np.ndarray, group: dict):
    rings = [convex_hull(p) for p in _points(value, count)]
    size = np.array([len(r) for r in rings])
    n = np.zeros(size.sum(), np.int64)
    n[np.cumsum(size) - size] = np.add.reduceat(value["n"].to_numpy(zero_copy_only=False), np.cumsum(count) - count)
    xy = np.concatenate(rings)
    return np.repeat(np.arange(len(rings)), size), {"x": xy[:, 0], "y": xy[:, 1], "n": n}


def _last_hull(value: dict, count: np.ndarray, group: dict):
    rings = [convex_hull(p) for p in _points(value, count)]
    kinds = [{1: "Point", 2: "LineString"}.get(len(r), "Polygon") for r in rings]
    xy = np.concatenate(rings)
    places = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rings])]), pa.int32())
    return np.arange(len(rings)), {
        "n_points": np.add.reduceat(value["n"].to_numpy(zero_copy_only=False), np.cumsum(count) - count),
        "kind": kinds,
        "area": [float(ring_area(r)) if k == "Polygon" else 0.0 for r, k in zip(rings, kinds)],
        "ring": pa.ListArray.from_arrays(offsets, places),
    }


def convex_outline(points: DataFrame, keys: list[str]) -> DataFrame:
    """Convex hull of each key's points.

    The hull of hulls is the hull: groups above HULL_CHUNK points are first cut by
    hash into chunks of that size and reduced to their corners, again and again
    until the corners of a group fit one call or no longer get fewer (they are then
    the hull itself, which is one row in any case).
    """
    types = dict(points.dtypes)
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)
    live = points.select(*keys, "x", "y", F.lit(1).cast("long").alias("n"))
    before = None
    while True:
        sizes = materialize(
            live.groupBy(*keys).count().where(F.col("count") > HULL_CHUNK)
            .select(*keys, F.ceil(F.col("count") / HULL_CHUNK).cast("int").alias("_chunks")), "sizes"
        )
        if sizes.isEmpty():
            break
        now = live.count()
        if before is not None and now >= before:
            break
        before = now
        tagged = live.join(sizes, keys, "left").withColumn(
            "_c", F.pmod(F.xxhash64("x", "y"), F.coalesce("_chunks", F.lit(1))).cast("int")
        )
        live = materialize(
            _by_group(tagged, [*keys, "_c"], ["x", "y", "n"], _partial_hull, f"{key_schema}, x double, y double, n long"), "hull"
        )
    return _by_group(
        live, keys, ["x", "y", "n"], _last_hull, f"{key_schema}, n_points long, kind string, area double, ring array<struct<x:double,y:double>>"
    )


def nearest_distance(points: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Distance of each point to its nearest other point of the same key within `reach`.

    Points are replicated to the neighbour tiles that can need them, so a task sees
    one tile of one cluster with its margin.
    """
    def work(value: dict, count: np.ndarray, group: dict):
        own = value["own"].to_numpy(zero_copy_only=False)
        mine = np.split(own, np.cumsum(count)[:-1])
        sets = _points(value, count)
        d = np.concatenate([nearest_other(p[m], p) if m.any() else np.zeros(0) for p, m in zip(sets, mine)])
        xy, near = np.concatenate(sets)[own], np.isfinite(d)
        return np.repeat(np.arange(len(count)), count)[own][near], {"x": xy[near, 0], "y": xy[near, 1], "nn": d[near]}

    types = dict(points.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", x double, y double, nn double"
    return _by_group(tile_with_margin(points, 4 * reach, reach), [*keys, "tx", "ty"], ["x", "y", "own"], work, schema)


def tile_with_margin(points: DataFrame, size, margin) -> DataFrame:
    """One row per (point, tile whose margin holds it); `own` marks the home tile.

    Size and margin are numbers or columns.
    """
    size = size if isinstance(size, Column) else F.lit(float(size))
    margin = margin if isinstance(margin, Column) else F.lit(float(margin))
    home = [F.floor(F.col(c) / size).cast("long") for c in ("x", "y")]
    around = offsets([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    tx, ty = F.col("_hx") + F.col("o.dx"), F.col("_hy") + F.col("o.dy")
    inside = (
        (F.col("x") >= tx * size - margin) & (F.col("x") < (tx + 1) * size + margin)
        & (F.col("y") >= ty * size - margin) & (F.col("y") < (ty + 1) * size + margin)
    )
    return (
        points.withColumn("_hx", home[0]).withColumn("_hy", home[1]).withColumn("o", F.explode(around))
        .where(inside)
        .withColumn("own", (F.col("o.dx") == 0) & (F.col("o.dy") == 0))
        .withColumn("tx", tx).withColumn("ty", ty)
        .drop("_hx", "_hy", "o")
    )


# Clusters above so many points are tried with half the alpha while no triangle is
# left, and the alpha below which that ends.
BACK_OFF_ABOVE, LEAST_ALPHA = 10, 4e-4


def _triangles(scaled: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Triangles of circumradius below `r` of each cluster, from tiles with a margin; written out."""
    types = dict(scaled.dtypes)
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)

    def work(value: dict, count: np.ndarray, group: dict):
        first = np.cumsum(count) - count
        r, d_min = (value[c].to_numpy(zero_copy_only=False)[first] for c in ("r", "d_min"))
        tri, centre, of = alpha_triangles(_points(value, count), r, d_min / 4)
        home = np.floor(centre / (tile * r[of])[:, None]).astype(int)
        tx, ty = (group[c].to_numpy(zero_copy_only=False)[of] for c in ("tx", "ty"))
        mine = (home[:, 0] == tx) & (home[:, 1] == ty)
        tri = np.round(tri[mine], 6)
        places = [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)]
        return of[mine], {"abcdef"[n]: np.ascontiguousarray(tri[:, c, axis]) for n, (c, axis) in enumerate(places)}

    tiles = tile_with_margin(scaled, F.col("r") * tile, F.col("r") * 3)
    # a cluster's r and d_min stand in each of its points
    tris = _by_group(tiles, [*keys, "tx", "ty"], ["x", "y", "r", "d_min"], work, key_schema + ", a double, b double, c double, d double, e double, f double")
    return materialize(tris, "triangles")


def chain(edges: list[tuple[tuple[float, float], tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings (without the repeated corner) through edges of which every corner has an even number; largest first."""
    at: dict[tuple[float, float], set[tuple[float, float]]] = {}
    for u, v in edges:
        at.setdefault(u, set()).add(v)
        at.setdefault(v, set()).add(u)
    rings = []
    for start in sorted(at):
        while at[start]:
            ring, here = [start], start
            while True:
                there = min(at[here])
                at[here].discard(there)
                at[there].discard(here)
                if there == start or not at[there]:
                    break
                ring.append(there)
                here = there
            if len(ring) > 2:
                rings.append(ring)
    return sorted(rings, key=lambda r: (-ring_area(np.array(r)), r))


def alpha_outline(points: DataFrame, keys: list[str], eps: float, tile: int = 24) -> DataFrame:
    """Alpha shape of each cluster with alpha = 1 / mean nearest-neighbour distance.

    Clusters of at most four points get their convex hull. Others: every point is
    inflated to an octagon of a quarter of the smallest neighbour distance, and a
    Delaunay triangle is kept when its circumradius is below the mean distance.
    Such a triangle depends only on points within one diameter, so tiles with that
    margin find exactly the triangles of the whole cluster; a triangle belongs to
    the tile of its circumcentre (a tile is `tile` mean distances
    wide, so it holds about the same number of points in sparse and dense clusters). Area is the sum of the triangles and the boundary
    is the edges used once, both plain aggregates. A cluster of more than ten points
    without any triangle is tried again with half the alpha, down to a least alpha;
    one that is still left, or a smaller one, falls back to its hull. `rings` are the
    closed boundary rings, outer ones and holes, largest first.
    """
    hulls = materialize(convex_outline(points, keys), "hulls")
    big = hulls.where("n_points > 4").select(*keys, "n_points")
    pts = points.join(big, keys)
    nn = nearest_distance(pts.drop("n_points"), keys, eps).groupBy(*keys).agg(F.min("nn").alias("d_min"), F.avg("nn").alias("r"))
    spacing = materialize(nn.join(big, keys), "spacing")
    sites = pts.select(*keys, "x", "y")
    tris = _triangles(sites.join(spacing, keys), keys, tile)
    # a handful of rounds: the radius doubles between the mean distance and 1 / LEAST_ALPHA
    still = spacing.where(F.col("n_points") > BACK_OFF_ABOVE).join(tris.select(*keys).distinct(), keys, "left_anti")
    still = materialize(still.where(1.0 / F.col("r") > LEAST_ALPHA), "empty")
    while not still.isEmpty():
        wider = still.withColumn("r", F.col("r") * 2)
        more = _triangles(sites.join(wider, keys), keys, tile)
        tris = tris.unionByName(more)
        still = wider.join(more.select(*keys).distinct(), keys, "left_anti")
        still = materialize(still.where(1.0 / F.col("r") > LEAST_ALPHA), "empty")
    area = tris.groupBy(*keys).agg(
        F.sum(F.abs((F.col("c") - F.col("a")) * (F.col("f") - F.col("b")) - (F.col("e") - F.col("a")) * (F.col("d") - F.col("b"))) / 2).alias("area")
    )

    def edge(p: tuple[str, str], q: tuple[str, str]):
        u = F.struct(F.col(p[0]).alias("x"), F.col(p[1]).alias("y"))
        v = F.struct(F.col(q[0]).alias("x"), F.col(q[1]).alias("y"))
        return F.struct(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))

    e = F.array(edge(("a", "b"), ("c", "d")), edge(("c", "d"), ("e", "f")), edge(("e", "f"), ("a", "b")))
    rim = materialize(tris.select(*keys, F.explode(e).alias("e")).groupBy(*keys, "e").count().where("count = 1").select(*keys, "e"), "rim")
    length = rim.groupBy(*keys).agg(
        F.sum(F.hypot(F.col("e.v.x") - F.col("e.u.x"), F.col("e.v.y") - F.col("e.u.y"))).alias("length"), F.count("*").alias("edges")
    )
    types = dict(points.dtypes)
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)

    def rings_of(value: dict, count: np.ndarray, group: dict):
        ends = [value[e].field(c).to_numpy(zero_copy_only=False).tolist() for e in "uv" for c in "xy"]
        edges = [((a, b), (c, d)) for a, b, c, d in zip(*ends)]
        last = np.cumsum(count).tolist()
        rings = [chain(edges[i:j]) for i, j in zip([0, *last], last)]
        told = [[[{"x": x, "y": y} for x, y in r] for r in shape] for shape in rings]
        place = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        return np.arange(len(count)), {"_rings": pa.array(told, pa.list_(pa.list_(place)))}

    # one outline is one row, so its corners meet in one call
    rings = _by_group(rim.select(*keys, "e.u", "e.v"), keys, ["u", "v"], rings_of, f"{key_schema}, _rings array<array<struct<x:double,y:double>>>")
    shape = area.join(length, keys).join(rings, keys).select(*keys, F.col("area").alias("_a"), "length", "edges", "_rings")
    return hulls.join(shape, keys, "left").select(
        *keys, "n_points",
        F.when(F.col("_a").isNotNull(), F.lit("Polygon")).otherwise(F.col("kind")).alias("kind"),
        F.coalesce("_a", "area").alias("area"), "length", "edges", F.coalesce("_rings", F.array("ring")).alias("rings"),
    )
