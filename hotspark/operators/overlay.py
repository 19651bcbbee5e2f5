"""Overlay of polygon layers that returns shapes, as a planar arrangement in tiles.

Outlines are snapped to a fine lattice and cut at the borders of tiles, which run
between the lattice lines. Equal edges collapse before any shuffle. How often each
layer covers a tile's corner follows from the edges that cross the lower border of its
row of tiles, summed from the west; so no polygon needs to be in one place, however
many corners it has. A task arranges the edges of one tile: it cuts them at their
crossings, labels both sides of every edge, keeps the edges that bound the result and
chains them into paths. Paths that end at a border are joined by ever larger tiles,
by their ends only; the corners move once, when a ring's paths come together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from hotspark.functions import arrangement as A, geom
from hotspark.operators.tiles import box_pairs
from hotspark.session import materialize, spread

#: Lattice step in metres.
SNAP = 1e-3
#: A tile of the next larger kind has so many tiles along each side.
GROW = 16

_PIECE = "array<struct<layer:int,ax:long,ay:long,bx:long,by:long,w:long>>"


def polygon_edges(shapes: DataFrame, keys: list[str], layer: int, ring: Column, holes: Column | None = None) -> DataFrame:
    """(keys, layer, x0, y0, x1, y1): the sides of simple rings, with the polygon on the left.

    `holes` is an array of rings inside `ring`. Rings of less than three corners have no
    sides; null rings and corners without coordinates neither.
    """
    ccw = F.when(F.size(ring) >= 3, geom.oriented(ring))
    rings = F.array(ccw)
    if holes is not None:
        rings = F.concat(rings, F.transform(F.coalesce(holes, F.array().cast(holes_type(shapes, holes))), lambda h: F.reverse(geom.oriented(h))))
    one = shapes.select(*keys, F.explode(rings).alias("_r")).where(F.size("_r") >= 3)
    nxt = F.concat(F.slice("_r", F.lit(2), F.size("_r")), F.slice("_r", 1, 1))
    sides = one.select(*keys, F.explode(F.arrays_zip(F.col("_r").alias("p"), nxt.alias("q"))).alias("s"))
    out = sides.select(*keys, F.lit(layer).alias("layer"), *(F.col(f"s.{e}.{c}").cast("double").alias(f"{c}{i}") for i, e in ((0, "p"), (1, "q")) for c in "xy"))
    return out.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")


def holes_type(shapes: DataFrame, holes: Column) -> T.DataType:
    return shapes.select(holes.alias("h")).schema["h"].dataType


def tiled(edges: DataFrame, keys: list[str], tile: float, snap: float = SNAP) -> DataFrame:
    """(keys, layer, tx, ty, ax, ay, bx, by, w): edges cut at the tiles' borders, each once, with its weight.

    Places are in half steps of the lattice: corners are even, borders odd. The cuts of
    an edge do not depend on its direction, so edges shared by two shapes stay equal.
    """
    size = 2 * round(tile / snap)
    key_fields = [edges.schema[k] for k in keys]
    longs = ["tx", "ty", "ax", "ay", "bx", "by", "w"]
    schema = T.StructType([*key_fields, T.StructField("layer", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in longs)])

    def run(pieces):
        for d in pieces:
            p = np.rint(d[["x0", "y0"]].to_numpy(float) / snap).astype(np.int64) * 2
            q = np.rint(d[["x1", "y1"]].to_numpy(float) / snap).astype(np.int64) * 2
            swap = (p[:, 0] > q[:, 0]) | ((p[:, 0] == q[:, 0]) & (p[:, 1] > q[:, 1]))
            a, b = np.where(swap[:, None], q, p), np.where(swap[:, None], p, q)
            first, last = (a - 1) // size, (b - 1) // size
            step = last - first
            n = np.abs(step)
            # crossings with vertical borders and with level ones, along each edge
            parts = []
            for axis in (0, 1):
                e = np.repeat(np.arange(len(a)), n[:, axis])
                k = np.arange(len(e)) - np.repeat(np.cumsum(n[:, axis]) - n[:, axis], n[:, axis])
                up = step[e, axis] > 0
                border = np.where(up, first[e, axis] + 1 + k, first[e, axis] - k) * size + 1
                t = (border - a[e, axis]) / (b[e, axis] - a[e, axis])
                parts.append((e, t, np.full(len(e), axis), border))
            e, t, axis, border = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((axis, t, e))
            e, t, axis, border = e[order], t[order], axis[order], border[order]
            # the tile before each crossing, counted along the edge, bounds the other coordinate
            start = np.searchsorted(e, np.arange(len(a)))
            at = np.empty((len(e), 2), np.int64)
            for ax in (0, 1):
                gone = np.concatenate([[0], np.cumsum(np.where(axis == ax, np.sign(step[e, ax]), 0))])
                at[:, ax] = first[e, ax] + gone[:-1] - gone[start[e]] if len(e) else 0
            place = np.empty((len(e), 2), np.int64)
            for ax in (0, 1):
                other = 1 - ax
                rows = axis == ax
                v = a[e[rows], other] + t[rows] * (b[e[rows], other] - a[e[rows], other])
                place[rows, ax] = border[rows]
                place[rows, other] = np.clip(2 * np.rint(v / 2).astype(np.int64), at[rows, other] * size + 2, (at[rows, other] + 1) * size)
            count = np.bincount(e, minlength=len(a))
            row = np.repeat(np.arange(len(a)), count + 1)
            head, tail = np.empty((len(row), 2), np.int64), np.empty((len(row), 2), np.int64)
            begin = np.cumsum(count + 1) - (count + 1)
            cut_at = begin[e] + np.arange(len(e)) - start[e] if len(e) else np.zeros(0, np.int64)
            head[begin] = a
            head[cut_at + 1] = place
            tail[begin + count] = b
            tail[cut_at] = place
            cell = np.empty((len(row), 2), np.int64)
            cell[begin + count] = last
            cell[cut_at] = at
            out = {k: d[k].to_numpy()[row] for k in keys} | {"layer": d["layer"].to_numpy()[row]}
            for i, name in enumerate("xy"):
                out |= {f"t{name}": cell[:, i], f"a{name}": head[:, i], f"b{name}": tail[:, i]}
            out["w"] = np.where(swap, -1, 1)[row]
            found = pd.DataFrame(out)
            yield found[(found.ax != found.bx) | (found.ay != found.by)][[*keys, "layer", *longs]]

    cut = edges.dropna(subset=keys or None, how="any").select(*keys, "layer", "x0", "y0", "x1", "y1").mapInPandas(run, schema)
    return cut.groupBy(*keys, "layer", *longs[:-1]).agg(F.sum("w").alias("w")).where("w <> 0")


def corners(pieces: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, tx, ty, wa, wb): how often each layer winds around the lower left corner of every tile with edges.

    An edge that falls through the lower border of a row of tiles adds one to all
    corners east of it, one that rises takes one away.
    """
    bottom = F.col("ty") * size + 1
    falls = F.when(F.col("ay") == bottom, -F.col("w")).when(F.col("by") == bottom, F.col("w")).otherwise(0)
    rows = pieces.groupBy(*keys, "ty", "tx").agg(*(F.sum(F.when(F.col("layer") == k, falls).otherwise(0)).alias(f"c{n}") for k, n in ((0, "a"), (1, "b"))))
    west = Window.partitionBy(*keys, "ty").orderBy("tx").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*keys, "tx", "ty", *(F.coalesce(F.sum(f"c{n}").over(west), F.lit(0)).alias(f"w{n}") for n in "ab"))


#: Edges of tiles that are arranged in one call, about; a tile is never cut.
CALL_EDGES = 1 << 15


def calls(*counts: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with about CALL_EDGES edges each."""
    total = np.cumsum(sum(counts))
    block = (total - 1) // CALL_EDGES
    cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(total)]
    return [(i, j) for i, j in zip(cuts, cuts[1:]) if j > i]


class Pieces:
    """An Arrow column of pieces as flat arrays."""

    def __init__(self, column: pa.Array):
        self.count = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.end = np.cumsum(self.count)
        flat = column.flatten()
        self.flat = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("layer", "ax", "ay", "bx", "by", "w")}

    def edges(self, i: int, j: int, tx: np.ndarray, ty: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends and weights of the edges of rows i to j - 1, with the rows' tiles set up for one call."""
        part = slice(int(self.end[i] - self.count[i]), int(self.end[j - 1]))
        tile = np.repeat(np.arange(j - i), self.count[i:j])
        v = {c: x[part] for c, x in self.flat.items()}
        own = tile * A.stride(size) - 1
        dx, dy = own - tx[i:j][tile] * size, own - ty[i:j][tile] * size
        w = np.where(v["layer"][:, None] == [0, 1], v["w"][:, None], 0).astype(np.int64)
        return np.column_stack([v["ax"] + dx, v["ay"] + dy]), np.column_stack([v["bx"] + dx, v["by"] + dy]), w


def paths(edges: DataFrame, keys: list[str], operations: list[str], tile: float, snap: float = SNAP) -> DataFrame:
    """(keys, operation, tx, ty, id, closed, xs, ys): the outlines of the results, cut at the tiles' borders."""
    size = 2 * round(tile / snap)
    pieces = materialize(tiled(edges, keys, tile, snap), "pieces")
    listed = spread(pieces, *keys, "tx", "ty").groupBy(*keys, "tx", "ty").agg(F.collect_list(F.struct("layer", "ax", "ay", "bx", "by", "w")).cast(_PIECE).alias("pieces"))
    rows = listed.join(corners(pieces, keys, size), [*keys, "tx", "ty"])
    fields = [*(edges.schema[k] for k in keys), T.StructField("operation", T.StringType()), T.StructField("tx", T.LongType()), T.StructField("ty", T.LongType()),
              T.StructField("closed", T.BooleanType()), T.StructField("xs", T.ArrayType(T.LongType())), T.StructField("ys", T.ArrayType(T.LongType()))]

    def run(batches):
        for d in batches:
            column = {n: d.column(k) for k, n in enumerate(d.schema.names)}
            tx, ty = (column[c].to_numpy(zero_copy_only=False) for c in ("tx", "ty"))
            wind = np.column_stack([column[c].to_numpy(zero_copy_only=False) for c in ("wa", "wb")]).astype(np.int64)
            pieces = Pieces(column["pieces"])
            for i, j in calls(pieces.count):
                a, b, w = A.split(*pieces.edges(i, j, tx, ty, size), size)
                left, right = A.windings(a, b, w, wind[i:j], size)
                for op in operations:
                    p, q = A.outline(a, b, left, right, op)
                    walk, count, closed = A.walks(p, q, size)
                    if not len(count):
                        continue
                    # an open path has one corner more than edges
                    places = count + ~closed
                    ends = np.cumsum(places)
                    last = np.zeros(ends[-1], bool)
                    last[ends[~closed] - 1] = True
                    points = np.empty((ends[-1], 2), np.int64)
                    points[~last] = p[walk]
                    points[last] = q[walk[np.cumsum(count)[~closed] - 1]]
                    tile = A.tile_of(p[walk[np.cumsum(count) - count]], size)
                    at, own = tile + i, np.repeat(tile, places)
                    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                    xs, ys = (pa.ListArray.from_arrays(offsets, pa.array(points[:, k] - own * A.stride(size) + t[i:j][own] * size + 1)) for k, t in ((0, tx), (1, ty)))
                    rows_ = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [*(column[k].take(rows_) for k in keys), pa.array([op] * len(at)), column["tx"].take(rows_), column["ty"].take(rows_), pa.array(closed), xs, ys],
                        names=[f.name for f in fields])

    found = rows.select(*keys, "tx", "ty", "pieces", "wa", "wb").mapInArrow(run, T.StructType(fields))
    return materialize(found.withColumn("id", F.monotonically_increasing_id()), "paths")


def _joined(group: np.ndarray, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, parent, pos, closed, first, last): paths joined end to start within their groups.

    Each path's place in the longer path, that path's name, and the rows of its first and last path.
    """
    n = len(ids)
    starts: dict = {}
    for k, v in enumerate(zip(group.tolist(), *start.T.tolist())):
        starts.setdefault(v, []).append(k)
    follow = []
    for v in zip(group.tolist(), *end.T.tolist()):
        out = starts.get(v)
        follow.append(out.pop() if out else -1)
    led = np.zeros(n + 1, bool)
    led[follow] = True
    seen, walk, count, closed = [False] * n, [], [], []
    for k in [*np.flatnonzero(~led[:n]).tolist(), *range(n)]:
        if seen[k]:
            continue
        begun, at = len(walk), k
        while at >= 0 and not seen[at]:
            seen[at] = True
            walk.append(at)
            at = follow[at]
        count.append(len(walk) - begun)
        closed.append(at == k)
    walk, count = np.array(walk, np.int64), np.array(count, np.int64)
    first = np.cumsum(count) - count
    each = [np.minimum.reduceat(ids[walk], first), closed, walk[first], walk[first + count - 1]]
    parent, closed, first_row, last_row = (np.repeat(x, count) for x in each)
    return walk, parent, np.arange(n) - np.repeat(first, count), closed, first_row, last_row


def _joined_calls(count: np.ndarray, v: dict[str, np.ndarray]):
    """(row, columns) of joined paths, for about CALL_EDGES paths at a time: rows do not meet, and a batch may hold millions of ends."""
    until = np.cumsum(count)
    for i, j in calls(count):
        part = slice(int(until[i] - count[i]), int(until[j - 1]))
        row = np.repeat(np.arange(i, j), count[i:j])
        ids, sx, sy, ex, ey = (v[c][part] for c in ("id", "sx", "sy", "ex", "ey"))
        start, end = np.column_stack([sx, sy]), np.column_stack([ex, ey])
        walk, parent, pos, closed, first, last = _joined(row, ids, start, end)
        new = [ids[walk], parent, pos, closed, *start[first].T, *end[last].T]
        yield row[walk], dict(zip(("id", "parent", "pos", "closed", "sx", "sy", "ex", "ey"), new))


def _join_ends(ends: DataFrame, by: list[str], fields: list) -> DataFrame:
    """The paths of every larger tile joined; one row holds the ends of a tile, a call takes many rows."""
    longs = ("id", "sx", "sy", "ex", "ey")
    listed = spread(ends, *by, "tx", "ty").groupBy(*by, "tx", "ty").agg(F.collect_list(F.struct(*longs)).alias("_ends"))

    def run(batches):
        for d in batches:
            column = {n: d.column(k) for k, n in enumerate(d.schema.names)}
            if not d.num_rows:
                continue
            count = column["_ends"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column["_ends"].flatten()
            v = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in longs}
            for row, new in _joined_calls(count, v):
                own = pa.array(row)
                out = {c: column[c].take(own) for c in (*by, "tx", "ty")} | {c: pa.array(x) for c, x in new.items()}
                yield pa.RecordBatch.from_arrays([out[f.name] for f in fields], names=[f.name for f in fields])

    return listed.mapInArrow(run, T.StructType(fields))


def rings(found: DataFrame, keys: list[str], snap: float = SNAP) -> DataFrame:
    """(keys, operation, ring, area): whole rings of paths(); outer ones have a positive area, holes a negative one.

    Corners that only tile borders made are left out again.
    """
    by = [*keys, "operation"]
    ends = found.where("not closed").select(*by, "id", "tx", "ty", *(F.element_at(c, i).alias(f"{n}{c[0]}") for n, i in (("s", 1), ("e", -1)) for c in ("xs", "ys")))
    fields = [*(ends.schema[k] for k in by)] + [T.StructField(c, T.LongType()) for c in ("id", "tx", "ty", "parent", "pos")] + [
        T.StructField("closed", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("sx", "sy", "ex", "ey"))]
    ways, open_ = None, materialize(ends, "ends")
    while not open_.isEmpty():
        # tile 0 of the larger kind lies around the origin, so that in the end it holds all
        larger = open_.withColumns({t: F.floor((F.col(t) + GROW // 2) / GROW).cast("long") for t in ("tx", "ty")})
        level = materialize(_join_ends(larger, by, fields), "joined")
        step = level.select(F.col("id").alias("_top"), F.col("parent").alias("_next"), F.col("pos").alias("_pos"))
        if ways is None:
            ways = step.select(F.col("_top").alias("id"), F.col("_next").alias("top"), F.array("_pos").alias("order"))
        else:
            # the places in longer paths come first; paths that are closed already have no more
            up = ways.join(step, ways["top"] == step["_top"], "left")
            ways = up.select("id", F.coalesce("_next", "top").alias("top"), F.when(F.col("_pos").isNull(), F.col("order")).otherwise(F.concat(F.array("_pos"), F.col("order"))).alias("order"))
        ways = materialize(ways, "ways")
        open_ = level.where("not closed and pos = 0").select(*by, F.col("parent").alias("id"), "tx", "ty", "sx", "sy", "ex", "ey")
    whole = found.where("closed").select(*by, "xs", "ys")
    if ways is not None:
        parts = found.join(ways, "id").select(*by, "top", F.struct("order", F.expr("slice(xs, 1, size(xs) - 1)").alias("xs"), F.expr("slice(ys, 1, size(ys) - 1)").alias("ys")).alias("part"))
        linked = parts.groupBy(*by, "top").agg(F.array_sort(F.collect_list("part")).alias("parts"))
        whole = whole.unionByName(linked.select(*by, F.flatten("parts.xs").alias("xs"), F.flatten("parts.ys").alias("ys")))
    point = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    out = T.StructType([*(found.schema[k] for k in by), T.StructField("ring", point), T.StructField("area", T.DoubleType())])

    def finish(batches):
        for d in batches:
            column = {n: d.column(k) for k, n in enumerate(d.schema.names)}
            size = column["xs"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            until = np.cumsum(size)
            flat = [column[c].flatten().to_numpy(zero_copy_only=False) for c in ("xs", "ys")]
            for i, j in calls(size) if len(size) else ():
                part = slice(int(until[i] - size[i]), int(until[j - 1]))
                p = np.column_stack([x[part] for x in flat])
                ring = np.repeat(np.arange(j - i), size[i:j])
                corner = (p % 2 == 0).all(axis=1)
                p, count = A.straightened(p[corner], np.bincount(ring[corner], minlength=j - i))
                kept = np.flatnonzero(count)
                if not len(kept):
                    continue
                count = count[kept]
                ends = np.cumsum(count)
                first = ends - count
                rel = (p - p[np.repeat(first, count)]).astype(float) * (snap / 2)
                nxt = np.arange(1, len(p) + 1)
                nxt[ends - 1] = first
                area = np.add.reduceat(rel[:, 0] * rel[nxt, 1] - rel[nxt, 0] * rel[:, 1], first) / 2
                xy = p * (snap / 2)
                places = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])
                rows = pa.array(i + kept)
                yield pa.RecordBatch.from_arrays(
                    [*(column[k].take(rows) for k in by), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), places), pa.array(area)], names=[f.name for f in out.fields])

    return whole.mapInArrow(finish, out)


def overlay(edges: DataFrame, keys: list[str], operations: list[str], tile: float, snap: float = SNAP) -> DataFrame:
    """(keys, operation, ring, area) of the two layers (0 and 1) of `edges`, for each key on its own.

    Operations: both, only_a, only_b, any, one (in exactly one). Within a layer, shapes
    that overlap or touch are one. Rows with a null key are left out. Corners are rounded to the lattice,
    crossings likewise; nothing else is lost. No edges give no rings.
    """
    return rings(paths(edges, keys, operations, tile, snap), keys, snap)


def with_holes(found: DataFrame, keys: list[str], tile: float) -> DataFrame:
    """(keys, operation, ring, holes, area): every hole with the smallest outer ring around it."""
    by = [*keys, "operation"]
    boxed = found.withColumn("_b", geom.bbox(F.col("ring"))).select(*by, "ring", "area", "_b.*")
    named = materialize(boxed.withColumn("id", F.monotonically_increasing_id()), "rings")
    outer = named.where("area > 0")
    # the middle of a side lies on no other ring
    hole = named.where("area < 0").withColumn("hx", (F.col("ring")[0].x + F.col("ring")[1].x) / 2).withColumn("hy", (F.col("ring")[0].y + F.col("ring")[1].y) / 2)
    pairs = box_pairs(hole, outer.select(*by, "id", "ring", "area", "x0", "y0", "x1", "y1"), tile, keys=by)
    held = pairs.where(geom.contains(F.col("b.ring"), F.col("a.hx"), F.col("a.hy")))
    owner = held.groupBy(F.col("a.id").alias("hole")).agg(F.min_by("b.id", F.struct(F.col("b.area").alias("s"), F.col("b.id").alias("i"))).alias("id"))
    holes = owner.join(hole.select(F.col("id").alias("hole"), F.col("ring").alias("h"), F.col("area").alias("minus")), "hole").groupBy("id").agg(
        F.collect_list("h").alias("holes"), F.sum("minus").alias("minus"))
    done = outer.join(holes, "id", "left")
    none = F.array().cast(T.ArrayType(found.schema["ring"].dataType))
    return done.select(*by, "ring", F.coalesce("holes", none).alias("holes"), (F.col("area") + F.coalesce("minus", F.lit(0.0))).alias("area"))
