"""Embedding near-dedup with a robust-pruned flat graph.

Equal vectors are one vertex. Vectors go to the shards of their nearest centroids, so
shards overlap; each shard builds a graph of bounded degree, inserting batches that
search the graph so far and keep diverse neighbours. The adjacency lists of a vector
are united over its shards. Then every vector is searched for in its shards: a greedy
search from the medoid that goes on through all vertices in range. Found pairs are
compared in double precision. An audit compares a bounded set of queries with all vectors
by brute force. An overlap at which too few of their links share a shard is not built, and
if a search finds too few, the next overlap follows. A dense group lies in more shards than
any overlap covers; then vectors are compared exactly, block by block, with all blocks whose
centroid and measured radius allow a link.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hotspark.llm.components import components
from hotspark.session import materialize

COSINE = 0.95
#: Vectors of a shard that its size aims at; a larger cluster is split and its parts search each other.
SHARD = 400
#: Rows that centroids are fitted to, about; all rows are indexed.
SAMPLE = 20_000
OVERLAPS = (2, 4, 8)
DEGREE, BEAM, ALPHA = 24, 48, 1.2
#: Vectors below the range by so much are still expanded, so that a search gets around small gaps.
SLACK = 0.04
#: Queries of the audit at most, about, and the share of their links that must be found.
AUDIT = 400
RECALL = 0.98
_QUERIES = 256
#: Vectors of a block of the exact search that its size aims at.
BLOCK = 4096


def unit_rows(column) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in column])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def marked(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(node, v, h1, h2): keys, and vectors that can link with a 128-bit name; v and names are null for the others."""
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(key).alias("node"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))
    ok = F.coalesce(good & F.col("node").isNotNull(), F.lit(False))
    return rows.select("node", F.when(ok, F.col("v")).alias("v"), F.when(ok, F.xxhash64("v")).alias("h1"), F.when(ok, F.xxhash64(F.reverse("v"), F.size("v"))).alias("h2"))


def spherical_means(x: np.ndarray, k: int, seed: int = 9, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(part @ c.T).argmax(axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], c)
    return c


def beam_search(x: np.ndarray, links, entry: int, queries: np.ndarray, beam: int, reach: float | None) -> np.ndarray:
    """Cosines of the vertices that each query has seen (-2: not seen), by greedy search over `links`.

    `links` is a table of lists filled up with -1, or offsets and flat lists. A query goes on while it has an unexpanded vertex among its `beam` best or, with a
    reach, any unexpanded one at least that close.
    """
    n = len(x)
    seen = np.full((len(queries), n), -2.0, np.float32)
    todo = np.full((len(queries), n), -2.0, np.float32)
    seen[:, entry] = todo[:, entry] = queries @ x[entry]
    active = np.arange(len(queries))
    width = 4
    kth = n - min(beam, n)
    for _ in range(n + 1):
        t = todo[active]
        at = np.argpartition(t, n - min(width, n), axis=1)[:, -width:]
        got = np.take_along_axis(t, at, axis=1)
        bar = np.partition(seen[active], kth, axis=1)[:, kth]
        if reach is not None:
            bar = np.minimum(bar, reach)
        use = (got > -2) & (got >= bar[:, None])
        go = use.any(axis=1)
        if not go.any():
            break
        active, at, use = active[go], at[go], use[go]
        q, v = np.repeat(active, use.sum(axis=1)), at[use]
        todo[q, v] = -2
        if isinstance(links, tuple):
            offs, flat = links
            counts = offs[v + 1] - offs[v]
            q = np.repeat(q, counts)
            v = flat[np.arange(len(q)) + np.repeat(offs[v] - np.cumsum(counts) + counts, counts)]
        else:
            near = links[v]
            q, v = np.repeat(q, near.shape[1]), near.ravel()
            ok = v >= 0
            q, v = q[ok], v[ok]
        new = seen[q, v] == -2
        q, v = q[new], v[new]
        key = np.unique(q * n + v)
        q, v = key // n, key % n
        s = np.einsum("ij,ij->i", queries[q], x[v])
        seen[q, v] = s
        todo[q, v] = s
    return seen


def robust_prune(x: np.ndarray, own: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Diverse neighbours of each row of `own` from its row of `pool` (-1: none).

    The nearest candidate is kept and removes those that are closer to it, by the factor
    alpha, than to the vertex; so on with the next.
    """
    rows = np.arange(len(own))
    safe = np.maximum(pool, 0)
    far = 1.0 - np.einsum("ij,ikj->ik", x[own], x[safe])
    far[(pool < 0) | (pool == own[:, None])] = np.inf
    out = np.full((len(own), degree), -1, np.int64)
    for k in range(degree):
        best = far.argmin(axis=1)
        have = np.isfinite(far[rows, best])
        if not have.any():
            break
        out[have, k] = pool[rows, best][have]
        between = 1.0 - np.einsum("ij,ikj->ik", x[safe[rows, best]], x[safe])
        gone = alpha * between <= far
        gone[rows, best] = True
        far[gone & have[:, None]] = np.inf
    return out


def build(x: np.ndarray, seed: int = 13) -> tuple[np.ndarray, int]:
    """Adjacency lists of a shard (-1: none) and its medoid."""
    n = len(x)
    mean = x.mean(axis=0)
    medoid = int((x @ mean).argmax())
    links = np.full((n, DEGREE), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[medoid], order[order != medoid]])
    done, size = 1, 1
    while done < n:
        batch = order[done:done + min(size, _QUERIES)]
        seen = beam_search(x, links, medoid, x[batch], BEAM, None)
        seen[np.arange(len(batch)), batch] = -2
        k = min(2 * BEAM, n)
        pool = np.argpartition(seen, n - k, axis=1)[:, -k:]
        pool = np.where(np.take_along_axis(seen, pool, axis=1) > -2, pool, -1)
        # vertices of the same batch do not see each other in the search
        mutual = np.tile(batch, (len(batch), 1))
        if len(batch) > BEAM:
            close = x[batch] @ x[batch].T
            near = np.argpartition(close, len(batch) - BEAM, axis=1)[:, -BEAM:]
            mutual = batch[near]
        links[batch] = robust_prune(x, batch, np.concatenate([pool, mutual], axis=1))
        # the way back; lists that grow too long are pruned
        a, b = np.repeat(batch, DEGREE), links[batch].ravel()
        a, b = a[b >= 0], b[b >= 0]
        by = np.argsort(b, kind="stable")
        a, b = a[by], b[by]
        targets, starts, counts = np.unique(b, return_index=True, return_counts=True)
        pool = np.full((len(targets), int(counts.max()) if len(counts) else 0), -1, np.int64)
        pool[np.repeat(np.arange(len(targets)), counts), np.arange(len(a)) - np.repeat(starts, counts)] = a
        for i in range(0, len(targets), _QUERIES):
            t = targets[i:i + _QUERIES]
            links[t] = robust_prune(x, t, np.concatenate([links[t], pool[i:i + _QUERIES]], axis=1))
        done += len(batch)
        size *= 2
    return links, medoid


def _nearest(x: np.ndarray, c: np.ndarray, overlap: int) -> np.ndarray:
    """Numbers of the nearest centroids of each row, in rising order."""
    k = min(overlap, len(c))
    out = [np.sort(np.argpartition(-(part @ c.T), k - 1, axis=1)[:, :k], axis=1) for part in np.array_split(x, max(1, len(x) // 2048))]
    return np.concatenate(out).astype(np.int32)


def _assigned(vectors: DataFrame, centroids: np.ndarray, overlap: int, dim_ok: int) -> DataFrame:
    """(node, v, n, shards): the nearest centroids of each vector, by number."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def nearest(column: pd.Series) -> pd.Series:
        return pd.Series(list(_nearest(unit_rows(column), shared.value, overlap)))

    return vectors.where(F.size("v") == dim_ok).withColumn("shards", nearest("v"))


def _sample(vectors: DataFrame, dim: int, total: int) -> np.ndarray:
    """The vectors that centroids are fitted to, in the order of their keys."""
    parts = 1 << 30
    sample = vectors.where(F.size("v") == dim).where(F.pmod(F.xxhash64("node"), F.lit(parts)) < max(1, round(parts * min(1.0, SAMPLE / max(1, total))))).select("node", "v").toPandas()
    return unit_rows(sample.sort_values("node")["v"]) if len(sample) else np.eye(1, dim)


def _links(vectors: DataFrame, dim: int, overlap: int, centroids: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(node, direct): links to other classes' rows; (a, b): a spanning set of the links."""
    spark = vectors.sparkSession
    placed = materialize(_assigned(vectors, centroids, overlap, dim), "placed")
    each = placed.select("node", "v", "n", "shards", F.explode("shards").alias("shard"))
    sizes = each.groupBy("shard").agg(F.count("*").alias("size")).withColumn("splits", F.ceil(F.col("size") / F.lit(2 * SHARD)).cast("int")).select("shard", "splits")
    each = materialize(each.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("node"), F.col("splits")).cast("int")), "shards")

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        links, _ = build(unit_rows(pdf["v"]))
        ids = pdf["node"].to_numpy()
        return pd.DataFrame({"node": ids, "near": [ids[row[row >= 0]] for row in links]})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    spread = each.select("shard", "part", "node", "v").repartition(tasks, "shard", "part")
    lists = spread.groupBy("shard", "part").applyInPandas(graph, "node long, near array<long>")
    united = materialize(lists.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near")), "adjacency")

    # parts of a cluster search each other, one way; most clusters have one part
    base = each.join(united, "node", "left").select("shard", "part", "node", "v", "n", "shards", "near", "splits")
    indexed = base.withColumn("asks", F.explode(F.sequence(F.col("part"), F.col("splits") - 1))).select(
        "shard", F.col("part").alias("index_part"), F.col("asks").alias("query_part"), "node", "v", "n", "shards", "near", F.lit(True).alias("indexed"))
    asking = base.where("part > 0").withColumn("index_part", F.explode(F.sequence(F.lit(0), F.col("part") - 1))).select(
        "shard", "index_part", F.col("part").alias("query_part"), "node", "v", "n", "shards", F.lit(None).cast("array<bigint>").alias("near"), F.lit(False).alias("indexed"))
    both = indexed.unionByName(asking).repartition(tasks, "shard", "index_part", "query_part")
    found = materialize(both.groupBy("shard", "index_part", "query_part").applyInPandas(_search, "node long, direct long, root long"), "found")
    return found.groupBy("node").agg(F.sum("direct").alias("direct")), found.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _adjacency(ids: np.ndarray, lists) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat lists of row numbers, both ways of each edge; keys of other shards are left out.

    In a dense group some vertices are in nobody's pruned list; the way back reaches them.
    """
    lists = [np.asarray(v if v is not None else [], np.int64) for v in lists]
    a = np.repeat(np.arange(len(ids)), [len(v) for v in lists])
    near = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    b = np.searchsorted(ids, near)
    b[b == len(ids)] = 0
    here = ids[b] == near
    a, b = a[here], b[here]
    edges = np.unique(np.concatenate([a * len(ids) + b, b * len(ids) + a]))
    return np.searchsorted(edges // len(ids), np.arange(len(ids) + 1)), edges % len(ids)


def _roots(hits: list[tuple[np.ndarray, np.ndarray]], n: int, up: np.ndarray | None = None) -> np.ndarray:
    """Smallest vertex that each vertex reaches over the pairs and, if given, over the roots of earlier pairs."""
    up = np.arange(n) if up is None else up
    for a, b in hits:
        while len(a):
            while (up[up] != up).any():
                up = up[up]
            x, y = up[a], up[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
    while (up[up] != up).any():
        up = up[up]
    return up


def _search(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one block: rows linked in their first common shard, and roots of the block's own components."""
    shard, index_part, query_part = keys
    index = pdf[pdf["indexed"]].sort_values("node", ignore_index=True)
    same = index_part == query_part
    queries = index if same else pdf[~pdf["indexed"]].sort_values("node", ignore_index=True)
    none = pd.DataFrame({"node": np.zeros(0, np.int64), "direct": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
    if not len(index) or not len(queries):
        return none
    x, qx = unit_rows(index["v"]), unit_rows(queries["v"])
    ids, qids = index["node"].to_numpy(np.int64), queries["node"].to_numpy(np.int64)
    homes, qhomes = np.array(list(index["shards"])), np.array(list(queries["shards"]))
    links = _adjacency(ids, index["near"])
    medoid = int((x @ x.mean(axis=0)).argmax())
    hit = np.zeros((len(qids), len(ids)), bool)
    for i in range(0, len(qids), _QUERIES):
        seen = beam_search(x, links, medoid, qx[i:i + _QUERIES], BEAM, COSINE - SLACK)
        q, v = np.nonzero(seen >= COSINE - 1e-4)
        hit[i + q, v] = np.einsum("ij,ij->i", qx[i + q], x[v]) >= COSINE
    if same:
        hit |= hit.T
        np.fill_diagonal(hit, False)
    direct, back, pairs = np.zeros(len(qids), np.int64), np.zeros(len(ids), np.int64), []
    weights, qweights = index["n"].to_numpy(np.int64), queries["n"].to_numpy(np.int64)
    shift = 0 if same else len(ids)
    for i in range(0, len(qids), _QUERIES):
        q, v = np.nonzero(hit[i:i + _QUERIES])
        q += i
        pairs.append((q + shift, v))
        # a pair counts in the first shard that holds both
        common = (qhomes[q][:, :, None] == homes[v][:, None, :]).any(axis=2)
        own = np.where(common, qhomes[q], np.iinfo(np.int32).max).min(axis=1) == shard
        direct += np.bincount(q[own], weights[v[own]], minlength=len(direct)).astype(np.int64)
        back += np.bincount(v[own], qweights[q[own]], minlength=len(back)).astype(np.int64)
    every = ids if same else np.concatenate([ids, qids])
    roots = every[_roots(pairs, len(every))]
    direct = direct if same else np.concatenate([back, direct])
    some = (direct > 0) | (roots != every)
    return pd.DataFrame({"node": every[some], "direct": direct[some], "root": roots[some]}) if some.any() else none


def _exact(vectors: DataFrame, dim: int, total: int, sample: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """What `_links` returns, without a graph: each pair of blocks that can hold a link is compared whole.

    A vector lies in the cell of its nearest centroid, cells are cut into blocks. A vector
    can link into another cell only if its angle to that centroid is within the cell's
    radius and the angle of a link, and if its distance to the plane between the two
    centroids is within the length of a link. A pair of blocks is read if any vector can.
    """
    spark = vectors.sparkSession
    centroids = spherical_means(sample, max(1, -(-total // BLOCK)))
    k = len(centroids)
    shared = spark.sparkContext.broadcast(centroids)
    angle, chord, slip = np.arccos(COSINE), np.sqrt(2 - 2 * COSINE), 1e-6

    def cells(batches):
        for pdf in batches:
            if len(pdf):
                near = unit_rows(pdf["v"]) @ shared.value.T
                cell = near.argmax(axis=1)
                yield pdf.assign(cell=cell.astype(np.int32), off=np.arccos(np.clip(near[np.arange(len(pdf)), cell], -1, 1)))

    placed = materialize(vectors.where(F.size("v") == dim).select("node", "v", "n").mapInPandas(cells, "node long, v array<double>, n long, cell int, off double"), "cells")
    stats = placed.groupBy("cell").agg(F.count("*").alias("size"), F.max("off").alias("radius")).toPandas()
    radius, splits = np.full(k, -np.inf), np.zeros(k, np.int64)
    radius[stats["cell"]] = stats["radius"]
    splits[stats["cell"]] = -(-stats["size"] // BLOCK)
    first = np.cumsum(splits) - splits
    reach = spark.sparkContext.broadcast(radius)

    def open_cells(batches):
        c = shared.value
        for pdf in batches:
            for part in (pdf[i:i + 1024] for i in range(0, len(pdf), 1024)):
                own = part["cell"].to_numpy()
                near = unit_rows(part["v"]) @ c.T
                apart = np.sqrt(np.maximum(2 - 2 * (c[own] @ c.T), 0))
                can = (np.arccos(np.clip(near, -1, 1)) <= reach.value + angle + slip) & (near[np.arange(len(own)), own][:, None] - near <= chord * apart + slip)
                q, b = np.nonzero(can)
                pairs = np.unique(own[q].astype(np.int64) * k + b)
                yield pd.DataFrame({"a": (pairs // k).astype(np.int32), "b": (pairs % k).astype(np.int32)})

    # both ends of a link see each other's cell as open; a pair of cells is compared once
    seen = placed.mapInPandas(open_cells, "a int, b int").distinct()
    seen = materialize(seen.join(seen.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]).where("a <= b"), "open-cells")
    split = spark.createDataFrame(pd.DataFrame({"cell": np.arange(k, dtype=np.int32), "splits": splits, "first": first}), "cell int, splits long, first long")
    blocks = placed.join(split, "cell").select("node", "v", "n", "cell", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("splits"))).alias("block"))
    blocks = materialize(blocks, "blocks")

    def numbers(name):
        return split.where("splits > 0").select(F.col("cell").alias(name), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("splits") - 1)).alias(f"{name}_block"))

    pairs = materialize(seen.join(numbers("a"), "a").join(numbers("b"), "b").where("a_block <= b_block").select("a_block", "b_block"), "block-pairs")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    left = blocks.join(pairs, F.col("block") == F.col("a_block")).withColumn("indexed", F.lit(True))
    right = blocks.join(pairs.where("a_block < b_block"), F.col("block") == F.col("b_block")).withColumn("indexed", F.lit(False))
    both = left.unionByName(right).select("a_block", "b_block", "node", "v", "n", "indexed").repartition(tasks, "a_block", "b_block")
    found = materialize(both.groupBy("a_block", "b_block").applyInPandas(_compare, "node long, direct long, root long"), "found")
    return found.groupBy("node").agg(F.sum("direct").alias("direct")), found.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _compare(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks, or within one: each row's sum, and roots of the components."""
    pdf = pdf.sort_values(["indexed", "node"], ascending=[False, True], ignore_index=True)
    m = int(pdf["indexed"].sum())
    same = keys[0] == keys[1]
    x, n = unit_rows(pdf["v"]), pdf["n"].to_numpy(np.int64)
    ids = pdf["node"].to_numpy(np.int64)
    direct, up = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i in range(0 if same else m, m if same else len(ids), _QUERIES):
        q = np.arange(i, min(i + _QUERIES, m if same else len(ids)))
        hit = x[q] @ x[:m].T >= COSINE
        if same:
            hit[np.arange(len(q)), q] = False
        else:
            direct[:m] += n[q] @ hit
        direct[q] += hit @ n[:m]
        a, b = np.nonzero(hit)
        up = _roots([(q[a], b)], len(ids), up)
    # the smallest key of a component, not its first row
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, up, ids)
    roots = low[up]
    some = (direct > 0) | (roots != ids)
    return pd.DataFrame({"node": ids[some], "direct": direct[some], "root": roots[some]})


def _audit(vectors: DataFrame, dim: int, total: int, centroids: dict[int, np.ndarray]) -> pd.DataFrame:
    """(node, truth, and for each overlap the part of it that shares a shard): links of a bounded set of queries to rows of other classes, by brute force over all vectors."""
    names = [f"share_{o}" for o in centroids]
    parts = 1 << 30
    asked = vectors.where(F.size("v") == dim).where(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(parts)) < max(1, round(parts * min(1.0, AUDIT / max(1, total))))).select("node", "v").toPandas()
    if not len(asked):
        return pd.DataFrame({name: np.zeros(0, np.int64) for name in ["node", "truth", *names]})
    q = unit_rows(asked["v"])
    shared = vectors.sparkSession.sparkContext.broadcast((asked["node"].to_numpy(), q, centroids, [_nearest(q, c, o) for o, c in centroids.items()]))

    def count(batches):
        ids, q, centroids, homes = shared.value
        sums = np.zeros((len(ids), 1 + len(homes)), np.int64)
        for pdf in batches:
            for part in (pdf[i:i + 4096] for i in range(0, len(pdf), 4096)):
                x, n = unit_rows(part["v"]), part["n"].to_numpy(np.int64)
                v, a = np.nonzero((x @ q.T >= COSINE) & (part["node"].to_numpy()[:, None] != ids[None]))
                np.add.at(sums[:, 0], a, n[v])
                for k, (overlap, c) in enumerate(centroids.items()):
                    rows, at = np.unique(v, return_inverse=True)
                    if len(rows):
                        near = _nearest(x[rows], c, overlap)
                        for i in range(0, len(a), 1 << 16):
                            some = slice(i, i + (1 << 16))
                            common = (near[at[some]][:, :, None] == homes[k][a[some]][:, None, :]).any(axis=(1, 2))
                            np.add.at(sums[:, 1 + k], a[some][common], n[v[some][common]])
        yield pd.DataFrame({"node": ids} | {name: sums[:, k] for k, name in enumerate(["truth", *names])})

    rows = vectors.where(F.size("v") == dim).select("node", "v", "n").mapInPandas(count, ", ".join(f"{name} long" for name in ["node", "truth", *names]))
    return rows.groupBy("node").agg(*(F.sum(name).alias(name) for name in ["truth", *names])).toPandas()


def _recall(found, truth) -> float:
    """Share of the audited links that were found."""
    return float(np.sum(found) / np.sum(truth)) if np.sum(truth) else 1.0


def find_links(vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame, float]:
    """Links of the classes whose vectors have `dim` parts, a spanning set of them, and the audited recall."""
    total = vectors.where(F.size("v") == dim).count()
    sample = _sample(vectors, dim, total)
    centroids = {o: spherical_means(sample, max(1, -(-total * o // SHARD))) for o in OVERLAPS}
    truth = _audit(vectors, dim, total, centroids)
    asked = vectors.sparkSession.createDataFrame(truth[["node"]], "node long")
    for overlap in OVERLAPS:
        if _recall(truth[f"share_{overlap}"], truth["truth"]) < RECALL:
            continue
        direct, spanning = _links(vectors, dim, overlap, centroids[overlap])
        got = dict(direct.join(asked, "node").select("node", "direct").toPandas().itertuples(index=False))
        recall = _recall(truth["node"].map(got).fillna(0), truth["truth"])
        if recall >= RECALL:
            return direct, spanning, recall
    return *_exact(vectors, dim, total, sample), 1.0


def dedup(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each row of `df`: key, n_links, component_id and kept.

    n_links counts other rows linked directly, copies included; component_id is the
    smallest key that links reach. A row with a null key, or with a vector that is null,
    empty, zero or has null or non-finite parts, links with nothing. Rows that share a key
    are one vertex. Vectors of different lengths do not link. An empty table gives an
    empty one. If the audit misses its recall at every overlap, all pairs that can link are compared.
    """
    rows = materialize(marked(df, key, vector), "vectors")
    classes = rows.where(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("node").alias("node"), F.count("*").alias("n"))
    classes = materialize(classes, "vector-classes")
    direct = spanning = None
    for r in sorted(classes.select(F.size("v").alias("dim")).distinct().collect()):
        d, s, _ = find_links(classes.drop("h1", "h2"), r["dim"])
        direct, spanning = (d, s) if direct is None else (direct.union(d), spanning.union(s))
    if direct is None:
        return rows.select(F.col("node").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("node").alias("component_id"), F.col("node").isNotNull().alias("kept"))
    linked = components(spanning)
    named = classes.select("h1", "h2", "node", "n").join(direct, "node", "left").join(linked, "node", "left").select(
        "h1", "h2", (F.col("n") - 1 + F.coalesce("direct", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = rows.select("node", "h1", "h2").join(materialize(named, "named-vectors"), ["h1", "h2"], "left")
    component = F.coalesce("component_id", "node")
    return out.select(F.col("node").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("node"), F.lit(False)).alias("kept"))
