"""Jaccard join on word shingles with adaptive multi-match prefixes.

All texts order shingles the same way, rarest first by a count sketch of the whole
corpus. Two sets of similarity t or more, cut to their first n - ceil(t n) + l
shingles, share at least l of them. Each text picks its own l: it lengthens its prefix
while the estimated number of candidates to verify falls by more than the longer
prefix costs; a pair must then share the smaller l of its two texts.

The sizes of a pair tighten both prefixes: with an overlap of at least o, the first l
common shingles lie in the first n - o + l of either.

Equal sets are one vertex. A first round compares each text only with one hub under
each of its prefix shingles, which gathers groups of near copies as stars; the second
round makes all pairs that are still in different components, so no pairs are made
inside a group that is known to be one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from hotspark.llm.bits import bitmap, join_groups, member
from hotspark.llm.components import components
from hotspark.llm.kernels import LOWER, UNSPACED, buffers, byte_values, list_array, run_hashes, signed, span_hashes, steps, word_spans
from hotspark.session import materialize

SHINGLE = 5
#: Similarity as a percentage.
PERCENT = 80
#: log2 of the sketch's counters; only the order and the choice of l depend on it.
SKETCH_BITS = 19
_BLOCK = 1 << 12
MOST_SHARED = 4
#: Cost of verifying one candidate, in units of one read posting, for each shingle of the text.
VERIFY_COST = 0.05
_VALUES = byte_values(31)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted, and their row offsets."""
    data = LOWER[data]
    first, last, woffs = word_spans(data, offs, UNSPACED)
    words = span_hashes(data, first, last, _VALUES)
    n_rows = len(offs) - 1
    sizes = np.diff(woffs)
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, (sizes > 0).astype(np.int64))
    rows = np.repeat(np.arange(n_rows), counts)
    ends = np.cumsum(counts)
    values = np.zeros(len(rows), np.uint64)
    long = (sizes >= SHINGLE)[rows]
    at = np.arange(len(rows)) - (ends - counts)[rows] + woffs[:-1][rows]
    if long.any():
        values[long] = run_hashes(words, SHINGLE, 41)[at[long]]
    for n in range(1, SHINGLE):
        short = (sizes == n)[rows]
        if short.any():
            values[short] = run_hashes(words, n, 41 + n)[at[short]]
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])])
        values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(n_rows + 1))


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sets_of(column):
    """For each step of a column: first row, sets, offsets, and the sets' 128-bit names."""
    data, offs = buffers(column)
    for i, j in steps(offs):
        values, at = shingle_sets(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
        names = np.frombuffer(b"".join(_digest(values[a:b]) for a, b in zip(at, at[1:])), "<i8").reshape(-1, 2)
        yield i, j, values, at, names


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, a, b) of each row, (a, b) being its set's name, and rows of sketch counters (block, counts)."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["key"], *(T.StructField(c, T.LongType()) for c in ("n", "a", "b")), T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def run(batches):
        counters = np.zeros(1 << SKETCH_BITS, np.uint32)
        key_type = None
        for batch in batches:
            keys = batch.column(0)
            key_type = keys.type
            for i, j, values, at, names in _sets_of(batch.column(1)):
                counters += np.bincount((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counters)).astype(np.uint32)
                none = j - i
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i), pa.array(np.diff(at).astype(np.int64)), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())],
                    names=schema.names)
        blocks = [k for k in range(len(counters) // _BLOCK) if counters[k * _BLOCK:(k + 1) * _BLOCK].any()]
        if blocks:
            none = len(blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(none, key_type), *(pa.nulls(none, pa.int64()) for _ in range(3)), pa.array(blocks, pa.int32()),
                 pa.array([counters[k * _BLOCK:(k + 1) * _BLOCK].tobytes() for k in blocks], pa.binary())],
                names=schema.names)

    return source.mapInArrow(run, schema)


def sketch(described: DataFrame) -> np.ndarray:
    """The counters summed over all tasks: a table of fixed size."""
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.uint64)
                sums[block] = sums[block] + c if block in sums else c
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"])

    rows = described.where(F.col("block").isNotNull()).select("block", "counts")
    out = np.zeros(1 << SKETCH_BITS, np.uint64)
    # two levels, so that no task sums one block over all tasks of the scan
    part = rows.repartition("block", F.pmod(F.xxhash64("counts"), F.lit(16))).mapInArrow(add, "block int, counts binary")
    for r in part.toLocalIterator():
        out[r["block"] * _BLOCK:(r["block"] + 1) * _BLOCK] += np.frombuffer(r["counts"], np.uint64)
    return out


def choose(costs: np.ndarray, n: int) -> int:
    """How many shared shingles to ask for, given the estimated frequencies in prefix order."""
    need = -(-PERCENT * n // 100)
    best, best_cost = 1, None
    for shared in range(1, min(MOST_SHARED, need) + 1):
        reads = float(costs[:n - need + shared].sum())
        cost = reads + VERIFY_COST * n * reads / shared ** 2
        if best_cost is None or cost < best_cost:
            best, best_cost = shared, cost
    return best


def prefixes(docs: DataFrame, text: str, counts: np.ndarray) -> DataFrame:
    """(sid, n, l, shingles) of each set: its number, size, chosen l and prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.float32))
    floor = float(np.median(counts))
    schema = T.StructType([T.StructField("sid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("l", T.IntegerType()), T.StructField("shingles", T.ArrayType(T.LongType(), False))])

    def run(batches):
        table = shared.value
        met: set[int] = set()  # sets that this task has told already; emptied when large
        for batch in batches:
            for i, j, values, at, names in _sets_of(batch.column(0)):
                seen = table[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                rows = np.repeat(np.arange(j - i), np.diff(at))
                order = np.lexsort((values, seen, rows))
                values, seen = values[order], np.maximum(seen[order] - floor, 1)
                sid, size, asked, parts = [], [], [], []
                for k in range(j - i):
                    a, n = at[k], at[k + 1] - at[k]
                    if n and names[k, 0] not in met:
                        if len(met) >= 1 << 20:
                            met.clear()
                        met.add(names[k, 0])
                        l = choose(seen[a:a + n], n)  # noqa: E741
                        sid.append(names[k, 0])
                        size.append(n)
                        asked.append(l)
                        parts.append(values[a:a + n - -(-PERCENT * n // 100) + l])
                flat = signed(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid, pa.int64()), pa.array(size, pa.int64()), pa.array(asked, pa.int32()), list_array(pa.array(flat), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]))],
                    names=schema.names)

    return docs.select(text).mapInArrow(run, schema)


def sets_for(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(sid, shingles as bytes) of the wanted sets, read from one text each.

    `wanted` has the sets' numbers and the keys of their texts; a bitmap of the keys
    keeps the other texts from being read again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("key").alias("h")), "h"))

    def run(batches):
        for batch in batches:
            near = member(shared.value, batch.column(1).to_numpy(zero_copy_only=False))
            for i, j, values, at, names in _sets_of(batch.column(0).filter(pa.array(near))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[:, 0].copy()), pa.array([values[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["sid", "shingles"])

    some = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("h"))
    sets = some.mapInArrow(run, "sid long, shingles binary").join(wanted.select("sid"), "sid", "left_semi")
    return materialize(sets.groupBy("sid").agg(F.first("shingles").alias("shingles")), "sets")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose sets are similar enough."""
    @F.pandas_udf(T.BooleanType())
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), bool)
        for k, (p, q) in enumerate(zip(x, y)):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            both = int((q[at] == p).sum())
            out[k] = 100 * both >= PERCENT * (len(p) + len(q) - both)
        return pd.Series(out)

    x = sets.select(F.col("sid").alias("x"), F.col("shingles").alias("p"))
    y = sets.select(F.col("sid").alias("y"), F.col("shingles").alias("q"))
    return pairs.join(x, "x").join(y, "y").where(similar("p", "q")).select("x", "y")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: key, n_shingles and component_id.

    component_id is the smallest key that links reach; a row without words is alone. A
    null key gets a component like any other row and is never the smallest; its
    component is null if no row in it has a key. Equal rows are in one component. An
    empty table gives an empty one. Sets are told apart by 64 bits.
    """
    described = materialize(describe(docs, key, text), "described")
    rows = described.where(F.col("n").isNotNull()).select("key", "n", F.col("a").alias("sid"))
    sets = materialize(rows.where("n > 0").groupBy("sid").agg(F.min("key").alias("key"), F.first("n").alias("n")), "classes")
    prefix = materialize(prefixes(docs, text, sketch(described)), "prefixes")
    postings = prefix.select("sid", "n", "l", F.posexplode("shingles").alias("pos", "s"))
    several = postings.groupBy("s").agg(F.min("sid").alias("low"), F.max("sid").alias("top")).where("low < top").select("s")
    common = materialize(postings.join(several, "s", "left_semi").distinct(), "common")

    def checked(pairs, name):
        pairs = materialize(pairs, name)
        used = pairs.select(F.explode(F.array("x", "y")).alias("sid")).distinct().join(sets.select("sid", "key"), "sid")
        return materialize(verify(pairs, sets_for(docs, key, text, materialize(used, "used"))), f"{name}-edges")

    def side(df, end):
        return df.select("s", F.col("sid").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "l", "pos")))

    # the text nearest to what its group has in common meets the others: its own rare shingles are the fewest
    hubs = common.groupBy("s").agg(F.min(F.struct("pos", "sid", "n", "l")).alias("h")).select("s", "h.*")
    meet = side(hubs, "x").join(side(common, "y"), "s").where("x != y").where(_within("x", "y"))
    stars = checked(_enough(meet), "stars")
    known = components(stars, "x", "y")

    grouped = materialize(common.join(known.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "grouped")
    mixed = grouped.groupBy("s").agg(F.min("root").alias("r"), F.max("root").alias("t")).where("r < t").select("s")
    grouped = materialize(grouped.join(mixed, "s", "left_semi"), "mixed")
    # of each component under a shingle: its smallest size and its largest possible overlap
    roots = grouped.groupBy("s", "root").agg(F.min("n").alias("least"), F.max(F.col("n") - F.col("pos") + F.col("l") - 1).alias("reach"))
    other = roots.select("s", F.col("root").alias("other"), F.col("least").alias("least2"), F.col("reach").alias("reach2"))
    can = (100 + PERCENT) * F.least("reach", "reach2") >= PERCENT * (F.col("least") + F.col("least2"))
    cross = roots.join(other, "s").where((F.col("root") < F.col("other")) & can).select("s", "root", "other", "least2", "reach2")
    # a member goes on if the other component can still reach the overlap that its size calls for
    own = F.least(F.col("n") - F.col("pos") + F.col("l") - 1, F.col("reach2"))
    x = cross.join(grouped, ["s", "root"]).where((100 + PERCENT) * own >= PERCENT * (F.col("n") + F.col("least2")))
    x = x.select("s", "other", F.col("sid").alias("x"), *(F.col(c).alias(f"{c}_x") for c in ("n", "l", "pos")))
    y = side(grouped.withColumn("s", F.struct("s", F.col("root").alias("other"))), "y").select("s.*", "y", "n_y", "l_y", "pos_y")
    rest = checked(_enough(x.join(y, ["s", "other"]).where(_within("x", "y"))), "rest")

    linked = components(stars.union(rest), "x", "y")
    named = sets.join(linked.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "key", F.coalesce("root", "sid").alias("root"))
    lowest = materialize(named.groupBy("root").agg(F.min("key").alias("component_id"), F.count("*").alias("_members")), "lowest")
    named = materialize(join_groups(named, lowest, "root", "_members").select("sid", "component_id"), "named")
    out = rows.join(named, "sid", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def _within(x: str, y: str):
    """Whether a common shingle lies in both prefixes that this pair's sizes call for."""
    need = PERCENT * (F.col(f"n_{x}") + F.col(f"n_{y}"))
    asked = F.least(f"l_{x}", f"l_{y}")
    left = F.least(F.col(f"n_{x}") - F.col(f"pos_{x}"), F.col(f"n_{y}") - F.col(f"pos_{y}")) + asked - 1
    alike = 100 * F.least(f"n_{x}", f"n_{y}") >= PERCENT * F.greatest(f"n_{x}", f"n_{y}")
    return alike & ((100 + PERCENT) * left >= need)


def _enough(meet: DataFrame) -> DataFrame:
    """Pairs (x < y) that share as many prefix shingles as the one that asks for fewer wants."""
    pairs = meet.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count("*").alias("shared"), F.first(F.least("l_x", "l_y")).alias("asked"))
    return pairs.where("shared >= asked").select("x", "y")
