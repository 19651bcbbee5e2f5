"""Vector code compression: integer product codes by tables over value dictionaries.

Vectors become integers and are packed into blocks. A block keeps, for each dimension,
the distinct integers of its rows (the dictionary) and each row's place among them. An
assignment round tabulates, for each dimension, the squared differences of every
distinct integer to all entries of the codebook; the distance of a part to an entry is
then the sum of gathered table rows. Blocks are written once, so a round reads small
integers and only the codebook travels. Blocks have a fixed number of values, tasks hold
one block and one codebook, and neither grows with the data.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hotspark.llm.bits import join_groups
from hotspark.session import materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Values (rows times dimensions) of a block, and rows whose distances are held at once.
BLOCK_VALUES = 1 << 19
STEP_ROWS = 1024
#: Above this magnitude sums of squares may not fit 64 bits: such a block is worked out with Python's integers.
WIDE = 1 << 26

_BLOCK = T.StructType([
    T.StructField("rows", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
    T.StructField("values", T.ArrayType(T.StringType())), T.StructField("places", T.BinaryType()),
])


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor non-finite components."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def integers(vectors: list) -> np.ndarray:
    """floor(1024 x) of equally long vectors: 64-bit where that is exact, else Python's integers."""
    x = np.array([np.asarray(v, np.float64) for v in vectors], np.float64)
    if x.size == 0 or np.abs(x).max() * SCALE < WIDE:
        return np.floor(x * SCALE).astype(np.int64)
    exact = [[n * SCALE // d for n, d in (float(v).as_integer_ratio() for v in row)] for row in x]
    return np.array(exact, object)


def _pack(pieces):
    """Blocks of BLOCK_VALUES values from batches of (row, vector)."""
    held: list = []

    def block(rows):
        ints = integers([r[1] for r in rows])
        values, sizes, places = [], [], np.empty(ints.shape, np.uint32)
        for d in range(ints.shape[1]):
            v, at = np.unique(ints[:, d], return_inverse=True)
            places[:, d] = at
            sizes.append(len(v))
            values += [str(i) for i in v.tolist()]
        return {"rows": [r[0] for r in rows], "sizes": sizes, "values": values, "places": places.tobytes()}

    for piece in pieces:
        held += zip(piece["_row"].tolist(), piece["vector"])
        dims = len(held[0][1]) if held else 1
        rows = max(1, BLOCK_VALUES // dims)
        while len(held) >= rows:
            yield pd.DataFrame([block(held[:rows])])
            held = held[rows:]
    if held:
        yield pd.DataFrame([block(held)])


class Dictionary:
    """The distinct integers of a block, by dimension, and each row's place among them."""

    def __init__(self, sizes, values, places):
        self.dims = len(sizes)
        ints = [int(v) for v in values]
        wide = any(abs(v) >= WIDE for v in ints)
        ends = np.cumsum(sizes)
        flat = np.array(ints, object if wide else np.int64)
        self.values = [flat[e - n:e] for e, n in zip(ends, sizes)]
        self.places = np.frombuffer(places, np.uint32).reshape(-1, self.dims) if self.dims else np.zeros((0, 0), np.uint32)

    def ints(self) -> np.ndarray:
        return np.stack([v[self.places[:, d]] for d, v in enumerate(self.values)], axis=1)

    def assign(self, book: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part (ties to the lower index) and the squared distances to it, both rows by parts."""
        n, width = len(self.places), self.dims // parts
        wide = any(v.dtype == object for v in self.values) or book.dtype == object
        kind = object if wide else np.int64
        best, least = np.zeros((n, parts), np.int64), np.zeros((n, parts), kind)
        # one table a dimension: squared differences of every distinct integer to that dimension of all entries
        for p in range(parts):
            tables = [(self.values[d].astype(kind)[:, None] - book[:, d].astype(kind)[None, :]) ** 2 for d in range(p * width, (p + 1) * width)]
            for i in range(0, n, STEP_ROWS):
                at = self.places[i:i + STEP_ROWS, p * width:(p + 1) * width]
                far = np.zeros((len(at), len(book)), kind)
                for k, table in enumerate(tables):
                    far += table[at[:, k]]
                best[i:i + STEP_ROWS, p] = near = np.argmin(far, axis=1) if len(book) else 0
                least[i:i + STEP_ROWS, p] = far[np.arange(len(at)), near]
        return best, least


def _sums(blocks: DataFrame, book, parts: int) -> DataFrame:
    """(part, entry, place, total, n): the sums over assigned parts, one partial row for each task."""
    def run(pieces):
        totals, counts = None, None
        for piece in pieces:
            for sizes, values, places in zip(piece["sizes"], piece["values"], piece["places"]):
                block = Dictionary(sizes, values, places)
                entries, width = len(book.value), block.dims // parts
                if totals is None:
                    totals = np.zeros((parts, entries, width), object)
                    counts = np.zeros((parts, entries), np.int64)
                best, _ = block.assign(book.value, parts)
                ints = block.ints()
                for p in range(parts):
                    counts[p] += np.bincount(best[:, p], minlength=entries)
                    part = np.zeros((entries, width), ints.dtype)
                    np.add.at(part, best[:, p], ints[:, p * width:(p + 1) * width])
                    totals[p] += part
        if totals is not None:
            p, e, w = (a.ravel() for a in np.indices(totals.shape))
            used = counts[p, e] > 0
            yield pd.DataFrame({"part": p[used], "entry": e[used], "place": w[used], "total": [str(int(t)) for t in totals.ravel()[used]], "n": counts[p, e][used]})

    rows = blocks.select("sizes", "values", "places").mapInPandas(run, "part int, entry int, place int, total string, n long")
    return rows.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def _book_array(book: list[list[int]]) -> np.ndarray:
    wide = any(abs(v) >= WIDE for row in book for v in row)
    return np.array(book, object if wide else np.int64).reshape(len(book), len(book[0]) if book else 0)


def digest(book: np.ndarray, parts: int) -> str:
    """SHA-256 of the final components as decimal text, by part, entry and position."""
    width = book.shape[1] // parts if len(book) else 0
    return hashlib.sha256(",".join(str(int(v)) for p in range(parts) for row in book for v in row[p * width:(p + 1) * width]).encode()).hexdigest()


def totals_by(df: DataFrame, key: str, value: str, total: str) -> DataFrame:
    """Adds the sum of a whole-number column over equal keys, nulls together; rows of a hot key are not gathered."""
    sums = df.groupBy(key).agg(F.sum(F.col(value).cast("decimal(20,0)")).try_cast("long").alias(total), F.count("*").alias("_n"))
    return join_groups(df, materialize(sums, "totals"), key, "_n")


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) for every vector that is kept.

    Kept are vectors without null or non-finite components whose length is the table's
    usual one: the commonest positive multiple of `parts`, the longer of equally common
    ones. The codebook starts as the kept vectors with the smallest keys (nulls last,
    equal keys by components, repeated rows each), fewer than `entries` if fewer are kept.
    Repeated rows are coded each; null labels count as one label, and without a label
    column all rows have one. An empty table gives an empty result. A sum that does not fit
    64 bits is null; a null `error` is left out of `label_error`.
    """
    named = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), (F.col(f"`{label}`") if label else F.lit(None).cast("int")).alias("label"))
    rows = named.where(finite(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).where((F.col("n") > 0) & (F.col("n") % parts == 0)).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    dims = sizes[0]["n"] if sizes else -1
    # the row number only ties a block's rows to their labels again; the written table fixes it
    kept = materialize(rows.where(F.size("vector") == dims).withColumn("_row", F.monotonically_increasing_id()), "vectors")
    first = kept.select("id", "vector").orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    book = _book_array(integers([r["vector"] for r in first]).tolist() if first else [])
    blocks = materialize(kept.select("_row", "vector").mapInPandas(_pack, _BLOCK), "blocks")
    sc = df.sparkSession.sparkContext
    width = max(dims, 0) // parts
    for _ in range(rounds if len(book) else 0):
        new = [list(row) for row in book.tolist()]
        for r in _sums(blocks, sc.broadcast(book), parts).toLocalIterator():
            new[r["entry"]][r["part"] * width + r["place"]] = int(r["total"]) // r["n"]
        book = _book_array(new)
    shared = sc.broadcast(book)

    def code(pieces):
        for piece in pieces:
            for numbers, sizes, values, places in zip(piece["rows"], piece["sizes"], piece["values"], piece["places"]):
                best, least = Dictionary(sizes, values, places).assign(shared.value, parts)
                error = [int(sum(int(v) for v in row)) for row in least.tolist()]
                yield pd.DataFrame({"_row": numbers, "code": ["".join(f"{e:02x}" for e in row) for row in best.tolist()], "error": pd.array([e if e < 1 << 63 else None for e in error], "Int64")})

    coded = blocks.select("rows", "sizes", "values", "places").mapInPandas(code, "_row long, code string, error long")
    out = materialize(kept.select("_row", "id", "label").join(coded, "_row"), "coded")
    return totals_by(out, "label", "error", "label_error").select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest(book, parts)).alias("codebooks_sha256"))
