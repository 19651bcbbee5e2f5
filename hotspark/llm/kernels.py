"""Small numpy helpers that run inside tasks on Arrow string columns.

A text is a slice of the column's UTF-8 buffer, so no Python string is made. Word
hashes are polynomial prefix hashes modulo 2**64: one pass over the bytes gives the
hash of every word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hotspark.session import prepare

#: Bytes of text that one numpy step takes; a longer text is a step of its own.
STEP_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = np.zeros(256, np.uint8)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = 1
#: Word bytes of `[^\x20\x09-\x0D]+`.
UNSPACED = np.ones(256, np.uint8)
UNSPACED[[9, 10, 11, 12, 13, 32]] = 0
#: Runs of letters and digits (1) and runs of other visible bytes (2).
KINDS = np.where(ALNUM == 1, 1, np.where(UNSPACED == 1, 2, 0)).astype(np.uint8)
KINDS[:9] = KINDS[14:32] = KINDS[127] = 0


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def steps(offs: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each, covering all rows."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one non-zero kind, and word offsets per row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = kinds[data]
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    cut[offs] = True
    at = np.flatnonzero(cut)
    first, last = at[:-1], at[1:]
    word = kind[first] != 0
    first, last = first[word], last[word]
    return first, last, np.searchsorted(first, offs)


#: Rows and bytes of an Arrow batch; a task holds a few batches at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 1 << 24


def ready(spark: SparkSession) -> SparkSession:
    """The session with its settings pinned and batches small enough for whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return prepare(spark)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def byte_values(seed: int) -> np.ndarray:
    """One fixed 64-bit value for each byte."""
    return np.array([_mix_int((seed << 8) + b + 1) for b in range(256)], np.uint64)


def _mix_int(x: int) -> int:
    x = (x * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & _MASK
    x ^= x >> 31
    x = (x * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 29)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[first:last] for each span."""
    power, inverse = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * power[:len(data)], out=prefix[1:])
    return mix((prefix[last] - prefix[first]) * inverse[first] + (last - first).astype(np.uint64) * values[0])


def run_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes; runs may cross rows, the caller cuts them."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    factor = _mix_int(seed) | 1
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(factor) + words[k:len(words) - n + 1 + k]
    return mix(out + np.uint64(n))


def within_rows(woffs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of n words that stay within one row, and their rows."""
    counts = np.maximum(np.diff(woffs) - n + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + woffs[:-1][rows], rows


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def map_texts(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], make: Callable[[], Callable]) -> DataFrame:
    """Columns `keep` and the new `fields`, which a function computes from the text column, batch by batch.

    `make()` runs once a task and returns a function from an Arrow string column to
    arrays. A kept column with a new field's name is replaced.
    """
    new = {f.name for f in fields}
    keep = [c for c in keep if c not in new]
    source = df.select(*(f"`{c}`" for c in dict.fromkeys([*keep, text])))
    schema = T.StructType([*(source.schema[c] for c in keep), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        f = make()
        for b in batches:
            made = f(b.column(b.schema.get_field_index(text)))
            kept = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(a if a.type == t.type else a.cast(t.type) for a, t in zip(made, list(arrow)[len(keep):]))],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)
