"""Training-order materialisation: fixed-stride shards in a keyed random order.

Documents are cut into sequences of token ids. Each sequence's running number goes
through a keyed Feistel permutation of [0, N); values outside the range are permuted
again until they fall into it, so every slot is taken once. Each task bundles its
sequences by shard, a shuffle gives every shard to one writer, and the writer puts them
into records of equal length by slot, so slot s is at byte (s mod shard size) * stride
of shard s div shard size, and a reader can start anywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hotspark.llm.kernels import buffers, list_array, mix
from hotspark.session import fresh_path

#: Tokens of a sequence, and sequences of a shard.
LENGTH = 512
SHARD = 1 << 15
ROUNDS = 6


def feistel(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """The numbers' places under a permutation of [0, size) that the key picks."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
    out = numbers.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> np.uint64(half), out[walk] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[walk] = (left << np.uint64(half)) | right
        walk = walk[out[walk] >= np.uint64(size)]
    return out.astype(np.int64)


def _tokens(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and row offsets: the bytes of a text, or a list of ids; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return buffers(column)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and (flat.min() < 0 or flat.max() > np.iinfo(kind).max):
        raise ValueError(f"an id does not fit into {kind}")
    return flat.astype(kind), np.concatenate([[0], np.cumsum(sizes)])


def write(df: DataFrame, key: str, tokens: str, path: str | None = None, seed: int = 1, length: int = LENGTH, shard: int = SHARD, kind: str = "u1") -> DataFrame:
    """Write the shards and return one row for each sequence: slot, key, part, n_tokens, ids_sha256, shard.

    `tokens` is a text (its UTF-8 bytes are the ids) or a list of ids that fit into `kind`;
    a null or empty one has no sequence, repeated rows have sequences of their own, a text
    of any length is cut into as many sequences as it needs, a null key stays null. An
    empty table writes nothing. A kept key with a new column's name keeps its values under `key`.

    Sequences are numbered by the scan's partitions, which are counted first; a writer
    that finds another count fails instead of filling a slot twice. A task that runs again
    writes the same shard under another name and then renames it.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "training-order")
    size_of = F.octet_length(tokens) if isinstance(df.schema[tokens].dataType, T.StringType) else F.size(tokens)
    n_parts = F.when(F.col(tokens).isNull(), 0).otherwise(F.ceil(size_of / F.lit(length)))
    counts = {r["p"]: r["n"] for r in df.select(F.spark_partition_id().alias("p"), n_parts.cast("long").alias("n")).groupBy("p").agg(F.sum("n").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p] = total
        total += counts[p]
    source = df.select(F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    dtype = np.dtype(kind).newbyteorder("<")
    width = dtype.itemsize
    held = source.schema["key"].dataType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("slots", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(held)),
        T.StructField("parts", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("ids", T.BinaryType())])

    def place(batches):
        """One row for each batch and shard: its sequences there, their ids compressed together."""
        p = TaskContext.get().partitionId()
        at, done = starts.get(p, 0), 0
        for b in batches:
            ids, offs = _tokens(b.column(1), dtype)
            raw = np.ascontiguousarray(ids).view(np.uint8)
            n = -(-np.diff(offs) // length)
            rows = np.repeat(np.arange(len(n)), n)
            part = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            slots = feistel(np.arange(at + done, at + done + len(rows)), total, seed)
            done += len(rows)
            begin = offs[:-1][rows] + part * length
            size = np.minimum(length, offs[1:][rows] - begin)
            order = np.argsort(slots)
            slots, rows, part, begin, size = slots[order], rows[order], part[order], begin[order] * width, size[order]
            shards_here, first = np.unique(slots // shard, return_index=True)
            bounds = np.append(first, len(slots))
            blobs = []
            for i, j in zip(bounds, bounds[1:]):
                piece = size[i:j] * width
                picked = np.repeat(begin[i:j] - np.cumsum(piece) + piece, piece) + np.arange(int(piece.sum()))
                blobs.append(pa.compress(raw[picked].tobytes(), codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards_here.astype(np.int32)), *(list_array(x, bounds) for x in (pa.array(slots), b.column(0).take(pa.array(rows)), pa.array(part.astype(np.int32)), pa.array(size.astype(np.int32)))), pa.array(blobs, pa.binary())],
                names=schema.names)
        if done != counts.get(p, 0):
            raise RuntimeError(f"partition {p} has {done} sequences and had {counts.get(p, 0)} when they were counted")

    shards = max(1, -(-total // shard))
    stride = 4 + length * width
    out_schema = T.StructType([T.StructField("slot", T.LongType()), source.schema["key"], T.StructField("part", T.IntegerType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("shard", T.IntegerType())])
    arrow = to_arrow_schema(out_schema)

    def store(batches):
        """Fill one shard's records in memory (its size is fixed) and write them."""
        number, record, keys, at, parts, sizes = None, None, [], [], [], []
        for b in batches:
            for k in range(b.num_rows):
                if record is None:
                    number = b.column(0)[k].as_py()
                    record = np.zeros((min(shard, total - number * shard), stride), np.uint8)
                slots, own, part, size = (b.column(c).slice(k, 1).flatten() for c in (1, 2, 3, 4))
                place_, n = slots.to_numpy() - number * shard, size.to_numpy().astype(np.int64)
                data = np.frombuffer(pa.decompress(b.column(5)[k].as_buffer(), int(n.sum()) * width, codec="zstd"), np.uint8)
                record[place_, :4] = n.astype("<u4").view(np.uint8).reshape(-1, 4)
                wide = n * width
                record.reshape(-1)[np.repeat(place_ * stride + 4 - np.cumsum(wide) + wide, wide) + np.arange(len(data))] = data
                keys.append(own)
                at.append(place_)
                parts.append(part)
                sizes.append(n)
        if record is None:
            return
        store_, folder = fs.FileSystem.from_uri(path)
        store_.create_dir(folder, recursive=True)
        name = f"{folder}/.shard-{number:06d}-{TaskContext.get().taskAttemptId()}"
        with store_.open_output_stream(name) as stream:
            stream.write(record.tobytes())
        store_.move(name, f"{folder}/shard-{number:06d}.bin")
        at = np.concatenate(at)
        order = np.argsort(at)
        take = lambda x: pa.concat_arrays(x).take(pa.array(order))
        sizes = np.concatenate(sizes)[order]
        sha = [hashlib.sha256(r[4:4 + n * width]).hexdigest() for r, n in zip(record, sizes)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[order] + number * shard), take(keys).cast(arrow.field(1).type), take(parts), pa.array(sizes), pa.array(sha, pa.string()), pa.array(np.full(len(at), number, np.int32))], names=out_schema.names)

    placed = source.mapInArrow(place, schema).repartitionById(shards, "shard")
    return placed.mapInArrow(store, out_schema).withColumnRenamed("key", key)


def read(path: str, slot: int, n: int, length: int = LENGTH, shard: int = SHARD, kind: str = "u1") -> list[np.ndarray]:
    """The ids of n slots from `slot` on, by position in the shards; stops at the end of the order."""
    store_, folder = fs.FileSystem.from_uri(path)
    dtype = np.dtype(kind).newbyteorder("<")
    stride = 4 + length * dtype.itemsize
    out: list[np.ndarray] = []
    while len(out) < n:
        name = f"{folder}/shard-{(slot + len(out)) // shard:06d}.bin"
        if store_.get_file_info(name).type != fs.FileType.File:
            break
        with store_.open_input_file(name) as f:
            first = (slot + len(out)) % shard
            raw = f.read_at(min((n - len(out)) * stride, max(0, f.size() - first * stride)), first * stride)
        if not raw:
            break
        for k in range(0, len(raw), stride):
            size = int.from_bytes(raw[k:k + 4], "little")
            out.append(np.frombuffer(raw, dtype, size, k + 4))
    return out
