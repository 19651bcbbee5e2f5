"""Byte-level BPE by monoid tree reduction.

Every pre-token is encoded by halves: both halves recursively, then joined. A join
re-encodes a window around the seam and grows it until it is stable. Stable is
provable: a token sequence is the encoding of its bytes if each pair of neighbours
is the encoding of that pair's bytes, because the first merge that crossed a seam
would also happen in the pair alone. Pairs outside the window are so already, pairs
inside come from one encoding, so only the two pairs at the window's edges are
tested. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from hotspark.llm.kernels import buffers, list_array, map_texts, steps

#: Bytes up to which a piece is a leaf of the tree.
LEAF_BYTES = 24
#: Pieces that a worker remembers; the memo is emptied when full and changes no result.
MEMO_PIECES = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 and number on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class Encoder:
    """Encoding of pieces by ranks; a worker holds one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def leaf(self, piece: bytes) -> list[int]:
        """Merge the neighbours of lowest rank, leftmost first, until none is left."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None and len(piece) == 1:
            return [whole]
        parts = [piece[i:i + 1] for i in range(len(piece))]
        found = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(found):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(found):
                found[at] = get(parts[at] + parts[at + 1])

    def window(self, piece: bytes) -> list[int]:
        """The same merges with a heap, for long windows."""
        if len(piece) <= 2 * LEAF_BYTES:
            return self.leaf(piece)
        n, get = len(piece), self.ranks.get
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                r = get(piece[i:end[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[i], end[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or end[i] != mid or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [self.ranks[piece[i:end[i]]] for i in range(n) if alive[i]]

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are next to each other."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO_PIECES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.window(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            keep = len(left) - i
            mid = self.window(self.bytes_of(left[keep:]) + self.bytes_of(right[:j]))
            open_left = keep > 0 and not self.stable(left[keep - 1], mid[0])
            open_right = j < len(right) and not self.stable(mid[-1], right[j])
            if not open_left and not open_right:
                return left[:keep] + mid + right[j:]
            i, j = i * (1 + open_left), j * (1 + open_right)

    def encode(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.leaf(piece) if piece else []
        half = len(piece) // 2
        return self.join(self.encode(piece[:half]), self.encode(piece[half:]))


class _Memo(dict):
    """Pieces of text and the little-endian ids that they encode to."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = np.array(self.encoder.encode(raw), "<u4").tobytes()
        if len(raw) <= 64:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Tokenizer:
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.memo = _Memo(Encoder(ranks))
        size = max(ranks.values(), default=-1) + 1
        self.lengths = np.zeros(size, np.int64)
        for t, r in ranks.items():
            self.lengths[r] = len(t)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.flat = np.frombuffer(b"".join(t for t, _ in by_rank), np.uint8)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.flat[at]


_worker: dict[str, Tokenizer] = {}


def _tokenizer(key: str, ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    if key not in _worker:
        _worker.clear()
        _worker[key] = Tokenizer(ranks, pattern)
    return _worker[key]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Kept columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the `ids` themselves.

    A null or empty text has no tokens; equal rows give equal results; an empty table
    gives an empty one. Kept columns with the new names are replaced. The rank file is
    read on the driver and broadcast (its size is that of a vocabulary). A batch is
    handled in steps of bounded bytes; a text of any length is encoded whole.
    """
    ranks = read_ranks(path)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    key = f"{path}\n{pattern}"
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))

    def make():
        tok = _tokenizer(key, shared.value, pattern)

        def run(column):
            data, offs = buffers(column)
            n_tokens, sha, back, all_ids = [], [], [], []
            for i, j in steps(offs):
                raw = data[offs[i]:offs[j]].tobytes()
                coded = [tok.encode(raw[offs[k] - offs[i]:offs[k + 1] - offs[i]].decode()) for k in range(i, j)]
                sha.extend(hashlib.sha256(c).hexdigest() for c in coded)
                counts = [len(c) // 4 for c in coded]
                n_tokens.extend(counts)
                ids = np.frombuffer(b"".join(coded), "<u4")
                decoded = tok.decode(ids).data
                ends = np.concatenate([[0], np.cumsum(tok.lengths[ids])])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
                back.extend(hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(ends, ends[1:]))
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            out = [pa.array(n_tokens, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                flat = np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32)
                out.append(list_array(pa.array(flat, pa.int32()), np.concatenate([[0], np.cumsum(n_tokens, dtype=np.int64)])))
            return out

        return run

    return map_texts(df, text, list(keep if keep is not None else [c for c in df.columns if c != text]), fields, make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """The frame with column `out`: the text that the ids stand for (null for null ids; unknown ids are an error)."""
    from pyspark.sql import functions as F

    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    key = f"{path}\n{pattern}"

    @F.pandas_udf(T.StringType())
    def text_of(column):
        tok = _tokenizer(key, shared.value, pattern)
        return column.map(lambda v: None if v is None else tok.decode(np.asarray(v, np.int64)).tobytes().decode("utf-8", "replace"))

    return df.withColumn(out, text_of(F.col(ids)))
