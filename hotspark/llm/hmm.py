"""Hidden Markov language model over words.

Tokens are a text's words and one end. Frequent words have emission probabilities of
their own; every other word is emitted as its class (a hash of its last bytes) and then
drawn from the class by smoothed counts, so unknown words have probability too and
each state's emissions sum to one. Baum-Welch runs over all training texts: tasks gather
expected counts, blocks of them are summed by a shuffle. In its first pass the texts come
in slices and the parameters move after each; whole rounds follow. Scores are the exact scaled forward recursion over each whole text.

Counts of all words stay a distributed table. Tasks hold the counts of a bounded number
of frequent words; the other words of a text meet their counts in a join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hotspark.llm.kernels import LOWER, UNSPACED, buffers, byte_values, list_array, map_texts, mix, signed, span_hashes, steps, word_spans
from hotspark.session import materialize

STATES = 8
CLASSES = 1 << 12
#: Words at most that tasks hold counts of, and those of them with own emissions.
COUNTED = 1 << 17
EMITTED = 1 << 15
#: Slices of the first pass, dealt by hash; together they are all training texts.
SLICES = 12
#: What earlier slices' counts keep of their weight at each slice.
FADE = 0.5
#: Rounds over all training texts after it.
ROUNDS = 2
#: Tokens of a training sequence; longer texts are cut for training, never for scoring.
SEGMENT = 64
#: Rarer words are emitted as their classes.
OWN_COUNT = 5
#: Pseudo counts of a state's emissions, and their share of the state's tokens, spread as the words' own frequencies.
PRIOR, SHARE = 20.0, 0.05
_BLOCK = 2048
_VALUES = byte_values(51)
_FLUSH = 1 << 20


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of each word, and word offsets per row."""
    data = LOWER[data]
    first, last, woffs = word_spans(data, offs, UNSPACED)
    tail = np.zeros(len(last), np.uint64)
    for k in (3, 2, 1):
        at = last - k
        tail = (tail << np.uint64(8)) | np.where(at >= first, data[np.maximum(at, 0)], 0).astype(np.uint64)
    return span_hashes(data, first, last, _VALUES), (mix(tail) % np.uint64(CLASSES)).astype(np.int32), woffs


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(h, class, c) of every word; each task sums its words before the shuffle."""
    def run(batches):
        parts: list[tuple] = []
        size = 0

        def flush():
            h, cls, c = (np.concatenate(x) for x in zip(*parts))
            h, at, back = np.unique(h, return_index=True, return_inverse=True)
            return h, cls[at], np.bincount(back, c).astype(np.int64)

        def batch_of(h, cls, c):
            return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(cls, pa.int32()), pa.array(c)], names=["h", "class", "c"])

        for b in batches:
            data, offs = buffers(b.column(0))
            for i, j in steps(offs):
                h, cls, _ = words_of(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                h, at, c = np.unique(h, return_index=True, return_counts=True)
                parts.append((h, cls[at], c))
                size += len(h)
                if size > _FLUSH:
                    parts = [flush()]
                    size = len(parts[0][0])
                    if size > _FLUSH // 2:
                        yield batch_of(*parts[0])
                        parts, size = [], 0
        if parts:
            yield batch_of(*flush())

    rows = docs.select(text).mapInArrow(run, "h long, class int, c long")
    return rows.groupBy("h").agg(F.first("class").alias("class"), F.sum("c").alias("c"))


class Vocabulary:
    """What tasks know of the words: hashes, counts and emission numbers of frequent words, class totals."""

    def __init__(self, h: np.ndarray, cls: np.ndarray, c: np.ndarray, classes: dict, total: int, distinct: int, ends: int):
        rank = np.lexsort((h, -c))
        own = np.full(len(h), -1, np.int64)
        best = rank[:EMITTED]
        best = best[c[best] >= OWN_COUNT]
        own[best] = np.arange(len(best))
        self.own = int((own >= 0).sum())
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        self.emits = np.where(own >= 0, own, self.own + cls)[order].astype(np.int32)
        self.size = self.own + CLASSES + 1
        self.end = self.size - 1
        # class totals: words without own emissions
        mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        for k, (m, n) in classes.items():
            mass[k], kinds[k] = m, n
        rest = own < 0
        mass += np.bincount(cls[rest], c[rest], CLASSES)
        kinds += np.bincount(cls[rest], minlength=CLASSES)
        self.class_log = np.log10(mass + kinds + 1)
        self.total, self.distinct, self.ends = total, distinct, ends
        self.frequency = np.zeros(self.size)
        self.frequency[own[own >= 0]] = c[own >= 0]
        self.frequency[self.own:self.end] = mass
        self.frequency[self.end] = ends
        self.frequency = (self.frequency + 0.5) / (self.frequency + 0.5).sum()

    def read(self, data: np.ndarray, offs: np.ndarray):
        """Per word: hash, emission number, whether its count is held here and the count; word offsets."""
        h, cls, woffs = words_of(data, offs)
        if not len(self.h):
            return h, (self.own + cls).astype(np.int32), np.zeros(len(h), bool), np.zeros(len(h), np.int64), woffs
        at = np.searchsorted(self.h, h)
        at[at == len(self.h)] = 0
        held = self.h[at] == h
        return h, np.where(held, self.emits[at], self.own + cls).astype(np.int32), held, np.where(held, self.c[at], 0), woffs

    def sequences(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Emission numbers of all rows, each with its end, and token offsets."""
        _, ids, _, _, woffs = self.read(data, offs)
        return self.with_ends(ids, woffs)

    def with_ends(self, ids: np.ndarray, woffs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(woffs) - 1
        out = np.full(len(ids) + n, self.end, np.int32)
        rows = np.repeat(np.arange(n), np.diff(woffs))
        out[np.arange(len(ids)) + rows] = ids
        return out, woffs + np.arange(n + 1)


class Model:
    """Start, transition and emission probabilities; `anywhere` starts a training segment within a text."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.start = np.full(STATES, 1 / STATES)
        self.anywhere = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES)
        noise = rng.gamma(2.0, 0.5, (vocabulary.size, STATES))
        self.emit = vocabulary.frequency[:, None] * noise
        self.emit /= self.emit.sum(axis=0)

    def expected(self, ids: np.ndarray, toffs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts over the texts: emissions, moves, states at a text's start, states at other segments' starts."""
        sizes = np.diff(toffs)
        counts = -(-sizes // SEGMENT)
        rows = np.repeat(np.arange(len(sizes)), counts)
        k = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = toffs[:-1][rows] + k * SEGMENT
        length = np.minimum(SEGMENT, toffs[1:][rows] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, first = begin[order], length[order], (k == 0)[order]
        moves = np.zeros((STATES, STATES))
        alive = [int(n) for n in np.searchsorted(-length, -np.arange(1, SEGMENT + 1), side="right")]
        alphas, seen = [], []
        alpha = np.where(first[:, None], self.start, self.anywhere)
        for t in range(SEGMENT):
            n = alive[t]
            if not n:
                break
            b = self.emit[ids[begin[:n] + t]]
            alpha = (alpha[:n] if t == 0 else alpha[:n] @ self.move) * b
            scale = alpha.sum(axis=1, keepdims=True)
            alpha = alpha / scale
            alphas.append(alpha)
            seen.append((b, scale))
        gammas = [None] * len(alphas)
        beta = np.ones((alive[len(alphas) - 1] if alphas else 0, STATES))
        for t in range(len(alphas) - 1, -1, -1):
            n = alive[t]
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), STATES))])
            g = alphas[t] * beta
            gammas[t] = g / g.sum(axis=1, keepdims=True)
            if t:
                b, scale = seen[t]
                w = b * beta / scale
                moves += alphas[t - 1][:n].T @ w
                beta = w @ self.move.T
        emits = np.zeros((len(self.emit), STATES))
        if gammas:
            flat = np.concatenate([ids[begin[:alive[t]] + t] for t in range(len(gammas))])
            g = np.concatenate(gammas)
            for s in range(STATES):
                emits[:, s] = np.bincount(flat, g[:, s], minlength=len(emits))
            starts = gammas[0][first].sum(axis=0), gammas[0][~first].sum(axis=0)
        else:
            starts = np.zeros(STATES), np.zeros(STATES)
        return emits, moves * self.move, *starts

    def update(self, emits, moves, start, inside, frequency) -> None:
        self.emit = emits + (PRIOR + SHARE * emits.sum(axis=0)) * frequency[:, None]
        self.emit /= self.emit.sum(axis=0)
        self.move = moves + 0.5
        self.move /= self.move.sum(axis=1, keepdims=True)
        self.start = (start + 0.5) / (start + 0.5).sum()
        both = start + inside + 0.5
        self.anywhere = both / both.sum()

    def forward(self, ids: np.ndarray, toffs: np.ndarray) -> np.ndarray:
        """log10 probability of each whole sequence."""
        sizes = np.diff(toffs)
        order = np.argsort(-sizes, kind="stable")
        begin, length = toffs[:-1][order], sizes[order]
        log = np.zeros(len(sizes))
        steps_ = int(length[0]) if len(length) else 0
        alive = np.searchsorted(-length, -np.arange(1, steps_ + 1), side="right")
        alpha = np.tile(self.start, (len(sizes), 1))
        for t in range(steps_):
            n = alive[t]
            alpha = (alpha[:n] if t == 0 else alpha[:n] @ self.move) * self.emit[ids[begin[:n] + t]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            log[:n] += np.log10(scale)
        out = np.empty(len(sizes))
        out[order] = log
        return out


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """The frequent words: the largest steps of counts (on a log scale) that hold at most COUNTED words."""
    step = F.floor(16 * F.log2("c")).cast("int")
    histogram = sorted(((r["step"], r["n"], r["mass"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("mass")).collect()), reverse=True)
    bar, kept = 1 << 20, 0
    for k, n, _ in histogram:
        if kept + n > COUNTED:
            break
        bar, kept = k, kept + n
    frequent = counts.where(step >= bar).select("h", "class", "c").toArrow()
    rest = {r["class"]: (r["mass"], r["n"]) for r in counts.where(step < bar).groupBy("class").agg(F.sum("c").alias("mass"), F.count("*").alias("n")).collect()}
    h, cls, c = (frequent.column(k).to_numpy() for k in ("h", "class", "c"))
    return Vocabulary(h.view(np.uint64) if len(h) else np.zeros(0, np.uint64), cls, c, rest, sum(m for _, _, m in histogram) + ends, sum(n for _, n, _ in histogram) + (ends > 0), ends)


def train(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, Vocabulary, Model]:
    """Counts of all words, the frequent words and the model, from all given texts."""
    spark = docs.sparkSession
    counts = materialize(count_words(docs, text), "words")
    ends = docs.count()
    vocab = vocabulary(counts, ends)
    model = Model(vocab)
    if not ends:
        return counts, vocab, model
    shared = spark.sparkContext.broadcast(vocab)
    sums = None
    for part in slices(docs, text, key):
        found = _expected(part, text, shared, model)
        sums = found if sums is None else tuple(FADE * s + x for s, x in zip(sums, found))
        model.update(*sums, vocab.frequency)
    for _ in range(ROUNDS):
        model.update(*_expected(docs, text, shared, model), vocab.frequency)
    return counts, vocab, model


def slices(docs: DataFrame, text: str, key: str) -> list[DataFrame]:
    """All rows, each in one of SLICES parts."""
    part = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(SLICES))
    return [docs.where(part == k) for k in range(SLICES)]


def _expected(docs: DataFrame, text: str, shared, model: Model):
    """Expected counts over all texts: one table a task, cut into blocks that a shuffle sums."""
    current = docs.sparkSession.sparkContext.broadcast(model)
    extra = 2 * STATES + STATES * STATES

    def run(batches):
        vocab, m = shared.value, current.value
        emits, other = np.zeros((vocab.size, STATES)), np.zeros(extra)
        for b in batches:
            data, offs = buffers(b.column(0))
            for i, j in steps(offs):
                e, moves, start, inside = m.expected(*vocab.sequences(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]))
                emits += e
                other += np.concatenate([start, inside, moves.ravel()])
        if other.any():
            blocks = [emits[k:k + _BLOCK].astype(np.float32) for k in range(0, len(emits), _BLOCK)]
            numbers = [k for k, x in enumerate(blocks) if x.any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *numbers], pa.int32()), pa.array([other.astype(np.float32).tobytes(), *(blocks[k].tobytes() for k in numbers)], pa.binary())], names=["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(counts.as_buffer(), np.float32).astype(float)
                sums[block] = sums[block] + x if block in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"])

    rows = docs.select(text).mapInArrow(run, "block int, counts binary")
    summed = rows.repartition("block", F.pmod(F.xxhash64("counts"), F.lit(8))).mapInArrow(add, "block int, counts binary")
    emits, other = np.zeros(len(model.emit) * STATES), np.zeros(extra)
    for r in summed.toLocalIterator():
        x = np.frombuffer(r["counts"], float)
        if r["block"] < 0:
            other += x
        else:
            emits[r["block"] * _BLOCK * STATES:r["block"] * _BLOCK * STATES + len(x)] += x
    return emits.reshape(-1, STATES), other[2 * STATES:].reshape(STATES, STATES), other[:STATES], other[STATES:2 * STATES]


_FIELDS = [
    T.StructField("_row", T.LongType()), T.StructField("_tokens", T.LongType()), T.StructField("_held", T.LongType()), T.StructField("_base", T.DoubleType()), T.StructField("_score", T.DoubleType()),
    T.StructField("_rare", T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("k", T.IntegerType())]))),
]


def score(docs: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Kept columns, n_tokens, n_known, train_tokens, base_score and score of each row.

    Learns from the rows where `learn` holds. A null or empty text is its end alone.
    Each row gets its own result, repeated rows equal ones; a text of any length is
    scored whole; without training rows every token is unknown and train_tokens is 0.
    An empty table gives an empty one. Kept columns that clash with new ones are replaced.
    """
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    columns = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    counts, vocab, model = train(docs.where(learn), text, key)
    sc = docs.sparkSession.sparkContext
    known, trained = sc.broadcast(vocab), sc.broadcast(model)

    def make():
        v, m = known.value, trained.value
        task = TaskContext.get()
        count = [(task.partitionId() if task else 0) << 40]
        unit = math.log10(v.total + v.distinct + 1)

        def run(column):
            data, offs = buffers(column)
            n = len(offs) - 1
            ids_, sizes, held_, base, score_, rare_h, rare_k, rare_n = [], [], [], [], [], [], [], []
            for i, j in steps(offs):
                h, ids, held, c, woffs = v.read(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                rows = np.repeat(np.arange(j - i), np.diff(woffs))
                logs = np.log10(c + 1.0)
                classed = ids >= v.own
                held_.append(np.bincount(rows[held], minlength=j - i))
                base.append(np.bincount(rows, logs - unit, minlength=j - i))
                of_class = np.where(classed, logs - v.class_log[np.where(classed, ids - v.own, 0)], 0.0)
                score_.append(np.bincount(rows, of_class, minlength=j - i))
                rows, h = rows[~held], h[~held]
                order = np.lexsort((h, rows))
                rows, h = rows[order], h[order]
                at = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
                rare_h.append(h[at])
                rare_k.append(np.diff(np.append(at, len(h))).astype(np.int32))
                rare_n.append(np.bincount(rows[at], minlength=j - i))
                ids, toffs = v.with_ends(ids, woffs)
                ids_.append(ids)
                sizes.append(np.diff(toffs))
            cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            sizes = cat(sizes, np.int64)
            logs = m.forward(cat(ids_, np.int32), np.concatenate([[0], np.cumsum(sizes)]))
            rare = pa.StructArray.from_arrays([pa.array(signed(cat(rare_h, np.uint64))), pa.array(cat(rare_k, np.int32))], names=["h", "k"])
            numbers = np.arange(count[0], count[0] + n)
            count[0] += n
            return [
                pa.array(numbers), pa.array(sizes), pa.array(cat(held_, np.int64) + (v.ends > 0)),
                pa.array(cat(base, float) + (math.log10(v.ends + 1) - unit)), pa.array(logs + cat(score_, float)),
                list_array(rare, np.concatenate([[0], np.cumsum(cat(rare_n, np.int64))])),
            ]

        return run

    read = materialize(map_texts(docs, text, columns, _FIELDS, make), "scored")
    rare = read.select("_row", F.explode("_rare").alias("r")).select("_row", F.col("r.h").alias("h"), F.col("r.k").alias("k"))
    sums = rare.join(counts.select("h", "c"), "h").groupBy("_row").agg(F.sum("k").alias("found"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("log"))
    out = read.drop("_rare").join(sums, "_row", "left").fillna({"found": 0, "log": 0.0})
    return out.select(
        *(F.col(f"`{c}`") for c in columns), F.col("_tokens").alias("n_tokens"), (F.col("_held") + F.col("found")).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("_base") + F.col("log")).alias("base_score"), (F.col("_score") + F.col("log")).alias("score"))
