"""Ranked lexical search: dual trees over items and documents.

One pass over the texts keeps, for each document, its length and the occurrences of the
words that any item holds (a bitmap of fixed size lets the others go). From that table
come the corpus counts and the words' weights. Items are dealt into batches of bounded
size; a batch is a tree whose nodes hold, for each word, the largest weight below them.
A task makes a tree of each batch of documents, whose nodes hold the largest impact of
each word. The sum of products of two nodes is a bound for all pairs below them, in
64-bit integers like the scores; if it is under the weakest k-th score of the items
below the node, the whole pair of nodes goes. Bounds never lie under a score, so the
result is exact. The first thresholds come from a share of the documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from hotspark.llm.bits import bitmap, member
from hotspark.llm.kernels import ALNUM, LOWER, buffers, byte_values, list_array, map_texts, signed, span_hashes, steps, word_spans
from hotspark.session import materialize

TOP = 10
#: Distinct words of a batch of items, about; a batch is broadcast and goes over the documents once.
BATCH_WORDS = 1 << 18
#: One document in this many sets the first thresholds. The result does not depend on it.
FIRST_SHARE = 16
#: Items and documents of a leaf, and children of a node.
ITEM_LEAF, DOC_LEAF, FAN = 8, 16, 8
_VALUES = byte_values(11)
#: A document's impact: SATURATE tf div (1000 tf + 8 m), with m from its length.
SATURATE = 1_000_000_000
_NONE = np.iinfo(np.int64).max


def _counted(data: np.ndarray, offs: np.ndarray, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row, and its distinct words (that the bitmap may hold) with their occurrences: lengths, row offsets, hashes, counts."""
    data = LOWER[data]
    first, last, woffs = word_spans(data, offs, ALNUM)
    words = span_hashes(data, first, last, _VALUES)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(woffs))
    if bits is not None:
        may = member(bits, words)
        words, rows = words[may], rows[may]
    order = np.lexsort((words, rows))
    words, rows = words[order], rows[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(words)))
    return np.diff(woffs), np.searchsorted(rows[at], np.arange(len(offs))), words[at], counts


def word_counts(df: DataFrame, text: str, keep: list[str], bits: np.ndarray | None = None) -> DataFrame:
    """Kept columns, n (words with repeats), words (hashes of distinct words) and counts; a null text has none."""
    shared = df.sparkSession.sparkContext.broadcast(bits)
    fields = [T.StructField("n", T.LongType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))]

    def make():
        def run(column):
            data, offs = buffers(column)
            n, ends, words, counts = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in steps(offs):
                a, b, c, d = _counted(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], shared.value)
                n.append(a)
                ends.append(ends[-1][-1] + b[1:])
                words.append(signed(c))
                counts.append(d)
            ends = np.concatenate(ends)
            return [pa.array(np.concatenate(n).astype(np.int64)), list_array(pa.array(np.concatenate(words)), ends), list_array(pa.array(np.concatenate(counts).astype(np.int64)), ends)]

        return run

    return map_texts(df, text, keep, fields, make)


class ItemTree:
    """Items as sparse rows over the batch's words, and levels of nodes that hold the maxima of their children."""

    def __init__(self, items: list[tuple[int, list[int], list[int]]], weights: dict[int, int]):
        vocabulary = np.array(sorted({w for _, words, _ in items for w in words if weights.get(w, 0) > 0}), np.int64)
        place = {w: i for i, w in enumerate(vocabulary.tolist())}
        rows = []
        for number, words, counts in items:
            own = sorted((place[w], weights[w] * c) for w, c in zip(words, counts) if w in place)
            if own:
                # neighbours share their heaviest word, so that nodes have few heavy words
                rows.append((max(own, key=lambda x: (x[1], -x[0]))[0], number, own))
        rows.sort()
        self.words = vocabulary
        self.numbers = np.array([r[1] for r in rows], np.int64)
        level = [r[2] for r in rows]
        self.levels = []
        step = ITEM_LEAF
        while True:
            self.levels.append(self._pack(level))
            if len(level) <= 1:
                break
            level = [self._union(level[i:i + step]) for i in range(0, len(level), step)]
            step = FAN

    @staticmethod
    def _union(children: list) -> list:
        best: dict[int, int] = {}
        for child in children:
            for w, v in child:
                best[w] = max(best.get(w, 0), v)
        return sorted(best.items())

    @staticmethod
    def _pack(level: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = [x for row in level for x in row]
        return (np.cumsum([0] + [len(r) for r in level]), np.array([w for w, _ in flat], np.int64), np.array([v for _, v in flat], np.int64))

    def children(self, depth: int, node: int) -> range:
        """Nodes of the level below (items, for depth 1)."""
        step = ITEM_LEAF if depth == 1 else FAN
        return range(node * step, min((node + 1) * step, len(self.levels[depth - 1][0]) - 1))

    def sums(self, depth: int, nodes: range, impacts: np.ndarray) -> np.ndarray:
        """Sums of weight times impact, for rows of impacts by consecutive nodes of a level."""
        offs, words, values = self.levels[depth]
        a, b = offs[nodes.start], offs[nodes.stop]
        # no row of a level is empty, so every segment has a start of its own
        return np.add.reduceat(impacts[..., words[a:b]] * values[a:b], offs[nodes.start:nodes.stop] - a, axis=-1)


class Best:
    """The k best (score, document) pairs of each item so far, ties to the smaller document."""

    def __init__(self, items: int, k: int, first: list[tuple[int, int]] | None = None):
        self.k = k
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in range(items)]
        self.limit = np.ones(items, np.int64)
        self.last = np.full(items, _NONE, np.int64)
        if first is not None and items:
            self.limit = np.array([s for s, _ in first], np.int64)
            self.last = np.array([d for _, d in first], np.int64)

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray, nulls: np.ndarray) -> None:
        """Takes in documents of one item that may be among its best."""
        rows = self.found[item] + list(zip((-scores).tolist(), docs.tolist(), nulls.tolist()))
        rows.sort()
        self.found[item] = rows = rows[:self.k]
        if len(rows) == self.k and (-rows[-1][0], -rows[-1][1]) > (self.limit[item], -self.last[item]):
            self.limit[item], self.last[item] = -rows[-1][0], rows[-1][1]


def _doc_tree(order: np.ndarray) -> list[list[np.ndarray]]:
    """Row numbers of the nodes, from the leaves to the root."""
    levels = [[order[i:i + DOC_LEAF] for i in range(0, len(order), DOC_LEAF)]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([np.concatenate(below[i:i + FAN]) for i in range(0, len(below), FAN)])
    return levels


class Search:
    """Dual descent of one batch of items against batches of documents."""

    def __init__(self, tree: ItemTree, total: int, length: int, best: Best):
        self.tree, self.total, self.length, self.best = tree, total, length, best
        self.visited = 0

    def run(self, docs: np.ndarray, nulls: np.ndarray, n: np.ndarray, offs: np.ndarray, words: np.ndarray, counts: np.ndarray) -> None:
        """Documents as sparse rows: ids, whether an id is null, lengths, offsets, word hashes and occurrences."""
        t = self.tree
        if not len(t.numbers):
            return
        at = np.searchsorted(t.words, words)
        at[at == len(t.words)] = 0
        known = t.words[at] == words
        rows = np.repeat(np.arange(len(docs)), np.diff(offs))[known]
        place, tf = at[known], counts[known]
        if not len(rows):
            return
        m = 25 + (75 * n * self.total) // self.length
        impact = (SATURATE * tf) // (1000 * tf + 8 * m[rows])
        # words of this batch of documents only: the others are zero in all its nodes
        top = np.zeros(len(t.words), np.int64)
        np.maximum.at(top, t.levels[0][1], t.levels[0][2])
        value = impact * top[place]
        heavy = np.lexsort((place, -value, rows))
        lead = heavy[np.unique(rows[heavy], return_index=True)[1]]
        order = rows[lead][np.lexsort((rows[lead], place[lead]))]
        self.starts = np.searchsorted(rows, np.arange(len(docs) + 1))
        self.place, self.impact, self.docs, self.nulls = place, impact, docs, nulls
        self.nodes = _doc_tree(order)
        self.maxima = [[None] * len(level) for level in self.nodes]
        depth = len(t.levels) - 1
        self._pair(depth, 0, len(self.nodes) - 1, 0)

    def _dense(self, rows: np.ndarray) -> np.ndarray:
        """Impacts of some documents, by the batch's words."""
        out = np.zeros((len(rows), len(self.tree.words)), np.int64)
        for i, r in enumerate(rows.tolist()):
            a, b = self.starts[r], self.starts[r + 1]
            out[i, self.place[a:b]] = self.impact[a:b]
        return out

    def _maximum(self, level: int, node: int) -> np.ndarray:
        """Largest impact of each word in a node; kept while its level is worked on."""
        if self.maxima[level][node] is None:
            out = np.zeros(len(self.tree.words), np.int64)
            for r in self.nodes[level][node].tolist():
                a, b = self.starts[r], self.starts[r + 1]
                own = self.place[a:b]
                out[own] = np.maximum(out[own], self.impact[a:b])
            used = np.flatnonzero(out)
            self.maxima[level][node] = (used, out[used])
        used, values = self.maxima[level][node]
        out = np.zeros(len(self.tree.words), np.int64)
        out[used] = values
        return out

    def _pair(self, depth: int, node: int, level: int, block: int) -> None:
        """All pairs below an item node and a document node whose bound reaches the items' weakest k-th score."""
        t = self.tree
        if depth <= 1 and level == 0:
            return self._leaves(depth, node, block)
        # the side with more rows below its node is opened
        if level == 0 or (depth > 1 and self._below(depth, node) > len(self.nodes[level][block])):
            inner = t.children(depth, node)
            bounds = t.sums(depth - 1, inner, self._maximum(level, block))
            pairs = [(-int(bound), depth - 1, i, level, block) for bound, i in zip(bounds, inner)]
        else:
            pairs = []
            for b in range(block * FAN, min((block + 1) * FAN, len(self.nodes[level - 1]))):
                bound = t.sums(depth, range(node, node + 1), self._maximum(level - 1, b))[0]
                pairs.append((-int(bound), depth, node, level - 1, b))
        # the best bounds first, as they raise the thresholds of the others
        for bound, d, i, l, b in sorted(pairs):
            if -bound >= self.best.limit[self._span(d, i)].min():
                self._pair(d, i, l, b)

    def _below(self, depth: int, node: int) -> int:
        span = self._span(depth, node)
        return span.stop - span.start

    def _span(self, depth: int, node: int) -> slice:
        """Places of the items below a node."""
        size = ITEM_LEAF * FAN ** (depth - 1) if depth else 1
        return slice(node * size, min((node + 1) * size, len(self.tree.numbers)))

    def _leaves(self, depth: int, node: int, block: int) -> None:
        """Exact scores of the items of a leaf and the documents of a leaf."""
        self.visited += 1
        rows = self.nodes[0][block]
        items = self.tree.children(1, node) if depth else range(node, node + 1)
        scores = self.tree.sums(0, items, self._dense(rows))
        docs, nulls = self.docs[rows], self.nulls[rows]
        for k, item in enumerate(items):
            s = scores[:, k]
            may = (s > self.best.limit[item]) | ((s == self.best.limit[item]) & (docs <= self.best.last[item]))
            if may.any():
                self.best.add(item, s[may], docs[may], nulls[may])


def _scan(docs: DataFrame, shared, total: int, length: int, k: int) -> DataFrame:
    """(item, doc, score): each task's best documents of each item that reach the thresholds."""
    def run(pieces):
        tree, first = shared.value
        best = Best(len(tree.numbers), k, first)
        search = Search(tree, total, length, best)
        for b in pieces:
            ids, n, words, counts = (b.column(i) for i in range(4))
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            offs = words.offsets.to_numpy()
            search.run(np.where(nulls, _NONE, ids.fill_null(0).to_numpy()), nulls, n.to_numpy(), offs - offs[0],
                       words.flatten().to_numpy(), counts.flatten().to_numpy())
        rows = [(int(tree.numbers[i]), None if null else d, -s) for i, found in enumerate(best.found) for s, d, null in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["item", "doc", "score"])

    return docs.select("doc", "n", "words", "counts").mapInArrow(run, "item long, doc long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(item_key, rank, doc_key, score): the k best documents with a score above 0 for each item.

    Keys are whole numbers. Equal scores are ranked by ascending document key, null keys
    last; documents that share a key are ranked each on its own. Items of equal key and
    text are one item, items that share a key but not a text are ranked each on its own,
    and a null item key stays null. Null and empty texts have no words, so such items
    have no rows. Empty tables give no rows. Other columns are not read. Words are told
    apart by 64-bit hashes: an item word is confused with one of n other words with a
    chance of n / 2**64.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    named = items.select(F.col(f"`{item_key}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("t")).distinct()
    asked = materialize(word_counts(named, "t", ["id"]).where("n > 0").withColumn("item", F.monotonically_increasing_id()), "items")
    terms = asked.select(F.explode("words").alias("word")).distinct()
    bits = bitmap(terms, "word")
    held = materialize(word_counts(docs.select(F.col(f"`{doc_key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("t")), "t", ["doc"], bits).where("n > 0"), "postings")
    sums = held.agg(F.count("*").alias("total"), F.sum("n").alias("length")).collect()[0]
    total, length = sums["total"], sums["length"] or 0
    # the weights of the items' words only: no word of the corpus meets a word that no item holds
    df = held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * total + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = materialize(terms.join(df, "word").select("word", weight.alias("w")), "weights")
    size = asked.agg(F.sum(F.size("words"))).collect()[0][0] or 0
    batches = max(1, -(-size // BATCH_WORDS))
    dealt = materialize(
        asked.select("item", F.pmod(F.xxhash64("item"), F.lit(batches)).cast("int").alias("batch"), F.posexplode("words").alias("p", "word"), "counts")
        .join(weighed, "word").groupBy("batch", "item").agg(F.collect_list(F.struct("word", "w", F.expr("counts[p]").alias("c"))).alias("words")), "batches")
    out = None
    if total:
        # a share of the documents in as many tasks as their number needs
        share = held.where(F.pmod(F.xxhash64("doc"), F.lit(FIRST_SHARE)) == 0)
        share = share.coalesce(max(1, held.rdd.getNumPartitions() // FIRST_SHARE))
    for batch in range(batches if total else 0):
        rows = dealt.where(F.col("batch") == batch).select("item", "words").collect()
        weights = {x["word"]: x["w"] for r in rows for x in r["words"]}
        tree = ItemTree([(r["item"], [x["word"] for x in r["words"]], [x["c"] for x in r["words"]]) for r in rows], weights)
        lasts = _ranked(_scan(share, sc.broadcast((tree, None)), total, length, k), k).where(F.col("rank") == k).select("item", "score", "doc").collect()
        limits = {r["item"]: (r["score"], _NONE if r["doc"] is None else r["doc"]) for r in lasts}
        first = [limits.get(i, (1, _NONE)) for i in tree.numbers.tolist()]
        found = _scan(held, sc.broadcast((tree, first)), total, length, k)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "item long, doc long, score long")
    return _ranked(out, k).join(asked.select("item", "id"), "item").select(F.col("id").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_key), "score")
