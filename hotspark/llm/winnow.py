"""Benchmark decontamination by winnowing.

A window is 13 consecutive words of a benchmark item (a shorter item is one window).
For windows of n words, both sides hash all runs of k = ceil(n/2) words and keep the
smallest hash in each group of n-k+1 neighbouring runs. A window that occurs on both
sides leaves the same smallest hash on both, so joining the kept hashes misses no
shared window. Each joined hash is extended to the windows around it, which are
compared by 128 bits with the benchmark's windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from hotspark.llm.bits import bitmap, member
from hotspark.llm.kernels import ALNUM, LOWER, buffers, byte_values, list_array, map_texts, run_hashes, signed, span_hashes, steps, within_rows, word_spans
from hotspark.session import materialize

WINDOW = 13
_FIRST, _SECOND = byte_values(21), byte_values(22)
_HIT = pa.struct([("n", pa.int32()), ("fp", pa.int64()), ("windows", pa.list_(pa.struct([("start", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])))])
_FIELDS = [
    T.StructField("_row", T.LongType()), T.StructField("_words", T.LongType()),
    T.StructField("_hits", T.ArrayType(T.StructType([
        T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()),
        T.StructField("windows", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))),
    ]))),
]


def kept_runs(words: np.ndarray, woffs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs that winnowing keeps for windows of n words."""
    k = (n + 1) // 2
    runs = run_hashes(words, k, 100 + n)
    starts, _ = within_rows(woffs, n)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    best, at = runs[starts], starts.copy()
    for o in range(1, n - k + 1):
        other = runs[starts + o]
        less = other <= best
        best, at = np.where(less, other, best), np.where(less, starts + o, at)
    new = np.concatenate([[True], at[1:] != at[:-1]])
    return at[new], best[new]


def _window_hashes(words: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    runs = run_hashes(words, n, seed + n)
    return runs[starts]


def _maker(lengths: list[int], bits, whole_items: bool):
    """Row number, word count and hits (kept hashes with the windows around them) of each text."""

    def make():
        task = TaskContext.get()
        count = [(task.partitionId() if task else 0) << 40]
        known = None if bits is None else bits.value

        def run(column):
            data, offs = buffers(column)
            all_rows, out_n, out_fp, win_counts, out_start, out_a, out_b = [], [], [], [], [], [], []
            n_words = []
            for i, j in steps(offs):
                text, toffs = LOWER[data[offs[i]:offs[j]]], offs[i:j + 1] - offs[i]
                first, last, woffs = word_spans(text, toffs, ALNUM)
                n_words.append(np.diff(woffs))
                words = span_hashes(text, first, last, _FIRST)
                second = None
                for n in lengths:
                    use = woffs
                    if whole_items and n < WINDOW:  # only items that are exactly one window
                        size = np.diff(woffs)
                        keep = np.repeat(size == n, size)
                        if not keep.any():
                            continue
                        sub, sub2 = words[keep], None
                        use = np.concatenate([[0], np.cumsum(np.where(size == n, size, 0))])
                    else:
                        sub = words
                    at, fp = kept_runs(sub, use, n)
                    if known is not None:
                        yes = member(known, fp)
                        at, fp = at[yes], fp[yes]
                    if not len(at):
                        continue
                    if second is None:
                        second = span_hashes(text, first, last, _SECOND)
                    sub2 = second[keep] if sub is not words else second
                    row = np.searchsorted(use, at, side="right") - 1
                    k = (n + 1) // 2
                    low, high = np.maximum(at - (n - k), use[row]), np.minimum(at, use[row + 1] - n)
                    counts = high - low + 1
                    ends = np.cumsum(counts)
                    starts = np.arange(ends[-1]) + np.repeat(low - ends + counts, counts)
                    all_rows.append(row + i)
                    out_n.append(np.full(len(at), n, np.int32))
                    out_fp.append(signed(fp))
                    win_counts.append(counts)
                    out_start.append((starts - np.repeat(use[row], counts)).astype(np.int32))
                    out_a.append(signed(_window_hashes(sub, starts, n, 200)))
                    out_b.append(signed(_window_hashes(sub2, starts, n, 300)))
            size = len(offs) - 1
            rows = np.concatenate(all_rows) if all_rows else np.zeros(0, np.int64)
            cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            counts = cat(win_counts, np.int64)
            windows = pa.StructArray.from_arrays([pa.array(cat(out_start, np.int32)), pa.array(cat(out_a, np.int64)), pa.array(cat(out_b, np.int64))], names=["start", "a", "b"])
            windows = list_array(windows, np.concatenate([[0], np.cumsum(counts)]))
            hits = pa.StructArray.from_arrays([pa.array(cat(out_n, np.int32)), pa.array(cat(out_fp, np.int64)), windows], names=["n", "fp", "windows"])
            hits = hits.take(pa.array(np.argsort(rows, kind="stable")))
            hits = list_array(hits, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=size))]))
            numbers = np.arange(count[0], count[0] + size)
            count[0] += size
            return [pa.array(numbers), pa.array(cat(n_words, np.int64).astype(np.int64)), hits]

        return run

    return make


def find(docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Kept columns, n_words, spans (merged hit word ranges) and items (names of items that occur, sorted).

    One row for each row of `docs`, repeated rows included. A null text has no words; an
    item without words or without a name has no windows; equal items are all named. Empty
    tables give no hits. Kept columns that clash with the new names are replaced. Nothing
    here grows with the documents but the joins; the bitmap of benchmark hashes has a
    fixed size, and the joins are left to the planner's size check.
    """
    new = ("n_words", "spans", "items")
    columns = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    named = items.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("_item"), F.col(item_text).alias("_text"))
    bench = materialize(map_texts(named, "_text", ["_item"], _FIELDS, _maker(list(range(1, WINDOW + 1)), None, True)), "bench").withColumn(
        "_n", F.least("_words", F.lit(WINDOW)))
    hits = bench.select("_item", "_n", F.explode("_hits").alias("h")).where("h.n = _n")
    prints = materialize(hits.select("_n", F.col("h.fp").alias("fp")).distinct(), "bench-prints")
    lengths = sorted(r["_n"] for r in prints.select("_n").distinct().collect())  # at most 13
    # windows with the same set of items share a number, so that a passage is one row a document
    owners = hits.select("_item", "_n", F.explode("h.windows").alias("w")).select("_item", "_n", "w.a", "w.b").distinct()
    marks = owners.groupBy("_n", "a", "b").agg(F.sum(F.xxhash64("_item").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("_item", F.lit(1)).cast("decimal(38,0)")).alias("t"), F.count("*").alias("c"))
    windows = materialize(marks.select("_n", "a", "b", F.xxhash64("s", "t", "c").alias("set")), "bench-windows")
    sets = materialize(owners.join(windows, ["_n", "a", "b"]).select("set", "_item").distinct(), "bench-sets")

    shared = docs.sparkSession.sparkContext.broadcast(bitmap(prints, "fp"))
    read = materialize(map_texts(docs, text, columns, _FIELDS, _maker(lengths, shared, False)), "winnowed")
    found = read.select("_row", F.explode("_hits").alias("h")).select("_row", F.col("h.n").alias("_n"), F.col("h.fp").alias("fp"), "h.windows")
    found = found.join(prints, ["_n", "fp"], "left_semi")
    found = found.select("_row", "_n", F.explode("windows").alias("w")).select("_row", "_n", "w.start", "w.a", "w.b")
    found = materialize(found.join(windows, ["_n", "a", "b"]).select("_row", "start", (F.col("start") + F.col("_n").cast("int")).alias("stop"), "set"), "hits")
    # a hit that starts beyond the furthest end so far begins a new span
    order = Window.partitionBy("_row").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.select("_row", "start", "stop", F.when(before >= F.col("start"), 0).otherwise(1).alias("new"))
    numbered = opened.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("_row", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    names = found.select("_row", "set").distinct().join(sets, "set").groupBy("_row").agg(F.array_sort(F.collect_set("_item")).alias("items"))
    out = read.select("_row", *(F.col(f"`{c}`") for c in columns), F.col("_words").alias("n_words")).join(spans, "_row", "left").join(names, "_row", "left")
    return out.select(
        *(F.col(f"`{c}`") for c in columns), "n_words",
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def judge(found: DataFrame) -> DataFrame:
    """The columns of `find` with n_hit, n_items, items_sha256 and contaminated in place of the lists."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["stop"] - x["start"]))
    out = found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.concat_ws(",", "items"), 256)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("spans", "items")
