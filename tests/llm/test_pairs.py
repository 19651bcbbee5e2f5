"""Decontamination, n-gram join and embedding near-dedup against brute force, and components."""

import random

import numpy as np
import pytest

import brute
from hotspark.llm import flatgraph, ngram_join, queries, winnow
from hotspark.llm.bits import without
from hotspark.llm.components import components


def _prose(rnd, n, words=3000):
    return [f"w{rnd.randrange(words)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Groups of near copies with few and many edits, exact copies, a common passage, short and odd texts."""
    rnd = random.Random(4)
    line = " ".join(_prose(rnd, 30))
    out = [None, "", " \n", "one two", "one two", "One  TWO", "a b c d e", "a b c d e f", "é " * 9, line, line]
    for size in (20, 60, 200):
        base = _prose(rnd, size)
        for k in range(25):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 9])):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10 ** 6)}"
            out.append(" ".join(w) + (" " + line if k % 5 == 0 else ""))
    out += [" ".join(_prose(rnd, rnd.randrange(3, 90))) + " " + line for _ in range(60)]
    out.append(" ".join(_prose(rnd, 30_000)))
    return out


def test_ngram_join_is_whole(spark, texts):
    rows = [(i * 3 % 997, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == brute.jaccard_components(rows)


def test_ngram_join_of_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.Q["op10_ngram_join"](spark, sf).collect()}
    assert got == brute.jaccard_components(rows)


def test_prefix_choice_keeps_the_guarantee():
    """Random sets: a pair at the threshold always shares enough prefix shingles, whatever each side asks for."""
    rnd = np.random.default_rng(1)
    for _ in range(300):
        universe = rnd.permutation(400)
        x = set(universe[:rnd.integers(5, 60)].tolist())
        y = set(x)
        for v in list(x)[:rnd.integers(0, 6)]:
            y.discard(v)
            if rnd.random() < 0.5:
                y.add(int(rnd.integers(1000, 2000)))
        both = len(x & y)
        if not y or 100 * both < 80 * len(x | y):
            continue
        lx, ly = rnd.integers(1, 5, 2)
        need = -(-80 * (len(x) + len(y)) // 180)
        l = min(lx, ly, -(-80 * len(x) // 100), -(-80 * len(y) // 100))  # noqa: E741
        assert len(set(sorted(x)[:len(x) - need + l]) & set(sorted(y)[:len(y) - need + l])) >= l


def test_ngram_join_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None), (9, None), (None, "alone in the world today")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, key string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.join(df).collect())
    assert got == sorted([("None", 2, "7"), ("7", 2, "7"), ("7", 2, "7"), ("None", 0, "None"), ("9", 0, "9"), ("None", 1, "None")])
    assert ngram_join.join(df.limit(0)).count() == 0


def test_contamination_of_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.Q["op2_decontamination"](spark, sf).collect()}
    assert got == brute.contamination(docs, items)


def test_contamination_with_short_equal_and_odd_items(spark):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rnd.choices(words, k=rnd.choice([1, 2, 3, 5, 8, 12, 13, 14, 30])))) for k in range(30)]
    items += [(100, items[0][1]), (101, items[0][1].upper()), (102, None), (103, "..."), (11, items[11][1])]
    docs = []
    for k in range(80):
        w = rnd.choices(words, k=rnd.randrange(0, 60))
        for _ in range(rnd.randrange(3)):
            item = rnd.choice(items)[1] or ""
            at = rnd.randrange(len(w) + 1)
            w[at:at] = item.split()[:rnd.choice([12, 13, 40])]
        docs.append((k, "-".join(w)))
    docs += [(900, None), (901, ""), (902, " ".join(rnd.choices(words, k=50_000)))]
    d = spark.createDataFrame([(*x, 5, "z") for x in docs], "doc_id long, text string, n_words long, items string")
    found = winnow.judge(winnow.find(d, spark.createDataFrame(items, "item_id long, text string")))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()}
    assert got == brute.contamination(docs, items)
    none = winnow.find(d, spark.createDataFrame([], "item_id long, text string"), keep=["doc_id"]).collect()
    assert len(none) == len(docs) and all(r.spans == [] and r["items"] == [] for r in none)
    assert winnow.find(d.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_contamination_of_many_spans_in_one_text(spark):
    """The spans of one text are merged in linear time: a one-word item, met at every second word."""
    d = spark.createDataFrame([(1, "the cat " * 150_000), (2, "the the cat the"), (3, "cat")], "doc_id long, text string")
    found = winnow.find(d, spark.createDataFrame([(1, "the"), (2, "the cat the")], "item_id long, text string"))
    got = {r.doc_id: r for r in winnow.judge(found).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[2].n_hit, got[3].n_hit) == (300_000, 299_999, 2, 4, 0)
    lone = winnow.find(d, spark.createDataFrame([(1, "the")], "item_id long, text string")).where("doc_id = 1").selectExpr("size(spans) as n", "spans[0] as a", "spans[149999] as b").collect()[0]
    assert (lone.n, tuple(lone.a), tuple(lone.b)) == (150_000, (0, 1), (299_998, 299_999))


def test_contamination_of_repeated_rows(spark):
    item = " ".join(f"q{k}" for k in range(20))
    d = spark.createDataFrame([(1, item), (1, item), (None, item), (None, "q1 q2")], "doc_id long, text string")
    rows = winnow.judge(winnow.find(d, spark.createDataFrame([(5, item), (None, item)], "item_id long, text string"))).collect()
    assert sorted((str(r.doc_id), r.n_hit, r.n_items) for r in rows) == [("1", 20, 1), ("1", 20, 1), ("None", 0, 0), ("None", 20, 1)]


def test_winnowing_guarantee():
    """Whatever stands around a shared window, one kept hash is shared."""
    rnd = np.random.default_rng(2)
    for n in range(1, 14):
        for _ in range(40):
            window = rnd.integers(0, 2 ** 63, n).astype(np.uint64)
            kept = []
            for _ in range(2):
                parts = [rnd.integers(0, 2 ** 63, rnd.integers(0, 20)).astype(np.uint64) for _ in range(2)]
                words = np.concatenate([parts[0], window, parts[1]])
                kept.append(set(winnow.kept_runs(words, np.array([0, len(words)]), n)[1].tolist()))
            assert kept[0] & kept[1]


def _truth(ids, x):
    x = np.asarray(x, float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.95
    np.fill_diagonal(s, False)
    u = brute.Union()
    for a, b in zip(*np.nonzero(s)):
        u.join(ids[a], ids[b])
    return {i: (int(n), u.find(i), u.find(i) == i) for i, n in zip(ids, s.sum(axis=1))}


def test_flat_graph_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(flatgraph, "SHARD", 60)  # several shards, and a dense group that is split
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(300, 24))
    near = np.concatenate([base[k] + rnd.normal(size=(m, 24)) * 0.05 for k, m in ((0, 150), (1, 20), (2, 3))])
    x = np.concatenate([base, near, near[:40], base[3:4] * 2]).astype(np.float32)
    ids = (rnd.permutation(len(x)) * 7).tolist()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in flatgraph.dedup(df).collect()}
    want = _truth(ids, x)
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert sum(got[i][1:] == want[i][1:] for i in ids) >= 0.99 * len(ids)


def test_flat_graph_of_a_dense_group_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(flatgraph, "SHARD", 40)  # the group's shards are more than the largest overlap
    monkeypatch.setattr(flatgraph, "BLOCK", 300)
    rnd = np.random.default_rng(6)
    base, off = rnd.normal(size=64), rnd.normal(size=(700, 64))
    group = base / np.linalg.norm(base) + 0.12 * off / np.linalg.norm(off, axis=1, keepdims=True)
    x = np.concatenate([group, rnd.normal(size=(1400, 64)), group[:30]]).astype(np.float32)
    ids = (rnd.permutation(len(x)) * 3).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in flatgraph.dedup(df).collect()}
    assert got == _truth(ids, x)


def test_flat_graph_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [-0.0, 1.0]), (12, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in flatgraph.dedup(df).collect()}
    alone = {k: (0, k, True) for k in (3, 4, 5, 6, 7, 8, 10)}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 9: (2, 1, False), 11: (1, 11, True), 12: (1, 11, False), None: (0, None, False), **alone}
    assert flatgraph.dedup(df.limit(0)).count() == 0


def test_components_of_long_chains_and_stars(spark):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1400)] + [(5000 + rnd.randrange(80), 5000 + rnd.randrange(80)) for _ in range(60)] + [(7, None), (9000, 9000)]
    u = brute.Union()
    for a, b in edges:
        if b is not None and a != b:
            u.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: u.find(k) for k in u.up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_removal_behind_the_bitmap(spark):
    df = spark.createDataFrame([(k if k % 7 else None, str(k % 5), k) for k in range(400)], "id long, h string, v long")
    gone = df.where("v % 3 = 0").select("id", "h")
    got = {r.v for r in without(df, gone, ["id", "h"]).collect()}
    pairs = {(r.id, r.h) for r in gone.collect()}
    assert got == {r.v for r in df.collect() if (r.id, r.h) not in pairs}
