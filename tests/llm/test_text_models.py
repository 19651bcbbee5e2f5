"""Language id, quality classifier and language model: held-out results, counts by brute force, odd rows."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from hotspark.llm import ftrl, hmm, langid, queries
from hotspark.llm.kernels import ALNUM, UNSPACED, buffers, byte_values, span_hashes, word_spans

ODD = [(1, None), (2, ""), (3, "123 !? 456"), (4, "\n\t "), (5, "wort " * 60_000), (6, "aé日本"), (6, "aé日本"), (None, "the house"), (8, "A\x00b\x1fc")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 0.5, "x", 7) for i, t in ODD], "doc_id long, text string, score double, lang_pred string, _row long")


def test_words_are_those_of_the_patterns():
    import pyarrow as pa

    texts = ["", "Ab c,d 9é", "x\x0by\x1fz", None, "ÄÖ  ü-ß", "\x7f~^a"]
    data, offs = buffers(pa.array(texts, pa.string()))
    from hotspark.llm.kernels import LOWER

    data = LOWER[data]
    for kinds, words in ((ALNUM, brute.alnum_words), (UNSPACED, brute.spaced_words)):
        first, last, woffs = word_spans(data, offs, kinds)
        got = [[data[a:b].tobytes().decode() for a, b in zip(first[i:j], last[i:j])] for i, j in zip(woffs, woffs[1:])]
        assert got == [words(t) for t in texts]
        h = span_hashes(data, first, last, byte_values(1))
        assert len(set(h.tolist())) == len({w for t in texts for w in words(t)})


def test_language_is_right_on_held_out_rows(spark, sf):
    out = queries.Q["op1_language_id"](spark, sf).toPandas()
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(truth, on="doc_id")
    assert len(both) == len(truth)
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (both.lang == both.lang_pred)[both.held_out].mean() > 0.97
    assert both.score.between(0, 1).all()


def test_language_of_odd_rows(spark, odd):
    net = langid.Network(["de", "en"])
    rows = langid.identify(odd, net).collect()
    assert len(rows) == len(ODD) and set(rows[0].asDict()) == {"doc_id", "text", "_row", "lang_pred", "score"}
    assert all((r.lang_pred == "und" and r.score == 0) == (r.doc_id in (1, 2, 3, 4)) for r in rows)
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 6}) == 1
    assert langid.identify(odd.limit(0), net).count() == 0
    none = langid.train(odd.withColumn("lang", F.lit(None).cast("string")))
    assert none.languages == [] and {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def test_long_text_is_read_to_its_end(spark):
    """The mean over windows: a prediction that read a prefix only would miss the second half."""
    net = langid.train(spark.createDataFrame([(i, ("the and of " if i % 2 else "der und ist ") * 30, "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string"))
    text = "the and of " * 2000 + "der und ist " * 4000
    assert langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), net).first().lang_pred == "de"


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.Q["op4_quality_classifier"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    assert (out.predicted == (out.score >= 0.3)).all() and out.score.between(0, 1).all()


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 0), (6, 1), (2, 1), (None, 1), (8, None), (9, 7)], "doc_id long, quality int")
    model = ftrl.train(odd, labels)
    rows = ftrl.classify(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 4)}) == 1
    assert ftrl.classify(odd.limit(0), model).count() == 0
    assert {r.score for r in ftrl.classify(odd, ftrl.train(odd, labels.limit(0))).collect()} == {0.5}


def _base(docs, learn):
    c = collections.Counter()
    for i, t in docs:
        if learn(i):
            c.update([*brute.spaced_words(t), None])
    n, v = sum(c.values()), len(c)
    out = collections.defaultdict(list)
    for i, t in docs:
        tokens = [*brute.spaced_words(t), None]
        out[i].append((len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens)))
    return out


def test_language_model_counts_and_gain(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = _base(docs, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    out = queries.Q["op9_hmm_scoring"](spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        tokens, known, n, base = want[r.doc_id][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_of_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(hmm, "COUNTED", 2)  # so that words meet their counts in the join
    rows = hmm.score(odd, F.col("doc_id").isNotNull(), keep=["doc_id", "score", "_row"]).collect()
    want = _base(ODD, lambda i: i is not None)
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][0][:3]
        assert math.isclose(r.base_score, want[r.doc_id][0][3], rel_tol=1e-9) and r.score < 0
    none = hmm.score(odd, F.lit(False), keep=["doc_id"]).collect()
    assert {(r.train_tokens, r.n_known) for r in none} == {(0, 0)}
    assert hmm.score(odd.limit(0), F.lit(True), keep=["doc_id"]).count() == 0


def test_language_model_learns_from_all_texts_alike(spark, monkeypatch):
    rows = [(k, f"word{k % 7} stands here {k}") for k in range(60)] + [(60, None), (61, "")]
    docs, seen = spark.createDataFrame(rows, "doc_id long, text string"), []
    plain, moved = hmm._expected, hmm.Model.update
    monkeypatch.setattr(hmm, "_expected", lambda part, *rest: seen.append([r[0] for r in part.select("doc_id").collect()]) or plain(part, *rest))
    monkeypatch.setattr(hmm.Model, "update", lambda self, *given: seen.append("update") or moved(self, *given))
    hmm.train(docs, "text", "doc_id")
    passes = [x for x in seen if x != "update"]
    # no update without counts of the training texts before it; the first pass reads each text once, a round reads all
    assert seen[1::2] == ["update"] * len(passes)
    assert sorted(i for part in passes[:-hmm.ROUNDS] for i in part) == list(range(62))
    assert all(sorted(part) == list(range(62)) for part in passes[-hmm.ROUNDS:])


def test_forward_recursion_is_exact():
    """Against the sum over all paths, and the model's probabilities of all short texts add up to at most one."""
    v = hmm.Vocabulary(np.array([5, 9], np.uint64), np.array([1, 2]), np.array([3, 4]), {}, 9, 3, 2)
    m = hmm.Model(v)
    ids = np.array([0, 1, v.end, 1, v.end], np.int32)
    got = m.forward(ids, np.array([0, 3, 5]))
    import itertools

    for seq, log in ((ids[:3], got[0]), (ids[3:], got[1])):
        total = 0.0
        for path in itertools.product(range(hmm.STATES), repeat=len(seq)):
            p = m.start[path[0]] * m.emit[seq[0], path[0]]
            for k in range(1, len(seq)):
                p *= m.move[path[k - 1], path[k]] * m.emit[seq[k], path[k]]
            total += p
        assert math.isclose(math.log10(total), log, rel_tol=1e-9)
    assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1)


def test_expected_counts_match_all_paths():
    v = hmm.Vocabulary(np.array([5, 9], np.uint64), np.array([1, 2]), np.array([3, 4]), {}, 9, 3, 2)
    m = hmm.Model(v)
    ids = np.array([0, 1, v.end], np.int32)
    import itertools

    moves, emits, total = np.zeros_like(m.move), np.zeros_like(m.emit), 0.0
    for path in itertools.product(range(hmm.STATES), repeat=3):
        p = m.start[path[0]] * m.emit[ids[0], path[0]] * m.move[path[0], path[1]] * m.emit[ids[1], path[1]] * m.move[path[1], path[2]] * m.emit[ids[2], path[2]]
        total += p
        for k in range(3):
            emits[ids[k], path[k]] += p
        for k in range(2):
            moves[path[k], path[k + 1]] += p
    e, mv, start, inside = m.expected(ids, np.array([0, 3]))
    assert np.allclose(e, emits / total) and np.allclose(mv, moves / total)
    assert math.isclose(start.sum(), 1) and inside.sum() == 0
