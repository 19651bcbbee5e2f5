"""Dual-tree search, vector codes and toxicity against plain versions, and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import brute
from hotspark.llm import bits, codes, dualtree, queries, toxicity

DOCS = "doc_id long, text string, score long, rank string, words string, n int, item long"
ITEMS = "item_id long, text string, doc_id long, doc string"


def plain_search(docs, items, k=10):
    """Rows (item, rank, doc, score), every document scored for every item."""
    held = [(d, Counter(brute.alnum_words(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked, rows = Counter(brute.alnum_words(text)), []
        for d, c in held:
            m = 25 + (75 * sum(c.values()) * total) // length
            s = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w, n in asked.items() if c[w])
            if s > 0:
                rows.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows)[:k])]
    return out


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(40_000)]
    docs = [(i, " ".join(words[rng.randrange(39_000):][:rng.randrange(1, 60)])) for i in range(500)]
    docs += [(600 + i, docs[7][1]) for i in range(40)]  # ties
    docs += [(7, docs[7][1]), (7, "w1 other w2"), (None, docs[9][1]), (None, "w3"), (701, None), (702, ""), (703, "?! -"), (704, "W1, w2 é日本 " * 20_000)]
    items = [(i, " ".join(words[rng.randrange(39_000):][:rng.randrange(1, 40)])) for i in range(60)]
    items += [(3, "w1 w1 É日本 é日本"), (3, "w1 w1 É日本 é日本"), (None, "w5 w9"), (90, None), (91, ""), (92, "unheard"), (93, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("words", [dualtree.BATCH_WORDS, 200])
def test_search_finds_what_scoring_all_pairs_finds(spark, corpus, words, monkeypatch):
    monkeypatch.setattr(dualtree, "BATCH_WORDS", words)
    docs, items = corpus
    got = dualtree.search(spark.createDataFrame([(*d, 5, "x", "y", 1, 2) for d in docs], DOCS).repartition(5), spark.createDataFrame([(*i, 9, "z") for i in items], ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got, *got.columns) == sorted(plain_search(docs, items), key=repr)


def test_search_of_nothing(spark, corpus):
    docs, items = (spark.createDataFrame([(*r, *rest) for r in rows], s) for rows, rest, s in ((corpus[0], (5, "x", "y", 1, 2), DOCS), (corpus[1], (9, "z"), ITEMS)))
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text is null"), items)):
        assert dualtree.search(a, b).collect() == []


def test_one_item(spark):
    got = dualtree.search(spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string"), k=1)
    assert rows_of(got, *got.columns) == sorted(plain_search([(1, "a b"), (2, "b c"), (3, "c")], [(1, "a")], 1))


def test_node_pairs_are_pruned():
    rng = np.random.default_rng(1)
    items = [(i, [1000 + i, 1 + i % 7], [1, 1]) for i in range(64)]
    tree = dualtree.ItemTree(items, {w: 5000 if w >= 1000 else 10 for _, ws, _ in items for w in ws})
    best = dualtree.Best(64, 10)
    search = dualtree.Search(tree, 4000, 80_000, best)
    whole = 0
    for part in range(4):
        words = np.concatenate([np.append(np.sort(rng.choice(np.arange(1, 20), 8, replace=False)), 1000 + rng.integers(64)) for _ in range(1000)])
        search.run(np.arange(1000) + part * 1000, np.zeros(1000, bool), np.full(1000, 20), np.arange(0, 9001, 9), words, np.ones(9000, np.int64))
        whole += 63 * 8
    assert search.visited < whole / 2


def plain_codes(rows, parts, entries, rounds):
    """{vec_id: (code, error, label_error)} and the digest; rows are (id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    first = [v for _, v, _ in sorted(kept, key=lambda r: (r[0], r[1]))[:entries]]
    book = [[v[p * width:(p + 1) * width] for v in first] for p in range(parts)]

    def nearest(v, p):
        part = v[p * width:(p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        took = [[[] for _ in first] for _ in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                took[p][nearest(v, p)[1]].append(v[p * width:(p + 1) * width])
        book = [[[sum(c) // len(own) for c in zip(*own)] if own else e for own, e in zip(took[p], book[p])] for p in range(parts)]
    out, by_label = [], Counter()
    for i, v, g in kept:
        found = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), g))
        by_label[g] += out[-1][2]
    return sorted((i, c, e, by_label[g]) for i, c, e, g in out), hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()


def vectors(n, dims, scale=0.2):
    rng = random.Random(n)
    rows = [(i, [round(rng.gauss(0, scale), 3) for _ in range(dims)], rng.choice([1, 1, 1, 2, None])) for i in range(n)]
    return rows + [(n + i, rows[3][1], 1) for i in range(30)] + [(3, rows[3][1], 2), (3, rows[4][1], 2)]


@pytest.mark.parametrize("rows, block", [(vectors(300, 8), 1 << 19), (vectors(300, 8), 100), (vectors(60, 4, 1e6), 64), (vectors(40, 4, 1e12), 1 << 19)])
def test_codes_are_those_of_the_plain_rounds(spark, rows, block, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK_VALUES", block)
    monkeypatch.setattr(bits, "HOT_SHARE", 3)
    bad = [(900, None, 1), (901, [None] * len(rows[0][1]), 1), (902, [float("nan")] * len(rows[0][1]), 1), (903, [float("inf")] * len(rows[0][1]), 7), (904, [1.0, 2.0, 3.0], 1), (905, [], 1)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows + bad], "vec_id long, embedding array<double>, label int, error int, code string").repartition(4)
    got = codes.compress(df, parts=2, entries=7, rounds=3)
    want, digest = plain_codes(rows, 2, 7, 3)
    if any(e >= 1 << 63 for _, _, e, _ in want):
        assert sorted((r["vec_id"], r["code"]) for r in got.collect()) == sorted((i, c) for i, c, _, _ in want)
    else:
        fit = [(i, c, e, t if t < 1 << 63 else None) for i, c, e, t in want]
        assert rows_of(got, "vec_id", "code", "error", "label_error") == sorted(fit, key=repr)
    assert {r["codebooks_sha256"] for r in got.collect()} == {digest}


def test_codes_of_nothing_and_of_null_keys(spark):
    shape = "vec_id long, embedding array<float>, label int"
    assert codes.compress(spark.createDataFrame([], shape)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, 2), (2, [1.0], 2)], shape)).collect() == []
    got = codes.compress(spark.createDataFrame([(None, [0.5] * 4, None), (5, [0.25] * 4, None)], shape), entries=1, rounds=0).collect()
    assert sorted((r["vec_id"] is None, r["code"], r["error"], r["label_error"]) for r in got) == [(False, "00000000", 0, 262144), (True, "00000000", 262144, 262144)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_finds_what_edit_distance_finds():
    rng = random.Random(2)
    terms = [("stupid", False, 3.0), ("stub", False, 3.0), ("stubborn", False, 3.0), ("disgusting", False, 3.0), ("idiot", False, 3.0), ("trött", False, 3.0), ("lowei", True, 2.0), ("weakly", False, 0.5)]
    lexicon = toxicity.Lexicon(terms)
    letters = "stupidbornglweiöt*x"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    for t, _, _ in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(w) + 1)
                w[at:at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
            words.append("".join(w) or "x")
    text = " ".join(words).encode()
    found = toxicity.Words(*toxicity.letters(*toxicity._pack([text])))
    at, term, edits = lexicon.find(found.points, found.first, found.last)
    got = {found.text(i): (lexicon.terms[t][0], e) for i, t, e in zip(at, term, edits)}
    for w in set(found.texts()):
        near = []
        for t, stem, weight in sorted(terms):
            allowed = 0 if stem or len(t) < 5 or weight < 1.5 else 2 if len(t) >= 9 else 1
            d = distance(w, t)
            if d <= allowed:
                near.append((d, t))
            elif stem and w.startswith(t):
                near.append((0, t))
        assert (w in got) == bool(near), w
        if near:
            assert got[w][1] == min(near)[0] and got[w][0] in [t for d, t in near if d == min(near)[0]], (w, got[w], near)


def test_surroundings_part_quotation_from_abuse():
    rng = random.Random(4)
    filler = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "sto", "ven", "dul", "pir")]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(filler) for _ in range(30)]
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(["stupid", "idiot", "worthless"])
        texts.append(" ".join(words).encode())
        labels.append(int(i % 4 == 0))
    order = sorted(range(400), key=lambda i: (labels[i], i))
    model = toxicity.learn([texts[i] for i in order], [labels[i] for i in order])
    assert {t for t, _, _ in model.lexicon.terms} == {"stupid", "idiot", "worthless"}

    def score(text):
        return float(model.scores(*toxicity._pack([text.encode()]))[0][0])

    abuse = score("kara you are a stupid idiot, kasto")
    assert abuse > 0.8
    assert score("kara lora stuupid lo id1ot worthles") > 0.5 > score("kara lora mira")
    quote = score('kara lora "stupid idiot" mira said the other kasto')
    assert quote < abuse / 2 and quote < 0.5
    assert score("kara\n> stupid idiot\nkasto lora") < 0.5
    assert score("kara «idiot» kasto lora") < score("kara idiot kasto lora")


def test_toxicity_is_right_on_held_out_rows(spark, sf):
    big = "/root/testdata/sf0.1"
    out = queries.Q["op13_toxicity"](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = out[out.held_out & out.toxic.notna()]
    assert (held.predicted == (held.score >= 0.5)).all()
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.97
    assert (held[held.toxic == 1].predicted == 1).mean() > 0.85


def test_toxicity_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 !? 456"), (4, "\n\t "), (5, "moron kala " * 60_000), (6, "aé日本"), (6, "aé日本"), (None, "moron"), (8, "A\x00b\x1fc * $"), (9, "m*ron"), (10, '"')]
    df = spark.createDataFrame([(i, t, "x", 7, 8) for i, t in rows], "doc_id long, text string, score string, hits int, label int")
    empty = spark.createDataFrame([], "doc_id long, toxic int, text string")
    plain = toxicity.train(df, empty)
    out = toxicity.classify(df, plain).collect()
    assert len(out) == len(rows) and len({r["score"] for r in out}) == 1 and not any(r["predicted"] or r["hits"] for r in out)
    model = toxicity.Model(toxicity.Lexicon([("moron", False, 3.0)]))
    got = {(r["doc_id"], r["text"]): r for r in toxicity.classify(df, model).collect()}
    assert got[5, rows[4][1]]["hits"] == 60_000 and got[9, "m*ron"]["hits"] == 1 and got[None, "moron"]["predicted"] == 1
    assert got[1, None]["score"] == got[2, ""]["score"] < 0.5
    assert toxicity.classify(df.limit(0), model).columns == ["doc_id", "text", "label", "score", "predicted", "hits"]
    assert toxicity.classify(df.limit(0), model).count() == 0
