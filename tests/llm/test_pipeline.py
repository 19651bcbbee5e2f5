"""The pipeline's stages against plain versions, each on its own input."""

import pytest

import brute
import corpus_pipeline
from hotspark.llm import queries


@pytest.fixture(scope="module")
def chain(spark):
    sf = "/root/testdata/sf0.01"
    docs, out = queries.table(spark, sf, "documents"), []
    from hotspark.session import materialize

    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, sf), name)
        out.append((name, docs, after))
        docs = after
    return sf, out


def test_stages_keep_whole_rows(chain):
    _, steps = chain
    for name, before, after in steps[:-1]:
        assert after.columns == before.columns, name
        assert after.exceptAll(before).count() == 0, name
    assert steps[-1][2].count() == steps[-1][1].count()


def test_clean_rows_stay_and_poor_ones_go(spark, chain):
    sf, steps = chain
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    (_, docs, first), (_, _, second) = steps[:2]
    assert first.count() == docs.count()  # every text of the table has a language
    kept = {r.doc_id for r in second.select("doc_id").collect()}
    poor = [d for d, q in labels.items() if q == 0]
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert sum(d not in kept for d in poor) >= 0.8 * len(poor)


def test_one_of_each_group_and_no_benchmark(spark, chain):
    sf, steps = chain
    (_, before, unique), (_, _, clean) = steps[2], steps[3]
    groups = brute.jaccard_components([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in unique.select("doc_id").collect()} == {g for _, g in groups.values()}
    items = [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    hit = brute.contamination([(r.doc_id, r.text) for r in unique.collect()], items)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {d for d, h in hit.items() if not h[4]}


def test_odd_rows_pass_every_stage(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    item = " ".join(f"word{k}" for k in range(14))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = [(1, "the house and the tree are here", "en"), (1, "the house and the tree are here", "en"), (2, item, "en"), (3, None, None), (None, "a lonely text without id", "en"), (4, "", "de"), (5, "the house", None)]
    docs = spark.createDataFrame([(*r, "s", 0, 0.5, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, n int")
    def named(stage):
        return sorted((str(r.doc_id), str(r.text)) for r in stage(spark, docs, sf).collect())

    every = sorted((str(r[0]), str(r[1])) for r in rows)
    assert named(corpus_pipeline.language_id) == [x for x in every if x[0] not in ("3", "4")]
    assert named(corpus_pipeline.near_duplicates) == sorted(set(every))
    assert named(corpus_pipeline.decontamination) == [x for x in every if x[0] != "2"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
