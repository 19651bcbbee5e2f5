"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hotspark.llm import bpe, codes, dualtree, flatgraph, ftrl, hmm, langid, layout, ngram_join, order, quotes, toxicity, winnow
from hotspark.llm.kernels import ready


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves that remainder; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 4, 2)
    net = langid.train(docs.where(F.col("doc_id").isNotNull() & ~held))
    out = langid.identify(docs.select("doc_id", "text", held.alias("held_out")), net, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return winnow.judge(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def mail(conversations: DataFrame) -> DataFrame:
    """The conversations as mail: each turn quotes the turn before it, and that one's predecessor one level deeper."""
    turns = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.min("text").alias("text"), quotes.role_of_least("text", "role"))

    def earlier(by: int, name: str) -> DataFrame:
        return turns.select("conv_id", (F.col("turn") + by).alias("turn"), F.col("text").alias(name))

    def quoted(text: Column, mark: str) -> Column:
        return F.concat(F.lit("\n" + mark), F.regexp_replace(text, "\n", "\n" + mark))

    joined = turns.join(earlier(1, "one"), ["conv_id", "turn"], "left").join(earlier(2, "two"), ["conv_id", "turn"], "left")
    intro = F.when(F.col("one").isNotNull(), F.concat(F.lit("\n\nOn turn "), (F.col("turn") - 1).cast("string"), F.lit(" somebody wrote:"), quoted(F.col("one"), "> ")))
    deeper = F.when(F.col("one").isNotNull() & F.col("two").isNotNull(), quoted(F.col("two"), "> > "))
    return joined.select("conv_id", "turn", "role", F.concat(F.coalesce("text", F.lit("")), F.coalesce(intro, F.lit("")), F.coalesce(deeper, F.lit(""))).alias("body"))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.link(mail(table(spark, sf_dir, "conversations")), "conv_id", "turn", "body")
    return linked.select("conv_id", "turn", F.sha2("own", 256).alias("own_sha256"), "n_quotes", "n_linked", "parent", "root", "depth")


def op3_reply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = quotes.conversations(mail(table(spark, sf_dir, "conversations")), "conv_id", "turn", "body", "role")
    return threads.select("conv_id", "root", "position", "turn", "role", "own", "parent", "depth")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 5, 0)
    model = ftrl.train(docs, table(spark, sf_dir, "labels").where(~held))
    return ftrl.classify(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"])


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op6_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.extract(table(spark, sf_dir, "pages").select("page_id", "html"), keep=["page_id"])


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.write(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def op8_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 7, 2)
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    out = hmm.score(rows, F.col("doc_id").isNotNull() & ~F.col("held_out"), keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 5, 0)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held))
    return toxicity.classify(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"])


def _codes_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS) -> str:
    """The assignment rounds one after the other, every component against every entry."""
    steps = [f"""v AS (
  SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT vec_id, i // (len(ints) // {parts}) AS part, i % (len(ints) // {parts}) AS place, ints[i + 1] AS x
  FROM (SELECT vec_id, ints, unnest(range(len(ints))) AS i FROM v)
), b0 AS (
  SELECT part, entry, place, x FROM c JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id)
)"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
  SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT vec_id, c.part, entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM c JOIN b{k} b ON b.part = c.part AND b.place = c.place GROUP BY ALL
  ) GROUP BY vec_id, part
)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS (
  SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT a.part, a.entry, c.place, CAST((sum(c.x) - ((sum(c.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM a{k} a JOIN c ON c.vec_id = a.vec_id AND c.part = a.part GROUP BY ALL
  ) m ON m.part = b.part AND m.entry = b.entry AND m.place = b.place
)""")
    return "WITH " + ", ".join(steps) + f""", o AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
), h AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b{rounds}
)
SELECT o.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id), h
"""


_QUERIES = [op1_language_id, op2_decontamination, op3_quotation_linking, op3_reply_order, op4_quality_classifier, op5_byte_bpe, op6_html_layout, op7_training_order, op8_flat_graph, op9_hmm_scoring, op10_ngram_join, op11_dual_tree_search, op12_vector_codes, op13_toxicity]


def _register(fn):
    def run(spark, sf_dir):
        return fn(ready(spark), sf_dir)

    run.__doc__ = fn.__doc__
    return run


Q = {fn.__name__: _register(fn) for fn in _QUERIES}
SQL: dict[str, str] = {
    "op3_quotation_linking": r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, min(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
), n AS (
  SELECT conv_id, turn, text, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS name FROM m
), f AS (
  SELECT conv_id, name, min(turn) AS ref FROM n WHERE name != '' GROUP BY conv_id, name
), p AS (
  SELECT a.conv_id, a.turn, a.text, b.turn IS NOT NULL AS one, b.turn IS NOT NULL AND c.turn IS NOT NULL AS two, g.ref AS parent, h.ref AS grand
  FROM n a LEFT JOIN n b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 LEFT JOIN n c ON c.conv_id = a.conv_id AND c.turn = a.turn - 2
  LEFT JOIN f g ON g.conv_id = a.conv_id AND g.name = b.name AND g.ref < a.turn
  LEFT JOIN f h ON h.conv_id = a.conv_id AND h.name = c.name AND h.ref < a.turn
), t AS (
  SELECT conv_id, turn, turn AS root, CAST(0 AS BIGINT) AS depth FROM p WHERE parent IS NULL
  UNION ALL SELECT p.conv_id, p.turn, t.root, t.depth + 1 FROM p JOIN t ON p.conv_id = t.conv_id AND p.parent = t.turn
)
SELECT p.conv_id, p.turn, sha256(regexp_replace(p.text, '^\s+|\s+$', '', 'g')) AS own_sha256,
  CAST(p.one AS BIGINT) + CAST(p.two AS BIGINT) AS n_quotes,
  CAST(p.one AND p.parent IS NOT NULL AS BIGINT) + CAST(p.two AND p.grand IS NOT NULL AS BIGINT) AS n_linked,
  p.parent, t.root, t.depth
FROM p JOIN t ON t.conv_id = p.conv_id AND t.turn = p.turn
""",
    "op3_reply_order": r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, min(text) AS text, first(role ORDER BY text NULLS LAST, role NULLS FIRST) AS role
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
), n AS (
  SELECT conv_id, turn, text, role, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS name FROM m
), f AS (
  SELECT conv_id, name, min(turn) AS ref FROM n WHERE name != '' GROUP BY conv_id, name
), p AS (
  SELECT a.conv_id, a.turn, a.text, a.role, g.ref AS parent
  FROM n a LEFT JOIN n b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
  LEFT JOIN f g ON g.conv_id = a.conv_id AND g.name = b.name AND g.ref < a.turn
), t AS (
  SELECT conv_id, turn, turn AS root, CAST(0 AS BIGINT) AS depth, [turn] AS path FROM p WHERE parent IS NULL
  UNION ALL SELECT p.conv_id, p.turn, t.root, t.depth + 1, list_append(t.path, p.turn) FROM p JOIN t ON p.conv_id = t.conv_id AND p.parent = t.turn
)
SELECT p.conv_id, t.root, row_number() OVER (PARTITION BY p.conv_id, t.root ORDER BY t.path) - 1 AS position, p.turn, p.role,
  coalesce(regexp_replace(p.text, '^\s+|\s+$', '', 'g'), '') AS own, p.parent, t.depth
FROM p JOIN t ON t.conv_id = p.conv_id AND t.turn = p.turn
""",
    "op12_vector_codes": _codes_sql(),
    "op11_dual_tree_search": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), i AS (
  SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM (SELECT DISTINCT item_id, text FROM benchmark)
), s AS (
  SELECT count(*) AS n_all, CAST(sum(len(words)) AS BIGINT) AS l_all FROM d WHERE len(words) > 0
), p AS (
  SELECT r, word, count(*) AS tf FROM (SELECT r, unnest(words) AS word FROM d) GROUP BY ALL
), w AS (
  SELECT word, CAST(floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, s GROUP BY word, n_all
), t AS (
  SELECT q, item_id, word, count(*) AS c FROM (SELECT q, item_id, unnest(words) AS word FROM i) GROUP BY ALL
), x AS (
  SELECT q, item_id, doc_id, r, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(words) * n_all) // l_all)))) AS BIGINT) AS score
  FROM t JOIN w USING (word) JOIN p USING (word) JOIN d USING (r), s GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 10
""",
}
