"""Documents to training tokens in five stages; each works on all that its predecessor kept.

Rows may have more columns than the table `documents`, under any name: they stay. Null
ids and texts, repeated rows and empty tables are allowed in every stage; what a stage
does with them stands in its docstring. The pipeline is tested against plain versions of
its stages, since SQL cannot express the trained ones.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hotspark.llm import bpe, ftrl, langid, ngram_join, winnow
from hotspark.llm.bits import without
from hotspark.llm.kernels import ready
from hotspark.llm.queries import fold, table
from hotspark.session import materialize

#: A text stays if its most likely language has at least this probability.
LANGUAGE_SCORE = 0.35


def _kept(docs: DataFrame, apply: Callable[[DataFrame, str, list[str]], DataFrame], condition: Column) -> DataFrame:
    """Rows of docs for which the operator's result meets the condition; column names cannot clash."""
    names = docs.columns
    safe = [f"_c{i}" for i in range(len(names))]
    out = apply(docs.toDF(*safe), safe[names.index("text")], safe).where(condition)
    return out.select(*(F.col(s).alias(n) for s, n in zip(safe, names)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from rows with text and language; texts without a letter or without a likely language go."""
    ready(spark)
    net = langid.train(docs.where(F.col("doc_id").isNotNull() & ~fold("doc_id", 4, 2)))
    return _kept(docs, lambda df, text, keep: langid.identify(df, net, text, keep), (F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the table `labels`; texts that are predicted 0 go. Without labels all stay."""
    ready(spark)
    model = ftrl.train(docs, table(spark, sf_dir, "labels").where(~fold("doc_id", 5, 0)))
    return _kept(docs, lambda df, text, keep: ftrl.classify(df, model, text, keep), F.col("predicted") == 1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one with the smallest id stays; of equal rows with one id, one stays.

    A row without an id cannot be named and stays; rows that share an id but not a text are judged together.
    """
    ready(spark)
    found = materialize(ngram_join.join(docs.select("doc_id", "text")).where(F.col("doc_id").isNotNull()), "groups")
    copies = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    rest = without(docs, materialize(copies.union(repeated).distinct(), "gone"), ["doc_id"])
    again = docs.join(repeated.join(copies, "doc_id", "left_anti"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of which at least one word in twenty lies in a benchmark window go."""
    ready(spark)
    h = "_text_hash"
    named = docs.withColumn(h, F.xxhash64("text"))
    found = winnow.judge(winnow.find(named.select("doc_id", "text", h), table(spark, sf_dir, "benchmark"), keep=["doc_id", h]))
    gone = materialize(found.where("contaminated").select("doc_id", h), "contaminated")
    return without(named, gone, ["doc_id", h]).drop(h)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number and the digests of the ids and of the decoded bytes."""
    ready(spark)
    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`, each one's result written and read again."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
