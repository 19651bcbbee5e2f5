"""Unions and row-set comparisons between a backlog and a new slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hotspark.operators.ranking import number_rows


def rows_once(df: DataFrame) -> DataFrame:
    """Rows that occur exactly once (all columns); a partial aggregate, no window."""
    return df.groupBy(*df.columns).count().where("count = 1").drop("count")


def new_minus_known(new: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the new slot beyond those already known, with multiplicity."""
    return new.exceptAll(known)


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows present in both; NULL equals NULL."""
    return a.intersect(b)


def append_slot(backlog: DataFrame, slot: DataFrame, index: str, order: list[str]) -> DataFrame:
    """Backlog plus slot; slot rows are numbered on from the backlog's highest index."""
    top = backlog.agg(F.coalesce(F.max(index), F.lit(-1)).alias("_top"))
    numbered = number_rows(slot, order, "_n", start=1)
    # `top` is one row
    placed = numbered.crossJoin(F.broadcast(top)).withColumn(index, F.col("_top") + F.col("_n")).drop("_top", "_n")
    return backlog.unionByName(placed, allowMissingColumns=True)


def losers(matched: DataFrame, winners: DataFrame, key: str) -> DataFrame:
    """Matched ids that did not win."""
    return matched.join(winners, key, "left_anti")
