"""A bitmap of fixed size that lets tasks skip most rows that a later join would drop.

Its size does not grow with the data. When it fills up it lets more rows through, and
the join that follows still decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

BITS = 1 << 23
_SHIFTS = (0, 20, 40)


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a column of 64-bit hashes: at most BITS / 64 numbers reach the driver."""
    at = F.explode(F.array(*(F.shiftrightunsigned(F.col(column), s).bitwiseAND(F.lit(BITS - 1)) for s in _SHIFTS)))
    words = df.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set"))
    out = np.zeros(BITS // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["set"]
    return out.view(np.uint64)


def member(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for hashes that are surely not in the column."""
    h = hashes.view(np.uint64)
    yes = np.ones(len(h), bool)
    for s in _SHIFTS:
        at = (h >> np.uint64(s)) & np.uint64(BITS - 1)
        yes &= ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
    return yes


def maybe_in(df: DataFrame, column: str) -> Column:
    """A condition on a column of 64-bit hashes: false only where the hash is surely not in df's column."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap(df, column))

    @F.pandas_udf(T.BooleanType())
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(member(shared.value, h.to_numpy(np.int64)))

    return test(F.col(column))


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys (nulls match nulls) are not in `gone`.

    Only rows that the bitmap cannot rule out are shuffled for the exact join.
    """
    h = "_hash_of_keys"
    name = F.xxhash64(*(F.col(f"`{k}`") for k in keys))
    gone = gone.select(*(F.col(f"`{k}`").alias(f"_gone_{i}") for i, k in enumerate(keys)), name.alias(h)).distinct()
    maybe = maybe_in(gone, h)
    rows = df.withColumn(h, name)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"l.`{k}`").eqNullSafe(F.col(f"r._gone_{i}"))
    clear = rows.where(~maybe)
    near = rows.where(maybe).alias("l").join(gone.drop(h).alias("r"), same, "left_anti")
    return clear.unionByName(near).drop(h)


#: A key with more than one row in this many is hot; so there are fewer hot keys than this.
HOT_SHARE = 1000


def join_groups(df: DataFrame, groups: DataFrame, key: str, n: str) -> DataFrame:
    """Rows of df with the columns of their group; keys are unique in `groups`, null keys meet, and no hot group is gathered.

    `groups` has a row for every key of df, and `n`, the rows of each. Groups with more
    than one row in HOT_SHARE are fewer than that and are broadcast; the rows of the
    others are shuffled. The column `n` is dropped.
    """
    total = groups.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).collect()[0]["n"]
    named = groups.withColumnRenamed(key, "_key").withColumn("_hot", F.col(n) * HOT_SHARE > total).drop(n)
    values = [c for c in named.columns if c not in ("_key", "_hot")]
    hot = F.broadcast(named.where("_hot"))
    near = df.join(hot, df[key].eqNullSafe(hot["_key"]), "left")
    done = near.where(F.col("_hot")).drop("_key", "_hot")
    rest = near.where(F.col("_hot").isNull()).drop("_key", "_hot", *values)
    cold = named.where(~F.col("_hot")).drop("_hot")
    return done.unionByName(rest.join(cold, rest[key].eqNullSafe(cold["_key"])).drop("_key"))
