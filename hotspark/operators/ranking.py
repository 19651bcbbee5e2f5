"""Row numbering over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hotspark.session import materialize

_ROW_BITS = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[str], out: str, start: int | Column = 1) -> DataFrame:
    """Add `out` = position in the order given by the `order` columns.

    A range sort spreads the rows; each row notes its partition and its place in
    it, and the partition sizes (one row per partition) give the offsets. `order`
    must identify a row for the numbering to be repeatable.
    """
    placed = materialize(
        df.sort(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))),
        "numbered",
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition of the sort, so this window and the broadcast below are
    # bounded by the partition count, not by the data
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        placed.join(F.broadcast(before), "_part")
        .withColumn(out, (F.col("_before") + F.col("_row") + first).cast("long"))
        .drop("_part", "_row", "_before")
    )


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """1-based position inside each key group, safe for a group of any size.

    The global sort key starts with `keys` and ends with `order`, so one huge
    group is spread over many partitions; the group's first position is a plain
    aggregate.
    """
    numbered = number_rows(df, [*keys, *order], "_pos")
    first = numbered.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min("_pos").alias("_first"))
    cond = [numbered[k].eqNullSafe(first[f"_k_{k}"]) for k in keys]
    return (
        numbered.join(first, cond)
        .withColumn(out, F.col("_pos") - F.col("_first") + 1)
        .drop("_pos", "_first", *[f"_k_{k}" for k in keys])
    )
