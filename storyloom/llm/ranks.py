"""Ranks of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.session import checkpointed

#: Offsets up to this number are broadcast; there is one for each part of the order and each group.
BROADCAST_OFFSETS = 100_000


def ranked(df: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``rank`` (from 0 within its group) and ``total``, and the groups' sizes ``(group, total)``.

    Rows are dealt out by ranges of group and order and numbered in their part; what stands before a part is summed over parts, so a group may hold
    any share of the rows. Rows equal in group and order are told apart by their place in the input, so that they too are dealt to several parts.
    Nulls come first. ``df`` is written once; it has no columns ``part``, ``at``, ``place``, ``rank``, ``total``.
    """
    by = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("place")]
    dealt = df.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = checkpointed(dealt.select(*df.columns, F.spark_partition_id().alias("part"), in_part.alias("at")))
    parts = rows.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = checkpointed(parts.select(F.col(group).alias("of_group"), F.col("part").alias("of_part"), (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total")))
    small = offsets.count() <= BROADCAST_OFFSETS
    out = rows.join(F.broadcast(offsets) if small else offsets, (F.col("part") == F.col("of_part")) & F.col(group).eqNullSafe(F.col("of_group")))
    return (
        out.select(*df.columns, (F.col("at") + F.col("shift")).alias("rank"), "total"),
        offsets.groupBy(F.col("of_group").alias(group)).agg(F.max("total").alias("total")),
    )

