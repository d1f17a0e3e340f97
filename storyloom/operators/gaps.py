"""Reappearance gaps and the grouped choices that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def max_gaps(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """For each key with two or more positions: the largest gap between neighbours and what goes with it.

    Returns keys, ``first_position``, ``last_position``, ``freq``, ``gap_jump``, ``gap_absent``, ``position_a``,
    ``position_b``, ``coverage`` and ``positions`` (distinct, in order). Of equal gaps the earliest counts. Repeated
    positions count once, null positions and null keys not at all.
    """
    seen = df.where(F.col(position).isNotNull()).dropna(subset=keys).select(*keys, F.col(position).alias("_p")).distinct()
    after = F.lead("_p").over(Window.partitionBy(*keys).orderBy("_p"))
    gaps = seen.withColumn("_n", after)
    best = F.max(F.when(F.col("_n").isNotNull(), F.struct((F.col("_n") - F.col("_p")).alias("gap"), (-F.col("_p")).alias("minus_a"), F.col("_n").alias("b"))))
    found = gaps.groupBy(*keys).agg(
        F.min("_p").alias("first_position"), F.max("_p").alias("last_position"), F.count("*").alias("freq"), best.alias("_best"), F.array_sort(F.collect_list("_p")).alias("positions")
    )
    gap = F.col("_best.gap")
    return found.where("freq >= 2").select(
        *keys, "first_position", "last_position", "freq", gap.alias("gap_jump"), F.greatest(gap - 1, F.lit(0)).alias("gap_absent"),
        (-F.col("_best.minus_a")).alias("position_a"), F.col("_best.b").alias("position_b"),
        (F.col("freq") / (F.col("last_position") - F.col("first_position") + 1)).alias("coverage"), "positions",
    )


def majority(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """Each key's most frequent value; of equally frequent ones that which comes first in ``order``."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(out))


def top_values(df: DataFrame, keys: list[str], value: str, order: str, out: str, most: int = 5) -> DataFrame:
    """Each key's ``most`` most frequent values, the same tie rule, as an array in that order."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "_first"))
    top = counts.withColumn("_r", place).where(F.col("_r") <= most)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda s: s[value]).alias(out))


def gap_quantiles(df: DataFrame, keys: list[str], gap: str = "gap_jump") -> DataFrame:
    """Linearly interpolated quartiles; 0 where there is no gap."""
    q = lambda p: F.coalesce(F.expr(f"percentile({gap}, {p})"), F.lit(0.0))
    return df.groupBy(*keys).agg(q(0.5).alias("q50"), q(0.75).alias("q75"))


def gap_level(gap: Column, q50: Column, q75: Column) -> Column:
    return F.when(gap <= q50, "medium").when(gap <= q75, "long").otherwise("extreme")


def reappearance_score(gap: Column, action: Column, visual: Column, state: Column) -> Column:
    """The order of reappearances: gap first, then how central, visible and changeable the object is."""
    return F.lit(2.0) * gap + F.lit(50.0) * action + F.lit(30.0) * visual + F.lit(20.0) * state
