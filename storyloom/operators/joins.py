"""Joins that Spark has no operator for: bands, nearest values, best overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators.stretches import Stretches


def band_join(left: DataFrame, right: DataFrame, l_value: str, r_value: str, radius: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose values differ by ``radius`` at most.

    Values are cut into stretches of the radius; a left row looks into its own and the two beside, so the
    join is an equi-join and no plan compares all with all. Columns other than the keys must have different names.
    """
    keys = keys or []
    near = left.withColumn("_cell", F.explode(F.transform(F.array(*(F.lit(d) for d in (-1, 0, 1))), lambda d: F.floor(F.col(l_value) / radius) + d)))
    far = right.withColumn("_cell", F.floor(F.col(r_value) / radius))
    return near.join(far, [*keys, "_cell"]).where(F.abs(F.col(r_value) - F.col(l_value)) <= radius).drop("_cell")


def nearest(left: DataFrame, right: DataFrame, target: str, value: str, keys: list[str], out: str = "nearest", spread: bool = False) -> DataFrame:
    """Adds to ``left`` the value of ``right`` with equal keys that is nearest to ``target``; the smaller of two equally near.

    Rows of both sides are merged in order of value and each target sees its neighbours through a window, so
    nothing is compared with all. Beyond either end the last value counts; without any value the result is null. The window holds a key's rows; with ``spread`` they
    lie in many tasks, for keys of any size.
    """
    kind = left.schema[target].dataType
    marks = right.select(*keys, F.col(value).cast(kind).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row")).dropna(subset=["_at"]).distinct()
    asks = left.select(*keys, F.col(target).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    known = F.when(F.col("_side") == 0, F.col("_at"))
    if spread:
        merged = Stretches(marks.union(asks), keys, [F.col("_at").asc(), F.col("_side").asc()])
        met = merged.running("_below", "last", known).running("_above", "last", known, backward=True).done().where("_side = 1")
        # a mark at the target itself stands before it in this order, and is what is below it
    else:
        # both frames grow from the partition's start; one that ends at its end would be read anew for each row
        upwards = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
        downwards = Window.partitionBy(*keys).orderBy(F.desc("_at"), "_side").rowsBetween(Window.unboundedPreceding, 0)
        below, above = F.last(known, ignorenulls=True).over(upwards), F.last(known, ignorenulls=True).over(downwards)
        met = marks.union(asks).withColumn("_below", below).withColumn("_above", above).where("_side = 1")
    left_wins = F.col("_above").isNull() | (F.col("_at") - F.col("_below") <= F.col("_above") - F.col("_at"))
    chosen = F.when(F.col("_below").isNotNull() & left_wins, F.col("_below")).otherwise(F.col("_above"))
    return met.select("_row.*", chosen.alias(out))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], l_id: str, r_id: str, l_aliases: Column, r_aliases: Column) -> DataFrame:
    """``(keys, l_id, r_id, shared)`` for each pair that shares an alias; ``shared`` is sorted. An inverted index joins them."""
    a = left.select(*keys, l_id, F.explode(F.array_distinct(l_aliases)).alias("_alias"))
    b = right.select(*keys, r_id, F.explode(F.array_distinct(r_aliases)).alias("_alias"))
    return a.join(b, [*keys, "_alias"]).groupBy(*keys, l_id, r_id).agg(F.array_sort(F.collect_set("_alias")).alias("shared"))
