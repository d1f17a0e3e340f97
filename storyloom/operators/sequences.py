"""Operators over ordered rows: islands, running indexes, windows of neighbours, ordered collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.session import checkpointed
from storyloom.operators.stretches import Stretches, shared_borders


def ordered_list(order: Column, value: Column) -> Column:
    """Aggregate: the values of a group in order of ``order``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])


def ordered_union(order: Column, values: Column, most: int | None = None) -> Column:
    """Aggregate: the distinct elements of a group's arrays in order of first occurrence."""
    out = F.array_distinct(F.flatten(ordered_list(order, values)))
    return out if most is None else F.slice(out, 1, most)


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: float, out: str = "island", spread: bool = False) -> DataFrame:
    """Adds ``out``: the number of the merged interval that a row belongs to, from 0 in order of start.

    A row joins the island before it if it starts no later than ``gap`` after the latest end so far. A window holds a key's rows; with ``spread`` they lie in many tasks, for keys of any size.
    """
    if spread:
        s = Stretches(df, keys, [F.col(start).asc(), F.col(end).asc()]).running("_reach", "max", F.col(end), before=True)
        new = F.when(F.col(start) > F.col("_reach") + gap, 1).otherwise(0)
        return s.running(out, "sum", new).done().withColumn(out, F.col(out).cast("int")).drop("_reach")
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) > reach + gap, 1).otherwise(0)
    flagged = df.withColumn("_new", new)
    return flagged.withColumn(out, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def running_index(df: DataFrame, order: str, active: Column, out: str, keys: list[str] | None = None, width: int = 65536) -> DataFrame:
    """Adds ``out``: the dense index from 0 of rows that are ``active``, in order of the whole number ``order``; -1 for others.

    Without ``keys`` the order runs over the whole table; rows are then counted for stretches of
    ``width`` order values, so that no window is larger than a stretch.
    """
    if keys:
        flagged = df.withColumn("_on", active.cast("long"))
        seen = F.sum("_on").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        return flagged.withColumn(out, F.when(F.col("_on") == 1, seen - 1).otherwise(-1)).drop("_on")
    flagged = df.withColumn("_on", F.coalesce(active, F.lit(False)).cast("long")).withColumn("_part", F.floor(F.col(order) / width).cast("long"))
    counts = checkpointed(flagged.groupBy("_part").agg(F.sum("_on").alias("_in")))
    # stretches are summed in two steps as well: 4,096 of them to a block
    counts = counts.withColumn("_block", F.floor(F.col("_part") / 4096))
    blocks = counts.groupBy("_block").agg(F.sum("_in").alias("_b"))
    before_block = F.coalesce(F.sum("_b").over(Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("_block").alias("_block2"), before_block.alias("_before_block"))
    within = F.coalesce(F.sum("_in").over(Window.partitionBy("_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.join(blocks, F.col("_block") == F.col("_block2")).select(F.col("_part").alias("_p"), (within + F.col("_before_block")).alias("_offset"))
    seen = F.sum("_on").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return (
        flagged.withColumn("_seen", seen).join(offsets, F.col("_part") == F.col("_p"))
        .withColumn(out, F.when(F.col("_on") == 1, F.col("_offset") + F.col("_seen") - 1).otherwise(F.lit(-1).cast("long")))
        .drop("_on", "_part", "_p", "_offset", "_seen")
    )


def neighbour_windows(df: DataFrame, keys: list[str], order: str, n: int, spread: bool = False, block: int = 65536) -> DataFrame:
    """For each timed text the window of ``n`` rows on both sides.

    Needs ``index, start_sec, end_sec, text``. Start is the first row's, end the last row's (not the latest), centre the row's own.
    A window holds a key's rows; with ``spread`` it holds ``block`` of them, and the ``n`` beyond its borders.
    """
    if spread:
        placed = Stretches(df, keys, [F.col(order).asc()]).running("_place", "sum", F.lit(1).cast("long"), before=True).done()
        df = shared_borders(placed.withColumn("_place", F.coalesce("_place", F.lit(0)).cast("long")), keys, "_place", n, max(block, 2 * n + 1))
        w, place = Window.partitionBy(*keys, "_block").orderBy("_place"), F.col("_place").cast("int")
    else:
        df = df.withColumn("_home", F.lit(True))
        w = Window.partitionBy(*keys).orderBy(order)
        place = F.row_number().over(w) - 1
    around = w.rowsBetween(-n, n)
    return df.select(
        *keys, "_home", place.alias("center_index"), F.collect_list("index").over(around).alias("segment_indices"),
        F.first("start_sec").over(around).alias("start_sec"), F.last("end_sec").over(around).alias("end_sec"),
        (F.lit(0.5) * (F.col("start_sec") + F.col("end_sec"))).alias("center_sec"), F.array_join(F.collect_list("text").over(around), " ").alias("text"),
    ).where("_home").drop("_home")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key; Spark limits groups before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")
