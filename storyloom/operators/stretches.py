"""Running values over ordered rows of a key of any size.

Rows are dealt out by ranges of key and order, so a key's rows lie in as many parts as they need; what a part holds of a key is a stretch. A running value is
computed within stretches by a window, what the stretches before (or after) it come to is summed over stretches, of which there are few, and carried into it. It works for any
associative value: sums and counts, largest and smallest, the last or next value that isn't null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.session import written

#: Carries up to this number are broadcast; there is one for each stretch.
BROADCAST_CARRIES = 100_000
OWN = ("_part", "_spot", "_tie")

#: Aggregate of a stretch or of its rows so far, in order, and how what was before is joined to it.
KINDS: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda carry, own: F.when(carry.isNull() & own.isNull(), None).otherwise(F.coalesce(carry, F.lit(0)) + F.coalesce(own, F.lit(0)))),
    "max": (F.max, lambda carry, own: F.greatest(carry, own)),
    "min": (F.min, lambda carry, own: F.least(carry, own)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda carry, own: F.coalesce(own, carry)),
}


class Stretches:
    """Rows of ``df`` in order within ``keys``; columns are added to ``rows`` by ``running``.

    Rows that are equal in key and order are told apart by their place in ``df``. Nulls come first, null keys are a key of their own. ``df`` has no columns named as in ``OWN``.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[Column], parts: int | None = None):
        self.keys = keys
        by = [*(F.col(k).asc_nulls_first() for k in keys), *order, F.col("_tie")]
        tied = df.withColumn("_tie", F.monotonically_increasing_id())
        dealt = (tied.repartitionByRange(*by) if parts is None else tied.repartitionByRange(parts, *by)).sortWithinPartitions(*by)
        # numbered in order within its part, as the table is read in other parts
        at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        self.rows = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_spot", at))

    def running(self, out: str, kind: str, value: Column, before: bool = False, backward: bool = False) -> Stretches:
        """Adds ``out``: ``value`` of a row and all rows before it of its key, taken together; of rows ``before`` it only, or with ``backward`` from the key's end."""
        whole, joined = KINDS[kind]
        down = lambda c: F.desc(c) if backward else F.asc(c)
        stretch = Window.partitionBy("_part", *self.keys).orderBy(down("_spot"))
        over = Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy(down("_part")).rowsBetween(Window.unboundedPreceding, -1)
        valued = self.rows.withColumn("_value", value)
        wholes = valued.groupBy("_part", *self.keys).agg(_of_stretch(kind, backward).alias("_whole"))
        carries = wholes.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)), whole("_whole").over(over).alias("_carry"))
        carries = written(carries.where("_carry is not null"))
        few = carries.count() <= BROADCAST_CARRIES
        same = F.col("_part") == F.col("_p")
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        own = whole("_value").over(stretch.rowsBetween(Window.unboundedPreceding, -1 if before else 0))
        met = valued.withColumn("_own", own).join(F.broadcast(carries) if few else carries, same, "left")
        self.rows = met.withColumn(out, joined(F.col("_carry"), F.col("_own"))).drop("_value", "_own", "_carry", "_p", *(f"_k{i}" for i in range(len(self.keys))))
        return self

    def done(self) -> DataFrame:
        return self.rows.drop(*OWN)


def _of_stretch(kind: str, backward: bool) -> Column:
    """The value of a whole stretch."""
    if kind != "last":
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind]("_value")
    at = F.when(F.col("_value").isNotNull(), F.col("_spot"))
    return F.min_by("_value", at) if backward else F.max_by("_value", at)


def shared_borders(df: DataFrame, keys: list[str], place: str, n: int, size: int) -> DataFrame:
    """``df`` cut into blocks of ``size`` places of a key, each with the ``n`` rows before and after it: ``_block``, and ``_home`` for the rows that are the block's own.

    ``place`` is a row's dense number within its key. With it a window over ``n`` rows on both sides needs no more than a block.
    """
    first, last = F.expr(f"greatest({place} - {n}, 0) div {size}"), F.expr(f"({place} + {n}) div {size}")
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_home", F.expr(f"{place} div {size}") == F.col("_block"))
