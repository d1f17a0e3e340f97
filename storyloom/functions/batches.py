"""Arrow batches in Python workers: whole groups of sorted rows, many to a call."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

GROUP = "group_"


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by ``key``, cut again so that a key's rows are never in two of them.

    Memory is a batch and the rows of its last key.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key))
        last = column[-1]
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1] != column[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        same = pc.sum(pc.cast(pc.equal(column, last), pa.int64())).as_py()
        cut = batch.num_rows - same
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def map_groups(df: DataFrame, keys: list[str], order: list[str], run: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """Rows of ``schema`` that ``run`` makes of each group's rows, which it gets in ``order``.

    Groups are dealt by their keys and sorted, so a task reads many of them one after another and nothing is called or planned for each. A group is
    what one call holds. Keys are not null.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    keyed = df.withColumn(GROUP, F.concat_ws("\x01", *(F.col(k).cast("string") for k in keys)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, GROUP):
            rows = t.to_pylist()
            made = [r for _, group in groupby(rows, key=lambda r: r[GROUP]) for r in run(list(group))]
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return keyed.repartition(GROUP).sortWithinPartitions(GROUP, *order).mapInArrow(task, schema)
