"""Tables in the shared folder."""

from pyspark.sql import functions as F

from storyloom.functions.session import written


def test_a_table_is_not_broadcast_by_the_size_of_its_files(spark):
    """A million rows that Parquet keeps in few bytes would be some 100 MB in the driver."""
    rows = written(spark.range(1_000_000).select(F.lit("one story").alias("story"), (F.col("id") % 1000).alias("row")))
    other = written(spark.range(10).select(F.lit("one story").alias("story"), F.col("id").alias("row")))
    plan = rows.join(rows.select("story", (F.col("row") + 1).alias("row")), ["story", "row"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    joined = rows.join(other, ["story", "row"])
    assert joined.count() == 10_000
