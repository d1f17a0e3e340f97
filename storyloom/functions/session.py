"""Session helpers: shared checkpoint folder and table reading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's parquet tables; any path Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where one machine holds
    driver and executors, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "storyloom-checkpoints"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage; use it on narrow tables."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting for what a file's byte is in memory, and its value: names and row numbers that come again and again take some sixtieth of their rows in Parquet.
SIZE_SETTING, SIZE_FACTOR = "spark.sql.sources.fileCompressionFactor", "64.0"


def honest_sizes(spark: SparkSession) -> None:
    """Has Spark plan with what files are in memory, not on disk, unless the session has a setting of its own.

    By file sizes a table of 10 MB is sent to all workers through the driver, though it may hold ten million rows. What is small indeed is still sent: that is decided by its rows when they have been shuffled.
    """
    if spark.conf.get(SIZE_SETTING, "1.0") == "1.0":
        spark.conf.set(SIZE_SETTING, SIZE_FACTOR)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table of the shared folder, to be deleted when the session's JVM ends, and read it.

    It cuts the lineage as ``checkpointed`` does, but its size is told by its files, which ``honest_sizes`` sets right. A checkpoint's estimate is the product of all joins before it, a number whose digits multiply from
    round to round; so loops of more than a few rounds use this, and small tables are joined as small ones.
    """
    spark = df.sparkSession
    honest_sizes(spark)
    folder = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


#: Rows of a narrow table that one partition may hold.
ROWS_EACH = 50_000


def compacted(df: DataFrame, rows_each: int = ROWS_EACH) -> DataFrame:
    """``checkpointed`` with as many partitions as its rows need; use it on tables that shrink from step to step, whose shuffles would be mostly empty files."""
    done = checkpointed(df)
    return done.coalesce(max(1, -(-done.count() // rows_each)))
