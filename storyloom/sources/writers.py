"""Sinks. Spark commits a job's output at once, so a reader never sees half a file."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.sources.video import placed

# The columns of the summary file.
SUMMARY_COLUMNS = ["name", "category", "gap", "scene_a", "scene_b", "page_a", "page_b", "heading_a", "heading_b", "score", "action", "visual", "state", "conf"]


def write_table(df: DataFrame, path: str, by_story: bool = True) -> None:
    """Parquet, divided by story where the table has one."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("story_id") if by_story and "story_id" in df.columns else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_scene_markers(scenes: DataFrame, path: str) -> None:
    """Scenes without their lines."""
    write_json(scenes.drop("lines"), path)


def write_summaries_csv(summaries: DataFrame, path: str) -> None:
    """The inspector's 14 columns with a header."""
    summaries.select(*SUMMARY_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def copy_frames(samples: DataFrame) -> DataFrame:
    """``(output_path, bytes)``: copies each sample's frame on the executors; both paths must be in a folder that all machines share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for source, target in zip(batch["source_path"], batch["output_path"]):
                source = source.removeprefix("file://").removeprefix("file:")
                placed(target, partial(shutil.copy2, source))
                sizes.append(os.path.getsize(target))
            yield pd.DataFrame({"output_path": batch["output_path"], "bytes": sizes})

    return samples.where(F.col("source_path").isNotNull()).select("source_path", "output_path").mapInPandas(run, "output_path string, bytes long")
