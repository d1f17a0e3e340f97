"""Readers: script pages, subtitles, the stages' JSON files, frame folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.plans import schemas as S

IMAGE_TYPES = ("jpg", "jpeg", "png", "bmp", "webp")
TIMECODE = r"(\d{2}:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[,.]\d{3})"


def _plain_pdf(content: bytes) -> list[str]:
    import io

    import pdfplumber  # optional; without it pass another ``extract``

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [p.extract_text() or "" for p in pdf.pages]


def read_pdf_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """``(story_id, page_no, text)`` of PDF files; the story is the file's name. ``extract`` gives the pages' texts of one file."""
    take = extract or _plain_pdf

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                pages = [t or "" for t in take(bytes(content))]
                yield pd.DataFrame({"story_id": name.rsplit("/", 1)[-1], "page_no": range(1, len(pages) + 1), "text": pages})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "story_id string, page_no int, text string")


def read_text_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(story_id, page_no, text)`` of text files whose pages are divided by form feeds."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("story_id"), "value")
    return files.select("story_id", F.posexplode(F.split("value", "\f")).alias("p", "text")).select("story_id", (F.col("p") + 1).alias("page_no"), "text")


def parse_subtitles(files: DataFrame) -> DataFrame:
    """Subtitles of ``files(story_id, value)`` in SRT or VTT: ``(story_id, pos, index, start_sec, end_sec, text)``.

    A block needs a time line with hours; what follows it is the text. Blocks without either are skipped and don't count.
    """
    clean = F.replace("value", F.lit("﻿"), F.lit(""))
    blocks = files.select("story_id", F.posexplode(F.split(T.strip(clean), r"\r?\n\r?\n+")).alias("b", "block"))
    lines = F.filter(F.split("block", r"\r\n|\r|\n"), lambda x: T.strip(x) != "")
    rows = blocks.withColumn("lines", lines).withColumn("at", F.array_position(F.transform("lines", lambda x: x.rlike(TIMECODE)), F.lit(True)).cast("int")).where("at > 0")
    time = F.element_at("lines", F.col("at"))
    rows = rows.select(
        "story_id", "b", T.timecode_seconds(F.regexp_extract(time, TIMECODE, 1)).alias("start_sec"), T.timecode_seconds(F.regexp_extract(time, TIMECODE, 2)).alias("end_sec"),
        T.strip(F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), " ")).alias("text"),
    ).where("text <> ''")
    pos = (F.row_number().over(Window.partitionBy("story_id").orderBy("b")) - 1).cast("int")
    return rows.withColumn("pos", pos).select("story_id", "pos", F.col("pos").alias("index"), "start_sec", "end_sec", "text")


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle files (``.srt``, ``.vtt``; ``.json`` with a list ``segments``); the story is the file's name."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    if path.lower().endswith(".json"):
        rows = spark.read.schema(S.SUBTITLES_JSON).json(path, multiLine=True).select(name.alias("story_id"), F.posexplode("segments").alias("p", "s"))
        return rows.select(
            "story_id", F.col("p").alias("pos"), F.coalesce("s.index", "p").alias("index"), "s.start_sec", "s.end_sec", T.strip(F.coalesce("s.text", F.lit(""))).alias("text")
        ).where("text <> ''")
    return parse_subtitles(spark.read.text(path, wholetext=True).select(name.alias("story_id"), "value"))


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stage-1 events, and ``(story_id, q50, q75, scenes)`` from the file's meta."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    docs = spark.read.schema(S.EVENTS_JSON).json(path, multiLine=True).select(name.alias("story_id"), "meta", "events")
    rows = docs.select("story_id", F.posexplode("events").alias("event_idx", "e"))
    return rows.select(
        "story_id", "event_idx", "e.entity_key", "e.canonical_name", "e.entity_type", "e.surface_forms", F.col("e.scene_a_idx_non_omitted").alias("scene_a"), F.col("e.scene_b_idx_non_omitted").alias("scene_b"), "e.gap_jump",
        "e.gap_absent", "e.freq_scenes", "e.coverage", "e.scores", F.col("e.provenance.scenes_non_omitted_list").alias("scenes"),
    ), docs.select("story_id", "meta.gap_quantiles.q50", "meta.gap_quantiles.q75", F.col("meta.scenes_non_omitted").alias("scenes"))


def read_inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scene objects, scene headings, and ``(story_id, inventory_total)``; defaults of missing fields are filled in."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    docs = spark.read.schema(S.INVENTORY_JSON).json(path, multiLine=True).select(name.alias("story_id"), "meta", "scenes")
    scenes = docs.select("story_id", F.explode("scenes").alias("k", "s")).select("story_id", F.col("k").cast("int").alias("scene_idx"), "s")
    rows = scenes.select("story_id", "scene_idx", F.posexplode("s.merged_loose_objects").alias("pos", "o"))
    channels = F.when(F.size(F.coalesce("o.source_channels", F.array().cast("array<string>"))) > 0, F.col("o.source_channels")).otherwise(F.array(F.coalesce("o.source_channel", F.lit("action"))))
    none = F.array().cast("array<string>")
    objects = rows.select(
        "story_id", "scene_idx", "pos", F.coalesce("o.object_id", F.lit("")).alias("object_id"), F.coalesce("o.canonical_name", F.lit("")).alias("canonical_name"), F.coalesce("o.surface_forms", none).alias("surface_forms"),
        F.coalesce("o.normalized_aliases", none).alias("normalized_aliases"), channels.alias("source_channels"), F.coalesce("o.category", F.lit("object")).alias("category"),
        F.coalesce("o.direct_visual_evidence", F.lit(False)).alias("direct_visual_evidence"), F.coalesce("o.mention_strength_max", "o.mention_strength", F.lit(0.0)).alias("mention_strength_max"),
        F.coalesce("o.confidence_max", "o.confidence", F.lit(0.0)).alias("confidence_max"), F.coalesce("o.evidence", none).alias("evidence"),
    )
    return objects, scenes.select("story_id", "scene_idx", F.coalesce("s.heading", F.lit("")).alias("heading")), docs.select("story_id", F.col("meta.scenes_non_omitted").alias("inventory_total"))


def read_climax(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scene climax rows, and ``(story_id, climax_total)``."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    docs = spark.read.schema(S.CLIMAX_JSON).json(path, multiLine=True).select(name.alias("story_id"), "meta", "scenes")
    rows = docs.select("story_id", F.explode("scenes").alias("k", "s"))
    return rows.select(
        "story_id", F.col("k").cast("int").alias("scene_idx"), F.coalesce("s.heading", F.lit("")).alias("heading"), F.coalesce("s.climax_score", F.lit(0)).alias("climax_score"), "s.objects"
    ), docs.select("story_id", F.col("meta.scenes_non_omitted").alias("climax_total"))


def frame_files(names: DataFrame) -> DataFrame:
    """``(story_id, frame_index, path)`` from ``names(story_id, path)``: images by extension, the last number in the name is the index; of files with one index the last name counts."""
    base = F.element_at(F.split("path", r"[/\\]"), -1)
    rows = names.withColumn("name", base).where(F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).isin(*IMAGE_TYPES))
    digits = F.regexp_extract_all(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit(r"(\d+)"), F.lit(1))
    rows = rows.withColumn("digits", digits).where(F.size("digits") > 0).withColumn("frame_index", F.element_at("digits", -1).try_cast("int")).where("frame_index is not null")
    return rows.groupBy("story_id", "frame_index").agg(F.max_by("path", "name").alias("path"))


def read_frame_folder(spark: SparkSession, path: str, story_id: str) -> DataFrame:
    """Frames of a folder; only the names are read, never the pixels."""
    return frame_files(spark.read.format("binaryFile").load(path).select(F.lit(story_id).alias("story_id"), "path"))
