"""From pages of a script to scenes, blocks and the texts of their channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators.sequences import ordered_list
from storyloom.operators.stretches import Stretches


def page_lines(pages: DataFrame) -> DataFrame:
    """``(story_id, page_no, line_no, line)`` from ``pages(story_id, page_no, text)``; a null page has none."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")
    out = pages.select("story_id", "page_no", F.posexplode(lines).alias("line_no", "line"), F.size(lines).alias("_n"))
    return out.where(~((F.col("line") == "") & (F.col("line_no") == F.col("_n") - 1))).drop("_n")  # what follows the last line end


def _counted(rows: DataFrame, order: list[str], on: dict[str, Column], spread: bool) -> DataFrame:
    """Adds for each name of ``on`` the rows so far of a story that are so."""
    if spread:
        stretches = Stretches(rows, ["story_id"], [F.col(c).asc() for c in order])
        for out, is_so in on.items():
            stretches = stretches.running(out, "sum", is_so.cast("int"))
        return stretches.done()
    so_far = Window.partitionBy("story_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({out: F.sum(is_so.cast("int")).over(so_far) for out, is_so in on.items()})


def split_scenes(lines: DataFrame, spread: bool = False) -> DataFrame:
    """Scenes in order from ``lines(story_id, page_no, line_no, line)``.

    A heading opens a scene; lines before the first belong to none. Revision and title headers are dropped.
    A scene ends on the page of its last line that isn't blank. Omitted scenes have no index of their own (-1).
    Scenes are numbered by a window that holds a story's lines; with ``spread`` they lie in many tasks, for a story of any length, and a scene's own lines are all that is gathered.
    """
    # a line travels once, with a small number that says whether it opens a scene (1) and one that is told (2); scenes and told ones are counted together
    parts = T.heading_parts(F.col("line"))
    flagged = lines.withColumn("_opens", F.when(parts.isNull(), 0).when(parts["kind"] == "OMITTED", 1).otherwise(2))
    marked = _counted(flagged, ["page_no", "line_no"], {"_scene": F.col("_opens") > 0, "_told": F.col("_opens") == 2}, spread)
    marked = marked.withColumn("scene_idx", F.col("_scene") - 1).where("scene_idx >= 0")
    marked = marked.withColumns({"_s": T.strip(F.col("line")), "_h": F.when(F.col("_opens") > 0, T.heading_parts(F.col("line")))}).drop("_scene", "_opens")
    header = F.col("_s").startswith("Rev.") | F.col("_s").startswith("HARRY POTTER")
    kept = F.col("_h").isNull() & ~header
    at = F.struct("page_no", "line_no")
    text = F.when(F.col("_s") == "", F.lit("")).otherwise(F.col("line"))
    scenes = marked.groupBy("story_id", "scene_idx").agg(
        F.max("_h").alias("_h"), F.max("_told").alias("_told"), F.min("page_no").alias("page_start"),
        F.coalesce(F.max(F.when(F.col("_s") != "", F.col("page_no"))), F.min("page_no")).alias("page_end"),
        F.filter(ordered_list(at, F.when(kept, text)), lambda x: x.isNotNull()).alias("lines"),
    )
    told = F.col("_h.kind") != "OMITTED"
    dense = F.col("_told") - 1
    return scenes.select(
        "story_id", F.col("scene_idx").cast("int").alias("scene_idx"), F.when(told, dense).otherwise(-1).cast("int").alias("scene_idx_non_omitted"), F.col("_h.label").alias("scene_label_raw"),
        F.regexp_extract("_h.label", r"^\d{1,3}", 0).cast("int").alias("scene_label_int"), F.col("_h.kind").alias("marker_type"),
        T.heading_text(F.col("_h.kind"), F.col("_h.rest"), F.col("_h.label")).alias("heading"), "page_start", "page_end", "lines",
    )


def near_headings(lines: DataFrame, most: int = 60) -> DataFrame:
    """Lines that look like headings and aren't, the first ``most`` of each story, to find missed scenes."""
    s = T.strip(F.col("line"))
    found = lines.where(s.rlike(T.NEAR_HEADING) & T.heading_parts(F.col("line")).isNull()).select("story_id", "page_no", "line_no", s.alias("line"))
    place = F.row_number().over(Window.partitionBy("story_id").orderBy("page_no", "line_no"))
    return found.withColumn("_r", place).where(F.col("_r") <= most).drop("_r")


def scene_meta(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy("story_id").agg(F.count("*").alias("scene_markers_total"), F.count_if(F.col("marker_type") != "OMITTED").alias("scene_markers_non_omitted"))


def clean_lines(lines: Column) -> Column:
    """Layout lines dropped, blank lines kept."""
    return F.filter(lines, lambda x: ~T.is_junk_line(x))


def blocks_of(lines: Column) -> Column:
    """Runs of lines that aren't blank, as an array of arrays."""
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("now"))

    def step(acc: Column, line: Column) -> Column:
        ended = F.struct(F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), none.alias("now"))
        return F.when(T.strip(line) == "", ended).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.array(line)).alias("now")))

    return F.aggregate(lines, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))


def is_dialogue(block: Column) -> Column:
    return T.is_speaker_line(F.element_at(block, 1))


def _texts(blocks: Column) -> Column:
    joined = F.transform(blocks, lambda b: F.array_join(F.filter(F.transform(b, T.strip), lambda x: x != ""), " "))
    return T.strip(F.array_join(F.filter(joined, lambda x: x != ""), "\n"))


def channel_texts(scenes: DataFrame) -> DataFrame:
    """Adds ``action_text`` and ``dialogue_text`` (without the speakers' names) of each scene."""
    blocks = F.col("_blocks")
    return (
        scenes.withColumn("_blocks", blocks_of(clean_lines(F.col("lines"))))
        .withColumn("action_text", _texts(F.filter(blocks, lambda b: ~is_dialogue(b))))
        .withColumn("dialogue_text", _texts(F.transform(F.filter(blocks, is_dialogue), lambda b: F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))))))
        .drop("_blocks")
    )
