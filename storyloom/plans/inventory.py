"""Scene inventory: every object that a scene shows or speaks of, merged where aliases meet."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions.numeric import rounded
from storyloom.functions.session import written
from storyloom.operators.arrivals import merge_order, most_voted, ordered_distinct

TRACKED = ("object", "artifact", "weapon", "creature", "vehicle", "substance")
RECORD = (
    "story_id string, scene_idx int, channel_no int, pos int, object_id string, canonical_name string, surface_forms array<string>, category string, direct_visual_evidence boolean,"
    " mention_strength double, confidence double, evidence array<string>, source_channel string, tracking_keep boolean"
)
COLUMNS = [c.strip().split(" ")[0] for c in RECORD.split(", ")]


def _none() -> Column:
    return F.array().cast("array<string>")


def action_records(mentions: DataFrame, categories: tuple[str, ...] = TRACKED) -> DataFrame:
    """Inventory records of what the action shows; unlike stage 1, ``keep`` doesn't decide."""
    m = mentions.where("physical_visualizable").where(F.coalesce("category", F.lit("other")).isin(*categories))
    name = T.strip(F.coalesce("canonical_name", F.lit("")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return m.select(
        "story_id", "scene_idx", F.lit(0).alias("channel_no"), "pos", T.object_key(name).alias("object_id"), name.alias("canonical_name"), F.coalesce("surface_forms", F.array().cast("array<string>")).alias("surface_forms"),
        "category", F.lit(True).alias("direct_visual_evidence"), rounded(F.greatest(zero("action"), zero("visual"), zero("state"))).alias("mention_strength"), rounded(zero("confidence")).alias("confidence"),
        F.slice(F.coalesce("evidence", F.array().cast("array<string>")), 1, 3).alias("evidence"), F.lit("action").alias("source_channel"), F.coalesce("keep", F.lit(False)).alias("tracking_keep"),
    ).where("object_id <> ''")


def dialogue_records(mentions: DataFrame, categories: tuple[str, ...] = TRACKED) -> DataFrame:
    """Inventory records that a model found in dialogue, as in ``schemas.SPOKEN_MENTIONS``."""
    m = mentions.where("physical_visualizable").where(F.coalesce("category", F.lit("other")).isin(*categories))
    name = T.strip(F.coalesce("canonical_name", F.lit("")))
    return m.select(
        "story_id", "scene_idx", F.lit(1).alias("channel_no"), "pos", T.object_key(name).alias("object_id"), name.alias("canonical_name"), F.coalesce("surface_forms", F.array().cast("array<string>")).alias("surface_forms"),
        "category", F.coalesce("direct_visual_evidence", F.lit(False)).alias("direct_visual_evidence"), rounded(F.coalesce("mention_strength", F.lit(0.0))).alias("mention_strength"),
        rounded(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.slice(F.coalesce("evidence", F.array().cast("array<string>")), 1, 3).alias("evidence"), F.lit("dialogue").alias("source_channel"),
        F.lit(False).alias("tracking_keep"),
    ).where("object_id <> ''")


def spoken_records(texts: DataFrame) -> DataFrame:
    """Inventory records by pattern from ``texts(story_id, scene_idx, dialogue_text)``: high recall, no model."""
    said = texts.select("story_id", "scene_idx", F.posexplode(T.sentences(F.col("dialogue_text"))).alias("s", "sentence"))
    named = said.select("story_id", "scene_idx", "s", "sentence", F.posexplode(T.spoken_names(F.col("sentence"))).alias("n", "name")).withColumn("object_id", T.object_key(F.col("name"))).where(T.is_spoken_object(F.col("object_id")))
    at = F.struct("s", "n")
    told = lambda value: F.transform(F.array_sort(F.collect_list(F.struct(at.alias("o"), F.col(value).alias("v")))), lambda x: x["v"])
    rows = named.groupBy("story_id", "scene_idx", "object_id").agg(
        F.min(at).alias("first"), F.min_by("name", at).alias("canonical_name"), F.array_distinct(told("name")).alias("surface_forms"), F.slice(F.array_distinct(told("sentence")), 1, 3).alias("evidence")
    )
    return rows.select(
        "story_id", "scene_idx", F.lit(1).alias("channel_no"), (F.col("first.s") * 10000 + F.col("first.n")).cast("int").alias("pos"), "object_id", "canonical_name", "surface_forms", F.lit("object").alias("category"),
        F.lit(False).alias("direct_visual_evidence"), F.lit(0.35).alias("mention_strength"), F.lit(0.30).alias("confidence"), "evidence", F.lit("dialogue").alias("source_channel"), F.lit(False).alias("tracking_keep"),
    )


def dialogue_channel(
    texts: DataFrame, mode: str, model: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]] | None = None, categories: tuple[str, ...] = TRACKED
) -> DataFrame:
    """Dialogue records by ``mode``: ``none``, ``heuristic``, ``llm``, or ``hybrid`` (the patterns where the model fails).

    ``model`` gives mentions, or mentions and the scenes ``(story_id, scene_idx)`` that it failed on: only these fall back. If it raises, all do; an error
    of Spark's own, such as a lost executor, is no failure of the model and ends the job.
    """
    if mode not in ("none", "heuristic", "llm", "hybrid"):
        raise ValueError(f"unknown dialogue mode: {mode}")
    patterns = spoken_records(texts)
    if mode == "none":
        return patterns.limit(0)
    if mode == "heuristic":
        return patterns
    if model is None:
        if mode == "llm":
            raise ValueError("the dialogue mode llm needs a model")
        return patterns
    try:
        found = model(texts)
    except (PySparkException, Py4JError, TypeError, NameError, AttributeError, ImportError, LookupError, AssertionError):
        raise  # Spark's own, and mistakes in the code that calls the model
    except Exception:
        if mode == "llm":
            raise
        return patterns
    found, failed = found if isinstance(found, tuple) else (found, None)
    records = dialogue_records(found, categories)
    return records if failed is None or mode == "llm" else records.unionByName(spoken_records(texts.join(failed, ["story_id", "scene_idx"], "left_semi")))


def merge_records(records: DataFrame) -> DataFrame:
    """Merged objects of each scene, ``pos`` in order of strength, confidence and name, all falling.

    Records of one scene are merged where they share an alias, in order of arrival (action first): each joins the first that has one of its aliases, which takes in the others that do.
    Names, votes and evidence are told in the order in which they came together, by grouped aggregates over ``merge_order``.
    """
    aliased = written(records.withColumn("aliases", T.keys_of(F.concat(F.array("object_id", "canonical_name"), F.coalesce("surface_forms", _none())), T.object_key)))
    scene = ["story_id", "scene_idx"]
    told = written(merge_order(aliased, F.concat_ws("\x01", F.col("scene_idx").cast("string"), "story_id"), F.col("channel_no").cast("long") * F.lit(1 << 32) + F.col("pos"), F.col("aliases")))
    key, place = [*scene, "first_row"], [F.col("place")]
    name = F.coalesce("canonical_name", F.lit(""))
    base = told.groupBy(*key).agg(
        F.min_by(F.struct("channel_no", "pos", "object_id"), "place").alias("_first"), F.min_by("canonical_name", F.struct(-F.length(name), F.col("place"))).alias("canonical_name"), F.array_sort(F.collect_set("source_channel")).alias("source_channels"),
        F.bool_or(F.coalesce("direct_visual_evidence", F.lit(False))).alias("direct_visual_evidence"), rounded(F.greatest(F.max("mention_strength"), F.lit(0.0))).alias("mention_strength_max"),
        rounded(F.greatest(F.max("confidence"), F.lit(0.0))).alias("confidence_max"), F.bool_or(F.coalesce("tracking_keep", F.lit(False))).alias("tracking_keep_any"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("normalized_aliases"),
    )
    forms = ordered_distinct(told, key, place, F.coalesce("surface_forms", _none()), "surface_forms")
    evidence = ordered_distinct(told, key, place, F.coalesce("evidence", _none()), "evidence", 5)
    merged = base.join(most_voted(told, key, "category", "place"), key).join(forms, key, "left").join(evidence, key, "left").select(
        "story_id", "scene_idx", F.col("_first.channel_no").cast("int").alias("order_channel"), F.col("_first.pos").cast("int").alias("order_pos"), F.col("_first.object_id").alias("first_id"), "canonical_name",
        F.coalesce("surface_forms", _none()).alias("surface_forms"), "source_channels", "normalized_aliases", "category", "direct_visual_evidence", "mention_strength_max", "confidence_max", F.coalesce("evidence", _none()).alias("evidence"), "tracking_keep_any",
    )
    own = T.object_key(F.col("canonical_name"))
    named = merged.withColumn("object_id", F.when(own != "", own).otherwise(F.col("first_id")))
    place = F.row_number().over(Window.partitionBy("story_id", "scene_idx").orderBy(F.desc("mention_strength_max"), F.desc("confidence_max"), F.desc("canonical_name"), "order_channel", "order_pos")) - 1
    return named.withColumn("pos", place).select(
        "story_id", "scene_idx", "pos", "object_id", "canonical_name", "surface_forms", "source_channels", "normalized_aliases", "category", "direct_visual_evidence", "mention_strength_max", "confidence_max", "evidence",
        "tracking_keep_any",
    )


def scene_inventory(action: DataFrame, dialogue: DataFrame) -> DataFrame:
    return merge_records(action.select(*COLUMNS).unionByName(dialogue.select(*COLUMNS)))
