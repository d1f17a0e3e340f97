"""Stage 1: objects that disappear for long and return."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions.numeric import clamped
from storyloom.operators.gaps import gap_level, gap_quantiles, majority, max_gaps, reappearance_score, top_values

TRACKED = ("object", "artifact", "weapon", "creature", "vehicle")


@dataclass(frozen=True)
class ReappearanceRules:
    min_gap: int = 20
    min_confidence: float = 0.70
    min_visual: float = 0.60
    min_action: float = 0.45
    min_state: float = 0.25
    categories: tuple[str, ...] = TRACKED
    top_k: int = 100
    contexts: int = 5


def gated_mentions(mentions: DataFrame, categories: tuple[str, ...] = TRACKED) -> DataFrame:
    """Mentions that count, with ``entity_key``: kept, visible, of a tracked category, with a name."""
    keyed = mentions.where("keep and physical_visualizable and canonical_name is not null").where(F.coalesce("category", F.lit("other")).isin(*categories))
    return keyed.withColumn("entity_key", T.mention_key(F.col("canonical_name"))).where("entity_key <> ''")


def mine_reappearances(mentions: DataFrame, scenes: DataFrame, rules: ReappearanceRules = ReappearanceRules()) -> DataFrame:
    """Ranked reappearances of each story, ``event_idx`` from 0.

    ``mentions`` as in ``schemas.ENTITY_MENTIONS``, ``scenes`` as in ``schemas.SCENES``. Means are over mentions; names and
    categories by majority, of equal ones the first mentioned; an object needs ``min_gap``, all four means and both
    anchor scenes. Equal ranks keep the order of first mention.
    """
    key = ["story_id", "entity_key"]
    base = gated_mentions(mentions, rules.categories).withColumn("ord", F.struct("scene_idx", "pos"))
    gaps = max_gaps(base, key, "scene_idx").where(F.col("gap_jump") >= rules.min_gap)
    mean = lambda c: clamped(F.avg(F.coalesce(c, F.lit(0.0))))
    means = base.groupBy(*key).agg(
        mean("action").alias("action"), mean("visual").alias("visual"), mean("state").alias("state"), mean("confidence").alias("confidence"), F.min("ord").alias("first_ord")
    ).where(
        (F.col("confidence") >= rules.min_confidence) & (F.col("visual") >= rules.min_visual) & (F.col("action") >= rules.min_action) & (F.col("state") >= rules.min_state)
    )
    found = gaps.join(means, key)
    kept = base.join(found.select(*key), key, "left_semi")
    forms = kept.select(*key, "ord", F.posexplode("surface_forms").alias("j", "form")).withColumn("o", F.struct("ord", "j"))
    found = (
        found.join(majority(kept, key, "canonical_name", "ord", "canonical_name"), key)
        .join(majority(kept, key, "category", "ord", "entity_type"), key)
        .join(top_values(forms, key, "form", "o", "surface_forms"), key, "left")
    )
    evidence = kept.groupBy(*key, "scene_idx").agg(
        F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("evidence", F.array().cast("array<string>")).alias("e")))), lambda s: s["e"]))), 1, rules.contexts).alias("context")
    )
    told = scenes.where("scene_idx_non_omitted >= 0")
    for side in ("a", "b"):
        anchor = told.select(
            F.col("story_id"), F.col("scene_idx_non_omitted").alias(f"position_{side}"), F.col("scene_label_raw").alias(f"scene_{side}_label_raw"), F.col("page_start").alias(f"page_{side}"),
            F.col("heading").alias(f"heading_{side}"),
        )
        found = found.join(anchor, ["story_id", f"position_{side}"])
        seen = evidence.select(*key, F.col("scene_idx").alias(f"position_{side}"), F.col("context").alias(f"context_{side}"))
        found = found.join(seen, [*key, f"position_{side}"], "left")
    found = found.join(gap_quantiles(found, ["story_id"]), "story_id")
    score = reappearance_score(F.col("gap_jump"), F.col("action"), F.col("visual"), F.col("state"))
    place = F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("rank_score"), "first_ord")) - 1
    none = F.array().cast("array<string>")
    return (
        found.withColumn("rank_score", score).withColumn("event_idx", place).where(F.col("event_idx") < rules.top_k)
        .select(
            "story_id", "event_idx", "entity_key", "canonical_name", "entity_type", F.coalesce("surface_forms", none).alias("surface_forms"), F.col("position_a").alias("scene_a"),
            F.col("position_b").alias("scene_b"), "gap_jump", "gap_absent", F.col("freq").cast("int").alias("freq_scenes"), "coverage", "scene_a_label_raw", "scene_b_label_raw", "page_a", "page_b",
            "heading_a", "heading_b", "context_a", "context_b",
            F.struct(F.col("action").alias("narrative_action_centrality"), F.col("visual").alias("visual_grounded_score"), F.col("state").alias("state_change_potential"), "confidence").alias("scores"),
            F.col("positions").alias("scenes"), gap_level(F.col("gap_jump"), F.col("q50"), F.col("q75")).alias("gap_level"), "q50", "q75", "rank_score",
        )
    )


def scene_event_names(events: DataFrame) -> DataFrame:
    """``(story_id, scene_idx, objects)``: the names of the events that each scene takes part in, in order of events."""
    rows = events.select("story_id", "event_idx", "canonical_name", F.explode("scenes").alias("scene_idx"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("event_idx", "canonical_name"))), lambda s: s["canonical_name"])
    return rows.groupBy("story_id", "scene_idx").agg(F.array_distinct(names).alias("objects"))


def scene_climax(scenes: DataFrame, scores: DataFrame, events: DataFrame) -> DataFrame:
    """``(story_id, scene_idx, heading, climax_score, objects)``: a model's score of each told scene and the objects of its events."""
    told = scenes.where("scene_idx_non_omitted >= 0").select("story_id", F.col("scene_idx_non_omitted").alias("scene_idx"), "heading")
    return told.join(scores.select("story_id", "scene_idx", "climax_score"), ["story_id", "scene_idx"]).join(scene_event_names(events), ["story_id", "scene_idx"], "left").withColumn(
        "objects", F.coalesce("objects", F.array().cast("array<string>"))
    )
