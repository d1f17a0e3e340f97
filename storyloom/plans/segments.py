"""Candidate segments of film time, from alignments: scored, merged where they are near, the best of each object kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.numeric import clamped, rounded
from storyloom.operators.sequences import islands, ordered_union, top_rows


def segment_role(tags: Column) -> Column:
    has = lambda t: F.array_contains(tags, t)
    return F.when(has("payoff_candidate"), "payoff").when(has("setup_candidate"), "setup").when(has("scene_inventory_loose_match"), "reappearance").otherwise("bridge")


def role_order(role: Column) -> Column:
    return F.when(role == "payoff", 3).when(role == "setup", 2).when(role == "reappearance", 1).otherwise(0)


def priority(score: Column, confidence: Column, tags: Column, source: Column) -> Column:
    bonus = lambda on, w: F.when(on, w).otherwise(0.0)
    has = lambda t: F.array_contains(tags, t)
    roles = bonus(has("payoff_candidate"), 0.14) + bonus(has("setup_candidate"), 0.08) + bonus(has("high_climax_scene"), 0.10) + bonus(has("action_supported_match"), 0.05) - bonus(source == "inventory_only", 0.02)
    return rounded(clamped(F.lit(0.56) * score + F.lit(0.34) * confidence + roles))


def reason_tags(source: Column, tags: Column, scores: Column) -> Column:
    told = F.filter(
        F.concat(
            F.array(F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("candidate_source:"), source))), F.transform(tags, lambda t: F.concat(F.lit("role:"), t)),
            F.array(F.when(scores["object_overlap"] > 0, F.lit("subtitle_object_overlap")), F.when(scores["lexical_overlap"] > 0, F.lit("subtitle_lexical_overlap"))),
        ),
        lambda t: t.isNotNull(),
    )
    return F.when(F.size(told) > 0, told).otherwise(F.array(F.lit("expected_time_fallback")))


def _scores() -> Column:
    part = lambda c: F.coalesce(F.col(f"component_scores.{c}"), F.lit(0.0)).alias(c)
    return F.struct(part("object_overlap"), part("lexical_overlap"))


def speaks_of_object(text: Column, scores: Column) -> Column:
    """Not so where subtitles matched by general words only."""
    return ~((F.coalesce(text, F.lit("")) != "") & (scores["object_overlap"] <= 0) & (scores["lexical_overlap"] > 0))


def seed_segments(candidates: DataFrame, alignments: DataFrame, min_confidence: float = 0.15, padding_sec: float = 12.0) -> DataFrame:
    """A segment for each alignment that is sure enough and speaks of its object."""
    roles = candidates.select("story_id", "candidate_index", F.explode("loose_scene_chain").alias("r")).select("story_id", "candidate_index", F.col("r.scene_idx").alias("scene_idx"), F.col("r.role_tags").alias("tags"))
    about = candidates.select("story_id", "candidate_index", F.col("object_id").alias("oid"), F.col("canonical_name").alias("name"), F.coalesce("candidate_source", F.lit("")).alias("source"), F.coalesce("possible_chekhov_score", F.lit(0.0)).alias("score"))
    kept = alignments.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence).where(speaks_of_object(F.col("matched_subtitle_text"), _scores()))
    rows = kept.join(about, ["story_id", "candidate_index"]).join(roles, ["story_id", "candidate_index", "scene_idx"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    start = F.greatest(F.lit(0.0), F.col("aligned_start_sec") - padding_sec)
    none = F.array().cast("array<string>")
    return rows.select(
        "story_id", F.format_string("cand%03d_scene%03d_%s", "candidate_index", "scene_idx", "oid").alias("segment_id"), "candidate_index", F.col("oid").alias("object_id"), F.col("name").alias("canonical_name"),
        F.col("source").alias("candidate_source"), F.col("score").alias("possible_chekhov_score"), "scene_idx", "alignment_index", segment_role(F.col("tags")).alias("segment_role"), rounded(start, 3).alias("segment_start_sec"),
        rounded(F.greatest(start, F.col("aligned_end_sec") + padding_sec), 3).alias("segment_end_sec"), priority(F.col("score"), F.col("confidence"), F.col("tags"), F.col("source")).alias("priority_score"),
        F.col("confidence").alias("alignment_confidence_max"), reason_tags(F.col("source"), F.col("tags"), _scores()).alias("reason_tags"),
        F.when(F.coalesce("matched_subtitle_text", F.lit("")) != "", F.array("matched_subtitle_text")).otherwise(none).alias("matched_subtitle_texts"),
        F.coalesce("matched_subtitle_indices", F.array().cast("array<int>")).alias("matched_subtitle_indices"), F.coalesce("query_terms", none).alias("query_terms"),
    )


def merge_segments(seeds: DataFrame, merge_gap_sec: float = 8.0) -> DataFrame:
    """Segments of an object that touch or are near become one; lists keep the order of start, end and alignment."""
    near = islands(seeds.withColumn("_end", F.struct("segment_end_sec", "alignment_index")), ["story_id", "object_id"], "segment_start_sec", "segment_end_sec", merge_gap_sec)
    at = F.struct("segment_start_sec", "segment_end_sec", "alignment_index")
    first = lambda c: F.min_by(c, at).alias(c)
    role = F.max_by("segment_role", F.struct(role_order(F.col("segment_role")).alias("r"))).alias("segment_role")
    merged = near.groupBy("story_id", "object_id", "island").agg(
        first("candidate_index"), first("canonical_name"), first("candidate_source"), first("possible_chekhov_score"), F.array_sort(F.collect_set("scene_idx")).alias("source_scene_indices"),
        F.array_sort(F.collect_set("alignment_index")).alias("source_alignment_indices"), role, F.min("segment_start_sec").alias("_start"), F.max("segment_end_sec").alias("_stop"),
        rounded(F.max("priority_score")).alias("priority_score"), rounded(F.max("alignment_confidence_max")).alias("alignment_confidence_max"), ordered_union(at, F.col("reason_tags")).alias("reason_tags"),
        ordered_union(at, F.col("matched_subtitle_texts")).alias("matched_subtitle_texts"), ordered_union(at, F.col("matched_subtitle_indices")).alias("matched_subtitle_indices"), ordered_union(at, F.col("query_terms")).alias("query_terms"),
    )
    name = F.format_string("cand%03d_%s_seg%03d", "candidate_index", "object_id", F.element_at("source_scene_indices", 1))
    return merged.select(
        "story_id", name.alias("segment_id"), "candidate_index", "object_id", "canonical_name", "candidate_source", "possible_chekhov_score", "source_scene_indices", "source_alignment_indices", "segment_role",
        F.col("_start").alias("segment_start_sec"), F.col("_stop").alias("segment_end_sec"), "priority_score", "alignment_confidence_max", "reason_tags", "matched_subtitle_texts", "matched_subtitle_indices", "query_terms",
    )


def candidate_segments(candidates: DataFrame, alignments: DataFrame, min_confidence: float = 0.15, padding_sec: float = 12.0, merge_gap_sec: float = 8.0, per_object: int = 4) -> DataFrame:
    """The best segments of each object, ``segment_index`` in order of object, priority and start."""
    merged = merge_segments(seed_segments(candidates, alignments, min_confidence, padding_sec), merge_gap_sec)
    best = top_rows(merged, ["story_id", "object_id"], [F.desc("priority_score"), F.desc("alignment_confidence_max"), F.asc("segment_start_sec")], per_object)
    order = Window.partitionBy("story_id").orderBy("object_id", F.desc("priority_score"), "segment_start_sec")
    return best.withColumn("segment_index", F.row_number().over(order) - 1)


def segment_meta(candidates: DataFrame, alignments: DataFrame, segments: DataFrame, min_confidence: float = 0.15) -> DataFrame:
    """Counts for each story: segments, and alignments skipped because only general words matched."""
    there = alignments.join(candidates.select("story_id", "candidate_index"), ["story_id", "candidate_index"], "left_semi").where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    skipped = there.groupBy("story_id").agg(F.count_if(~speaks_of_object(F.col("matched_subtitle_text"), _scores())).alias("skipped_non_object_specific_alignments"))
    return skipped.join(segments.groupBy("story_id").agg(F.count("*").alias("segments_returned")), "story_id", "full").na.fill(0)
