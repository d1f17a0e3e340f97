"""Registered queries that run whole stages: reappearances, alignment, segments, frames, and candidates of literal stories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions.session import checkpointed, read_table
from storyloom.plans import schemas as S
from storyloom.plans.alignment import align
from storyloom.plans.candidates import CandidateRules, mine_candidates
from storyloom.plans.inventory import action_records, scene_inventory, spoken_records
from storyloom.plans.reappearance import ReappearanceRules, mine_reappearances
from storyloom.plans.sampling import review_plan, sample_frames
from storyloom.plans.segments import candidate_segments

#: Gates of the stage-1 query, low enough for its evenly spread scores.
STAGE1 = ReappearanceRules(min_gap=20, min_confidence=0.3, min_visual=0.3, min_action=0.3, min_state=0.2, categories=("artifact", "object"), top_k=50)


def _joined(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|")


def stage1_reappearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 1 on events: a story is a user modulo 20, a scene a quarter of a day (one in 13 omitted), an entity a user's event type under three spellings."""
    from storyloom.queries import event_mentions

    e = event_mentions(spark, sf_dir).select("event_id", "user_id", "event_type", "at", "cents")
    name = F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))
    part = lambda c: F.pmod(c, F.lit(64)) / 64.0  # noqa: E731  sums of these are exact
    m = e.select(
        F.pmod("user_id", F.lit(20)).cast("string").alias("story_id"), F.floor(F.col("at") / 21600).cast("int").alias("scene_idx"), F.col("event_id").cast("int").alias("pos"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("The "), name)).when(F.col("event_id") % 3 == 1, name).otherwise(F.upper(name)).alias("canonical_name"),
        F.array("event_type", F.when(F.col("event_id") % 2 == 0, F.lit("it")).otherwise(F.lit("that"))).alias("surface_forms"),
        F.when(F.col("event_id") % 7 == 0, "location").when(F.col("event_id") % 5 < 3, "artifact").otherwise("object").alias("category"), (F.col("event_id") % 17 != 0).alias("physical_visualizable"), (F.col("event_id") % 11 != 0).alias("keep"),
        part(F.col("cents")).alias("action"), part(F.expr("cents div 64")).alias("visual"), part(F.col("event_id")).alias("state"), part(F.expr("event_id div 3")).alias("confidence"),
        F.array(F.concat(F.lit("e"), F.col("event_id").cast("string")), F.lit("same")).alias("evidence"),
    )
    n = F.col("scene_idx")
    scenes = m.select("story_id", "scene_idx").distinct().select(
        "story_id", "scene_idx", F.when(F.pmod(n, F.lit(13)) == 7, -1).otherwise(n).alias("scene_idx_non_omitted"), F.concat(n.cast("string"), F.lit("A")).alias("scene_label_raw"), n.alias("scene_label_int"),
        F.lit("INT.").alias("marker_type"), F.concat(F.lit("INT. HOUR "), n.cast("string")).alias("heading"), (n + 1).alias("page_start"), (n + 2).alias("page_end"), F.array().cast("array<string>").alias("lines"),
    )
    found = mine_reappearances(m, scenes, STAGE1)
    return found.select(
        "story_id", "event_idx", "entity_key", "canonical_name", "entity_type", _joined("surface_forms").alias("forms"), "scene_a", "scene_b", "gap_jump", "gap_absent", "freq_scenes", "coverage", "scene_a_label_raw", "page_b",
        "heading_b", _joined("context_a").alias("context_a"), "gap_level", F.col("scores.confidence").alias("confidence"), F.floor(F.col("rank_score") * 1000).cast("long").alias("rank_milli"),
    )


def _film(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates of three scenes each from benchmark items, the number of scenes, and turns as subtitles; ten stories."""
    items = read_table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    low, high = F.coalesce(F.array_min("t"), F.lit("")), F.coalesce(F.array_max("t"), F.lit(""))
    i, none = F.col("item_id"), F.array().cast("array<string>")
    row = lambda away, objects, *tags: F.struct(
        (F.pmod(i, F.lit(20)) + away).cast("int").alias("scene_idx"), F.concat(F.lit("INT. "), F.upper(high)).alias("heading"), objects.alias("matched_inventory_objects"), F.array(*(F.lit(t) for t in tags)).alias("role_tags")
    )
    chain = F.array(row(0, F.array(low), "setup_candidate"), row(20, none, "scene_inventory_loose_match", "action_supported_match"), row(39, F.array(high), "payoff_candidate", "high_climax_scene"))
    kinds = F.array(*(F.lit(k) for k in ("inventory_only", "stage1_fallback", "inventory_with_stage1_prior")))
    candidates = items.select(
        F.pmod(i, F.lit(10)).cast("string").alias("story_id"), F.expr("cast(item_id div 10 as int)").alias("candidate_index"), F.concat(F.lit("obj "), low).alias("object_id"), F.concat_ws(" ", low, high).alias("canonical_name"),
        F.element_at(kinds, (F.pmod(i, F.lit(3)) + 1).cast("int")).alias("candidate_source"), (F.pmod(i, F.lit(32)) / 64.0 + 0.5).alias("possible_chekhov_score"), chain.alias("loose_scene_chain"),
    )
    start = F.expr("(conv_id div 10) * 80.0D + turn * 10.0D")
    subtitles = read_table(spark, sf_dir, "conversations").select(
        F.pmod("conv_id", F.lit(10)).cast("string").alias("story_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), (F.col("conv_id") * 1000 + F.col("turn")).cast("int").alias("index"), start.alias("start_sec"),
        (start + 8.0).alias("end_sec"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return candidates, candidates.select("story_id").distinct().withColumn("total_scenes", F.lit(60)), subtitles


def _alignments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    candidates, total, subtitles = _film(spark, sf_dir)
    return candidates, checkpointed(align(candidates, total, subtitles))


def scene_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment stage: expected times, options by terms, the greedy pick along each chain, fallback windows."""
    _, a = _alignments(spark, sf_dir)
    return a.select(
        "story_id", "alignment_index", "candidate_index", "object_id", "scene_idx", "aligned_start_sec", "aligned_end_sec", "expected_time_sec", "confidence", _joined("matched_subtitle_indices").alias("subtitles"),
        _joined("query_terms").alias("terms"), "component_scores.order_score", "component_scores.lexical_overlap", "component_scores.object_overlap",
    )


def film_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment stage on those alignments: gates, priorities, roles and reasons, merged neighbours, four of each object."""
    found = candidate_segments(*_alignments(spark, sf_dir))
    return found.select(
        "story_id", "segment_index", "segment_id", "candidate_index", "object_id", "candidate_source", _joined("source_scene_indices").alias("scenes"), _joined("source_alignment_indices").alias("alignments"), "segment_role",
        "segment_start_sec", "segment_end_sec", "priority_score", "alignment_confidence_max", _joined("reason_tags").alias("reasons"), F.size("matched_subtitle_texts").alias("n_texts"),
    )


def _user_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyloom.queries import merge_segments

    s = merge_segments(spark, sf_dir)
    story = F.col("user_id").cast("string")
    return s.select(
        story.alias("story_id"), F.concat_ws("_", F.lit("u"), story, F.col("island").cast("string")).alias("segment_id"), F.concat(F.lit("o"), F.pmod("island", F.lit(3)).cast("string")).alias("object_id"), story.alias("canonical_name"),
        F.col("segment_start").cast("double").alias("segment_start_sec"), F.col("segment_end").cast("double").alias("segment_end_sec"), (F.col("top_cents") / 65536.0).alias("priority_score"), (F.col("n_events") / 64.0).alias("alignment_confidence_max"),
    )


def frame_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame stage: four moments of each user's segments and the nearest of the user's events as frames."""
    from storyloom.queries import event_mentions

    frames = event_mentions(spark, sf_dir).select(F.col("user_id").cast("string").alias("story_id"), F.expr("cast(at div 4 as int)").alias("frame_index")).distinct()
    frames = frames.withColumn("path", F.concat(F.lit("in/frame_"), F.col("frame_index").cast("string"), F.lit(".JPG")))
    found = sample_frames(_user_segments(spark, sf_dir), frames, fps=0.25, per_segment=4, out_dir="out")
    return found.select("story_id", "segment_id", "sample_index", "timestamp_sec", "target_frame_index", "frame_index", "source_path", "output_path")


def review_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review stage: each object's best segment, a window of 50 seconds about it, a moment every 16 seconds and the sheet it goes to."""
    found = review_plan(_user_segments(spark, sf_dir), radius_sec=200.0, every_sec=16.0, fps=2.0, duration_sec=4_000_000.0)
    return found.drop("canonical_name")


def _event(i: int, key: str, name: str, forms: list[str], a: int, b: int, scenes: list[int], confidence: float) -> tuple:
    return "s", i, key, name, "artifact", forms, a, b, b - a, b - a - 1, len(scenes), 0.25, (0.75, 0.5, 0.5, confidence), scenes


def candidate_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal story: a book named in three ways over three scenes with two prior events that become one candidate, a generic name that links nothing,
    a cup that only the inventory has, and a sword that only an event has."""
    thing = lambda scene, pos, name, aliases, channel, direct, strength, sure, told, kind="artifact": (
        "s", scene, pos, name.lower(), name, aliases, [name.lower(), *aliases], [channel], kind, direct, strength, sure, told
    )
    objects = spark.createDataFrame(
        [
            thing(2, 0, "Torn Diary", ["diary"], "action", True, 0.75, 0.5, ["She opens it."]), thing(9, 0, "diary", [], "dialogue", False, 0.5, 0.5, ["Where is it?"]), thing(10, 0, "Torn Diary", ["diary"], "action", True, 1.0, 0.75, ["It burns."]),
            thing(3, 0, "silver cup", ["cup"], "action", True, 0.5, 0.5, [], "object"), thing(11, 0, "cup", [], "action", True, 1.0, 1.0, ["The cup falls."], "object"), thing(5, 0, "book", [], "action", True, 1.0, 1.0, []),
        ],
        S.SCENE_OBJECTS,
    )
    headings = spark.createDataFrame([("s", n, f"INT. {n}") for n in (2, 3, 5, 9, 10, 11)], S.SCENE_HEADINGS)
    climax = spark.createDataFrame([("s", n, f"CLIMAX {n}", v) for n, v in ((1, 0), (2, 25), (3, 25), (9, 75), (10, 100), (11, 75))], S.SCENE_CLIMAX)
    events = spark.createDataFrame(
        [_event(0, "torn diary", "Torn Diary", ["diary"], 2, 10, [2, 10], 0.75), _event(1, "diary", "diary", ["the diary"], 2, 9, [2, 9], 0.5), _event(2, "sword", "Sword", [], 1, 11, [1, 11], 0.5)], S.EVENTS
    )
    meta = spark.createDataFrame([("s", 4.0, 8.0, 13)], S.STORY_META)
    found = mine_candidates(events, objects, headings, climax, meta, CandidateRules(min_score=0.3))
    return found.select(
        "candidate_index", "object_id", "canonical_name", "entity_type", "candidate_source", "possible_chekhov_score", "possible_chekhov_label", _joined("validation_reasons").alias("reasons"), _joined("setup_scene_indices").alias("setup"),
        _joined("payoff_scene_indices").alias("payoff"), _joined("loose_scene_chain.scene_idx").alias("chain"), _joined("loose_scene_chain.heading").alias("headings"),
        F.array_join(F.transform("loose_scene_chain", lambda r: F.array_join(r["role_tags"], "+")), "|").alias("roles"), _joined("inventory_support.inventory_scene_indices").alias("inventory"),
        _joined("inventory_support.source_channels_seen").alias("channels"), "candidate_stats.gap_jump", "candidate_stats.freq_scenes", F.col("stage1_prior.source_event_index").alias("prior"), _joined("stage1_supports.source_event_index").alias("supports"),
    )


def inventory_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal scene inventory: action and dialogue of two scenes, merged where keys meet; untracked and unseen things stay out."""
    seen = lambda scene, pos, name, forms, kind, visible, keep, action, visual, state, sure, told: ("s", scene, pos, name, forms, kind, visible, keep, action, visual, state, sure, told)
    mentions = spark.createDataFrame(
        [
            seen(0, 0, "the diary", ["diary", "it"], "artifact", True, True, 0.5, 0.75, 0.25, 0.75, ["a", "b", "c", "d"]), seen(0, 1, "Old Diary", ["the diary"], "object", True, False, 0.25, 0.5, 1.0, 0.5, ["e", "a"]),
            seen(0, 2, "hall", [], "location", True, True, 1.0, 1.0, 1.0, 1.0, []), seen(0, 3, "fear", [], "object", False, True, 1.0, 1.0, 1.0, 1.0, []), seen(1, 0, "sword", [], "weapon", True, True, None, None, 0.5, None, None),
        ],
        S.ENTITY_MENTIONS,
    )
    texts = spark.createDataFrame([("s", 0, "Bring the diary. The diary is back!"), ("s", 1, "Take the sword and run.")], "story_id string, scene_idx int, dialogue_text string")
    found = scene_inventory(action_records(mentions), spoken_records(texts))
    return found.select(
        "scene_idx", "pos", "object_id", "canonical_name", _joined("surface_forms").alias("forms"), _joined("source_channels").alias("channels"), _joined("normalized_aliases").alias("aliases"), "category", "direct_visual_evidence",
        "mention_strength_max", "confidence_max", _joined("evidence").alias("evidence"), "tracking_keep_any",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (stage1_reappearances, scene_alignments, film_segments, frame_samples, review_windows)}


def literal_stories() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Stories of a few rows with results written by hand, for tests; they read no table, so they aren't registered."""
    return {f.__name__: f for f in (candidate_story, inventory_story)}
