"""Coarse alignment of a candidate's scenes to film time through subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions.numeric import rounded
from storyloom.operators.joins import band_join
from storyloom.operators.sequences import neighbour_windows


def subtitle_windows(subtitles: DataFrame, neighborhood: int = 1) -> DataFrame:
    """``(story_id, center_index, segment_indices, start_sec, end_sec, center_sec, text, tokens)`` in order of the subtitles' ``pos``."""
    windows = neighbour_windows(subtitles, ["story_id"], "pos", neighborhood)
    return windows.withColumn("tokens", F.array_distinct(T.tokens(F.col("text"))))


def query_terms(name: Column, heading: Column, objects: Column) -> tuple[Column, Column]:
    """General terms (name, heading and matched objects) and object terms (matched objects, else the name), both distinct and sorted."""
    of_objects = F.flatten(F.transform(objects, T.tokens))
    own = F.when(F.size(of_objects) > 0, of_objects).otherwise(T.tokens(name))
    every = F.concat(T.tokens(name), T.tokens(heading), of_objects)
    return F.array_sort(F.array_distinct(every)), F.array_sort(F.array_distinct(own))


def overlap(terms: Column, seen: Column) -> Column:
    """Share of the terms that were seen; 0 if there are none."""
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, seen)) / F.size(terms)).otherwise(0.0)


def scene_steps(candidates: DataFrame, total_scenes: DataFrame, durations: DataFrame) -> DataFrame:
    """One row for each scene of each candidate's chain with its expected time and its terms; ``step`` counts from 0."""
    rows = candidates.select(
        "story_id", "candidate_index", "object_id", "canonical_name", "candidate_source", F.posexplode(F.array_sort("loose_scene_chain")).alias("step", "r")
    ).join(total_scenes, "story_id").join(durations, "story_id")
    general, own = query_terms(F.col("canonical_name"), F.col("r.heading"), F.coalesce("r.matched_inventory_objects", F.array().cast("array<string>")))
    expected = F.col("r.scene_idx") / F.greatest(F.col("total_scenes") - 1, F.lit(1)).cast("double") * F.col("duration")
    return rows.select(
        "story_id", "candidate_index", "step", "object_id", "canonical_name", "candidate_source", F.col("r.scene_idx").alias("scene_idx"), F.col("r.heading").alias("heading"), expected.alias("expected"), "duration",
        general.alias("general"), own.alias("own"),
    )


def matching_options(steps: DataFrame, windows: DataFrame, radius: float) -> DataFrame:
    """Windows within the radius of a step's expected time that speak of its object, or share two general terms, with their scores."""
    met = band_join(steps.select("story_id", "candidate_index", "step", "expected", "general", "own"), windows, "expected", "center_sec", radius, ["story_id"])
    order = F.lit(1.0) - F.abs(F.col("center_sec") - F.col("expected")) / max(radius, 1.0)
    lexical, thing = overlap(F.col("general"), F.col("tokens")), overlap(F.col("own"), F.col("tokens"))
    kept = met.where(F.arrays_overlap("own", "tokens") | (F.size(F.array_intersect("general", "tokens")) >= 2))
    return kept.select(
        "story_id", "candidate_index", "step", "center_index", "segment_indices", "start_sec", "end_sec", "center_sec", "text", rounded(F.lit(0.45) * order + F.lit(0.20) * lexical + F.lit(0.35) * thing).alias("confidence"),
        rounded(order).alias("order_score"), rounded(lexical).alias("lexical_overlap"), rounded(thing).alias("object_overlap"),
    )


def monotone_pick(options: Column) -> Column:
    """From a chain's ranked options (an array of arrays) one for each step: the first that isn't before the last pick, else the top one."""
    kind = "struct<previous:double,picked:array<int>>"
    start = F.struct(F.lit(-1.0).alias("previous"), F.array().cast("array<int>").alias("picked")).cast(kind)

    def step(acc: Column, ranked: Column) -> Column:
        fit = F.array_position(F.transform(ranked, lambda o: o["center_sec"] + 1e-6 >= acc["previous"]), F.lit(True)).cast("int")
        at = F.greatest(fit, F.lit(1))
        return F.struct(F.element_at(ranked, at)["center_sec"].alias("previous"), F.concat(acc["picked"], F.array(at)).alias("picked")).cast(kind)

    return F.aggregate(options, start, step, lambda acc: acc["picked"])


def alignment_meta(candidates: DataFrame, subtitles: DataFrame, alignments: DataFrame) -> DataFrame:
    """Counts for each story: candidates, subtitles (each is the middle of one window), alignments, and the film's length by its subtitles."""
    seen = candidates.groupBy("story_id").agg(F.count("*").alias("scene_candidates_considered"))
    said = subtitles.groupBy("story_id").agg(F.count("*").alias("subtitle_segments"), rounded(F.max("end_sec"), 3).alias("movie_duration_sec"))
    made = alignments.groupBy("story_id").agg(F.count("*").alias("alignments_returned"))
    return seen.join(said, "story_id", "full").join(made, "story_id", "full").na.fill(0).withColumn("subtitle_windows", F.col("subtitle_segments"))


def align(candidates: DataFrame, total_scenes: DataFrame, subtitles: DataFrame, search_radius_sec: float = 420.0, default_window_sec: float = 75.0, neighborhood: int = 1) -> DataFrame:
    """One alignment for each scene of each candidate's chain, ``alignment_index`` in order of candidates and scenes.

    ``subtitles`` as in ``schemas.SUBTITLES`` with ``pos``, their order. A step without a matching window gets the window about its expected time, with
    confidence 0. The pick along a chain is greedy and goes back in time where nothing later fits.
    """
    windows = subtitle_windows(subtitles, neighborhood)
    steps = scene_steps(candidates, total_scenes, subtitles.groupBy("story_id").agg(F.max("end_sec").alias("duration")))
    options = matching_options(steps, windows, search_radius_sec)
    fields = ["segment_indices", "start_sec", "end_sec", "center_sec", "text", "confidence", "order_score", "lexical_overlap", "object_overlap"]
    ranked = F.array_sort(F.collect_list(F.struct(*((-F.col(c)).alias(f"_{c}") for c in ("confidence", "order_score", "lexical_overlap", "object_overlap")), "center_index", *fields)))
    by_step = options.groupBy("story_id", "candidate_index", "step").agg(ranked.alias("ranked"))
    by_step = by_step.withColumn("ranked", F.transform("ranked", lambda o: F.struct(*(o[c].alias(c) for c in fields))))
    half = default_window_sec / 2
    low, high = F.greatest(F.lit(0.0), F.col("expected") - half), F.least(F.col("duration"), F.col("expected") + half)
    none = F.struct(
        F.array().cast("array<int>").alias("segment_indices"), low.alias("start_sec"), high.alias("end_sec"), (F.lit(0.5) * (low + high)).alias("center_sec"), F.lit("").alias("text"),
        *(F.lit(0.0).alias(c) for c in ("confidence", "order_score", "lexical_overlap", "object_overlap")),
    )
    full = steps.join(by_step, ["story_id", "candidate_index", "step"], "left").withColumn("ranked", F.coalesce("ranked", F.array(none)))
    chains = full.groupBy("story_id", "candidate_index").agg(F.array_sort(F.collect_list(F.struct("step", "object_id", "canonical_name", "candidate_source", "scene_idx", "heading", "expected", "general", "ranked"))).alias("chain"))
    picked = chains.withColumn("picked", monotone_pick(F.transform("chain", lambda s: s["ranked"])))
    rows = picked.select("story_id", "candidate_index", F.explode(F.zip_with("chain", "picked", lambda s, i: F.struct(s.alias("s"), F.element_at(s["ranked"], i).alias("o")))).alias("x"))
    sized = chains.select("story_id", "candidate_index", F.size("chain").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("story_id").orderBy("candidate_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sized.select("story_id", "candidate_index", before.alias("offset"))
    return rows.join(offsets, ["story_id", "candidate_index"]).select(
        "story_id", (F.col("offset") + F.col("x.s.step")).cast("int").alias("alignment_index"), "candidate_index", "x.s.object_id", "x.s.canonical_name", "x.s.candidate_source", "x.s.scene_idx", "x.s.heading",
        rounded(F.col("x.o.start_sec"), 3).alias("aligned_start_sec"), rounded(F.col("x.o.end_sec"), 3).alias("aligned_end_sec"), rounded(F.col("x.s.expected"), 3).alias("expected_time_sec"), "x.o.confidence",
        F.col("x.o.segment_indices").alias("matched_subtitle_indices"), F.col("x.o.text").alias("matched_subtitle_text"), F.col("x.s.general").alias("query_terms"),
        F.struct("x.o.order_score", "x.o.lexical_overlap", "x.o.object_overlap").alias("component_scores"),
    )
