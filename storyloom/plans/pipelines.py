"""The stages end to end, from pages and files to tables; models are passed in as plain functions on requests.

A model function gets a list of requests (dicts with prompt, scene_idx, heading, text and, where it applies, channel or entity) and gives as many JSON texts. What
it has answered is in a cache table ``(key, response)``, keyed by the request and the name ``model``; each stage also returns the rows to append to it. What a stage returns is written
to the shared checkpoint folder, so plans stay short and a model is asked once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.session import checkpointed
from storyloom.plans import annotate, legacy
from storyloom.plans.alignment import align
from storyloom.plans.candidates import CandidateRules, mine_candidates, story_meta
from storyloom.plans.inventory import action_records, dialogue_channel, scene_inventory
from storyloom.plans.reappearance import ReappearanceRules, mine_reappearances, scene_climax
from storyloom.plans.sampling import review_plan, sample_frames
from storyloom.plans.scenes import blocks_of, channel_texts, is_dialogue, page_lines, split_scenes
from storyloom.plans.segments import candidate_segments
from storyloom.sources.readers import read_climax, read_events, read_inventory, read_subtitles

Model = Callable[[list[dict]], list[str]]


def empty_cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "key string, response string")


def parse_scenes(pages: DataFrame) -> DataFrame:
    """``pages(story_id, page_no, text)`` to scenes."""
    return checkpointed(split_scenes(page_lines(pages)))


def told_channels(scenes: DataFrame) -> DataFrame:
    """Told scenes with their own index as ``scene_idx`` and the texts of both channels."""
    return channel_texts(scenes.where("scene_idx_non_omitted >= 0")).withColumn("scene_idx", F.col("scene_idx_non_omitted"))


def _written(answers: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checkpointed(answers), fresh


def ask_channel(scenes: DataFrame, channel: str, ask: Model, cache: DataFrame, model: str = "", tolerant: bool = False) -> tuple[DataFrame, DataFrame]:
    """Answers for the scenes that have a text in the channel; where ``tolerant``, null ones for those that the model fails on."""
    told = {name: F.col(name) for name in ("scene_idx", "heading", "channel", "text")}
    wording = annotate.prompt(annotate.SCENE_PROMPT if channel == "action" else annotate.CHANNEL_PROMPT, **told)
    text = F.col(f"{channel}_text")
    requests = told_channels(scenes).where(text != "").select("story_id", "scene_idx", "heading", F.lit(channel).alias("channel"), text.alias("text"))
    return _written(*annotate.annotated(requests, cache, ask, list(told), model=model, wording=wording, tolerant=tolerant))


def mine_stage1(scenes: DataFrame, ask: Model, cache: DataFrame, rules: ReappearanceRules = ReappearanceRules(), model: str = "") -> tuple[DataFrame, DataFrame]:
    """Scenes to ranked reappearances."""
    answers, fresh = ask_channel(scenes, "action", ask, cache, model)
    return checkpointed(mine_reappearances(annotate.scene_mentions(answers), scenes, rules)), fresh


def build_scene_inventory(
    scenes: DataFrame, ask_action: Model, cache: DataFrame, ask_dialogue: Model | None = None, dialogue_mode: str = "hybrid", model: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Scenes to the merged objects of each, from action and dialogue; headings come with them.

    In the mode ``hybrid`` a scene whose dialogue the model fails on, or answers with what can't be read, falls back to the patterns alone; in ``llm`` a failure
    ends the job. The rows for the cache are those of both channels.
    """
    answers, fresh = ask_channel(scenes, "action", ask_action, cache, model)
    action = action_records(annotate.scene_mentions(answers))
    added = [fresh]

    def spoken(_: DataFrame) -> tuple[DataFrame, DataFrame]:
        said, more = ask_channel(scenes, "dialogue", ask_dialogue, cache, model, tolerant=dialogue_mode == "hybrid")
        added.append(more)
        return annotate.spoken_mentions(said), annotate.unanswered(said)

    texts = told_channels(scenes).where("dialogue_text <> ''").select("story_id", "scene_idx", "dialogue_text")
    merged = checkpointed(scene_inventory(action, dialogue_channel(texts, dialogue_mode, spoken if ask_dialogue else None)))
    return merged, reduce(DataFrame.unionByName, added)


def mine_climax(scenes: DataFrame, events: DataFrame, ask: Model, cache: DataFrame, story: str = "", model: str = "") -> tuple[DataFrame, DataFrame]:
    """Each told scene's climax score by the model, from all of its lines and a summary of the ``story``, with the objects of its events."""
    requests = scenes.where("scene_idx_non_omitted >= 0").select("story_id", F.col("scene_idx_non_omitted").alias("scene_idx"), "heading", F.array_join("lines", "\n").alias("text"))
    told = {name: F.col(name) for name in ("scene_idx", "heading", "text")}
    named = f"{model}\n{story}" if story else model  # another summary is another request
    answers, fresh = _written(*annotate.annotated(requests, cache, ask, list(told), model=named, wording=annotate.prompt(annotate.CLIMAX_PROMPT, story=F.lit(story), **told)))
    scores = answers.select("story_id", "scene_idx", F.from_json(annotate.json_part(F.col("response")), "climax_score int")["climax_score"].alias("climax_score"))
    return checkpointed(scene_climax(scenes, scores, events)), fresh


def candidates_from_files(spark: SparkSession, events_path: str, inventory_path: str, climax_path: str, rules: CandidateRules = CandidateRules()) -> DataFrame:
    """The three stage files of a story to its candidates; an inventory or climax without scenes is an error."""
    events, quartiles = read_events(spark, events_path)
    objects, headings, inventory_total = read_inventory(spark, inventory_path)
    climax, climax_total = read_climax(spark, climax_path)
    one = lambda df: df.withColumn("story_id", F.lit("story"))  # noqa: E731  three files of one story
    events, objects, headings, climax = one(events), one(objects), one(headings), one(climax)
    if headings.isEmpty():
        raise ValueError("the inventory has no scenes")
    if climax.isEmpty():
        raise ValueError("the climax file has no scenes")
    given = one(quartiles).select("story_id", "q50", "q75").join(one(inventory_total), "story_id").join(one(climax_total), "story_id")
    return mine_candidates(events, objects, headings, climax, story_meta(events, headings, climax, given), rules)


def segments_from_subtitles(candidates: DataFrame, total_scenes: DataFrame, subtitles: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Alignments, and the candidate segments made of them."""
    if subtitles.isEmpty():
        raise ValueError("there are no subtitles")
    if not total_scenes.where("total_scenes is null or total_scenes <= 0").isEmpty():
        raise ValueError("the number of scenes must be positive")
    keys = ("search_radius_sec", "default_window_sec", "neighborhood")
    alignments = checkpointed(align(candidates, total_scenes, subtitles, **{k: how[k] for k in keys if k in how}))
    return alignments, candidate_segments(candidates, alignments, **{k: v for k, v in how.items() if k not in keys})


def mine_legacy(scenes: DataFrame, chunk: Callable[[str], list[dict]], curate: Model, cache: DataFrame, min_gap: int = 20, preselect: int = 200, include_dialogue: bool = True, model: str = "", **rules) -> tuple[DataFrame, DataFrame]:
    """The older miner: noun chunks of blocks, rough gaps, curation by a model on up to eight contexts; the anchors' pages, headings and contexts come with each event."""
    told = scenes.where("scene_idx_non_omitted >= 0").select("story_id", "scene_idx", "scene_idx_non_omitted", F.posexplode(blocks_of(F.col("lines"))).alias("block", "b"))
    spoken = is_dialogue(F.col("b"))
    texts = told.select(
        "story_id", "scene_idx", "scene_idx_non_omitted", "block", F.when(spoken, "dialogue").otherwise("action").alias("channel"),
        F.array_join(F.when(spoken, F.slice("b", 2, F.greatest(F.size("b") - 1, F.lit(0)))).otherwise(F.col("b")), " ").alias("text"),
    ).where("trim(text) <> ''")
    mentions = annotate.noun_chunks(texts if include_dialogue else texts.where("channel = 'action'"), chunk)
    mentions = checkpointed(mentions)
    rough = checkpointed(legacy.rough_gaps(mentions, min_gap, preselect))
    store = legacy.mention_store(mentions).select("story_id", "entity", "scene_idx", "channel", "contexts")
    ends = rough.select("story_id", "entity", F.posexplode(F.array("scene_a_idx_all", "scene_b_idx_all")).alias("side", "scene_idx"))
    some = F.slice("contexts", 1, F.when(F.col("channel") == "action", 3).otherwise(1))
    told_by = F.struct(F.when(F.col("channel") == "action", 0).otherwise(1).alias("c"), "side", some.alias("x"))
    contexts = ends.join(store, ["story_id", "entity", "scene_idx"]).groupBy("story_id", "entity").agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(told_by)), lambda s: s["x"])), 1, 8).alias("contexts"))
    requests = rough.join(contexts, ["story_id", "entity"], "left").select("story_id", "entity", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))
    wording = annotate.prompt(annotate.CURATION_PROMPT, entity=F.col("entity"), contexts=F.array_join("contexts", "\n"))
    answers, fresh = _written(*annotate.annotated(requests, cache, curate, ["entity", "contexts"], model=model, wording=wording))
    return legacy.event_rows(legacy.curate(rough, annotate.curations(answers), **rules), scenes, mentions), fresh


__all__ = [
    "align", "ask_channel", "build_scene_inventory", "candidate_segments", "candidates_from_files", "empty_cache", "mine_candidates", "mine_climax", "mine_legacy", "mine_reappearances", "mine_stage1", "parse_scenes",
    "read_subtitles", "review_plan", "sample_frames", "segments_from_subtitles", "told_channels",
]
