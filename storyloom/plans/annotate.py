"""Annotation by a model behind a cache table.

A request is a row; its key is a hash of its content and of the model's name, so an unchanged request is never made twice of one model. Misses are found
by an anti-join, asked once for each key in batches on the executors, and appended to the cache. The model is a plain
function on a list of requests, passed in; nothing here reaches a network.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.session import checkpointed

MENTION_JSON = (
    "entities array<struct<canonical_name:string,surface_forms:array<string>,category:string,physical_visualizable:boolean,narrative_action_centrality:double,state_change_potential:double,"
    "visual_grounded_score:double,confidence:double,keep:boolean,evidence:array<string>>>"
)
SPOKEN_JSON = (
    "entities array<struct<canonical_name:string,surface_forms:array<string>,category:string,physical_visualizable:boolean,direct_visual_evidence:boolean,mention_strength:double,confidence:double,evidence:array<string>>>"
)
CURATION_JSON = (
    "canonical_name string, keep boolean, physical_visualizable boolean, category string, state_change_potential double, narrative_action_centrality double, visual_grounded_score double, confidence double,"
    " short_rationale string"
)


#: Requests that fail one after another in a batch before the rest of it isn't asked any more.
DOWN_AFTER = 5


def request_key(*parts: Column) -> Column:
    """SHA-1 of the parts as a JSON object; nulls are kept, so different requests have different keys."""
    return F.sha1(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def annotated(
    requests: DataFrame, cache: DataFrame, ask: Callable[[list[dict]], list[str]], parts: list[str], batch: int = 64, model: str = "", wording: Column | None = None, tolerant: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``requests`` with ``response``, and the rows to append to ``cache(key, response)``.

    ``parts`` are the columns that make a request; equal requests are asked once. ``model`` names who answers: another name has other keys. ``wording`` is
    given to the model as ``prompt``. Where ``tolerant``, a batch that the model fails on is asked again one by one until ``DOWN_AFTER`` of them fail one after another; a request that fails
    alone, or isn't asked any more, has a null response that no cache takes. Else the failure ends the job.
    """
    keyed = requests.withColumn("key", request_key(*([F.lit(model).alias("model")] if model else []), *(F.col(p) for p in parts)))
    missing = keyed.select("key", *parts).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    fields = list(parts)
    if wording is not None:
        missing, fields = missing.withColumn("prompt", wording), [*parts, "prompt"]

    def alone(request: dict) -> str | None:
        try:
            return ask([request])[0]
        except Exception:  # whatever the model raises; a lost worker or an error of Spark doesn't come this way
            return None

    def answers(asked: list[dict]) -> list[str | None]:
        if not tolerant:
            return ask(asked)
        try:
            return ask(asked)
        except Exception:
            told: list[str | None] = []
            for r in asked:  # a model that fails this often one after another is down, and isn't asked again
                told.append(None if told[-DOWN_AFTER:] == [None] * DOWN_AFTER else alone(r))
            return told

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "response": answers(part[fields].to_dict("records"))})

    fresh = checkpointed(missing.mapInPandas(run, "key string, response string").where("response is not null"))  # written, so that a model is asked once
    known = cache.select("key", "response").unionByName(fresh)
    return keyed.join(known, "key", "left").drop("key"), fresh


CACHE = "key string, response string"


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """``(key, response)`` of all answers that runs with this folder have kept; of a key that two runs asked at once the least answer."""
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(f"{folder}/answers/run=none")
    return spark.read.schema(f"{CACHE}, run string").option("basePath", f"{folder}/answers").parquet(f"{folder}/answers").groupBy("key").agg(F.min("response").alias("response"))


def annotated_by_steps(
    requests: DataFrame, folder: str, ask: Callable[[list[dict]], list[str]], parts: list[str], batch: int = 64, model: str = "", wording: Column | None = None, per_task: int = 256, width: int = 32
) -> DataFrame:
    """``requests`` with ``response``, as ``annotated`` gives them, answers kept in ``folder`` step by step.

    What ``folder`` has no answer for is written there as a table of ``per_task`` requests a file, and a stream over it asks for ``width`` files at a time; a step's answers are kept before the next one begins.
    A run that ends by a failure has lost its last step: the next one with the same folder asks for what has no answer yet. A step that Spark repeats replaces its own answers. The
    folder is one that executors share and outlives the session; what was asked for is left in it, too.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("key", request_key(*([F.lit(model).alias("model")] if model else []), *(F.col(p) for p in parts)))
    missing = keyed.select("key", *parts).dropDuplicates(["key"]).join(cached(spark, folder).select("key"), "key", "left_anti")
    fields = list(parts)
    if wording is not None:
        missing, fields = missing.withColumn("prompt", wording), [*parts, "prompt"]
    run_id = uuid.uuid4().hex
    missing = checkpointed(missing)
    files = max(1, -(-missing.count() // per_task))
    missing.repartition(files, "key").write.parquet(f"{folder}/asked/{run_id}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "response": ask(part[fields].to_dict("records"))})

    def step(asked: DataFrame, number: int) -> None:
        asked.mapInPandas(run, CACHE).where("response is not null").write.mode("overwrite").parquet(f"{folder}/answers/run={run_id}-{number}")

    stream = spark.readStream.schema(missing.schema).option("maxFilesPerTrigger", width).parquet(f"{folder}/asked/{run_id}")
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress/{run_id}").trigger(availableNow=True).start()
    query.awaitTermination()
    return keyed.join(cached(spark, folder), "key", "left").drop("key")


def scene_mentions(answers: DataFrame) -> DataFrame:
    """``answers(story_id, scene_idx, response)`` as rows of ``schemas.ENTITY_MENTIONS``."""
    rows = answers.select("story_id", "scene_idx", F.posexplode(F.from_json("response", MENTION_JSON)["entities"]).alias("pos", "e"))
    return rows.select(
        "story_id", "scene_idx", "pos", "e.canonical_name", "e.surface_forms", "e.category", "e.physical_visualizable", "e.keep", F.col("e.narrative_action_centrality").alias("action"), F.col("e.visual_grounded_score").alias("visual"),
        F.col("e.state_change_potential").alias("state"), "e.confidence", "e.evidence",
    )


def spoken_mentions(answers: DataFrame) -> DataFrame:
    """``answers(story_id, scene_idx, response)`` of the dialogue channel as rows of ``schemas.SPOKEN_MENTIONS``."""
    rows = answers.select("story_id", "scene_idx", F.posexplode(F.from_json("response", SPOKEN_JSON)["entities"]).alias("pos", "e"))
    return rows.select("story_id", "scene_idx", "pos", "e.*")


def unanswered(answers: DataFrame) -> DataFrame:
    """``(story_id, scene_idx)`` of the dialogue channel's answers that are missing or can't be read."""
    return answers.where(F.from_json("response", SPOKEN_JSON)["entities"].isNull()).select("story_id", "scene_idx").distinct()


def curations(answers: DataFrame) -> DataFrame:
    """``answers(story_id, entity, response)`` as what ``legacy.curate`` reads."""
    c = answers.select("story_id", "entity", F.from_json("response", CURATION_JSON).alias("c"))
    return c.select(
        "story_id", "entity", "c.canonical_name", "c.keep", "c.physical_visualizable", "c.category", F.col("c.state_change_potential").alias("state"), F.col("c.narrative_action_centrality").alias("action"),
        F.col("c.visual_grounded_score").alias("visual"), "c.confidence", "c.short_rationale",
    )


def json_part(text: Column) -> Column:
    """From the first ``{`` to the last ``}`` of a model's free answer; null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


SCENE_PROMPT = f"List the physical objects that the action of this scene shows, as one JSON object of these fields: {MENTION_JSON}\nScene {{scene_idx}}: {{heading}}\n{{text}}"
CHANNEL_PROMPT = f"List every physical object that the {{channel}} of this scene mentions, as one JSON object of these fields: {SPOKEN_JSON}\nScene {{scene_idx}}: {{heading}}\n{{text}}"
CLIMAX_PROMPT = "Story: {story}\nRate from 0 to 100 how much this scene is a climax, as JSON with climax_score.\nScene {scene_idx}: {heading}\n{text}"
CURATION_PROMPT = f"Is '{{entity}}' a physical object that matters to the story? Answer as one JSON object of these fields: {CURATION_JSON}\n{{contexts}}"
SCENE_SUMMARY_PROMPT = "Sum this scene up in two sentences, as JSON.\nScene {scene_idx}: {heading}\n{text}"
STORY_SUMMARY_PROMPT = "Sum the story up from its scenes, as JSON.\n{scenes}"


def prompt(template: str, **parts: Column) -> Column:
    """A template filled in with columns."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def noun_chunks(texts: DataFrame, chunk: Callable[[str], list[dict]]) -> DataFrame:
    """Mentions for ``legacy`` from ``texts(story_id, scene_idx, scene_idx_non_omitted, channel, block, text)``.

    ``chunk`` gives for a text its noun chunks as ``{surface, sentence, verbs, persons}``; a language library does that, and is passed in.
    """
    from storyloom.functions.text import chunk_key

    schema = "story_id string, scene_idx int, scene_idx_non_omitted int, channel string, block int, body string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = rows.drop(columns=["text"]).copy()
            out["body"] = [json.dumps(chunk(t or "")) for t in rows["text"]]
            yield out

    found = texts.select("story_id", "scene_idx", "scene_idx_non_omitted", "channel", "block", "text").mapInPandas(run, schema)
    rows = found.select("story_id", "scene_idx", "scene_idx_non_omitted", "channel", "block", F.posexplode(F.from_json("body", "array<struct<surface:string,sentence:string,verbs:array<string>,persons:array<string>>>")).alias("n", "c"))
    return rows.select(
        "story_id", "scene_idx", "scene_idx_non_omitted", "channel", (F.col("block") * 10000 + F.col("n")).alias("pos"), chunk_key(F.col("c.surface")).alias("entity"), F.trim("c.surface").alias("surface"), "c.sentence", "c.verbs", "c.persons"
    ).where("entity <> ''")
