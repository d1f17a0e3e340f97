"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.session import read_table
from storyloom.llm import oracles
from storyloom.llm.bpe import coding_digests
from storyloom.llm.chat_tools import linked_calls
from storyloom.llm.exact_dedup import exact_duplicates
from storyloom.llm.fim import fill_in_middle, restored
from storyloom.llm.html_text import main_text
from storyloom.llm.language_id import held_out as language_held_out
from storyloom.llm.language_id import identified, learned
from storyloom.llm.media import text_media
from storyloom.llm.merkle import merkle_manifest, without_line_ends
from storyloom.llm.mixing import mix
from storyloom.llm.packing import packed
from storyloom.llm.quality import held_out, scored, trained
from storyloom.llm.simhash import simhash_components
from storyloom.llm.url_rules import judged, mined_rules, url_parts

#: Target weights of the mixing query, and the domain of a source: its number modulo 3.
MIX_WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 6, "de": 2, "fr": 1, "es": 1}, "source": {"src0": 2}}
MIX_PERMILLE, MIX_EPOCHS, MIX_SEED = 900, 2, 42


def source_domain():
    return F.concat(F.lit("d"), F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 3").cast("string"))


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identified(docs, learned(docs))
    return found.select("doc_id", language_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


#: A document is of quality if its probability is this or more.
QUALITY_LINE = 0.3


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rated = scored(docs.select("doc_id", "text"), trained(docs, read_table(spark, sf_dir, "labels")))
    score = F.col("quality_score")
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= QUALITY_LINE).cast("int").alias("predicted"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding_digests(read_table(spark, sf_dir, "documents"), vocabulary())


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_PERMILLE, MIX_EPOCHS, MIX_SEED, source_domain())


#: The one tool of the chat query: a turn that asks, answered by the next turn.
ANSWER = {
    "type": "object", "required": ["question", "turn"], "additionalProperties": False,
    "properties": {"question": {"type": "string", "minLength": 1, "maxLength": 300}, "turn": {"type": "integer", "minimum": 0}},
}


#: What a call needs, as distances in turns, by its conversation's number modulo 5 and half its turn modulo 4: one call before it with identifiers
#: that repeat (0), chains of later calls (1), two later calls or one before (2), circles of two (3), and calls before with some that aren't there (4).
NEEDS = {0: [[-4]] * 4, 1: [[2], [2], [2], []], 2: [[2, 4], [-2], [-2], [-2]], 3: [[2], [-2], [-2], []], 4: [[-2]] * 4}


def op9_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn that isn't the assistant's is a call of ``answer`` (of a tool that nobody knows where the turn ends in 8); every
    assistant's turn is the result of the turn before it. What calls need is in ``NEEDS``."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").withColumn("kind", F.pmod("conv_id", F.lit(5)))
    named = lambda turn: F.concat(F.lit("t"), F.when(F.col("kind") == 0, turn - F.pmod(turn, F.lit(4))).otherwise(turn).cast("string"))
    asks = turns.where("role <> 'assistant'").withColumn("call_id", named(F.col("turn")))
    of_kind = F.array(*(F.array(*(F.array(*(F.lit(d) for d in away)).cast("array<int>") for away in by_half)) for _, by_half in sorted(NEEDS.items())))
    away = F.element_at(F.element_at(of_kind, (F.col("kind") + 1).cast("int")), F.expr("cast(pmod(turn div 2, 4) + 1 as int)"))
    wants = asks.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.explode(away).alias("d"))
    there = wants.join(asks, (F.col("c") == F.col("conv_id")) & (F.col("t") + F.col("d") == F.col("turn"))).groupBy("c", "t").agg(F.array_sort(F.collect_set("call_id")).alias("there"))
    arguments = F.to_json(F.struct("turn", F.col("text").alias("question")))
    lost = F.when((F.col("kind") == 4) & (F.pmod("turn", F.lit(6)) == 0), F.array(F.lit("x9"))).otherwise(F.array().cast("array<string>"))
    calls = asks.join(there, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left").select(
        "conv_id", "call_id", "turn", F.when(F.pmod("turn", F.lit(10)) == 8, "lookup").otherwise("answer").alias("name"), arguments.alias("arguments"),
        F.concat(F.coalesce("there", F.array().cast("array<string>")), lost).alias("needs"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", named(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    found = linked_calls(calls, results, {"answer": ANSWER})
    return found.select(
        "conv_id", "call_id", "turn", F.col("key").alias("order_key"), F.col("level").cast("int").alias("order_level"), "status",
        F.size("errors").cast("int").alias("n_errors"), F.sha2("message", 256).alias("message_sha256"),
    )


#: Rules that come before any mined one: verdict, host, start of the path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules are mined from pages whose document, named by the path's number, is labelled: block where its quality is 0."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    labels = read_table(spark, sf_dir, "labels")
    number = F.regexp_extract(url_parts(F.col("url"))[1], "([0-9]{1,18})(?:[.][a-z]+)?/?$", 1).try_cast("long")
    labelled = pages.withColumn("of", number).join(labels.where("quality is not null"), F.col("of") == F.col("doc_id")).select(
        "url", F.when(F.col("quality") == 0, "block").otherwise("allow").alias("verdict")
    )
    return judged(pages, URL_RULES, mined_rules(labelled))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle_manifest(read_table(spark, sf_dir, "documents"), without_line_ends())
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_html_text": op2_html_text,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_quality": op4_quality,
        "op5_media_columns": op5_media_columns,
        "op6_bpe": op6_bpe,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_mixing": op8_mixing,
        "op9_chat_tools": op9_chat_tools,
        "op10_url_filter": op10_url_filter,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_best_fit_packing": op12_best_fit_packing,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": oracles.EXACT_DEDUP,
        "op11_fill_in_middle": oracles.FILL_IN_MIDDLE,
        "op13_merkle_manifest": oracles.merkle(),
        "op9_chat_tools": oracles.chat_tools(NEEDS),
        "op8_mixing": oracles.mixing(MIX_WEIGHTS, MIX_PERMILLE, MIX_EPOCHS, MIX_SEED),
    }
