"""Exact duplicates by recipes of content-defined chunks, in DataFrame functions only.

A text is cut where its own content says so: at the first line or sentence end after ``least``
characters, at ``most`` characters otherwise. Equal texts are cut alike, wherever they stand. A recipe
is the ordered list of a text's chunk identifiers, and texts are compared by recipe, so that a
text's characters travel once, as chunks that are merged before the shuffle where they repeat.

Identifiers are SHA-256 digests, and they are verified: chunks are grouped by their characters, and
the digests that two different chunks share are found. Where there are any, those chunks get their
rank among the chunks of that digest as part of the identifier, by a join on the characters themselves.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.session import checkpointed


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else.

    ``lower`` does the same, and faster, for a text that is all ASCII: one of as many bytes as characters. No table of letters is asked, as those of ``lower``, of
    regular expressions and of their later versions differ.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def chunks_of(text: Column, least: int, most: int) -> Column:
    """The text's chunks in order; joined, they are the text. An empty text has none."""
    cut = rf"(?s).{{{least - 1},{most - 1}}}?[.\n]|.{{1,{most}}}"
    return F.when(F.length(text) < least, F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))).otherwise(
        F.regexp_extract_all(text, F.lit(cut), F.lit(0))
    )


def _digest(chunk: Column, bits: int) -> Column:
    """``bits`` under 256 keep a few characters of the digest only, to have collisions in tests."""
    return F.sha2(chunk, 256) if bits == 256 else F.substring(F.sha2(chunk, 256), 1, bits // 4)


def exact_duplicates(docs: DataFrame, least: int = 2048, most: int = 16384, digest_bits: int = 256) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs(doc_id, text, ...)``.

    Texts are equal if identical after lower-casing A-Z; null counts as empty, and empty texts equal
    each other. Of a group the row with the largest doc_id stays. Rows that repeat a doc_id are
    counted each, and every one that has the largest doc_id of its group is kept; a null doc_id is kept only if its group has no other. An empty
    table gives an empty result; other columns are ignored.
    """
    norm = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    texts = docs.select(F.col("doc_id"), norm.alias("text"))
    cut = texts.select("doc_id", "text", chunks_of(F.col("text"), least, most).alias("chunks"))
    recipes = checkpointed(
        cut.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform("chunks", lambda c: F.unhex(_digest(c, digest_bits))).alias("recipe"))
    )
    chunk = F.explode("chunks").alias("chunk")
    known = cut.select(chunk).groupBy("chunk").agg(F.lit(1).alias("one"))
    shared = checkpointed(
        known.select(F.unhex(_digest(F.col("chunk"), digest_bits)).alias("id")).groupBy("id").count().where("count > 1").select("id")
    )
    if not shared.isEmpty():
        recipes = _ranked(cut, known, shared, recipes, digest_bits)
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    # the join key differs from the grouping key, so both sides are dealt out anew and AQE can split a hot group
    groups = groups.select(F.xxhash64("recipe").alias("h"), F.col("recipe").alias("of"), "keep_id", "group_size")
    return (
        recipes.withColumn("key", F.xxhash64("recipe"))
        .join(groups, (F.col("key") == F.col("h")) & (F.col("recipe") == F.col("of")), "left")
        .select(
            "doc_id",
            F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("h").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            "text_sha256",
        )
    )


def _ranked(cut: DataFrame, known: DataFrame, shared: DataFrame, recipes: DataFrame, digest_bits: int) -> DataFrame:
    """Recipes in which an identifier that several chunks share is followed by the chunk's rank among them."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("chunk"))
    names = (
        known.select("chunk", F.unhex(_digest(F.col("chunk"), digest_bits)).alias("id"))
        .join(shared, "id", "left_semi").select(F.col("chunk").alias("same"), rank.alias("rank"))
    )
    exact = (
        cut.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode_outer("chunks").alias("pos", "chunk"))
        .join(names, F.col("chunk") == F.col("same"), "left")
        .withColumn("id", F.concat(F.unhex(_digest(F.col("chunk"), digest_bits)), F.coalesce(F.col("rank").cast("string"), F.lit("")).cast("binary")))
    )
    lists = exact.groupBy(F.col("doc_id").alias("d"), F.col("text_sha256").alias("t")).agg(F.array_sort(F.collect_set(F.struct("pos", "id"))).alias("l"))
    ranked = recipes.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_sha256") == F.col("t")))
    return checkpointed(ranked.select("doc_id", "text_sha256", F.col("l.id").alias("recipe")))
