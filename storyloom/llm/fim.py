"""Fill-in-the-middle examples, cut at whole units of text, by joins of units and cuts.

A unit is a run of letters or any other single character. Matches are exploded with their ordinal, running sums of their lengths tell where each unit ends, and cuts
are joined to them by ordinal. That is done twice over: first for stretches of ``STRETCH`` units, of which there are few, then for the units of the stretches that
hold a cut. So a document of n units is n / ``STRETCH`` + 2 ``STRETCH`` narrow rows at most instead of n, and none is larger for a longer text. What the cuts' offsets add up to for a document meets
its text by one join, and substrings are taken there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle, and the pattern of a unit.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
STRETCH = 32


def _number(digits: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits."""
    return F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long")


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _rows(docs: DataFrame, seed: int, plain_from: int, spm_below: int) -> DataFrame:
    """``(key, stretches, n, form, cut_1, cut_2)``: what each text is cut into and where. Equal rows have equal keys."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (_number(digits, 2) % 100 >= plain_from)
    form = F.when(plain, "plain").when(_number(digits, 3) % 100 < spm_below, "spm").otherwise("psm")
    cut = docs.select(
        _key(docs).alias("key"), form.alias("form"), _number(digits, 0).alias("h1"), _number(digits, 1).alias("h2"),
        _matches(text, f"(?:[A-Za-z]++|[^A-Za-z]){{1,{STRETCH}}}+").alias("stretches"),
    )
    last = F.coalesce(F.size(_matches(F.try_element_at("stretches", F.lit(-1)), UNIT)), F.lit(0))
    counted = cut.withColumn("n", F.greatest(F.size("stretches") - 1, F.lit(0)).cast("long") * STRETCH + F.greatest(last, F.lit(0)))
    ends = counted.withColumn("a", F.col("h1") % (F.col("n") + 1)).withColumn("b", F.col("h2") % (F.col("n") + 1))
    return ends.select("key", "stretches", "n", "form", F.least("a", "b").alias("cut_1"), F.greatest("a", "b").alias("cut_2"))


def _key(docs: DataFrame) -> Column:
    """16 bytes of a digest of doc_id and text."""
    shown = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.coalesce(F.substring(F.unhex(F.sha2(shown, 256)), 1, 16), F.lit(b""))  # never null, which spares a filter


def _once(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each key, dealt out by key; rows that repeat are one before they are dealt."""
    return rows.groupBy("key").agg(F.first(F.struct(*columns)).alias("r")).select("key", "r.*")


def _offsets(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """``(key, end_1, end_2)``: the characters before the two cuts. Every step after the two that ``_once`` deals out keeps to the partitions by key."""
    asked = rows.where("form <> 'plain'").withColumn("lengths", F.transform(F.slice("stretches", F.lit(1), F.expr(f"cast(cut_2 div {STRETCH} as int) + 1")), lambda s: F.length(s)))
    lengths = _once(asked, "lengths").select(F.col("key").alias("k"), F.posexplode("lengths").alias("stretch", "chars"))
    before = F.coalesce(F.sum("chars").over(Window.partitionBy("k").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = lengths.select("k", "stretch", before.cast("long").alias("before"))
    # a cut is asked for by the ordinal of the last unit before it; a cut before the first unit is at 0
    cuts = requests.where("form <> 'plain'").select("key", F.explode(F.array(*(F.struct(F.lit(i).alias("cut"), (F.col(f"cut_{i}") - 1).alias("unit"), F.col(f"text_{i}").alias("text")) for i in (1, 2)))).alias("c"))
    cuts = cuts.select("key", "c.*").where("unit >= 0")
    # two inequalities, since an equality on the ordinal would be dealt out by
    first = F.col("stretch") * STRETCH
    met = cuts.join(stretches, (F.col("key") == F.col("k")) & (F.col("unit") >= first) & (F.col("unit") < first + STRETCH))
    units = met.select("key", "cut", "unit", "before", "stretch", F.posexplode(_matches(F.col("text"), UNIT)).alias("at", "match"))
    upto = F.sum(F.length("match")).over(Window.partitionBy("key", "cut").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    ends = units.select("key", "cut", "unit", (F.col("stretch") * STRETCH + F.col("at")).alias("ordinal"), (F.col("before") + upto).alias("end")).where("ordinal = unit")
    return ends.groupBy("key").agg(*(F.max(F.when(F.col("cut") == i, F.col("end"))).alias(f"end_{i}") for i in (1, 2)))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """``(doc_id, text, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs(doc_id, text, ...)``.

    n counts units. The numbers of the digest of ``seed:doc_id`` say where the two cuts are, and whether a text stays as it is (``plain``) or is written as
    prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``). An empty text and one that holds a mark stay plain, with null counts of characters.
    A null text counts as empty, a null doc_id as an empty one. Lengths are code points. Rows that repeat are cut alike and returned each; rows that share a doc_id only are
    cut each by its own text. An empty table gives an empty result; other columns are ignored.
    """
    rows = _rows(docs.select("doc_id", "text"), seed, plain_from, spm_below)
    held = {f"text_{i}": F.try_element_at("stretches", F.expr(f"cast(greatest(cut_{i} - 1, 0) div {STRETCH} + 1 as int)")) for i in (1, 2)}
    requests = _once(rows.withColumns(held), "n", "form", "cut_1", "cut_2", *held)
    ends = _offsets(rows, requests).withColumnRenamed("key", "of")
    known = requests.join(ends, F.col("key") == F.col("of"), "left").select(
        F.xxhash64("key").alias("of_hash"), F.col("key").alias("of_key"), "n", "form", *(F.when(F.col("form") != "plain", F.coalesce(f"end_{i}", F.lit(0))).cast("long").alias(f"end_{i}") for i in (1, 2))
    )
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _key(docs).alias("key"))
    # on a hash beside the key: both sides are dealt out anew, and AQE can split the texts of rows that repeat
    met = texts.join(known, (F.xxhash64("key") == F.col("of_hash")) & (F.col("key") == F.col("of_key")))
    part = lambda begin, end: F.substring(F.col("text"), begin + 1, end - begin)
    whole, first, second = F.length("text"), F.col("end_1").cast("int"), F.col("end_2").cast("int")
    prefix, middle, suffix = part(F.lit(0), first), part(first, second), part(second, whole)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col("text"))
    )
    return met.select("doc_id", "text", "n", "form", F.col("end_1").alias("prefix_chars"), (F.col("end_2") - F.col("end_1")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of; its parts hold no mark, so the marks part it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    order = lambda *at: F.concat(*(F.element_at(parts, i) for i in at))
    return F.when(form == "psm", order(2, 4, 3)).when(form == "spm", order(3, 4, 2)).otherwise(output)
