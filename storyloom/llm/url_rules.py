"""URL filtering by host and path rules, and by association rules mined with Spark's FP-growth.

Everything is a DataFrame function, or FP-growth as Spark has it. Labelled urls become sets of tokens with
their label as one more; FP-growth mines the sets that occur together, rules from tokens to a label are
kept if their support and confidence suffice, if they say more than the label's base rate does, on the urls that they are mined from and on others held out, and if no shorter rule says as much. A url is
matched by an inverted index: each rule stands under its rarest token, a url looks its own tokens up, and the rules found are verified
against all its tokens. Of the rules of both labels that fit, the surest decides: a rule's certainty is the share of the way from
its label's base rate to 1 that its confidence has gone, taken at the lower end of the confidence's interval, so that a
label that is rare everywhere can win, and a rule seen a few times counts for less.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.session import checkpointed
from storyloom.llm.exact_dedup import ascii_lower

BLOCK, ALLOW = "block", "allow"
LABEL = "label="
#: A rule's tokens and label occur together in this share of the labelled urls, and in so many, at least.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.002, 10, 0.2
#: A rule's confidence is so many times its label's base rate at least, and the interval below it that still exceeds the rate is so many standard errors wide.
MIN_LIFT, ERRORS = 1.02, 1.0
#: One labelled url of so many, by its hash, is held out from mining, and there a rule's confidence, so many standard errors lower, must exceed the label's rate as well.
HELD_EVERY, HELD_ERRORS = 3, 1.64
#: Up to so many rules are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 50_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null and where there is no ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Of ``rules`` (verdict, host, path) that fit, the longest, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a url: scheme, site (the host's last two names), other names of the host, words of the path, names of parameters, fragment.

    No token implies another, so that FP-growth's sets don't multiply.
    """
    host, path = url_parts(url)
    none = F.array().cast("array<string>")
    marked = lambda mark, words: F.transform(words, lambda w: F.concat(F.lit(mark), w))
    lettered = lambda words: F.filter(words, lambda w: w.rlike(r"\p{L}"))
    scheme = ascii_lower(F.substring_index(url, "://", 1))
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    return F.array_distinct(
        F.concat(
            F.when(F.length(host) > 0, F.array(F.concat(F.lit("site="), F.regexp_extract(host, r"[^.]*(?:\.[^.]*)?$", 0)))).otherwise(none),
            marked("name=", lettered(F.split(F.regexp_replace(host, r"(?:^|\.)[^.]*(?:\.[^.]*)?$", ""), r"[.\-]"))),
            marked("path=", lettered(F.split(ascii_lower(path), r"[^\p{L}\p{N}_]+"))),
            marked("query=", F.filter(F.transform(query, lambda p: F.regexp_extract(p, r"^[^=]*", 0)), lambda w: F.length(w) > 0)),
            F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(none),
            F.when(F.instr(url, "://") > 1, F.array(F.concat(F.lit("scheme="), scheme))).otherwise(none),
        )
    )


def _low(share: Column, n: Column, errors: float) -> Column:
    """The lower end of Wilson's interval."""
    z = errors * errors
    return (share + z / (n * 2) - errors * F.sqrt((share * (1 - share) + z / (n * 4)) / n)) / (1 + z / n)


def certainty(confidence: Column, lift: Column, support: Column, rows: int, errors: float) -> Column:
    """From 0 (no more than the base rate) to 1, at the lower end of Wilson's interval; negative below the rate."""
    rate = confidence / lift
    return (_low(confidence, support * rows / confidence, errors) - rate) / F.greatest(1 - rate, F.lit(1e-12))


def mined_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, errors: float = ERRORS,
    held_every: int = HELD_EVERY, held_errors: float = HELD_ERRORS,
) -> DataFrame:
    """``(tokens, verdict, confidence, support, lift, certainty, under, held_n, held_confidence, held_rate)`` from ``labelled(url, verdict)``.

    ``under`` is the rule's rarest token. Rules are mined from the urls that aren't held out, and must hold on those that are; equal urls are on one side. Rows with a null url or verdict teach nothing; where
    fewer than ``min_count`` rows are left, only what all of them share can be a rule; where all have one verdict, no rule says more than that. A rule is dropped if a rule from part of its tokens
    to the same verdict is at least as certain. Other columns are ignored.
    """
    known = labelled.where("url is not null and verdict is not null")
    sets = checkpointed(known.select(url_tokens(F.col("url")).alias("tokens"), "verdict", (F.pmod(F.xxhash64("url"), F.lit(held_every)) == 0).alias("held")))
    mine = sets.where("not held").select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    rows = mine.count()
    model = FPGrowth(itemsCol="items", minSupport=min(max(min_support, min_count / max(rows, 1)), 1.0), minConfidence=min_confidence).fit(mine)
    sure = certainty(F.col("confidence"), F.col("lift"), F.col("support"), rows, errors)
    found = (
        model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL) & ~F.exists("antecedent", lambda t: t.startswith(LABEL)) & (F.col("lift") >= min_lift))
        .select(F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), len(LABEL) + 1, 99).alias("verdict"), "confidence", "support", "lift", sure.alias("certainty"))
        .where("certainty > 0")
    )
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), F.col("freq"))
    figures = ["confidence", "support", "lift", "certainty"]
    rarest = (
        found.withColumn("token", F.explode("tokens")).join(single, "token")
        .groupBy("tokens", "verdict").agg(*(F.max(c).alias(c) for c in figures), F.min_by("token", F.struct("freq", "token")).alias("under"))
    )
    found = checkpointed(_confirmed(checkpointed(rarest), sets.where("held"), held_errors))
    # shorter rules are found under each token of a longer one, and must be part of it
    part = found.select(F.explode("tokens").alias("token"), F.col("tokens").alias("short"), F.col("verdict").alias("v"), F.col("certainty").alias("c"))
    longer = found.where(F.size("tokens") > 1).withColumn("token", F.explode("tokens"))
    covered = (
        longer.join(part, "token")
        .where((F.col("verdict") == F.col("v")) & (F.size("short") < F.size("tokens")) & (F.col("c") >= F.col("certainty")) & (F.size(F.array_except("short", "tokens")) == 0))
        .select("tokens", "verdict").distinct()
    )
    return checkpointed(found.join(covered, ["tokens", "verdict"], "left_anti"))


def _confirmed(rules: DataFrame, held: DataFrame, errors: float) -> DataFrame:
    """The rules whose confidence on the held-out rows, ``errors`` standard errors lower, exceeds the rate of their label there."""
    index = rules.select("under", F.col("tokens").alias("wanted"), F.col("verdict").alias("wants"))
    few = index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = held.withColumn("token", F.explode("tokens")).join(F.broadcast(index) if few else index, F.col("token") == F.col("under")).where(F.size(F.array_except("wanted", "tokens")) == 0)
    seen = met.groupBy("wanted", "wants").agg(F.count("*").alias("held_n"), F.avg((F.col("verdict") == F.col("wants")).cast("double")).alias("held_confidence"))
    rates = held.groupBy(F.col("verdict").alias("of")).agg(F.count("*").alias("n"))
    rates = rates.select("of", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("held_rate"))  # a row for each label
    out = rules.join(seen, (F.col("tokens") == F.col("wanted")) & (F.col("verdict") == F.col("wants"))).join(F.broadcast(rates), F.col("verdict") == F.col("of"))
    return out.where(_low(F.col("held_confidence"), F.col("held_n"), errors) > F.col("held_rate")).drop("wanted", "wants", "of")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, mined)`` of the surest rule that fits each different url, as a struct of verdict, tokens, confidence, support, lift and certainty; urls
    that no rule fits are left out. Of equally sure ones the rule of higher confidence, higher support and more tokens, then ``allow``, then the last tokens in order."""
    figures = ["confidence", "support", "lift", "certainty"]
    index = rules.select("under", F.col("tokens").alias("wanted"), F.col("verdict").alias("mined"), *figures)
    few = index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    looked = urls.where("url is not null").select("url").distinct().withColumn("tokens", url_tokens(F.col("url"))).withColumn("token", F.explode("tokens"))
    met = looked.join(F.broadcast(index) if few else index, F.col("token") == F.col("under")).where(F.size(F.array_except("wanted", "tokens")) == 0)
    order = F.struct("certainty", "confidence", "support", F.size("wanted"), F.col("mined") == ALLOW, F.col("wanted"))
    rule = F.struct(F.col("mined").alias("verdict"), F.col("wanted").alias("tokens"), *figures)
    return met.groupBy("url").agg(F.max_by(rule, order).alias("mined"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], mined: DataFrame, otherwise: str = ALLOW) -> DataFrame:
    """``(page_id, host, path, rule, verdict, mined_rule, confidence, support, lift)`` for every row of ``pages(page_id, url, ...)``.

    The longest of ``rules`` that fits decides; where none does, the surest mined rule, whose tokens are in ``mined_rule``, and ``otherwise`` where there
    is none. A null url has no host, path or token. Repeated rows are judged each, other columns are ignored, an empty
    table gives an empty result.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = url_parts(F.col("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    open_ = rows.where("fits is null and url is not null")
    # the join's key differs from the grouping's, so AQE can split a hot url
    found = matched(open_, mined).select(F.xxhash64("url").alias("_key"), F.col("url").alias("_url"), "mined")
    met = open_.join(found, (F.xxhash64("url") == F.col("_key")) & (open_["url"] == F.col("_url")), "left").select("page_id", "host", "path", "fits", "mined")
    rest = rows.where("fits is not null or url is null").select("page_id", "host", "path", "fits", F.lit(None).cast(found.schema["mined"].dataType).alias("mined"))
    return met.union(rest).select(
        "page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", "mined.verdict", F.lit(otherwise)).alias("verdict"),
        F.array_join("mined.tokens", " ").alias("mined_rule"), "mined.confidence", "mined.support", "mined.lift",
    )
