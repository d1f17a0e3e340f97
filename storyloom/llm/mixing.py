"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

The tree has a domain, a language and a source level. A node's weight counts against its siblings'.
A budget in tokens is handed down from the root: at each level it is divided by weight, no child
gets more than its capacity (its tokens times ``max_epochs``), and what a child can't use goes to its
siblings by weight. A node's capacity is the sum of its leaves', so a shortage reaches an ancestor only when all
siblings are full. Dividing with capacities has a closed form over the children in order of
capacity/weight (running sums), so each level is two window functions over the small table of nodes.

A leaf's budget buys whole epochs and the prefix of one more, in that epoch's seeded order. The prefix ends at a
place in the order that is found as in a dictionary: tokens are summed for 256 ranges of the order, then for 256 ranges of the
one in which the budget ends, and once more; of what is left, a leaf's 16-millionth part, places are summed one by one. Every
sum is pre-aggregated, no window holds more than 256 rows of a leaf, and rows meet their leaf's place in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.session import checkpointed
from storyloom.llm.columns import own, unused

LEVELS = ("domain", "lang", "source")
#: Characters of a place that name a range, and how often ranges are divided.
DIGITS, DIVISIONS = 2, 3
#: Parts in which a leaf's rows meet its budget, so that a hot leaf isn't one task.
SALTS = 64


def _weight(label: str, weights: dict[str, int] | None) -> Column:
    out = F.lit(1).cast("long")
    for name, w in (weights or {}).items():
        if int(w) != w or w < 1:
            raise ValueError(f"weights are whole numbers of 1 or more: {name}: {w}")
        out = F.when(F.col(label) == name, F.lit(int(w)).cast("long")).otherwise(out)
    return out


def _divide(nodes: DataFrame, parent: list[str], label: str) -> DataFrame:
    """Adds ``budget``: the share of ``parent_budget`` of each child; needs ``cap`` and ``weight``."""
    by = Window.partitionBy(*(parent or [F.lit(0)]))
    order = by.orderBy(F.col("cap") / F.col("weight"), label)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the weight from here on, as the whole less what is before: Spark sums a frame that ends at the partition's end anew for each row
    rest = F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = nodes.withColumn("before", before).withColumn("rest", rest)
    wide = lambda c: f"cast({c} as decimal(19,0))"  # noqa: E731  products of tokens and weights can exceed a long
    full = full.withColumn("full", F.expr(f"{wide('cap')} * {wide('rest')} <= {wide('weight')} * {wide('parent_budget - before')}"))
    used = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by)
    left = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(by)
    shared = full.withColumn("used", used).withColumn("left", left)
    return shared.withColumn("budget", F.expr(f"if(full, cap, ({wide('weight')} * {wide('parent_budget - used')}) div left)")).drop("before", "rest", "full", "used", "left")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], permille: int, max_epochs: int) -> DataFrame:
    """``(domain, lang, source, tokens, budget)`` from ``leaves(domain, lang, source, tokens)``."""
    nodes = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    got: DataFrame | None = None
    above: list[str] = []
    for label in LEVELS:
        path = [*above, label]
        level = nodes.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(label, weights.get(label)))
        level = level.withColumn("parent_budget", F.lit(total * permille // 1000).cast("long")) if got is None else level.join(got, above)
        got = _divide(level, above, label).select(*path, F.col("budget").alias("parent_budget"))
        above = path
    return leaves.join(got.withColumnRenamed("parent_budget", "budget"), list(LEVELS))


def mix(
    docs: DataFrame,
    weights: dict[str, dict[str, int]],
    permille: int,
    max_epochs: int = 2,
    seed: int = 42,
    domain: Column | None = None,
) -> DataFrame:
    """``(doc_id, domain, lang, source, n_tokens, leaf_budget, copies)`` for every row of ``docs(doc_id, text, lang, source, ...)``.

    ``weights`` has whole weights by label for each level, 1 where a label is missing; the budget is
    ``permille`` thousandths of all tokens; ``copies`` counts the epochs in which the row is selected. Tokens are
    runs of characters other than ASCII white space; a null text has none. A null domain, language or
    source is a label of its own, ``(none)``. Rows that repeat a doc_id in a leaf stand together in the order and are
    selected together. A null doc_id stands under the name ``(none)``. An empty table gives an empty
    result. Rows without tokens cost nothing and are selected where they stand within the prefix, never from a leaf whose budget is 0.
    """
    none = F.lit("(none)")
    rows = checkpointed(
        docs.select(
            "doc_id",
            F.coalesce((domain if domain is not None else F.lit("all")).cast("string"), none).alias("domain"),
            F.coalesce(F.col("lang").cast("string"), none).alias("lang"),
            F.coalesce(F.col("source").cast("string"), none).alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
        )
    )
    leaves = checkpointed(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    plan = checkpointed(
        leaf_budgets(leaves, weights, permille, max_epochs)
        .withColumn("epochs", F.expr("if(tokens = 0, 0, budget div tokens)"))
        .withColumn("rest", F.expr("budget - epochs * tokens"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), none)))
    met = checkpointed(
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)).cast("int"))
        .join(plan, [*LEVELS, "salt"])
        .select("doc_id", *LEVELS, "n_tokens", "budget", "epochs", "rest", "salt", order.alias("place"))
    )
    ends = checkpointed(_ends(met.where("rest > 0")))
    parts = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    taken = F.coalesce(F.col("place") <= F.col("end"), F.lit(False))
    return met.join(parts, [*LEVELS, "salt"], "left").select(
        "doc_id", *LEVELS, "n_tokens", F.col("budget").cast("long").alias("leaf_budget"), (F.col("epochs") + F.when(taken, 1).otherwise(0)).cast("long").alias("copies")
    )


def _ends(met: DataFrame) -> DataFrame:
    """``(domain, lang, source, end)``: the last place of each leaf's prefix that holds no more than ``rest`` tokens."""
    left, within = met.select(*LEVELS, "n_tokens", "rest", "place"), None
    by = Window.partitionBy(*LEVELS)
    for k in range(1, DIVISIONS + 1):
        sums = left.withColumn("range", F.substring("place", 1, DIGITS * k)).groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("held"), F.max("rest").alias("rest"))
        if within is not None:  # what is taken before this range
            sums = sums.join(within.select(*LEVELS, "taken"), [*LEVELS])
        upto = F.sum("held").over(by.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) + (F.col("taken") if within is not None else F.lit(0))
        found = sums.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("held") <= F.col("rest")))
        within = checkpointed(found.select(*LEVELS, "range", (F.col("upto") - F.col("held")).alias("taken")))
        same = within.select(*(F.col(c).alias(f"in_{c}") for c in LEVELS), F.col("range").alias("in_range"))
        # on a hash of the leaf, so that a leaf of which many rows are left can be split
        here = F.xxhash64(*LEVELS) == F.xxhash64(*(f"in_{c}" for c in LEVELS))
        for c in LEVELS:
            here = here & (F.col(c) == F.col(f"in_{c}"))
        left = left.join(same, here & (F.substring("place", 1, DIGITS * k) == F.col("in_range"))).select(*LEVELS, "n_tokens", "rest", "place")
    places = left.groupBy(*LEVELS, "place").agg(F.sum("n_tokens").alias("held"), F.max("rest").alias("rest")).join(within, [*LEVELS])
    upto = F.sum("held").over(by.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) + F.col("taken")
    last = places.withColumn("upto", upto).groupBy(*LEVELS).agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("place"))).alias("place"))
    # where no place of the last range is taken, all before the range are
    return within.join(last, [*LEVELS], "left").select(*LEVELS, F.coalesce("place", "range").alias("end"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` selects them, with all their own columns, whatever their names."""
    none = F.lit("(none)")
    of_id, of_lang, of_source, copies, copy = unused(docs, "of_id", "of_lang", "of_source", "copies", "copy")
    chosen = mix(docs, **how).where("copies > 0").groupBy(F.col("doc_id").alias(of_id), F.col("lang").alias(of_lang), F.col("source").alias(of_source)).agg(F.max("copies").alias(copies))
    same = (
        F.col("doc_id").eqNullSafe(F.col(of_id))
        & (F.coalesce(F.col("lang").cast("string"), none) == F.col(of_lang))
        & (F.coalesce(F.col("source").cast("string"), none) == F.col(of_source))
    )
    return docs.join(chosen, same).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*own(docs))
