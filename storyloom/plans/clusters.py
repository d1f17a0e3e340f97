"""Candidates taken for one: a fold in order, found as a fixed point.

Candidates come in order. Each joins the first cluster that has its object_id or a specific alias in common, and changes by that what the cluster is called and which aliases it goes by: its id, its name's
key and those of the events behind it. So who joins whom depends on everything before, and clusters never meet later. But once it is assumed who is where, what every cluster goes by between
any two of its candidates is a matter of running maxima over the cluster, and with it each candidate's decision is a join on keys with an interval of time. Assumption and decision are repeated until they agree.
The first decision holds after the first round, and every round settles at least the next one, so that an agreement is the fold's own result; most candidates settle at once, as a cluster
keeps to its name. Rounds take as many as decisions hang on each other, not as many as there are candidates, and a cluster of any size is sorted by a window and never held by a call.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions.session import written
from storyloom.operators.arrivals import roots

#: What a candidate's event brings to a decision.
TRAIT = "struct<event:int,gap:int,confidence:double,name:string,key:string,aliases:array<string>>"
LAST = (1 << 63) - 1


def _id_key(c: Column) -> Column:
    return F.concat(F.lit("id:"), F.coalesce(c, F.lit("")))


def _alias_keys(aliases: Column) -> Column:
    return F.transform(T.specific(aliases), lambda x: F.concat(F.lit("as:"), x))


def link_keys(object_id: Column, aliases: Column) -> Column:
    """The keys by which a candidate finds a cluster: one for its object_id, one for each specific alias."""
    return F.array_distinct(F.concat(F.array(_id_key(object_id)), _alias_keys(aliases)))


def _named(*parts: Column) -> Column:
    return F.struct(*(p.alias(f"c{i}") for i, p in enumerate(parts)))


def _states(rows: DataFrame) -> DataFrame:
    """Adds to ``rows(story_id, home, at, ...)`` what a cluster is called after each of its candidates: ``home`` (its first candidate), ``n``, ``told_name``, ``told_key``, ``told_id``."""
    each = Window.partitionBy("story_id", "home").orderBy("at")
    upto, before = each.rowsBetween(Window.unboundedPreceding, 0), each.rowsBetween(Window.unboundedPreceding, -1)
    rank = T.key_rank(F.col("_key"))
    # the best event so far by gap, confidence and name; of equal ones the first event, as the first candidate told it
    best = F.array_max(F.transform(F.filter("traits", lambda p: p["event"] >= 0), lambda p, i: _named(p["gap"], p["confidence"], T.key_rank(p["key"]), -p["event"], -F.col("at"), -i, p["name"])))
    rows = rows.withColumns({"_rank": rank, "_force": F.struct("score", "gap"), "_prior": F.max(best).over(upto), "n": F.row_number().over(each), "_first": F.min("at").over(upto)})
    rows = rows.withColumn("_heard", F.when(F.col("n") > 1, F.col("_prior.c2")))
    top = F.max(F.greatest(F.col("_rank"), F.coalesce("_heard", F.col("_rank"))))
    rows = rows.withColumns({"_top": top.over(before), "_most": F.max("_force").over(before)})
    by_name = F.col("_top").isNull() | (F.col("_rank") > F.col("_top")) | ((F.col("_rank") == F.col("_top")) & (F.col("_force") > F.col("_most")))
    chosen = F.when(F.col("_heard") > F.greatest("_top", "_rank"), F.struct(F.col("_prior.c6").alias("name"))).when(by_name, F.struct("name"))
    telling = F.array_min(F.transform(T.specific(F.col("aliases")), lambda a: _named(-T.key_rank(a)["words"], -T.key_rank(a)["size"], a)))
    rows = rows.withColumns({"_name": F.last(chosen, ignorenulls=True).over(upto), "_telling": F.min(telling).over(upto), "_any": F.min(F.array_min("aliases")).over(upto)})
    rows = rows.withColumns({"told_name": F.col("_name.name"), "told_key": F.coalesce(T.alias_key(F.col("_name.name")), F.lit("")), "home": F.col("_first")})
    own = F.coalesce(F.when(~T.is_generic(F.col("told_key")), F.col("told_key")), F.col("_telling.c2"), F.nullif("told_key", F.lit("")), F.col("_any"), F.lit(""))
    return rows.withColumn("told_id", F.when(F.col("n") == 1, F.col("object_id")).otherwise(own)).drop("_key", "_rank", "_force", "_prior", "_heard", "_top", "_most", "_name", "_telling", "_any", "_first")


def _intervals(states: DataFrame) -> DataFrame:
    """``(story_id, key, home, since, until)``: a cluster goes by a key for candidates after ``since`` up to ``until``."""
    cluster = Window.partitionBy("story_id", "home").orderBy("at")
    second = F.min(F.when(F.col("n") == 2, F.col("at"))).over(Window.partitionBy("story_id", "home"))
    states = states.withColumn("second", second)
    alone = states.where("n = 1").select("story_id", "home", F.col("at").alias("since"), F.coalesce("second", F.lit(LAST)).alias("until"), F.explode(link_keys(F.col("object_id"), F.col("aliases"))).alias("key"))
    # what it is called, from change to change
    changes = states.where("n > 1").withColumn("was", F.lag(F.struct("told_id", "told_key")).over(cluster)).where("was is null or was <> struct(told_id, told_key)")
    changes = changes.withColumn("until", F.coalesce(F.lead("at").over(cluster), F.lit(LAST)))
    called = changes.select("story_id", "home", F.col("at").alias("since"), "until", F.explode(link_keys(F.col("told_id"), F.array("told_id", "told_key"))).alias("key"))
    # of each event the best account so far
    p = states.where("second is not null").select("story_id", "home", "at", "second", F.posexplode("traits").alias("i", "p")).where("p.event >= 0")
    p = p.select("story_id", "home", F.greatest("at", "second").alias("since"), "at", "i", F.col("p.event").alias("event"), _named(F.col("p.gap"), F.col("p.confidence"), T.key_rank(F.col("p.key"))).alias("weight"), "p.key", "p.aliases")
    of_event = Window.partitionBy("story_id", "home", "event").orderBy("at", "i")
    kept = p.withColumn("best", F.max("weight").over(of_event.rowsBetween(Window.unboundedPreceding, -1))).where("best is null or weight > best")
    kept = kept.withColumn("until", F.coalesce(F.lead("since").over(of_event), F.lit(LAST))).where("since < until")
    behind = kept.select("story_id", "home", "since", "until", F.explode(_alias_keys(F.concat(F.array("key"), "aliases"))).alias("key"))
    columns = ["story_id", "key", "home", "since", "until"]
    return reduce(lambda a, b: a.unionByName(b), (x.select(*columns) for x in (alone, called, behind)))


def ordered_clusters(candidates: DataFrame) -> DataFrame:
    """``(story_id, at, cluster, alone, told_name, told_id)`` for ``candidates(story_id, at, score, gap, object_id, name, aliases, traits)``.

    ``at`` is a whole number that orders a story's candidates, its own for each; ``cluster`` is the first one's. ``aliases`` are keys, ``traits`` as in ``TRAIT``; neither is null. A cluster is called by the
    name that tells most, of equals the strongest candidate's, and by that of its best event if it tells more. A candidate that shares no key with another is alone.
    """
    asks = candidates.select("story_id", "at", F.explode(link_keys(F.col("object_id"), F.col("aliases"))).alias("key"))
    shared = asks.groupBy("story_id", "key").agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1").select(F.xxhash64("story_id", "key").alias("h"), F.col("story_id").alias("s"), F.col("key").alias("k"), "first")
    # on a hash beside the key: both sides are dealt out anew, and AQE can split a frequent key
    asks = written(asks.join(shared, (F.xxhash64("story_id", "key") == F.col("h")) & (F.col("story_id") == F.col("s")) & (F.col("key") == F.col("k"))).select("story_id", "at", "key", "first"))
    linked = asks.groupBy("story_id", "at").agg(F.min("first").alias("up"))
    assumed = roots(linked.select(F.col("story_id").alias("story"), F.col("at").alias("row"), "up"))
    assumed = assumed.select(F.col("story").alias("story_id"), F.col("row").alias("at"), F.col("up").alias("home"))
    many = written(candidates.join(linked, ["story_id", "at"], "left_semi").withColumn("_key", F.coalesce(T.alias_key(F.col("name")), F.lit(""))))
    while True:
        states = written(_states(many.join(assumed, ["story_id", "at"])))
        goes = _intervals(states).select(F.xxhash64("story_id", "key").alias("h"), F.col("story_id").alias("s"), F.col("key").alias("k"), F.col("home").alias("found"), "since", "until")
        met = asks.join(goes, (F.xxhash64("story_id", "key") == F.col("h")) & (F.col("story_id") == F.col("s")) & (F.col("key") == F.col("k")) & (F.col("since") < F.col("at")) & (F.col("at") <= F.col("until")))
        decided = met.groupBy("story_id", "at").agg(F.min("found").alias("decided"))
        both = written(states.select("story_id", "at", "home").join(decided, ["story_id", "at"], "left").select("story_id", "at", "home", F.coalesce("decided", "at").alias("decided")))
        if both.where("home <> decided").isEmpty():
            break
        assumed = both.select("story_id", "at", F.col("decided").alias("home"))
    whole = Window.partitionBy("story_id", "home")
    last = F.max(F.struct("n", "told_name", "told_id")).over(whole)
    found = states.select("story_id", "at", F.col("home").alias("cluster"), last.alias("last"))
    found = found.select("story_id", "at", "cluster", (F.col("last.n") == 1).alias("alone"), F.col("last.told_name").alias("told_name"), F.col("last.told_id").alias("told_id"))
    single = candidates.join(linked, ["story_id", "at"], "left_anti")
    return found.unionByName(single.select("story_id", "at", F.col("at").alias("cluster"), F.lit(True).alias("alone"), F.col("name").alias("told_name"), F.col("object_id").alias("told_id")))
