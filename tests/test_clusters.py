"""The ordered fold of candidates against doing it one by one."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.functions.text import GENERIC_ALIASES
from storyloom.plans.clusters import TRAIT, ordered_clusters

CANDIDATES = f"story_id string, at long, score double, gap int, object_id string, name string, aliases array<string>, traits array<{TRAIT}>"


def rank(key):
    return (int(key not in GENERIC_ALIASES), len(key.split(" ")), len(key)) if key else (-1, -1, -1)


def weight(t):
    return t[1], t[2], rank(t[4])


def folded(rows):
    """``{(story, at): (cluster, alone, name, id)}``; names here are their own keys."""
    out = {}
    for story in {r[0] for r in rows}:
        clusters = []
        for _, at, score, gap, object_id, name, aliases, traits in sorted(r for r in rows if r[0] == story):
            events = {}
            for t in traits:
                if t[0] >= 0 and (t[0] not in events or weight(t) > weight(events[t[0]])):
                    events[t[0]] = t
            telling = {a for a in aliases if a not in GENERIC_ALIASES}
            c = next((c for c in clusters if c["id"] == object_id or telling & c["aliases"]), None)
            if c is None:
                clusters.append({"id": object_id, "aliases": set(aliases), "name": name, "force": (score, gap), "events": events, "ats": [at]})
                continue
            names = [c["name"], name]
            if (score, gap) > c["force"]:
                names.reverse()
                c["force"] = (score, gap)
            held = names[1] if rank(names[1]) > rank(names[0]) else names[0]
            for e, t in events.items():
                if e not in c["events"] or weight(t) > weight(c["events"][e]):
                    c["events"][e] = t
            best = max((c["events"][e] for e in sorted(c["events"])), key=weight, default=None)
            if best and rank(best[3]) > rank(held):
                held = best[3]
            known = c["aliases"] | set(aliases)
            tells = sorted((a for a in known if a not in GENERIC_ALIASES), key=lambda a: (*(-x for x in rank(a)), a))
            c["id"] = held if held and held not in GENERIC_ALIASES else (tells[0] if tells else held or min(known, default=""))
            c["name"] = held
            c["aliases"] = {a for a in (c["id"], held, *(k for t in c["events"].values() for k in (t[4], *t[5]))) if a}
            c["ats"].append(at)
        for c in clusters:
            out.update({(story, at): (c["ats"][0], len(c["ats"]) == 1, c["name"], c["id"]) for at in c["ats"]})
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, CANDIDATES).repartition(3)
    return {(r.story_id, r.at): (r.cluster, r.alone, r.told_name, r.told_id) for r in ordered_clusters(df).collect()}


WORDS = ["cup", "key", "red ring", "lamp", "old coat", "mask", "book", "thing", "sword of oak", "jar", "bell", "pin", "rope", "map", "silver cup", "mirror"]


def drawn(r, story, n, words):
    rows = []
    for i in range(n):
        name = r.choice([*words, *words, ""])
        traits = []
        for _ in range(r.choice([0, 0, 1, 2])):
            told = r.choice(words)
            traits.append((r.choice([-1, 0, 1, 2, 3]), r.choice([3, 5, 8]), r.choice([0.25, 0.5]), told, told, [r.choice(words) for _ in range(r.choice([0, 1, 2]))]))
        object_id = r.choice([name, name, name, r.choice(words), ""])
        aliases = list(dict.fromkeys(x for x in [object_id, name, *(a for t in traits for a in (t[4], *t[5]))] if x))
        rows.append((story, 7 * i, r.choice([0.25, 0.5, 0.75]), r.choice([1, 2]), object_id, name, aliases, traits))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_the_fold(spark, seed):
    r = random.Random(seed)
    rows = [row for k in range(40) for row in drawn(r, f"s{k}", r.choice([2, 5, 10, 25]), r.sample(WORDS, r.choice([4, 8, 16])))]
    want = folded(rows)
    assert found(spark, rows) == want
    assert len({c[:1] for c in want.values()}) > 1 and any(not c[1] for c in want.values())


def test_a_name_that_most_candidates_have(spark):
    """One cluster of 30,000 candidates beside others, settled in a few rounds."""
    n = 30_000
    df = spark.range(n).select(
        F.lit("s").alias("story_id"), F.col("id").alias("at"), F.lit(0.5).alias("score"), F.lit(1).alias("gap"), F.when(F.col("id") % 3 > 0, "cup").otherwise(F.concat(F.lit("cup "), F.col("id") % 1000)).alias("object_id"),
    ).withColumns({"name": F.col("object_id"), "aliases": F.array("object_id"), "traits": F.expr(f"cast(array() as array<{TRAIT}>)")})
    got = ordered_clusters(df).groupBy("cluster").count().orderBy(F.desc("count"), "cluster").collect()
    assert got[0]["count"] == n * 2 // 3 and len(got) == 1 + len({i % 1000 for i in range(0, n, 3)}) and sum(r["count"] for r in got) == n


def test_no_candidates(spark):
    assert ordered_clusters(spark.createDataFrame([], CANDIDATES)).count() == 0
