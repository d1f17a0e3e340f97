"""The older miners and the inspector of event files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators.gaps import gap_level, gap_quantiles, max_gaps, reappearance_score
from storyloom.operators.sequences import ordered_list, top_rows

# Patterns of the older miner.
LEGACY_HEADING = r"^\s*(\d+)\s+(INT\.|EXT\.|INT/EXT\.|EXT/INT\.)\s+(.+)$"
LEGACY_SPEAKER = r"^([A-Z][A-Z \-'.]+?)(?:\s*\(.*\))?\s*$"


def trimmed(c: Column) -> Column:
    return F.btrim(T.squeeze(c), F.lit(" ,.;:()[]"))


def speaker_scenes(lines: DataFrame) -> DataFrame:
    """``(story_id, scene_no, heading, page_start, entities)`` from script lines: scenes by printed number, entities are the speakers' names."""
    s = T.strip(F.col("line"))
    w = Window.partitionBy("story_id").orderBy("page_no", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = s.rlike(LEGACY_HEADING)
    rows = lines.withColumn("_s", s).withColumn("_head", head).withColumn("_scene", F.sum(head.cast("int")).over(w)).where("_scene > 0")
    name = trimmed(F.replace(F.regexp_extract("_s", LEGACY_SPEAKER, 1), F.lit("."), F.lit("")))
    speaks = ~F.col("_head") & F.col("_s").rlike(LEGACY_SPEAKER) & F.length(name).between(1, 22) & ~name.startswith("INT") & ~name.startswith("EXT") & ~F.col("_s").startswith("THE CHAMBER OF SECRETS")
    part = lambda i: F.regexp_extract("_s", LEGACY_HEADING, i)
    return rows.groupBy("story_id", "_scene").agg(
        F.max(F.when(F.col("_head"), part(1).cast("int"))).alias("scene_no"), F.max(F.when(F.col("_head"), trimmed(F.concat_ws(" ", part(2), part(3))))).alias("heading"), F.min("page_no").alias("page_start"),
        F.array_sort(F.collect_set(F.when(speaks, name))).alias("entities"),
    ).drop("_scene")


def mine_speaker_gaps(scenes: DataFrame, k: int = 30) -> DataFrame:
    """Each speaker's largest gap between scene numbers; spellings that differ in punctuation only count once; the ``k`` largest of each story."""
    said = scenes.select("story_id", F.explode("entities").alias("entity"), "scene_no")
    gaps = max_gaps(said, ["story_id", "entity"], "scene_no").select("story_id", "entity", F.col("gap_jump").alias("gap_scenes"), F.col("position_a").alias("scene_a"), F.col("position_b").alias("scene_b"))
    first = distinct_by_key(gaps, ["story_id"], "entity", "gap_scenes")
    for side in ("a", "b"):
        at = scenes.groupBy("story_id", F.col("scene_no").alias(f"scene_{side}")).agg(F.last("page_start").alias(f"page_{side}"), F.last("heading").alias(f"heading_{side}"))
        first = first.join(at, ["story_id", f"scene_{side}"])
    return top_rows(first, ["story_id"], [F.desc("gap_scenes"), F.asc("entity")], k)


def distinct_by_key(events: DataFrame, keys: list[str], name: str, gap: str) -> DataFrame:
    """Of events whose names have the same bare key the one with the largest gap, of equal gaps the first name."""
    keyed = events.withColumn("_bare", T.bare_key(F.col(name)))
    return top_rows(keyed, [*keys, "_bare"], [F.desc(gap), F.asc(name)], 1).drop("_bare")


def rough_gaps(mentions: DataFrame, min_gap: int, preselect: int) -> DataFrame:
    """From ``mentions(story_id, entity, scene_idx, scene_idx_non_omitted, channel)``: the largest jump between neighbours, ordered by all markers and measured on told scenes.

    An entity needs two scenes, a mention in action and the gap; the ``preselect`` largest of each story are kept, equal ones by name.
    """
    key = ["story_id", "entity"]
    told = mentions.where("scene_idx_non_omitted >= 0")
    scenes = told.groupBy(*key, "scene_idx", "scene_idx_non_omitted").agg(F.bool_or(F.col("channel") == "action").alias("acted"))
    w = Window.partitionBy(*key).orderBy("scene_idx")
    nxt = scenes.withColumn("_n", F.lead(F.struct("scene_idx", "scene_idx_non_omitted")).over(w))
    jump = F.col("_n.scene_idx_non_omitted") - F.col("scene_idx_non_omitted")
    best = F.max(F.when(F.col("_n").isNotNull(), F.struct(jump.alias("gap"), (-F.col("scene_idx")).alias("minus_a"), F.col("_n.scene_idx").alias("b"), (-F.col("scene_idx_non_omitted")).alias("minus_na"), F.col("_n.scene_idx_non_omitted").alias("nb"))))
    found = nxt.groupBy(*key).agg(F.count("*").alias("freq_scenes_all"), F.count_if("acted").alias("action_scene_count_all"), best.alias("m"), F.array_sort(F.collect_list("scene_idx")).alias("scene_idxs_all_list"))
    found = found.where((F.col("freq_scenes_all") >= 2) & (F.col("action_scene_count_all") >= 1) & (F.col("m.gap") >= min_gap)).select(
        *key, F.col("m.gap").alias("gap_jump"), F.greatest(F.col("m.gap") - 1, F.lit(0)).alias("gap_absent"), (-F.col("m.minus_a")).alias("scene_a_idx_all"), F.col("m.b").alias("scene_b_idx_all"),
        (-F.col("m.minus_na")).alias("scene_a_idx_non_omitted"), F.col("m.nb").alias("scene_b_idx_non_omitted"), "freq_scenes_all", "action_scene_count_all", F.slice("scene_idxs_all_list", 1, 80).alias("scene_idxs_all_list"),
    )
    return top_rows(found, ["story_id"], [F.desc("gap_jump"), F.asc("entity")], preselect)


def mention_store(mentions: DataFrame) -> DataFrame:
    """Counts and contexts for each entity, scene and channel, from ``mentions(story_id, entity, scene_idx, channel, pos, surface, sentence, verbs, persons)``."""
    at = ["story_id", "entity", "scene_idx", "channel"]
    base = mentions.groupBy(*at).agg(F.count("*").alias("mentions"), F.array_distinct(ordered_list(F.col("pos"), F.col("sentence"))).alias("contexts"))
    out = base
    for column, name in (("surface", "surface_forms"), ("verbs", "verb_counts"), ("persons", "person_counts")):
        value = F.explode(column).alias("v") if column != "surface" else F.col(column).alias("v")
        counts = mentions.select(*at, value).where("v is not null").groupBy(*at, "v").agg(F.count("*").alias("n")).groupBy(*at).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias(name))
        out = out.join(counts, at, "left")
    return out


def curate(rough: DataFrame, curated: DataFrame, min_confidence: float = 0.75, min_visual: float = 0.70, min_action: float = 0.55, min_state: float = 0.35, categories: tuple[str, ...] = ("object", "artifact", "weapon", "creature", "vehicle"), top_k: int = 40) -> DataFrame:
    """Rough gaps that a curator keeps, ranked; ``curated(story_id, entity, canonical_name, keep, physical_visualizable, category, state, action, visual, confidence)``."""
    sure = curated.where("keep and physical_visualizable").where(
        (F.col("confidence") >= min_confidence) & (F.col("visual") >= min_visual) & (F.col("action") >= min_action) & (F.col("state") >= min_state) & F.col("category").isin(*categories)
    )
    kept = rough.join(sure, ["story_id", "entity"])
    kept = top_rows(kept, ["story_id"], [F.desc("gap_jump"), F.asc("entity")], top_k)  # the curator stops at so many
    kept = kept.join(gap_quantiles(kept, ["story_id"]), "story_id").withColumn("gap_level", gap_level(F.col("gap_jump"), F.col("q50"), F.col("q75")))
    score = reappearance_score(F.col("gap_jump"), F.col("action"), F.col("visual"), F.col("state"))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("story_id").orderBy(score.desc(), F.desc("gap_jump"), "entity")))


def event_rows(curated: DataFrame, scenes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Curated gaps with both anchors' label, page, heading and contexts (three of action, two of dialogue), the commonest surface in the first anchor and the action strength.

    ``scenes`` as in ``schemas.SCENES``, ``mentions`` as ``mention_store`` reads them; of equally common surfaces the first by spelling.
    """
    key = ["story_id", "entity"]
    sides = curated.select(*key, F.posexplode(F.array("scene_a_idx_all", "scene_b_idx_all")).alias("side", "scene_idx"))
    there = sides.join(mentions.select(*key, "scene_idx", "channel", "pos", "surface", "sentence"), [*key, "scene_idx"])
    told = there.groupBy(*key, "side", "channel", "sentence").agg(F.min("pos").alias("pos")).where("sentence <> ''")
    said = lambda channel, n: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("channel") == channel, F.struct("pos", "sentence")))), lambda s: s["sentence"]), 1, n)
    contexts = told.groupBy(*key, "side").agg(F.concat(said("action", 3), said("dialogue", 2)).alias("context"))
    named = there.where("side = 0").groupBy(*key, "surface").agg(F.count("*").alias("n")).groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("m"), "surface"))["surface"].alias("entity_surface"))
    out = curated.join(named, key, "left").withColumn("entity_surface", F.coalesce("entity_surface", "entity")).withColumn("action_strength", F.col("action") * 5.0)
    for side, letter in enumerate("ab"):
        anchor = scenes.select(
            "story_id", F.col("scene_idx").alias(f"scene_{letter}_idx_all"), F.col("scene_label_raw").alias(f"scene_{letter}_label_raw"), F.col("page_start").alias(f"page_{letter}"), F.col("heading").alias(f"heading_{letter}")
        )
        some = contexts.where(F.col("side") == side).select(*key, F.col("context").alias(f"context_{letter}"))
        out = out.join(anchor, ["story_id", f"scene_{letter}_idx_all"], "left").join(some, key, "left").withColumn(f"context_{letter}", F.coalesce(f"context_{letter}", F.array().cast("array<string>")))
    return out


def lowered(c: Column) -> Column:
    return F.regexp_replace(T.strip(F.lower(c)), r"\s+", " ")


def event_summaries(events: DataFrame) -> DataFrame:
    """The inspector's columns, from whichever of the alternative columns a file has; a gap that's no number is -1."""
    have = set(events.columns)

    def pick(names: list[str], default=None, kind: str = "int") -> Column:
        found = next((F.col(n) for n in names if n in have), F.lit(None).cast(kind if default is None else "string"))
        return found if default is None else F.coalesce(found, F.lit(default))

    score = lambda name: F.col(f"scores.{name}") if "scores" in have else F.col(f"llm_curator.{name}") if "llm_curator" in have else F.lit(None).cast("double")
    return events.select(
        pick(["canonical_name", "entity", "entity_key"], "unknown").alias("name"), pick(["entity_type", "entity_category", "type"], "unknown").alias("category"),
        F.coalesce(pick(["gap_jump", "gap_scenes_non_omitted", "gap_scenes"]).cast("string").try_cast("int"), F.lit(-1)).alias("gap"), pick(["scene_a_idx_non_omitted", "scene_a", "scene_a_idx"]).alias("scene_a"),
        pick(["scene_b_idx_non_omitted", "scene_b", "scene_b_idx"]).alias("scene_b"), pick(["page_a"]).alias("page_a"), pick(["page_b"]).alias("page_b"), pick(["heading_a"], "").alias("heading_a"),
        pick(["heading_b"], "").alias("heading_b"), pick(["score"], kind="double").alias("score"), score("narrative_action_centrality").alias("action"), score("visual_grounded_score").alias("visual"),
        score("state_change_potential").alias("state"), score("confidence").alias("conf"), pick(["context_a"], kind="array<string>").alias("context_a"), pick(["context_b"], kind="array<string>").alias("context_b"),
    )


def inspect(summaries: DataFrame, entity: str | None = None, category: str | None = None, min_gap: int | None = None, max_gap: int | None = None, keyword: str | None = None, top: int | None = 20) -> DataFrame:
    """Summaries that pass the filters, by gap and name, both falling; the first ``top`` or all."""
    out = summaries
    norm = lambda s: " ".join(s.lower().split())
    name = lowered(F.col("name"))
    if entity:
        out = out.where(name.contains(norm(entity)))
    if category:
        out = out.where(lowered(F.col("category")) == norm(category))
    if min_gap is not None:
        out = out.where(F.col("gap") >= min_gap)
    if max_gap is not None:
        out = out.where(F.col("gap") <= max_gap)
    if keyword:
        none = F.array().cast("array<string>")
        said = lowered(F.array_join(F.concat(F.coalesce("context_a", none), F.coalesce("context_b", none)), " "))
        out = out.where(said.contains(norm(keyword)) | name.contains(norm(keyword)))
    out = out.orderBy(F.desc("gap"), F.desc("name"))
    return out if top is None else out.limit(top)


def printed(summaries: DataFrame, contexts: int = 6) -> DataFrame:
    """Summaries with ``printed``, a text for people: name and gap, both anchors, the scores and up to so many contexts of each side (0: none)."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("None"))
    line = lambda template, **values: reduce(lambda text, item: F.replace(text, F.lit("{" + item[0] + "}"), shown(item[1])), values.items(), F.lit(template))
    lines = [
        F.lit("=" * 80), line("{n}  |  category={c}  |  gap={g}  |  score={s}", s="score", g="gap", c="category", n="name"),
        *(line(f"Scene {x.upper()}: idx={{i}}  page={{p}}  heading={{h}}", i=f"scene_{x}", p=f"page_{x}", h=f"heading_{x}") for x in "ab"), line("Scores: action={a}  visual={v}  state={s}  conf={c}", a="action", v="visual", s="state", c="conf"),
    ]
    for x in "ab" if contexts else "":
        some = F.slice(F.coalesce(f"context_{x}", F.array().cast("array<string>")), 1, contexts)
        lines.append(F.when(F.size(some) > 0, F.concat(F.lit(f"\nContext {x.upper()}:\n"), F.array_join(F.transform(some, lambda c: F.concat(F.lit("  - "), c)), "\n"))))
    return summaries.withColumn("printed", F.concat_ws("\n", *lines))


def event_stats(summaries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Number of events, least, upper median and largest gap, number of categories."""
    keys = keys or []
    known = F.when(F.col("gap") >= 0, F.col("gap"))
    # the upper median is the element at n div 2: counts by value keep the list short
    counts = summaries.withColumn("g", known).where("g is not null").groupBy(*keys, "g").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    upto = F.sum("n").over(by.orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(by))
    medians = placed.where("upto > total div 2").groupBy(*keys).agg(F.min("g").alias("gap_median"))
    base = summaries.groupBy(*keys).agg(F.count("*").alias("events"), F.min(known).alias("gap_min"), F.max(known).alias("gap_max"), F.count_distinct("category").alias("categories"))
    return base.join(medians, keys, "left") if keys else base.withColumn("_1", F.lit(1)).join(medians.withColumn("_1", F.lit(1)), "_1", "left").drop("_1")


def category_counts(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy(lowered(F.col("category")).alias("category")).agg(F.count("*").alias("n"))
