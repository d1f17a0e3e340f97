"""Stage 1, climax, inventory, annotation, legacy miners, streaming and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from storyloom.operators.gaps import gap_level, reappearance_score
from storyloom.plans import annotate, legacy
from storyloom.plans import schemas as S
from storyloom.plans.inventory import action_records, dialogue_channel, scene_inventory, spoken_records
from storyloom.plans.reappearance import ReappearanceRules, mine_reappearances, scene_climax, scene_event_names
from storyloom.plans.scenes import page_lines
from storyloom.sources.readers import read_climax, read_events, read_inventory, read_pdf_pages, read_text_pages
from storyloom.sources.writers import write_json, write_scene_markers, write_summaries_csv
from storyloom.streaming.gaps import running_gaps


def scenes(spark, n=60):
    return spark.createDataFrame([("s", i, i, f"{i + 1}", i + 1, "INT.", f"INT. {i}", i // 2, i // 2, []) for i in range(n)] + [("s", n, -1, "99", 99, "OMITTED", "OMITTED", 9, 9, [])], S.SCENES)


def mention(scene, pos, name, kind="artifact", forms=(), keep=True, seen=True, action=0.8, visual=0.9, state=0.5, conf=0.9, ev=()):
    return ("s", scene, pos, name, list(forms), kind, seen, keep, action, visual, state, conf, list(ev))


def test_reappearances(spark):
    rows = [
        mention(1, 0, "The diary", forms=["diary", "book"], ev=["a", "b", "a"]), mention(1, 1, "diary", forms=["diary"], ev=["c", "b"]), mention(40, 0, "Diary", "weapon", forms=["old diary"], ev=["z"], conf=0.7),
        mention(45, 0, "The diary", forms=["book"]), mention(2, 0, "ring"), mention(59, 0, "a ring"), mention(3, 0, "cup"), mention(10, 0, "cup"), mention(5, 0, "ghost", "creature", keep=False), mention(50, 0, "ghost", "creature"),
        mention(6, 0, "love", "other"), mention(55, 0, "love", "other"), mention(6, 1, "dim", visual=0.1), mention(56, 0, "dim", visual=0.1),
    ]
    out = mine_reappearances(spark.createDataFrame(rows, S.ENTITY_MENTIONS), scenes(spark)).orderBy("event_idx").collect()
    assert [(r.entity_key, r.gap_jump) for r in out] == [("ring", 57), ("diary", 39)]
    d = out[1]
    assert (d.canonical_name, d.entity_type, d.surface_forms) == ("The diary", "artifact", ["diary", "book", "old diary"])
    assert (d.scene_a, d.scene_b, d.freq_scenes, d.scenes, d.page_a, d.heading_b) == (1, 40, 3, [1, 40, 45], 0, "INT. 40")
    assert d.context_a == ["a", "b", "c"] and d.context_b == ["z"] and d.coverage == pytest.approx(3 / 45)
    assert d.scores.confidence == pytest.approx((0.9 * 3 + 0.7) / 4)
    assert (d.q50, d.q75, d.gap_level, out[0].gap_level) == (48.0, 52.5, "medium", "extreme")


def test_rank_ties_keep_first_mention_and_limit(spark):
    rows = [mention(s, p, n) for n, p in (("b", 1), ("a", 2)) for s in (0, 30)]
    m = spark.createDataFrame(rows, S.ENTITY_MENTIONS)
    assert [r.entity_key for r in mine_reappearances(m, scenes(spark)).orderBy("event_idx").collect()] == ["b", "a"]
    assert mine_reappearances(m, scenes(spark), ReappearanceRules(top_k=1)).count() == 1
    assert mine_reappearances(m.limit(0), scenes(spark)).count() == 0


def test_score_and_level(spark):
    r = spark.range(1).select(reappearance_score(F.lit(82), F.lit(0.9), F.lit(0.95), F.lit(0.6)).alias("s"), gap_level(F.lit(35), F.lit(35.0), F.lit(49.5)).alias("m"), gap_level(F.lit(50), F.lit(35.0), F.lit(49.5)).alias("x")).first()
    assert r.s == pytest.approx(164 + 45 + 28.5 + 12) and (r.m, r.x) == ("medium", "extreme")


def test_climax_objects(spark):
    e = spark.createDataFrame([("s", 0, "ring", [1, 3]), ("s", 1, "cup", [3]), ("s", 2, "ring", [3])], "story_id string, event_idx int, canonical_name string, scenes array<int>")
    assert {r.scene_idx: r.objects for r in scene_event_names(e).collect()} == {1: ["ring"], 3: ["ring", "cup"]}
    scores = spark.createDataFrame([("s", 3, 80), ("s", 4, 10)], "story_id string, scene_idx int, climax_score int")
    assert {r.scene_idx: (r.climax_score, r.objects) for r in scene_climax(scenes(spark, 5), scores, e).collect()} == {3: (80, ["ring", "cup"]), 4: (10, [])}


def test_inventory_merges_across_channels(spark):
    act = action_records(spark.createDataFrame([mention(0, 0, "Tom's diary", forms=["the diary"], keep=False, ev=["1", "2", "3", "4"]), mention(0, 1, "idea", "abstract")], S.ENTITY_MENTIONS))
    said = spark.createDataFrame([("s", 0, 0, "diary", ["diary"], "artifact", True, False, 0.4, 0.6, ["5"])], S.SPOKEN_MENTIONS)
    from storyloom.plans.inventory import dialogue_records

    out = scene_inventory(act, dialogue_records(said)).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.object_id, r.canonical_name, r.source_channels, r.tracking_keep_any, r.mention_strength_max) == ("tom's diary", "Tom's diary", ["action", "dialogue"], False, 0.9)
    assert r.normalized_aliases == ["diary", "tom's diary"] and r.evidence == ["1", "2", "3", "5"]


def test_bridging_record_joins_two_groups(spark):
    rows = [mention(0, 0, "cup", forms=[], ev=["c"]), mention(0, 1, "goblet", forms=[]), mention(0, 2, "grail", forms=["cup", "goblet"])]
    out = scene_inventory(action_records(spark.createDataFrame(rows, S.ENTITY_MENTIONS)), spoken_records(spark.createDataFrame([], "story_id string, scene_idx int, dialogue_text string"))).collect()
    assert [(r.canonical_name, r.normalized_aliases, r.surface_forms) for r in out] == [("goblet", ["cup", "goblet", "grail"], ["cup", "goblet"])]


def test_dialogue_patterns_and_modes(spark):
    texts = spark.createDataFrame([("s", 0, "Bring the key. Bring the sword! I saw Old Harry Moon and my idea. The cup")], "story_id string, scene_idx int, dialogue_text string")
    assert {r.object_id for r in spoken_records(texts).collect()} == {"key", "sword", "old harry moon"}
    assert dialogue_channel(texts, "none").count() == 0 and dialogue_channel(texts, "heuristic").count() == 3

    def broken(_):
        raise RuntimeError("no model")

    assert dialogue_channel(texts, "hybrid", broken).count() == 3
    with pytest.raises(RuntimeError):
        dialogue_channel(texts, "llm", broken)
    with pytest.raises(ValueError):
        dialogue_channel(texts, "other")


def test_annotation_asks_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def ask(requests):
        import uuid

        (log / uuid.uuid4().hex).write_text(str(len(requests)))
        return [json.dumps({"entities": [{"canonical_name": r["text"], "keep": True, "confidence": 0.5}]}) for r in requests]

    req = spark.createDataFrame([("s", 0, "h", "ring"), ("s", 1, "h", "ring"), ("s", 2, "h", "cup"), ("s", 3, "h", None)], "story_id string, scene_idx int, heading string, text string")
    key = annotate.request_key(F.col("text"))
    cache = req.where("text = 'cup'").select(key.alias("key"), F.lit('{"entities": []}').alias("response"))
    done, fresh = annotate.annotated(req, cache, ask, ["text"])
    rows = {r.scene_idx: r.response for r in done.collect()}
    assert rows[2] == '{"entities": []}' and rows[0] == rows[1] and "ring" in rows[0]
    assert sum(int(p.read_text()) for p in log.iterdir()) == 2 and fresh.count() == 2
    assert annotate.scene_mentions(done).where("canonical_name = 'ring'").count() == 2
    assert spark.range(1).select(annotate.json_part(F.lit('x {"a": {"b": 1}} y')).alias("j")).first().j == '{"a": {"b": 1}}'
    assert spark.range(1).select(annotate.prompt(annotate.SCENE_PROMPT, scene_idx=F.lit(3), heading=F.lit("H"), text=F.lit("T")).alias("p")).first().p.endswith("Scene 3: H\nT")


def test_legacy_speaker_gaps(spark):
    text = "1 INT. A - DAY\nHARRY\nhi\nRON (V.O.)\n5 EXT. B\nH.ARRY\n9 INT. C\nHARRY.\nINT\n7 INT. D\nRON"
    s = legacy.speaker_scenes(page_lines(spark.createDataFrame([("s", 1, text)], "story_id string, page_no int, text string")))
    assert {r.scene_no: r.entities for r in s.collect()} == {1: ["HARRY", "RON"], 5: ["HARRY"], 7: ["RON"], 9: ["HARRY"]}
    out = legacy.mine_speaker_gaps(s).collect()
    assert sorted((r.entity, r.gap_scenes, r.scene_a, r.scene_b, r.heading_a) for r in out) == [("HARRY", 4, 1, 5, "INT. A - DAY"), ("RON", 6, 1, 7, "INT. A - DAY")]


def test_rough_gaps_and_curation(spark):
    m = spark.createDataFrame(
        [("s", "ring", 0, 0, "action"), ("s", "ring", 5, 3, "dialogue"), ("s", "ring", 9, 30, "dialogue"), ("s", "talk", 0, 0, "dialogue"), ("s", "talk", 9, 30, "dialogue"), ("s", "cup", 2, 2, "action"), ("s", "cup", 8, -1, "action")],
        "story_id string, entity string, scene_idx int, scene_idx_non_omitted int, channel string",
    )
    r = legacy.rough_gaps(m, 20, 200).collect()
    assert [(x.entity, x.gap_jump, x.scene_a_idx_all, x.scene_b_idx_all, x.scene_a_idx_non_omitted, x.scene_b_idx_non_omitted, x.freq_scenes_all) for x in r] == [("ring", 27, 5, 9, 3, 30, 3)]
    c = spark.createDataFrame([("s", "ring", "Ring", True, True, "artifact", 0.5, 0.6, 0.8, 0.9)], "story_id string, entity string, canonical_name string, keep boolean, physical_visualizable boolean, category string, state double, action double, visual double, confidence double")
    assert legacy.curate(legacy.rough_gaps(m, 20, 200), c).first().rank == 1
    assert legacy.curate(legacy.rough_gaps(m, 20, 200), c, min_confidence=0.95).count() == 0


def test_noun_chunks_and_store(spark):
    def chunk(text):
        return [{"surface": w, "sentence": text, "verbs": ["be"], "persons": []} for w in text.split()]

    t = spark.createDataFrame([("s", 0, 0, "action", 0, "The-ring my cup")], "story_id string, scene_idx int, scene_idx_non_omitted int, channel string, block int, text string")
    m = annotate.noun_chunks(t, chunk)
    assert [r.entity for r in m.orderBy("pos").collect()] == ["the-ring", "my", "cup"]
    s = {r.entity: r for r in legacy.mention_store(m).collect()}
    assert s["cup"].mentions == 1 and s["cup"].verb_counts == {"be": 1} and s["cup"].contexts == ["The-ring my cup"]


def test_inspector(spark, tmp_path):
    e = spark.createDataFrame([("The Ring", "artifact", 30, ["a  Key"]), ("cup", "object", 12, []), ("mask", "object", None, [])], "canonical_name string, entity_type string, gap_jump int, context_a array<string>")
    s = legacy.event_summaries(e)
    assert [r.name for r in legacy.inspect(s).collect()] == ["The Ring", "cup", "mask"]
    assert [r.name for r in legacy.inspect(s, keyword="a key").collect()] == ["The Ring"] and legacy.inspect(s, category="OBJECT", min_gap=0).count() == 1
    r = legacy.event_stats(s).first()
    assert (r.events, r.gap_min, r.gap_median, r.gap_max, r.categories) == (3, 12, 30, 30, 2)
    assert {(x.category, x.n) for x in legacy.category_counts(s).collect()} == {("artifact", 1), ("object", 2)}
    write_summaries_csv(s, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns[:3] == ["name", "category", "gap"]


def test_json_files_round_trip(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"meta": {"gap_quantiles": {"q50": 1.0, "q75": 2.0}}, "events": [{"entity_key": "ring", "canonical_name": "Ring", "gap_jump": 5, "provenance": {"scenes_non_omitted_list": [1, 6]}}]}))
    ev, meta = read_events(spark, str(tmp_path / "e.json"))
    assert (ev.first().entity_key, ev.first().scenes, meta.first().q75) == ("ring", [1, 6], 2.0)
    (tmp_path / "i.json").write_text(json.dumps({"meta": {"scenes_non_omitted": 12}, "scenes": {"3": {"heading": "H", "merged_loose_objects": [{"object_id": "ring", "mention_strength": 0.4, "source_channel": "dialogue"}, {"object_id": "x"}]}}}))
    ob, head, total = read_inventory(spark, str(tmp_path / "i.json"))
    rows = ob.orderBy("pos").collect()
    assert (rows[0].mention_strength_max, rows[0].source_channels, rows[1].source_channels, rows[1].category) == (0.4, ["dialogue"], ["action"], "object")
    assert head.first().scene_idx == 3 and total.first().inventory_total == 12
    (tmp_path / "c.json").write_text(json.dumps({"scenes": {"3": {"heading": "H", "climax_score": 70}}}))
    assert read_climax(spark, str(tmp_path / "c.json"))[0].first().climax_score == 70
    write_json(head, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().heading == "H"
    write_scene_markers(scenes(spark, 2), str(tmp_path / "marks"))
    assert "lines" not in spark.read.json(str(tmp_path / "marks")).columns


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ftwo")
    assert [(r.page_no, r.text) for r in read_text_pages(spark, str(tmp_path / "a.txt")).orderBy("page_no").collect()] == [(1, "one\n"), (2, "two")]
    (tmp_path / "b.pdf").write_bytes(b"x|y")
    assert [(r.story_id, r.page_no, r.text) for r in read_pdf_pages(spark, str(tmp_path / "b.pdf"), lambda c: c.decode().split("|")).orderBy("page_no").collect()] == [("b.pdf", 1, "x"), ("b.pdf", 2, "y")]


def test_running_gaps_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "entity string, scene_idx long"
    q = running_gaps(spark.readStream.schema(schema).json(str(src))).writeStream.outputMode("update").format("memory").queryName("running_gaps_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for n, rows in enumerate(([("ring", 1), ("ring", 4), ("cup", 2)], [("ring", 20), ("ring", 3)])):
            (src / f"{n}.json").write_text("\n".join(json.dumps({"entity": e, "scene_idx": s}) for e, s in rows))
            q.processAllAvailable()
    finally:
        q.stop()
    last = {r.entity: r for r in spark.sql("select * from running_gaps_out").orderBy("last_scene").collect()}
    assert (last["ring"].gap_jump, last["ring"].scene_a, last["ring"].scene_b, last["ring"].late) == (16, 4, 20, 1) and last["cup"].gap_jump == -1


def test_event_text(spark):
    rows = [("Ring", 30, 1, 31, ["a", "b"])]
    e = spark.createDataFrame(rows, "canonical_name string, gap_jump int, scene_a int, scene_b int, context_a array<string>")
    full, short = (legacy.printed(legacy.event_summaries(e), n).first().printed.split("\n") for n in (1, 0))
    assert short == ["=" * 80, "Ring  |  category=unknown  |  gap=30  |  score=None", "Scene A: idx=1  page=None  heading=", "Scene B: idx=31  page=None  heading=", "Scores: action=None  visual=None  state=None  conf=None"]
    assert full == [*short, "", "Context A:", "  - a"]
