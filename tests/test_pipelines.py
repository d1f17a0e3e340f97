"""Stages end to end with models that are plain functions."""

import json
import sys

import pytest
from pyspark import cloudpickle

from storyloom.plans import pipelines as P
from storyloom.plans.alignment import alignment_meta
from storyloom.plans.candidates import CandidateRules, candidate_meta, inventory_groups
from storyloom.plans.reappearance import ReappearanceRules
from storyloom.sources.video import contact_sheets, continuous_frames, frames_at, video_metadata, write_clips, write_frames, write_sheets

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module

SCRIPT = "\n".join(
    f"{i + 1} {'OMITTED' if i == 4 else f'INT. ROOM {i} - DAY'}\n" + ("" if i == 4 else f"\nThe {'diary' if i in (1, 9) else 'lamp'} lies here.\n\nANN\nWhere is the {'diary' if i in (1, 6, 9) else 'door'}?\n") for i in range(11)
)


def ask(requests):
    out = []
    for r in requests:
        name = "diary" if "diary" in r["text"] else "lamp"
        out.append(json.dumps({"entities": [{"canonical_name": name, "surface_forms": [name], "category": "artifact", "physical_visualizable": True, "keep": name == "diary", "narrative_action_centrality": 0.9, "state_change_potential": 0.6, "visual_grounded_score": 0.9, "confidence": 0.9, "evidence": [r["text"]]}]}))
    return out


def climax(requests):
    return [f'Sure: {{"climax_score": {90 if r["scene_idx"] == 8 else 10}}}' for r in requests]


def test_script_to_segments(spark):
    scenes = P.parse_scenes(spark.createDataFrame([("s", 1, SCRIPT)], "story_id string, page_no int, text string"))
    cache = P.empty_cache(spark)
    events, fresh = P.mine_stage1(scenes, ask, cache, ReappearanceRules(min_gap=5))
    assert [(r.entity_key, r.scene_a, r.scene_b, r.gap_jump) for r in events.collect()] == [("diary", 1, 8, 7)]
    assert fresh.count() == 10
    objects, _ = P.build_scene_inventory(scenes, ask, fresh)
    diary = {r.scene_idx: r.source_channels for r in objects.where("object_id = 'diary'").collect()}
    assert diary == {1: ["action", "dialogue"], 5: ["dialogue"], 8: ["action", "dialogue"]}
    peaks, _ = P.mine_climax(scenes, events, climax, cache)
    assert {r.scene_idx: (r.climax_score, r.objects) for r in peaks.where("scene_idx in (1, 5, 8)").collect()} == {1: (10, ["diary"]), 5: (10, []), 8: (90, ["diary"])}
    headings = P.told_channels(scenes).select("story_id", "scene_idx", "heading")
    found = P.mine_candidates(events.select("story_id", "event_idx", "entity_key", "canonical_name", "entity_type", "surface_forms", "scene_a", "scene_b", "gap_jump", "gap_absent", "freq_scenes", "coverage", "scores", "scenes"), objects, headings, peaks)
    top = found.where("candidate_index = 0").first()
    assert (top.object_id, top.candidate_source, [r.scene_idx for r in top.loose_scene_chain]) == ("diary", "inventory_with_stage1_prior", [1, 5, 8])
    total = spark.createDataFrame([("s", 10)], "story_id string, total_scenes int")
    subs = spark.createDataFrame([("s", i, i, 60.0 * i, 60.0 * i + 5, "Where is the diary?" if i in (1, 8) else "Hello") for i in range(10)], "story_id string, pos int, index int, start_sec double, end_sec double, text string")
    alignments, segments = P.segments_from_subtitles(found, total, subs, search_radius_sec=100.0, neighborhood=0, per_object=2)
    rows = alignments.where("object_id = 'diary'").orderBy("alignment_index").collect()
    assert [r.matched_subtitle_indices for r in rows] == [[1], [], [8]] and {r.segment_role for r in segments.where("object_id = 'diary'").collect()} == {"setup", "payoff"}
    m = alignment_meta(found, subs, alignments).first()
    assert (m.scene_candidates_considered, m.subtitle_segments, m.subtitle_windows, m.alignments_returned, m.movie_duration_sec) == (found.count(), 10, 10, alignments.count(), 545.0)
    c = candidate_meta(events, inventory_groups(objects, headings), headings, peaks, found).first()
    assert (c.stage1_events_considered, c.scene_inventory_summaries_considered, c.scene_climax_summaries_considered) == (1, 10, 10)
    assert c.candidates_returned == found.count() == sum(c.candidate_source_counts.values()) and c.candidate_source_counts["inventory_with_stage1_prior"] == 1 and c.inventory_groups_considered >= 2
    with pytest.raises(ValueError):
        P.segments_from_subtitles(found, total, subs.limit(0))


def test_files_to_candidates(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"meta": {}, "events": []}))
    thing = lambda: {"object_id": "ring", "canonical_name": "ring", "normalized_aliases": ["ring"], "source_channels": ["action"], "category": "weapon", "direct_visual_evidence": True, "mention_strength_max": 0.9, "confidence_max": 0.9}
    (tmp_path / "i.json").write_text(json.dumps({"meta": {"scenes_non_omitted": 20}, "scenes": {str(k): {"heading": f"H{k}", "merged_loose_objects": [thing()]} for k in (1, 18)}}))
    (tmp_path / "c.json").write_text(json.dumps({"scenes": {"18": {"heading": "H", "climax_score": 99}}}))
    paths = [str(tmp_path / f"{n}.json") for n in "eic"]
    got = P.candidates_from_files(spark, *paths, CandidateRules(min_score=0.5)).collect()
    assert [(r.object_id, r.candidate_stats.gap_jump, r.loose_scene_chain[1].climax_score) for r in got] == [("ring", 17, 99)]
    (tmp_path / "c.json").write_text(json.dumps({"scenes": {}}))
    with pytest.raises(ValueError):
        P.candidates_from_files(spark, *paths)


def test_older_miner(spark):
    scenes = P.parse_scenes(spark.createDataFrame([("s", 1, SCRIPT)], "story_id string, page_no int, text string"))

    def chunk(text):
        return [{"surface": f"the {w}", "sentence": text, "verbs": [], "persons": []} for w in ("diary", "lamp") if w in text]

    def curate(requests):
        return [json.dumps({"canonical_name": r["entity"].title(), "keep": len(r["contexts"]) <= 8, "physical_visualizable": True, "category": "artifact", "state_change_potential": 0.9, "narrative_action_centrality": 0.9, "visual_grounded_score": 0.9, "confidence": 0.9}) for r in requests]

    out, _ = P.mine_legacy(scenes, chunk, curate, P.empty_cache(spark), min_gap=3)
    assert [(r.entity, r.canonical_name, r.gap_jump, r.scene_a_idx_all, r.scene_b_idx_all) for r in out.collect()] == [("diary", "Diary", 4, 1, 6)]
    r = out.first()
    assert (r.entity_surface, r.scene_a_label_raw, r.page_a, r.heading_b, r.action_strength) == ("the diary", "2", 1, "INT. ROOM 6 - DAY", 4.5)
    assert (r.context_a, r.context_b) == (["The diary lies here.", "Where is the diary?"], ["Where is the diary?"])


class Film:
    fps, frames = 10.0, 50

    def __init__(self, path):
        self.path = path

    def read(self, i):
        return f"{self.path}:{i}".encode()


def test_video_boundary(spark):
    meta = video_metadata(spark.createDataFrame([("a",)], "path string"), Film).first()
    assert (meta.fps, meta.frames, meta.duration_sec) == (10.0, 50, 5.0)
    plan = continuous_frames(spark.createDataFrame([("a", 4.7, 5.2)], "path string, window_start_sec double, window_end_sec double"), 10.0)
    assert sorted((r.frame_index, bytes(r.image)) for r in frames_at(plan, Film).collect()) == [(47, b"a:47"), (48, b"a:48"), (49, b"a:49"), (50, b"a:49"), (51, b"a:49"), (52, b"a:49")]
    many = spark.createDataFrame([("o", i, i * 2) for i in range(45)], "o string, sample_index int, frame_index int")
    assert [len(r.frame_indices) for r in contact_sheets(many, ["o"]).orderBy("sheet").collect()] == [20, 20, 5]


def test_exports(spark, tmp_path):
    def encode(images, fps, path):
        with open(path, "wb") as f:
            f.write(b",".join(images) + str(fps).encode())

    film = str(tmp_path / "clip" / "a.mp4")
    clips = spark.createDataFrame([("a", 47, 60, film)], "path string, first_frame int, last_frame int, output_path string")
    assert [(r.fps, r.frames) for r in write_clips(clips, Film, encode).collect()] == [(10.0, 3)]
    assert (tmp_path / "clip" / "a.mp4").read_bytes() == b"a:47,a:48,a:4910.0" and len(list((tmp_path / "clip").iterdir())) == 1
    sheets = spark.createDataFrame([("a", [1, 99], str(tmp_path / "sheets" / "0.jpg"))], "path string, frame_indices array<int>, output_path string")
    assert write_sheets(sheets, Film, b"|".join).first().frames == 2 and (tmp_path / "sheets" / "0.jpg").read_bytes() == b"a:1|a:49"
    frames = spark.createDataFrame([(bytearray(b"xy"), str(tmp_path / "f" / "1.jpg"))], "image binary, output_path string")
    assert write_frames(frames).first().bytes == 2 and (tmp_path / "f" / "1.jpg").read_bytes() == b"xy"


def test_one_scene_falls_back_alone(spark):
    scenes = P.parse_scenes(spark.createDataFrame([("s", 1, SCRIPT)], "story_id string, page_no int, text string"))
    cache = P.empty_cache(spark)

    def spoken(requests):
        assert all(r["text"] in r["prompt"] and r["heading"] in r["prompt"] for r in requests)
        if any(r["scene_idx"] == 5 for r in requests):
            raise RuntimeError("no answer")
        one = {"canonical_name": "chalice", "surface_forms": [], "category": "artifact", "physical_visualizable": True, "direct_visual_evidence": False, "mention_strength": 0.5, "confidence": 0.5, "evidence": []}
        return ["not json" if r["scene_idx"] == 8 else json.dumps({"entities": [one]}) for r in requests]

    objects, fresh = P.build_scene_inventory(scenes, ask, cache, spoken, "hybrid", model="one")
    found = {(r.scene_idx, r.object_id) for r in objects.where("array_contains(source_channels, 'dialogue')").collect()}
    assert {i for i, o in found if o == "chalice"} == set(range(10)) - {5, 8}  # the model answers for all but two scenes
    assert {i for i, o in found if o == "diary"} == {5, 8}  # which fall back to the patterns
    assert fresh.count() == 19  # ten of action, ten of dialogue less the one without an answer
    known = {r.key for r in fresh.collect()}
    _, again = P.build_scene_inventory(scenes, ask, fresh, spoken, "hybrid", model="one")
    assert again.count() == 0
    _, other = P.mine_stage1(scenes, ask, fresh, model="two")  # another model answers for itself
    assert other.count() == 10 and not known & {r.key for r in other.collect()}
    with pytest.raises(Exception, match="no answer"):
        P.build_scene_inventory(scenes, ask, cache, spoken, "llm")
