"""Subtitles, alignment, segments, sampling and review windows on small literal cases."""

import pytest
from pyspark.sql import functions as F

from storyloom.plans import sampling
from storyloom.plans.alignment import align, monotone_pick
from storyloom.plans.segments import candidate_segments, segment_meta
from storyloom.sources.readers import frame_files, parse_subtitles, read_subtitles

CAND = (
    "story_id string, candidate_index int, object_id string, canonical_name string, candidate_source string, possible_chekhov_score double,"
    " loose_scene_chain array<struct<scene_idx:int,heading:string,matched_inventory_objects:array<string>,role_tags:array<string>>>"
)


def subs(spark, rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "story_id string, pos int, index int, start_sec double, end_sec double, text string")


def aligned(spark, chain, rows, total=2, **how):
    c = spark.createDataFrame([("s", 0, "diary", "diary", "inventory_only", 0.8, chain)], CAND)
    t = spark.createDataFrame([("s", total)], "story_id string, total_scenes int")
    return align(c, t, subs(spark, rows), **how).orderBy("alignment_index").collect()


def test_overlap_and_order(spark):
    rows = [(1, 35.0, 40.0, "Did you bring the diary?"), (2, 60.0, 65.0, "No one is here."), (3, 200.0, 205.0, "The diary is destroyed.")]
    out = aligned(spark, [(0, "INT. ROOM", ["diary"], []), (1, "INT. HALL", ["diary"], [])], rows, search_radius_sec=120.0, neighborhood=0)
    assert [r.matched_subtitle_indices for r in out] == [[1], [3]]
    assert out[0].expected_time_sec == 0.0 and out[1].expected_time_sec == 205.0
    assert out[0].confidence == pytest.approx(round(0.45 * (1 - 37.5 / 120) + 0.20 * 1 + 0.35, 4), abs=1e-4)


def test_fallback_and_irrelevant_subtitle(spark):
    out = aligned(spark, [(0, "INT. ROOM", ["locket"], [])], [(1, 0.0, 5.0, "Nothing to see."), (2, 95.0, 100.0, "Goodbye now.")])
    assert (out[0].confidence, out[0].matched_subtitle_text, out[0].matched_subtitle_indices) == (0.0, "", [])
    assert (out[0].aligned_start_sec, out[0].aligned_end_sec) == (0.0, 37.5)


def test_pick_goes_back_where_nothing_fits(spark):
    o = "array<array<struct<center_sec:double>>>"
    df = spark.createDataFrame([([[(50.0,), (10.0,)], [(20.0,), (60.0,)], [(30.0,), (40.0,)]],)], f"o {o}")
    assert df.select(monotone_pick(F.col("o")).alias("p")).first().p == [1, 2, 1]


def test_windows_use_the_last_end(spark):
    from storyloom.plans.alignment import subtitle_windows

    w = subtitle_windows(subs(spark, [(7, 0.0, 90.0, "a one"), (8, 10.0, 20.0, "b two"), (9, 30.0, 35.0, "c")]), 1).orderBy("center_index").collect()
    assert [(r.start_sec, r.end_sec, r.center_sec, r.segment_indices) for r in w] == [(0.0, 20.0, 45.0, [7, 8]), (0.0, 35.0, 15.0, [7, 8, 9]), (10.0, 35.0, 32.5, [8, 9])]


ALIGN = (
    "story_id string, alignment_index int, candidate_index int, scene_idx int, aligned_start_sec double, aligned_end_sec double, confidence double, matched_subtitle_text string, matched_subtitle_indices array<int>,"
    " query_terms array<string>, component_scores struct<order_score:double,lexical_overlap:double,object_overlap:double>"
)


def cand(spark, chain):
    return spark.createDataFrame([("s", 0, "diary", "diary", "inventory_only", 0.8, chain)], CAND)


def test_near_segments_merge(spark):
    c = cand(spark, [(2, "", [], ["setup_candidate"]), (3, "", [], ["payoff_candidate"]), (9, "", [], ["x"])])
    a = spark.createDataFrame([
        ("s", 0, 0, 2, 107.0, 108.0, 0.6, "the diary", [1], ["diary"], (0.5, 0.5, 1.0)), ("s", 1, 0, 3, 110.0, 113.0, 0.7, "diary again", [1, 2], ["diary", "hall"], (0.5, 0.5, 1.0)),
        ("s", 2, 0, 9, 500.0, 505.0, 0.1, "diary", [9], [], (0.5, 0.5, 1.0)), ("s", 3, 0, 9, 900.0, 905.0, 0.5, "hospital wing", [11], [], (0.5, 0.5, 0.0)),
    ], ALIGN)
    out = candidate_segments(c, a).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.segment_start_sec, r.segment_end_sec, r.segment_role, r.segment_id) == (95.0, 125.0, "payoff", "cand000_diary_seg002")
    assert r.source_scene_indices == [2, 3] and r.source_alignment_indices == [0, 1] and r.matched_subtitle_texts == ["the diary", "diary again"] and r.query_terms == ["diary", "hall"]
    assert r.reason_tags == ["candidate_source:inventory_only", "role:setup_candidate", "subtitle_object_overlap", "subtitle_lexical_overlap", "role:payoff_candidate"]
    assert r.priority_score == pytest.approx(0.56 * 0.8 + 0.34 * 0.7 + 0.14 - 0.02)
    assert segment_meta(c, a, candidate_segments(c, a)).first().skipped_non_object_specific_alignments == 1


def test_cap_per_object(spark):
    c = cand(spark, [(i, "", [], []) for i in range(5)])
    a = spark.createDataFrame([("s", i, 0, i, 1000.0 * i, 1000.0 * i + 5, 0.5 + i / 20, "diary", [i], [], (0.5, 0.5, 1.0)) for i in range(5)], ALIGN)
    assert [r.source_scene_indices for r in candidate_segments(c, a, per_object=2).orderBy("segment_index").collect()] == [[4], [3]]


def test_subtitle_files(spark, tmp_path):
    srt = tmp_path / "a.srt"
    srt.write_text("﻿1\n00:00:01,500 --> 00:00:03,000\nHello\nthere\n\n2\nno time\n\n3\n00:01:00.000 --> 01:00:02.250\nLater\n\n4\n00:02:00,000 --> 00:02:01,000\n\n", encoding="utf-8")
    rows = read_subtitles(spark, str(srt)).orderBy("pos").collect()
    assert [(r["index"], r.start_sec, r.end_sec, r.text) for r in rows] == [(0, 1.5, 3.0, "Hello there"), (1, 60.0, 3602.25, "Later")]
    js = tmp_path / "b.json"
    js.write_text('{"segments": [{"index": 5, "start_sec": 1, "end_sec": 2, "text": " hi "}, {"start_sec": 2, "end_sec": 3, "text": " "}, {"start_sec": 4, "end_sec": 5, "text": "yo"}]}')
    assert [(r["index"], r.text) for r in read_subtitles(spark, str(js)).orderBy("pos").collect()] == [(5, "hi"), (2, "yo")]
    assert parse_subtitles(spark.createDataFrame([("x", "MM only\n01:02.000 --> 01:03.000\nno hours")], "story_id string, value string")).count() == 0


def test_frames_uniform_and_tie(spark):
    seg = spark.createDataFrame([("s", "seg", "o", "o", 0.0, 4.0)], "story_id string, segment_id string, object_id string, canonical_name string, segment_start_sec double, segment_end_sec double")
    frames = spark.createDataFrame([("s", i, f"/f/frame_{i:06d}.JPG") for i in (0, 4)], "story_id string, frame_index int, path string")
    rows = sampling.sample_frames(seg, frames, 1.0, per_segment=3, out_dir="out").orderBy("sample_index").collect()
    assert [(r.target_frame_index, r.frame_index) for r in rows] == [(0, 0), (2, 0), (4, 4)]
    assert rows[2].output_path == "out/seg/sample_02_f000004.jpg"


def test_frame_names(spark):
    names = spark.createDataFrame([("s", p) for p in ("/a/x2_f0007.png", "/a/y_7.jpg", "/a/note.txt", "/a/nodigits.jpg", "/a/3.bmp")], "story_id string, path string")
    assert {(r.frame_index, r.path) for r in frame_files(names).collect()} == {(7, "/a/y_7.jpg"), (3, "/a/3.bmp")}


def test_sample_times(spark):
    one = spark.range(1)
    t = lambda n, s: one.select(sampling.sample_times(F.lit(0.0), F.lit(10.0), n, s).alias("t")).first().t
    assert t(1, "uniform") == [5.0] and t(3, "uniform") == [0.0, 5.0, 10.0] and t(2, "first_middle_last") == [0.0, 5.0] and t(4, "first_middle_last") == [0.0, 5.0, 10.0, 5.0]
    with pytest.raises(ValueError):
        t(0, "uniform")
    with pytest.raises(ValueError):
        t(2, "other")


def test_review_windows(spark):
    one = spark.range(1)
    w = one.select(sampling.centered_window(F.lit(10.0), F.lit(20.0), 30.0, duration=F.lit(40.0)).alias("w")).first().w
    assert (w.center_sec, w.window_start_sec, w.window_end_sec, w.window_start_hhmmss, w.window_end_hhmmss) == (15.0, 0.0, 40.0, "00:00:00", "00:00:40")
    w = one.select(sampling.centered_window(F.lit(10.0), F.lit(20.0), 5.0, center=F.lit(3700.5)).alias("w")).first().w
    assert (w.window_start_sec, w.window_end_hhmmss) == (3695.5, "01:01:46")
    e = lambda a, b, d=None: one.select(sampling.explicit_window(F.lit(a), F.lit(b), d).alias("w")).first().w
    assert e(5.0, 9.0).center_sec == 7.0 and e(9.0, 5.0) is None and e(50.0, 60.0, F.lit(40.0)) is None
    d = lambda a, b, s: one.select(sampling.dense_times(F.lit(a), F.lit(b), s).alias("t")).first().t
    assert d(0.0, 1.0, 0.4) == [0.0, 0.4, 0.8, 1.0] and d(0.0, 1.0, 0.5) == [0.0, 0.5, 1.0] and d(2.0, 2.0, 1.0) == [2.0]


def test_best_segment_and_plan(spark):
    seg = spark.createDataFrame(
        [("s", "a", "o", 0.0, 10.0, 0.5, 0.9), ("s", "b", "o", 20.0, 30.0, 0.7, 0.1), ("s", "c", "o", 10.0, 30.0, 0.7, 0.1)],
        "story_id string, segment_id string, object_id string, segment_start_sec double, segment_end_sec double, priority_score double, alignment_confidence_max double",
    )
    assert [r.segment_id for r in sampling.select_segments(seg).collect()] == ["c"]
    plan = sampling.review_plan(seg, 2.0, 0.1, 24.0, 60.0).orderBy("sample_index").collect()
    assert plan[0].timestamp_sec == 18.0 and plan[-1].timestamp_sec == 22.0 and plan[20].sheet == 1
    named = sampling.review_plan(seg, 2.0, 1.0, 24.0, 60.0, segment_id="a", center_sec=30.0)
    assert {(r.segment_id, r.center_sec, r.window_start_sec, r.window_end_sec) for r in named.collect()} == {("a", 30.0, 28.0, 32.0)} and sampling.review_plan(seg, 2.0, 1.0, 24.0, 60.0, object_id="none").count() == 0


def test_windows_set_by_hand(spark):
    windows = spark.createDataFrame([("The Hat", 4976.0, 4987.0), ("beyond", 12000.0, 12001.0), ("turned", 5.0, 4.0)], "label string, start_sec double, end_sec double")
    rows = sampling.explicit_plan(windows, 24.0, 10000.0).orderBy("sample_index").collect()
    assert len(rows) == 23 and {(r.label, r.center_sec, r.window_start_hhmmss, r.window_end_hhmmss) for r in rows} == {("The Hat", 4981.5, "01:22:56", "01:23:07")}
    assert [rows[i].frame_index for i in (0, 1, 22)] == [119424, 119436, 119688] and [r.sheet for r in rows].count(1) == 3
    clip = sampling.clip_plan(windows, 24.0, 10000.0, "/out/").collect()
    assert [(r.first_frame, r.last_frame, r.output_path) for r in clip] == [(119424, 119688, "/out/clip/the_hat.mp4")]
