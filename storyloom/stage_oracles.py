"""DuckDB SQL of the stage queries; literal stories have their scores worked out in SQL and the rest as rows."""

from __future__ import annotations

from storyloom.oracles import CLOCK, MENTIONS, SEGMENTS, TOKENS, max_gaps_sql

#: Four digits, half up on the decimal form.
R4 = lambda x: f"CAST(round(CAST({x} AS DECIMAL(24, 12)), 4) AS DOUBLE)"
R3 = lambda x: f"CAST(round(CAST({x} AS DECIMAL(24, 12)), 3) AS DOUBLE)"
D = lambda x: f"CAST({x} AS DOUBLE)"
CLAMP = lambda x: f"least(greatest({x}, {D('0.0')}), {D('1.0')})"

STAGE1 = f"""WITH {MENTIONS},
b AS (SELECT CAST(user_id % 20 AS VARCHAR) AS story_id, CAST(floor(at_s / 21600) AS INT) AS s, CAST(event_id AS INT) AS pos, event_type, event_type || ' ' || user_id AS k,
  CASE event_id % 3 WHEN 0 THEN 'The ' || event_type || ' ' || user_id WHEN 1 THEN event_type || ' ' || user_id ELSE upper(event_type || ' ' || user_id) END AS name,
  CASE WHEN event_id % 7 = 0 THEN 'location' WHEN event_id % 5 < 3 THEN 'artifact' ELSE 'object' END AS kind, event_id % 17 <> 0 AND event_id % 11 <> 0 AS ok, CASE WHEN event_id % 2 = 0 THEN 'it' ELSE 'that' END AS form2,
  (cents % 64) / 64.0::DOUBLE AS act, ((cents // 64) % 64) / 64.0::DOUBLE AS vis, (event_id % 64) / 64.0::DOUBLE AS sta, ((event_id // 3) % 64) / 64.0::DOUBLE AS con FROM m),
scenes AS (SELECT DISTINCT story_id, s FROM b WHERE s % 13 <> 7),
g AS (SELECT * FROM b WHERE ok AND kind <> 'location'),{max_gaps_sql('mg', 'g', 'story_id, k', 's')},
means AS (SELECT story_id, k, sum(act) / count(*) AS act, sum(vis) / count(*) AS vis, sum(sta) / count(*) AS sta, sum(con) / count(*) AS con, min(s * 1000000000::BIGINT + pos) AS ord FROM g GROUP BY story_id, k),
best AS (SELECT story_id, k, what, v, row_number() OVER (PARTITION BY story_id, k, what ORDER BY count(*) DESC, min(o)) AS r FROM (
  SELECT story_id, k, 'name' AS what, name AS v, (s * 1000000000::BIGINT + pos) * 2 AS o FROM g UNION ALL SELECT story_id, k, 'kind', kind, (s * 1000000000::BIGINT + pos) * 2 FROM g
  UNION ALL SELECT story_id, k, 'form', event_type, (s * 1000000000::BIGINT + pos) * 2 FROM g UNION ALL SELECT story_id, k, 'form', form2, (s * 1000000000::BIGINT + pos) * 2 + 1 FROM g) GROUP BY story_id, k, what, v),
ev AS (SELECT story_id, k, s, string_agg(x, '|' ORDER BY f) AS context FROM (SELECT *, row_number() OVER (PARTITION BY story_id, k, s ORDER BY f) AS r FROM (
  SELECT story_id, k, s, x, min(f) AS f FROM (SELECT story_id, k, s, 'e' || pos AS x, pos * 2 AS f FROM g UNION ALL SELECT story_id, k, s, 'same', pos * 2 + 1 FROM g) GROUP BY story_id, k, s, x)) WHERE r <= 5 GROUP BY story_id, k, s),
found AS (SELECT mg.*, act, vis, sta, con, ord FROM mg JOIN means USING (story_id, k) JOIN scenes sa ON sa.story_id = mg.story_id AND sa.s = mg.a JOIN scenes sb ON sb.story_id = mg.story_id AND sb.s = mg.b
  WHERE gap_jump >= 20 AND con >= 0.3 AND vis >= 0.3 AND act >= 0.3 AND sta >= 0.2),
q AS (SELECT story_id, quantile_cont(gap_jump, 0.5) AS q50, quantile_cont(gap_jump, 0.75) AS q75 FROM found GROUP BY story_id),
ranked AS (SELECT *, {D('2.0')} * gap_jump + {D('50.0')} * act + {D('30.0')} * vis + {D('20.0')} * sta AS score FROM found),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY story_id ORDER BY score DESC, ord) - 1 AS INT) AS event_idx FROM ranked)
SELECT p.story_id, event_idx, p.k AS entity_key, n.v AS canonical_name, t.v AS entity_type, f.forms, a AS scene_a, b AS scene_b, gap_jump, gap_absent, CAST(freq AS INT) AS freq_scenes, coverage, a || 'A' AS scene_a_label_raw,
  CAST(b + 1 AS INT) AS page_b, 'INT. HOUR ' || b AS heading_b, ev.context AS context_a, CASE WHEN gap_jump <= q50 THEN 'medium' WHEN gap_jump <= q75 THEN 'long' ELSE 'extreme' END AS gap_level, con AS confidence,
  CAST(floor(score * 1000) AS BIGINT) AS rank_milli
FROM placed p JOIN q USING (story_id) JOIN best n ON n.story_id = p.story_id AND n.k = p.k AND n.what = 'name' AND n.r = 1 JOIN best t ON t.story_id = p.story_id AND t.k = p.k AND t.what = 'kind' AND t.r = 1
JOIN (SELECT story_id, k, string_agg(v, '|' ORDER BY r) AS forms FROM best WHERE what = 'form' AND r <= 5 GROUP BY story_id, k) f ON f.story_id = p.story_id AND f.k = p.k
JOIN ev ON ev.story_id = p.story_id AND ev.k = p.k AND ev.s = p.a WHERE event_idx < 50"""

FILM = f"""
it0 AS (SELECT item_id, {TOKENS("coalesce(text, '')")} AS t FROM benchmark),
it AS (SELECT item_id, CAST(item_id % 10 AS VARCHAR) AS story_id, CAST(item_id // 10 AS INT) AS ci, coalesce(list_min(t), '') AS lo, coalesce(list_max(t), '') AS hi,
  CASE item_id % 3 WHEN 0 THEN 'inventory_only' WHEN 1 THEN 'stage1_fallback' ELSE 'inventory_with_stage1_prior' END AS source, (item_id % 32) / 64.0::DOUBLE + 0.5::DOUBLE AS score FROM it0),
sub AS (SELECT CAST(conv_id % 10 AS VARCHAR) AS story_id, conv_id * 1000 + turn AS pos, {D('(conv_id // 10) * 80.0 + turn * 10.0')} AS s, {D('(conv_id // 10) * 80.0 + turn * 10.0 + 8.0')} AS e, coalesce(text, '') AS text FROM conversations),
w0 AS (SELECT story_id, row_number() OVER (PARTITION BY story_id ORDER BY pos) - 1 AS center, list(pos) OVER k AS idx, first_value(s) OVER k AS st, last_value(e) OVER k AS en, {D('0.5')} * (s + e) AS mid, array_to_string(list(text) OVER k, ' ') AS text
  FROM sub WINDOW k AS (PARTITION BY story_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
w AS (SELECT *, {TOKENS('text')} AS tokens FROM w0),
dur AS (SELECT story_id, max(e) AS duration FROM sub GROUP BY story_id),
st0 AS (SELECT it.*, v.step, CAST(item_id % 20 + v.away AS INT) AS scene, CASE v.step WHEN 0 THEN [lo] WHEN 1 THEN [] ELSE [hi] END AS things FROM it, (VALUES (0, 0), (1, 20), (2, 39)) v(step, away)),
steps AS (SELECT st0.*, duration, scene / {D('59')} * duration AS expected, list_sort(list_distinct(list_concat({TOKENS("lo || ' ' || hi")}, {TOKENS("'INT. ' || upper(hi)")}, {TOKENS("array_to_string(things, ' ')")}))) AS general,
  CASE WHEN len({TOKENS("array_to_string(things, ' ')")}) > 0 THEN {TOKENS("array_to_string(things, ' ')")} ELSE {TOKENS("lo || ' ' || hi")} END AS own FROM st0 JOIN dur USING (story_id)),
op0 AS (SELECT s.story_id, s.ci, s.step, w.center, w.idx, w.st, w.en, w.mid, w.text, {D('1.0')} - abs(w.mid - s.expected) / {D('420.0')} AS o,
  CASE WHEN len(s.general) > 0 THEN len(list_intersect(s.general, w.tokens)) / {D('len(s.general)')} ELSE 0.0 END AS l, CASE WHEN len(s.own) > 0 THEN len(list_intersect(s.own, w.tokens)) / {D('len(s.own)')} ELSE 0.0 END AS t
  FROM steps s JOIN w ON w.story_id = s.story_id AND abs(w.mid - s.expected) <= 420 WHERE len(list_intersect(s.own, w.tokens)) > 0 OR len(list_intersect(s.general, w.tokens)) >= 2),
op1 AS (SELECT *, {R4(f"{D('0.45')} * o + {D('0.20')} * l + {D('0.35')} * t")} AS conf, {R4('o')} AS o4, {R4('l')} AS l4, {R4('t')} AS t4 FROM op0),
opt AS (SELECT story_id, ci, step, idx, st, en, mid, text, conf, o4, l4, t4, row_number() OVER (PARTITION BY story_id, ci, step ORDER BY conf DESC, o4 DESC, l4 DESC, t4 DESC, center) AS k FROM op1
  UNION ALL SELECT story_id, ci, step, []::BIGINT[], greatest({D('0.0')}, expected - 37.5), least(duration, expected + 37.5), {D('0.5')} * (greatest({D('0.0')}, expected - 37.5) + least(duration, expected + 37.5)), '', 0, 0, 0, 0, 1
  FROM steps ANTI JOIN op1 USING (story_id, ci, step)),
pick AS (SELECT story_id, ci, step, idx, st, en, mid, text, conf, o4, l4, t4 FROM opt WHERE step = 0 AND k = 1 UNION ALL
  (SELECT z.story_id, z.ci, z.step, z.idx, z.st, z.en, z.mid, z.text, z.conf, z.o4, z.l4, z.t4 FROM (SELECT o.*, row_number() OVER (PARTITION BY o.story_id, o.ci ORDER BY CASE WHEN o.mid + 1e-6 >= p.mid THEN 0 ELSE 1 END, o.k) AS r
    FROM pick p JOIN opt o ON o.story_id = p.story_id AND o.ci = p.ci AND o.step = p.step + 1) z WHERE z.r = 1)),
al AS (SELECT p.*, CAST(3 * (dense_rank() OVER (PARTITION BY p.story_id ORDER BY p.ci) - 1) + p.step AS INT) AS ai, s.lo, s.scene, s.source, s.score, s.expected, s.general, {R3('p.st')} AS st3, {R3('p.en')} AS en3
  FROM pick p JOIN steps s ON s.story_id = p.story_id AND s.ci = p.ci AND s.step = p.step)"""

ALIGNMENTS = f"""WITH RECURSIVE {FILM}
SELECT story_id, ai AS alignment_index, ci AS candidate_index, 'obj ' || lo AS object_id, scene AS scene_idx, st3 AS aligned_start_sec, en3 AS aligned_end_sec, {R3('expected')} AS expected_time_sec, {D('conf')} AS confidence,
  array_to_string(idx, '|') AS subtitles, array_to_string(general, '|') AS terms, {D('o4')} AS order_score, {D('l4')} AS lexical_overlap, {D('t4')} AS object_overlap FROM al"""

#: Roles and tags of a step, as in the query.
STEP_TAGS = "CASE step WHEN 0 THEN ['setup_candidate'] WHEN 1 THEN ['scene_inventory_loose_match', 'action_supported_match'] ELSE ['payoff_candidate', 'high_climax_scene'] END"

FILM_SEGMENTS = f"""WITH RECURSIVE {FILM},
seed AS (SELECT story_id, ai, ci, 'obj ' || lo AS object_id, source, scene, CASE step WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END AS role, {R3(f"greatest({D('0.0')}, st3 - 12)")} AS s, {R3(f"greatest(greatest({D('0.0')}, st3 - 12), en3 + 12)")} AS e,
  {R4(CLAMP(f"{D('0.56')} * score + {D('0.34')} * conf + (CASE step WHEN 0 THEN {D('0.08')} WHEN 1 THEN {D('0.05')} ELSE {D('0.14')} + {D('0.10')} END) - (CASE WHEN source = 'inventory_only' THEN {D('0.02')} ELSE {D('0.0')} END)"))} AS prio,
  conf, text, list_concat(['candidate_source:' || source], list_transform({STEP_TAGS}, lambda x: 'role:' || x), CASE WHEN t4 > 0 THEN ['subtitle_object_overlap'] ELSE [] END, CASE WHEN l4 > 0 THEN ['subtitle_lexical_overlap'] ELSE [] END) AS reasons
  FROM al WHERE conf >= 0.15 AND NOT (text <> '' AND t4 <= 0 AND l4 > 0)),
fl AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY story_id, object_id ORDER BY s, e, ai ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 8 THEN 1 ELSE 0 END AS f FROM seed),
isl AS (SELECT *, sum(f) OVER (PARTITION BY story_id, object_id ORDER BY s, e, ai ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island, row_number() OVER (ORDER BY s, e, ai) AS o FROM fl),
rs AS (SELECT story_id, object_id, island, string_agg(x, '|' ORDER BY f) AS reasons FROM (SELECT story_id, object_id, island, x, min(o * 100 + j) AS f FROM (
  SELECT story_id, object_id, island, o, unnest(reasons) AS x, generate_subscripts(reasons, 1) AS j FROM isl) GROUP BY story_id, object_id, island, x) GROUP BY story_id, object_id, island),
mg AS (SELECT story_id, object_id, island, arg_min(ci, o) AS ci, arg_min(source, o) AS source, list_sort(list(DISTINCT scene)) AS scenes, list_sort(list(DISTINCT ai)) AS als, max(role) AS role, min(s) AS s, max(e) AS e, max(prio) AS prio,
  max(conf) AS conf, CAST(count(DISTINCT CASE WHEN text <> '' THEN text END) AS INT) AS n_texts FROM isl GROUP BY story_id, object_id, island),
top AS (SELECT *, row_number() OVER (PARTITION BY story_id, object_id ORDER BY prio DESC, conf DESC, s) AS r FROM mg)
SELECT story_id, CAST(row_number() OVER (PARTITION BY story_id ORDER BY object_id, prio DESC, s) - 1 AS INT) AS segment_index, printf('cand%03d_%s_seg%03d', ci, object_id, scenes[1]) AS segment_id, ci AS candidate_index, object_id,
  source AS candidate_source, array_to_string(scenes, '|') AS scenes, array_to_string(als, '|') AS alignments, CASE role WHEN 3 THEN 'payoff' WHEN 2 THEN 'setup' ELSE 'reappearance' END AS segment_role, s AS segment_start_sec,
  e AS segment_end_sec, prio AS priority_score, {D('conf')} AS alignment_confidence_max, reasons, n_texts FROM top JOIN rs USING (story_id, object_id, island) WHERE r <= 4"""

FRAMES = f"""WITH {SEGMENTS},
k AS (SELECT CAST(user_id AS VARCHAR) AS story_id, 'u_' || user_id || '_' || island AS segment_id, CAST(i AS INT) AS sample_index, {D('segment_start')} + i * (({D('segment_end')} - {D('segment_start')}) / {D('3.0')}) AS t
  FROM seg, (VALUES (0), (1), (2), (3)) v(i)),
a AS (SELECT *, CAST(round_even(t * {D('0.25')}, 0) AS INT) AS target FROM k), fr AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS story_id, CAST(at_s // 4 AS INT) AS f FROM m),
n AS (SELECT a.*, f, row_number() OVER (PARTITION BY a.story_id, segment_id, sample_index ORDER BY abs(f - target), f) AS o FROM a JOIN fr USING (story_id))
SELECT story_id, segment_id, sample_index, {R3('t')} AS timestamp_sec, target AS target_frame_index, f AS frame_index, 'in/frame_' || f || '.JPG' AS source_path,
  'out/' || segment_id || printf('/sample_%02d_f%06d', sample_index, f) || '.jpg' AS output_path FROM n WHERE o = 1"""

REVIEW = f"""WITH {SEGMENTS},
s AS (SELECT CAST(user_id AS VARCHAR) AS story_id, 'o' || (island % 3) AS object_id, 'u_' || user_id || '_' || island AS segment_id, {D('segment_start')} AS st, {D('segment_end')} AS en, top_cents, n_events FROM seg),
b AS (SELECT *, row_number() OVER (PARTITION BY story_id, object_id ORDER BY top_cents DESC, n_events DESC, st, segment_id) AS r FROM s),
x AS (SELECT story_id, object_id, segment_id, (st + en) / 2 AS mid, greatest({D('0.0')}, (st + en) / 2 - 200) AS lo, least({D('4000000.0')}, (st + en) / 2 + 200) AS hi FROM b WHERE r = 1),
t AS (SELECT *, unnest(CASE WHEN hi = lo THEN [lo] WHEN (hi - lo) - floor((hi - lo) / 16) * 16 > 1e-3 THEN list_append(list_transform(range(0, CAST(floor((hi - lo) / 16) AS BIGINT) + 1), lambda i: lo + i * 16.0), hi)
  ELSE list_transform(range(0, CAST(floor((hi - lo) / 16) AS BIGINT) + 1), lambda i: lo + i * 16.0) END) AS ts FROM x),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY story_id, object_id ORDER BY ts) - 1 AS INT) AS i FROM t)
SELECT story_id, object_id, segment_id, {R3('mid')} AS center_sec, {R3('lo')} AS window_start_sec, {R3('hi')} AS window_end_sec, {CLOCK('lo')} AS window_start_hhmmss, {CLOCK('hi')} AS window_end_hhmmss, i AS sample_index,
  {R3('ts')} AS timestamp_sec, CAST(least(round_even(ts * 2, 0), 7999999) AS INT) AS frame_index, CAST(i // 20 AS INT) AS sheet FROM n"""


def _score(gap, first, last, climax, action, visual, state, confidence, coverage, *bonus) -> str:
    terms = [
        f"0.22 * least({gap} / 8.0, 1)", f"0.15 * (1 - {first} / 12.0)", f"0.15 * {last} / 12.0", f"0.16 * {climax} / 100.0", f"0.10 * {action}", f"0.08 * {visual}", f"0.05 * {state}", f"0.04 * {confidence}", f"0.04 * (1 - {coverage})", "0.03",
    ]
    return R4(" + ".join(D(f"({t})") for t in [*terms, *map(str, bonus)]))


CANDIDATES = f"""SELECT CAST(i AS INT) AS candidate_index, object_id, canonical_name, entity_type, candidate_source, possible_chekhov_score, 'high' AS possible_chekhov_label, reasons, setup, payoff, "chain", headings, roles, inventory, channels,
  CAST(gap AS INT) AS gap_jump, CAST(2 AS INT) AS freq_scenes, CAST(prior AS INT) AS prior, supports FROM (VALUES
(0, 'silver cup', 'silver cup', 'object', 'inventory_only', {_score(8, 3, 11, 75, '1.0', '1.0', '0.35', '0.75', '2 / 9.0', '0.04', '0.02')},
  'inventory_only_candidate|early_setup_scene|extreme_reappearance_gap|late_story_return|high_climax_payoff_scene|sparse_reoccurrence_pattern|action_central_object|state_changeable_object|scene_inventory_loose_reinforcement|action_channel_reinforcement',
  '3', '11', '3|11', 'INT. 3|INT. 11', 'setup_candidate+gap_anchor_a+scene_inventory_loose_match+action_supported_match|payoff_candidate+gap_anchor_b+high_climax_scene+scene_inventory_loose_match+action_supported_match', '3|11', 'action', 8, NULL, ''),
(1, 'torn diary', 'Torn Diary', 'artifact', 'inventory_with_stage1_prior', {_score(8, 2, 10, 100, '0.75', '0.5', '0.5', '0.75', '0.25', '0.04', '0.03')},
  'stage1_prior_support|early_setup_scene|extreme_reappearance_gap|late_story_return|high_climax_payoff_scene|sparse_reoccurrence_pattern|action_central_object|state_changeable_object|scene_inventory_loose_reinforcement|dialogue_only_support'
  || '|stage1_fallback_candidate|long_reappearance_gap|action_channel_reinforcement|dedup_merged_support',
  '2', '9|10', '2|9|10', 'INT. 2|INT. 9|INT. 10', 'setup_candidate+gap_anchor_a+action_supported_match|high_climax_scene+scene_inventory_loose_match+dialogue_only_match+payoff_candidate+gap_anchor_b'
  || '|payoff_candidate+gap_anchor_b+high_climax_scene+action_supported_match+scene_inventory_loose_match', '2|9|10', 'action|dialogue', 8, 0, '0|1'),
(2, 'sword', 'Sword', 'artifact', 'stage1_fallback', {_score(10, 1, 11, 75, '0.75', '0.5', '0.5', '0.5', '0.25', '0.03')},
  'stage1_fallback_candidate|stage1_prior_support|early_setup_scene|extreme_reappearance_gap|late_story_return|high_climax_payoff_scene|sparse_reoccurrence_pattern|action_central_object|state_changeable_object',
  '1', '11', '1|11', 'CLIMAX 1|INT. 11', 'setup_candidate+gap_anchor_a|payoff_candidate+gap_anchor_b+high_climax_scene', '', '', 10, 2, '2')
) v(i, object_id, canonical_name, entity_type, candidate_source, possible_chekhov_score, reasons, setup, payoff, "chain", headings, roles, inventory, channels, gap, prior, supports)"""

INVENTORY = f"""SELECT CAST(scene AS INT) AS scene_idx, CAST(0 AS INT) AS pos, object_id, canonical_name, forms, channels, aliases, category, true AS direct_visual_evidence, {D('strength')} AS mention_strength_max, {D('sure')} AS confidence_max, evidence,
  keep AS tracking_keep_any FROM (VALUES
(0, 'diary', 'the diary', 'diary|it|the diary', 'action|dialogue', 'diary|it|old diary', 'object', 1.0, 0.75, 'a|b|c|e|Bring the diary.', true),
(1, 'sword', 'sword', 'sword', 'action|dialogue', 'sword', 'weapon', 0.5, 0.3, 'Take the sword and run.', true)
) v(scene, object_id, canonical_name, forms, channels, aliases, category, strength, sure, evidence, keep)"""


def oracle_sql() -> dict[str, str]:
    return {
        "stage1_reappearances": STAGE1, "scene_alignments": ALIGNMENTS, "film_segments": FILM_SEGMENTS, "frame_samples": FRAMES, "review_windows": REVIEW,
    }


def literal_sql() -> dict[str, str]:
    return {"candidate_story": CANDIDATES, "inventory_story": INVENTORY}
