"""DuckDB SQL of the narrative queries, to compare results with."""

from __future__ import annotations

from storyloom.functions.text import CLAUSE_WORDS, DETERMINERS, GENERIC_ALIASES, JUNK_LINES, NOUN_AFTER_DETERMINER, STOPWORDS, TITLE_CASE_NAME, VAGUE_NAMES
from storyloom.queries import MIN_GAP


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


MENTIONS = """
m AS (SELECT event_id, user_id, event_type, CAST(floor((epoch_us(ts) - 1704067200000000) / 1000000) AS BIGINT) AS at_s,
  CAST(floor(floor((epoch_us(ts) - 1704067200000000) / 1000000) / 3600) AS BIGINT) AS scene, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events)"""


def max_gaps_sql(name: str, source: str, keys: str, position: str) -> str:
    return f"""
{name}_d AS (SELECT DISTINCT {keys}, {position} AS p FROM {source}),
{name}_n AS (SELECT *, lead(p) OVER (PARTITION BY {keys} ORDER BY p) AS n FROM {name}_d),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n - p DESC NULLS LAST, p) AS r, count(*) OVER (PARTITION BY {keys}) AS freq,
  min(p) OVER (PARTITION BY {keys}) AS lo, max(p) OVER (PARTITION BY {keys}) AS hi FROM {name}_n),
{name} AS (SELECT {keys}, n - p AS gap_jump, greatest(n - p - 1, 0) AS gap_absent, p AS a, n AS b, freq, lo, hi, freq / (hi - lo + 1) AS coverage FROM {name}_r WHERE r = 1 AND freq >= 2)"""


GAPS = MENTIONS + "," + max_gaps_sql("g0", "m", "user_id, event_type", "scene") + f", g AS (SELECT * FROM g0 WHERE gap_jump >= {MIN_GAP})"

#: Object key and spoken names of a sentence.
DET = "|".join(DETERMINERS)
KEY = lambda c: (
    rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '^(?:{DET})\s+', ''), '[^\p{{L}}\p{{N}}_\s'']+', '', 'g'), '\s+', ' ', 'g'))"
)
ALIAS = lambda c: (
    rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '^(?:the|a|an)\s+', ''), '[^\p{{L}}\p{{N}}_\s'']+', '', 'g'), '\s+', ' ', 'g'))"
)
TURN_MENTIONS = rf"""
s0 AS (SELECT conv_id, turn, role, string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM conversations),
s1 AS (SELECT conv_id, turn, role, unnest(ss) AS raw, generate_subscripts(ss, 1) AS i FROM s0),
s2 AS (SELECT conv_id, turn, role, i, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS sentence FROM s1 WHERE regexp_replace(raw, '^\s+|\s+$', '', 'g') <> ''),
s2a AS (SELECT *, regexp_replace(sentence, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}]', '_', 'g') AS plain FROM s2), -- word borders know ASCII only
s3 AS (SELECT *, list_concat(regexp_extract_all(plain, {_q(NOUN_AFTER_DETERMINER)}, 1), regexp_extract_all(plain, {_q(TITLE_CASE_NAME)}, 1)) AS names FROM s2a),
s4 AS (SELECT conv_id, turn, role, i, sentence, unnest(names) AS raw, generate_subscripts(names, 1) AS j FROM s3),
s5 AS (SELECT conv_id, turn, role, i, j, sentence, trim(string_split(regexp_replace(trim(raw), '\b(?:{'|'.join(CLAUSE_WORDS)})\b', chr(1)), chr(1))[1], ' ,.;:!?()[]{{}}"''') AS name FROM s4),
s6 AS (SELECT *, {KEY('name')} AS object_id FROM s5),
t AS (SELECT * FROM s6 WHERE length(object_id) >= 3 AND object_id NOT IN ({_list(VAGUE_NAMES)}))"""

TOKENS = lambda c: rf"list_distinct(list_filter(regexp_extract_all(lower({c}), '([a-z0-9'']+)', 1), lambda x: length(x) > 1 AND x NOT IN ({_list(STOPWORDS)})))"

WINDOWS = f"""
u AS (SELECT conv_id, turn, conv_id * 80.0 + turn * 10.0 AS s, conv_id * 80.0 + turn * 10.0 + 8.0 AS e, coalesce(text, '') AS text FROM conversations),
w AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS center_index, list(turn) OVER k AS idx, CAST(first_value(s) OVER k AS DOUBLE) AS start_sec,
  CAST(last_value(e) OVER k AS DOUBLE) AS end_sec, CAST(0.5 * (s + e) AS DOUBLE) AS center_sec, array_to_string(list(text) OVER k, ' ') AS text
  FROM u WINDOW k AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
wt AS (SELECT *, {TOKENS('text')} AS tokens FROM w)"""

ALIGNED = f"""{WINDOWS},
items AS (SELECT item_id, CAST(item_id * 400.0 AS DOUBLE) AS expected, {TOKENS("coalesce(text, '')")} AS terms FROM benchmark),
met AS (SELECT item_id, conv_id, center_index, center_sec, expected, len(terms) AS n_terms, len(list_intersect(terms, tokens)) AS shared FROM items JOIN wt ON abs(center_sec - expected) <= 420),
al AS (SELECT *, CAST(floor((CAST(0.45 AS DOUBLE) * (CAST(1.0 AS DOUBLE) - abs(center_sec - expected) / CAST(420.0 AS DOUBLE)) + CAST(0.55 AS DOUBLE) * (shared / n_terms)) * 1000000) AS BIGINT) AS confidence_micro
  FROM met WHERE shared >= 2)"""

SEGMENTS = f"""{MENTIONS},
seed AS (SELECT user_id, event_id, at_s - 720 AS s, at_s + 720 AS e, cents FROM m),
fl AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 480 THEN 1 ELSE 0 END AS f FROM seed),
isl AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM fl),
seg AS (SELECT user_id, CAST(island AS INT) AS island, count(*) AS n_events, min(s) AS segment_start, max(e) AS segment_end, max(cents) AS top_cents, min(event_id) AS first_event FROM isl GROUP BY user_id, island)"""

CLOCK = lambda c: f"printf('%02d:%02d:%02d', CAST(round_even({c}, 0) AS BIGINT) // 3600, (CAST(round_even({c}, 0) AS BIGINT) % 3600) // 60, CAST(round_even({c}, 0) AS BIGINT) % 60)"

TURN_WORDS = f"""
t0 AS (SELECT conv_id, turn, role, {TOKENS("coalesce(text, '')")} AS words FROM conversations), t1 AS (SELECT conv_id, turn, role, unnest(words) AS object_id FROM t0),
t AS (SELECT * FROM t1 WHERE length(object_id) >= 5)"""

PRIORS = f"""{TURN_WORDS},
gk AS (SELECT DISTINCT conv_id, turn, object_id FROM t WHERE role = 'user' AND object_id NOT IN ({_list(GENERIC_ALIASES)})),
ev AS (SELECT conv_id, object_id, min(turn) AS a, max(turn) AS b, count(DISTINCT turn) AS n FROM t WHERE role = 'assistant' GROUP BY conv_id, object_id),
al AS (SELECT *, {ALIAS('object_id')} AS alias FROM ev),
hit AS (SELECT gk.conv_id, gk.turn, al.object_id AS entity_key, al.b - al.a AS gap_jump, al.n, al.alias FROM gk JOIN al ON gk.conv_id = al.conv_id AND gk.object_id = al.alias
  WHERE al.alias NOT IN ({_list(GENERIC_ALIASES)})),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY len(string_split(alias, ' ')) DESC, length(alias) DESC, gap_jump DESC, n DESC, entity_key) AS r FROM hit)"""


def oracle_sql() -> dict[str, str]:
    from storyloom import group_oracles, stage_oracles

    clamp = lambda x: f"least(greatest({x}, CAST(0.0 AS DOUBLE)), CAST(1.0 AS DOUBLE))"
    d = lambda x: f"CAST({x} AS DOUBLE)"
    return {
        "reappearance_gaps": f"""WITH {GAPS},
mean AS (SELECT user_id, event_type, count(*) AS mentions, CAST(sum(cents) AS BIGINT) AS total FROM m GROUP BY user_id, event_type),
x AS (SELECT *, total / mentions / {d('50000.0')} AS v FROM g JOIN mean USING (user_id, event_type)),
y AS (SELECT user_id, event_type, gap_jump, gap_absent, a AS scene_a, b AS scene_b, freq, coverage, mentions,
  CAST(floor(({d('2.0')} * gap_jump + {d('50.0')} * v + {d('30.0')} * v + {d('20.0')} * v) * 1000) AS BIGINT) AS score_milli FROM x)
SELECT * FROM y ORDER BY score_milli DESC, user_id, event_type LIMIT 100""",
        "gap_levels": f"""WITH {GAPS}, q AS (SELECT event_type, quantile_cont(gap_jump, 0.5) AS q50, quantile_cont(gap_jump, 0.75) AS q75 FROM g GROUP BY event_type)
SELECT user_id, event_type, gap_jump, q50, q75, CASE WHEN gap_jump <= q50 THEN 'medium' WHEN gap_jump <= q75 THEN 'long' ELSE 'extreme' END AS gap_level FROM g JOIN q USING (event_type)""",
        "majority_label_top_forms": """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY user_id, event_type),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM c)
SELECT user_id, max(CASE WHEN r = 1 THEN event_type END) AS label, string_agg(event_type, ',' ORDER BY r) AS top_forms FROM r WHERE r <= 3 GROUP BY user_id""",
        "dense_active_index": """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey) - 1 AS BIGINT) ELSE -1 END AS active_index FROM orders""",
        "line_blocks": """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
f AS (SELECT *, length(line) < 12 OR regexp_matches(line, '^\\s*$') AS blank FROM l),
b AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f),
g AS (SELECT doc_id, k, count(*) AS n, string_agg(line, ' ' ORDER BY i) AS t FROM b WHERE NOT blank GROUP BY doc_id, k)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS block_no, CAST(n AS INT) AS n_lines, md5(t) AS text_md5 FROM g""",
        "line_kinds": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), s AS (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS sq FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE sq <> '' AND regexp_matches(line, {_q('(?i)' + '|'.join(JUNK_LINES))})) AS n_junk,
  count(*) FILTER (WHERE length(sq) BETWEEN 2 AND 32 AND sq NOT IN ('CUT TO', 'DISSOLVE TO', 'FADE IN', 'FADE OUT', 'MONTAGE', 'OMITTED') AND regexp_matches(sq, '^[A-Z][A-Z \\-''.]+$')) AS n_speakers FROM s GROUP BY doc_id""",
        "script_scenes": """WITH x AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 0 AS scene_idx, 0 AS scene_idx_non_omitted, '1' AS scene_label_raw, 1 AS scene_label_int, 'INT.' AS marker_type, 'INT. FIRST PLACE - DAY' AS heading, 1 AS page_start, 1 AS page_end, CAST(n + 3 AS INT) AS n_lines, 12 AS dialogue_chars FROM x
UNION ALL SELECT doc_id, 1, -1, '2', 2, 'OMITTED', 'OMITTED 2', 2, 2, 0, 0 FROM x
UNION ALL SELECT doc_id, 2, 1, '3A', 3, 'EXT/INT.', 'EXT/INT. LAST - NIGHT', 2, 2, 1, 0 FROM x""",
        "dialogue_mentions": f"""WITH {TURN_MENTIONS},
o AS (SELECT conv_id, turn, object_id, arg_min(name, i * 10000 + j) AS canonical_name, CAST(count(DISTINCT name) AS INT) AS n_forms FROM t WHERE role = 'user' GROUP BY conv_id, turn, object_id),
e0 AS (SELECT conv_id, turn, object_id, sentence, min(i * 10000 + j) AS f FROM t WHERE role = 'user' GROUP BY conv_id, turn, object_id, sentence),
e1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, object_id ORDER BY f) AS r FROM e0),
e AS (SELECT conv_id, turn, object_id, md5(string_agg(sentence, chr(10) ORDER BY r)) AS evidence_md5 FROM e1 WHERE r <= 3 GROUP BY conv_id, turn, object_id)
SELECT conv_id, CAST(turn AS INT) AS turn, object_id, canonical_name, n_forms, evidence_md5 FROM o JOIN e USING (conv_id, turn, object_id)""",
        "channel_merge": f"""WITH {TURN_MENTIONS},
b AS (SELECT DISTINCT conv_id, turn, object_id, CASE role WHEN 'user' THEN 'dialogue' ELSE 'action' END AS channel FROM t WHERE role IN ('user', 'assistant'))
SELECT conv_id, object_id, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, count(*) AS n_mentions, CAST(min(turn) AS INT) AS first_turn, bool_or(channel = 'action') AS acted FROM b GROUP BY conv_id, object_id""",
        "alias_components": """WITH RECURSIVE l AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE length(line) >= 20),
s AS (SELECT line, min(doc_id) AS f FROM l GROUP BY line HAVING count(*) >= 2),
e AS (SELECT DISTINCT f AS a, doc_id AS b FROM l JOIN s USING (line) WHERE f <> doc_id), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.node, x.b FROM r JOIN both_ways x ON r.root = x.a)
SELECT node AS doc_id, min(root) AS component FROM r GROUP BY node""",
        "best_prior": f"WITH {PRIORS} SELECT conv_id, CAST(turn AS INT) AS turn, entity_key, CAST(gap_jump AS INT) AS gap_jump, 1 AS n_shared FROM best WHERE r = 1",
        "unmatched_events": f"""WITH {PRIORS} SELECT conv_id, object_id AS entity_key, CAST(b - a AS INT) AS gap_jump FROM ev
WHERE NOT EXISTS (SELECT 1 FROM best WHERE r = 1 AND best.conv_id = ev.conv_id AND best.entity_key = ev.object_id)""",
        "scene_chain_score": f"""WITH {TURN_WORDS},{max_gaps_sql('g', 't', 'conv_id, object_id', 'turn')},
c AS (SELECT conv_id, turn, least(CAST(floor(length(text) / 20) AS INT), 100) AS climax FROM conversations), tot AS (SELECT conv_id, max(turn) + 1 AS total FROM c GROUP BY conv_id),
q AS (SELECT conv_id, quantile_cont(gap_jump, 0.75) AS q75 FROM g GROUP BY conv_id), ac AS (SELECT conv_id, object_id, bool_or(role = 'assistant') AS acted FROM t GROUP BY conv_id, object_id),
lt AS (SELECT g.conv_id, g.object_id, max(climax) AS climax FROM g JOIN (SELECT DISTINCT conv_id, object_id, turn FROM t) k ON g.conv_id = k.conv_id AND g.object_id = k.object_id AND k.turn >= g.b
  JOIN c ON c.conv_id = k.conv_id AND c.turn = k.turn GROUP BY g.conv_id, g.object_id),
x AS (SELECT *, {d('greatest(total - 1, 1)')} AS dd, CASE WHEN acted THEN {d('0.8')} ELSE {d('0.35')} END AS act FROM g JOIN tot USING (conv_id) JOIN q USING (conv_id) JOIN ac USING (conv_id, object_id) JOIN lt USING (conv_id, object_id)),
y AS (SELECT *, {d('0.22')} * {clamp('gap_jump / greatest(q75, CAST(1.0 AS DOUBLE))')} + {d('0.15')} * {clamp(d('1.0') + ' - lo / dd')} + {d('0.15')} * {clamp('hi / dd')} + {d('0.16')} * {clamp('climax / ' + d('100.0'))}
  + {d('0.10')} * act + {d('0.08')} * {d('0.4')} + {d('0.05')} * {d('0.35')} + {d('0.04')} * {d('0.3')} + {d('0.04')} * {clamp(d('1.0') + ' - coverage')}
  + {d('0.03')} * (CASE WHEN freq <= 5 THEN {d('1.0')} ELSE {clamp(d('1.0') + ' - (freq - 5) / ' + d('10.0'))} END) + {d('0.04')} + (CASE WHEN acted THEN {d('0.02')} ELSE {d('0.0')} END) + {d('0.0')} AS s FROM x)
SELECT conv_id, object_id, CAST(gap_jump AS INT) AS gap_jump, freq, climax, CAST(floor({clamp('s')} * 1000000) AS BIGINT) AS score_micro FROM y""",
        "subtitle_windows": f"WITH {WINDOWS} SELECT conv_id, center_index, array_to_string(idx, ',') AS segments, start_sec, end_sec, center_sec, CAST(len(tokens) AS INT) AS n_tokens FROM wt",
        "coarse_alignment": f"""WITH {ALIGNED}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY confidence_micro DESC, conv_id, center_index) AS r FROM al)
SELECT item_id, conv_id, center_index, CAST(shared AS INT) AS shared, confidence_micro FROM r WHERE r = 1""",
        "monotone_alignment": f"""WITH RECURSIVE {ALIGNED},
st AS (SELECT item_id, CAST(floor(item_id / 8) AS BIGINT) AS chain FROM al GROUP BY item_id), sn AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY item_id) AS step FROM st),
op AS (SELECT sn.chain, sn.step, al.item_id, conv_id, center_index, center_sec, row_number() OVER (PARTITION BY al.item_id ORDER BY confidence_micro DESC, conv_id, center_index, center_sec) AS k FROM al JOIN sn USING (item_id)),
p AS (SELECT chain, 1 AS step, item_id, conv_id, center_index, center_sec FROM op WHERE step = 1 AND k = 1
  UNION ALL (SELECT z.chain, CAST(z.step AS INT), z.item_id, z.conv_id, z.center_index, z.center_sec FROM (
    SELECT op.*, row_number() OVER (PARTITION BY op.chain ORDER BY CASE WHEN op.center_sec + 1e-6 >= p.center_sec THEN 0 ELSE 1 END, op.k) AS pick FROM p JOIN op ON op.chain = p.chain AND op.step = p.step + 1) z WHERE z.pick = 1))
SELECT chain, item_id, conv_id, center_index, center_sec FROM p""",
        "merge_segments": f"WITH {SEGMENTS} SELECT * FROM seg",
        "top_segments": f"WITH {SEGMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY top_cents DESC, n_events DESC, segment_start) AS r FROM seg) SELECT * EXCLUDE (r) FROM r WHERE r <= 4",
        "nearest_frame": f"""WITH {SEGMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY top_cents DESC, n_events DESC, segment_start) AS r FROM seg),
k AS (SELECT user_id, island, sample, segment_start + CAST(floor((segment_end - segment_start) * sample / 2) AS BIGINT) AS target FROM r, (VALUES (0), (1), (2)) v(sample) WHERE r <= 4),
n AS (SELECT k.*, at_s, row_number() OVER (PARTITION BY k.user_id, island, sample ORDER BY abs(at_s - target), at_s) AS o FROM k JOIN (SELECT DISTINCT user_id, at_s FROM m) x ON x.user_id = k.user_id)
SELECT user_id, island, sample, target, at_s AS nearest_at FROM n WHERE o = 1""",
        "centered_windows": f"""WITH {MENTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, event_id) AS r, {d('((at_s % 86400) + 86400) % 86400')} AS c FROM m),
x AS (SELECT user_id, event_id, c, greatest({d('0.0')}, c - 90) AS lo, least({d('86400.0')}, c + 90) AS hi FROM r WHERE r = 1)
SELECT user_id, event_id, c AS center_sec, lo AS window_start_sec, hi AS window_end_sec, {CLOCK('lo')} AS window_start_hhmmss, {CLOCK('hi')} AS window_end_hhmmss FROM x""",
        "sample_plan": f"""WITH {SEGMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY top_cents DESC, segment_start) AS r FROM seg),
k AS (SELECT user_id, sample, {d('segment_start')} + sample * (({d('segment_end')} - {d('segment_start')}) / {d('4.0')}) AS "time" FROM r, (VALUES (0), (1), (2), (3), (4)) v(sample) WHERE r = 1)
SELECT user_id, sample, "time", CAST(round_even("time" * {d('0.125')}, 0) AS BIGINT) AS frame FROM k""",
        "legacy_gap_dedup": f"""WITH {MENTIONS}, n AS (SELECT *, (CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END) || '-' || user_id AS name FROM m),{max_gaps_sql('g', 'n', 'user_id, name', 'scene')},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') ORDER BY gap_jump DESC, name) AS r FROM g)
SELECT user_id, name, gap_jump, a AS position_a, b AS position_b FROM r WHERE r = 1""",
        "event_inspector": f"""WITH {GAPS} SELECT event_type || ' ' || user_id AS name, event_type AS category, CAST(gap_jump AS INT) AS gap, a AS scene_a, b AS scene_b FROM g
WHERE gap_jump >= {MIN_GAP + 10} AND contains(lower(event_type || ' ' || user_id), 'c') ORDER BY gap DESC, name DESC""",
        "event_gap_stats": f"""WITH {GAPS}, s AS (SELECT event_type, count(*) AS n, list(gap_jump ORDER BY gap_jump) AS l FROM g GROUP BY event_type)
SELECT event_type AS kind, n AS events, CAST(l[1] AS INT) AS gap_min, CAST(l[len(l)] AS INT) AS gap_max, CAST(1 AS BIGINT) AS categories, CAST(l[n // 2 + 1] AS INT) AS gap_median FROM s""",
        "annotation_cache": """WITH k AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.text IS NOT DISTINCT FROM d.text) THEN 'cached' ELSE 'words=' || len(string_split(coalesce(text, ''), ' ')) END AS response FROM documents d""",
    } | stage_oracles.oracle_sql() | group_oracles.oracle_sql()
