"""DuckDB SQL of the queries in which rows are taken for one in order, replayed one after another by recursion, and of those over whole tables as one story."""

from __future__ import annotations

from storyloom.functions.text import GENERIC_ALIASES
from storyloom import oracles
from storyloom.oracles import _list

TOKENS = lambda c: oracles.TOKENS(c).replace("x -> ", "lambda x: ")
NAMES = f"""
t AS (SELECT conv_id, turn, role, list_sort(list_distinct(list_filter({TOKENS("coalesce(text, '')")}, lambda x: length(x) >= 3))) AS names FROM conversations),
p0 AS (SELECT conv_id, turn, role, names, unnest(range(0, len(names), 2)) AS i FROM t),
p AS (SELECT conv_id, turn, role, CAST(i // 2 AS INT) AS pos, names[i + 1] AS one, names[i + 2] AS other FROM p0)"""
GENERIC = lambda x: f"({x} = '' OR {x} IN ({_list(GENERIC_ALIASES)}))"
#: How telling a key is, as one number.
RANK = lambda x: f"CASE WHEN {x} = '' THEN -1 ELSE (CASE WHEN {x} IN ({_list(GENERIC_ALIASES)}) THEN 0 ELSE 100000000 END) + len(string_split({x}, ' ')) * 10000 + length({x}) END"


def replay(rows: str) -> str:
    """``placed(story, n, first, place)`` of ``rows(story, n, names)``, n from 1 without gaps: groups hold their rows in the order in which they came together."""
    return f"""
replay(story, n, groups) AS (SELECT DISTINCT story, CAST(0 AS BIGINT), []::STRUCT(names VARCHAR[], held BIGINT[])[] FROM {rows}
  UNION ALL SELECT story, n, CASE WHEN len(hits) = 0 THEN list_append(groups, {{'names': names, 'held': [n]}}) ELSE
    [CASE WHEN i = hits[1] THEN {{'names': list_distinct(list_concat(flatten([groups[h].names for h in hits]), names)), 'held': list_append(flatten([groups[h].held for h in hits]), n)}} ELSE groups[i] END
      for i in range(1, len(groups) + 1) if i = hits[1] OR NOT list_contains(hits, i)] END
    FROM (SELECT s.story, r.n, s.groups, r.names, [i for i in range(1, len(s.groups) + 1) if list_has_any(s.groups[i].names, r.names)] AS hits FROM replay s JOIN {rows} r ON r.story = s.story AND r.n = s.n + 1)),
last_state AS (SELECT story, groups FROM replay QUALIFY row_number() OVER (PARTITION BY story ORDER BY n DESC) = 1),
held AS (SELECT story, unnest(groups).held AS rows_in FROM last_state),
placed AS (SELECT story, rows_in[1] AS first, unnest(rows_in) AS n, generate_subscripts(rows_in, 1) AS place FROM held)"""


STORY_GROUPS = f"""WITH RECURSIVE {NAMES},
o AS (SELECT *, list_distinct(list_filter([one, other], lambda x: x IS NOT NULL)) AS aliases FROM p),
o1 AS (SELECT *, list_filter(aliases, lambda x: NOT {GENERIC('x')}) AS names FROM o),
r AS (SELECT *, conv_id AS story, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS n FROM o1 WHERE len(names) > 0),{replay('r')},
m AS (SELECT r.*, placed.first, placed.place, CASE WHEN length(one) > 4 THEN 'artifact' ELSE 'object' END AS kind FROM r JOIN placed USING (story, n)),
base AS (SELECT story, first, arg_min(turn, place) AS first_turn, arg_min(pos, place) AS first_pos, arg_max(one, ({RANK('one')}) * 1000000 - place) AS canonical_name, list_sort(list_distinct(flatten(list(aliases)))) AS names,
  list_sort(list_distinct(list(turn))) AS turns, min(turn) AS t0 FROM m GROUP BY story, first),
kinds AS (SELECT story, first, kind FROM m GROUP BY story, first, kind QUALIFY row_number() OVER (PARTITION BY story, first ORDER BY count(*) DESC, min(place)) = 1),
told AS (SELECT story, first, turn, one, min(place) AS f FROM m GROUP BY story, first, turn, one),
said0 AS (SELECT story, first, turn, place * 2 AS f, one || '!' AS e FROM m UNION ALL SELECT story, first, turn, place * 2 + 1, coalesce(other, one) || '?' FROM m),
said AS (SELECT story, first, turn, e, min(f) AS f FROM said0 GROUP BY story, first, turn, e QUALIFY row_number() OVER (PARTITION BY story, first, turn ORDER BY min(f)) <= 4),
scene AS (SELECT story, first, turn, max(length(one) / 16.0::DOUBLE) AS strength, bool_or(role <> 'user') AS direct, any_value(role) AS role FROM m GROUP BY story, first, turn)
SELECT b.story AS conv_id, CAST(first_turn AS INT) AS first_turn, first_pos, canonical_name, kind AS entity_type, array_to_string(b.names, '|') AS names, array_to_string(turns, ',') AS turns,
  (SELECT string_agg(one, '|' ORDER BY f) FROM told x WHERE x.story = b.story AND x.first = b.first AND x.turn = b.t0) AS objects, (SELECT string_agg(e, '|' ORDER BY f) FROM said x WHERE x.story = b.story AND x.first = b.first AND x.turn = b.t0) AS evidence,
  CASE WHEN s.role = 'user' THEN 'dialogue' ELSE 'action' END AS channels, s.direct, s.strength
FROM base b JOIN kinds k ON k.story = b.story AND k.first = b.first JOIN scene s ON s.story = b.story AND s.first = b.first AND s.turn = b.t0"""

ROLE_INVENTORY = f"""WITH RECURSIVE {NAMES},
o AS (SELECT *, conv_id * 4 + CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS story, turn % 3 AS channel, turn * 10000 + pos AS spot, list_distinct(list_filter([one, other], lambda x: x IS NOT NULL)) AS names FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY channel, spot) AS n FROM o),{replay('r')},
m AS (SELECT r.*, placed.first, placed.place, CASE WHEN length(one) > 4 THEN 'artifact' ELSE 'object' END AS kind FROM r JOIN placed USING (story, n)),
base AS (SELECT story, first, arg_max(one, length(one) * 1000000 - place) AS canonical_name, list_sort(list_distinct(flatten(list(names)))) AS names, max(length(one) / 16.0::DOUBLE) AS strength, bool_or(pos % 5 = 0) AS direct, bool_or(pos % 7 = 0) AS keep,
  arg_min(channel * 4294967296 + spot, place) AS began, string_agg(DISTINCT CASE WHEN channel = 0 THEN 'action' ELSE 'dialogue' END, '|' ORDER BY CASE WHEN channel = 0 THEN 'action' ELSE 'dialogue' END) AS channels FROM m GROUP BY story, first),
kinds AS (SELECT story, first, kind FROM m GROUP BY story, first, kind QUALIFY row_number() OVER (PARTITION BY story, first ORDER BY count(*) DESC, min(place)) = 1),
forms AS (SELECT story, first, string_agg(other, '|' ORDER BY f) AS forms FROM (SELECT story, first, other, min(place) AS f FROM m WHERE other IS NOT NULL GROUP BY story, first, other) GROUP BY story, first),
said AS (SELECT story, first, string_agg(one || '!', '|' ORDER BY f) AS evidence FROM (SELECT story, first, one, min(place) AS f FROM m GROUP BY story, first, one QUALIFY row_number() OVER (PARTITION BY story, first ORDER BY min(place)) <= 5) GROUP BY story, first)
SELECT b.story // 4 AS conv_id, CAST(b.story % 4 AS INT) AS role_no, CAST(row_number() OVER (PARTITION BY b.story ORDER BY round(strength, 4) DESC, canonical_name DESC, began) - 1 AS INT) AS pos, canonical_name AS object_id, canonical_name,
  coalesce(forms, '') AS forms, channels, array_to_string(names, '|') AS names, kind AS category, direct, round(strength, 4) AS strength, evidence, keep
FROM base b JOIN kinds k ON k.story = b.story AND k.first = b.first JOIN said s ON s.story = b.story AND s.first = b.first LEFT JOIN forms f ON f.story = b.story AND f.first = b.first"""

CLUSTER = "STRUCT(id VARCHAR, name VARCHAR, names VARCHAR[], force BIGINT, events STRUCT(e INTEGER, gap INTEGER, name VARCHAR, alias VARCHAR)[], held INTEGER[])[]"
WEIGHT = lambda x: f"{x}.gap * 1000000000::BIGINT + {RANK(f'{x}.name')}"
CANDIDATE_DEDUP = f"""WITH RECURSIVE {NAMES.split(',' + chr(10) + 'p0')[0]},
c AS (SELECT conv_id, turn, names[1] AS id, CASE WHEN len(names) > 1 THEN names[1] || ' ' || names[2] ELSE names[1] END AS name, least(len(names), 16) * 100 + len(names) % 5 AS force,
  CASE WHEN len(names) > 3 THEN [{{'e': CAST(turn // 2 AS INTEGER), 'gap': CAST(len(names) % 7 AS INTEGER), 'name': names[3], 'alias': names[4]}}] ELSE [] END AS events,
  list_distinct(list_filter([names[1], CASE WHEN len(names) > 1 THEN names[1] || ' ' || names[2] ELSE names[1] END, CASE WHEN len(names) > 3 THEN names[3] END, names[4]], lambda x: x IS NOT NULL)) AS names,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM t WHERE len(names) > 0),
fold(conv_id, n, cl) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), []::{CLUSTER} FROM c
  UNION ALL SELECT conv_id, n, CASE WHEN hit IS NULL THEN list_append(cl, {{'id': id, 'name': name, 'names': names, 'force': force, 'events': events, 'held': [turn]}}) ELSE
    [CASE WHEN i = hit THEN {{'id': new_id, 'name': called, 'names': list_distinct(list_filter(list_concat([new_id, called], flatten([[x.name, x.alias] for x in ev])), lambda x: x <> '')), 'force': greatest(force, k.force), 'events': ev, 'held': list_append(k.held, turn)}} ELSE cl[i] END
      for i in range(1, len(cl) + 1)] END
    FROM (SELECT *, CASE WHEN NOT {GENERIC('called')} THEN called ELSE coalesce(list_sort([{{'r': -({RANK('x')}), 'x': x}} for x in known if NOT {GENERIC('x')}])[1].x, nullif(called, ''), list_min(known), '') END AS new_id
      FROM (SELECT *, CASE WHEN len(ev) > 0 AND {RANK('best.name')} > {RANK('heard')} THEN best.name ELSE heard END AS called
        FROM (SELECT *, list_sort([{{'w': -({WEIGHT('x')}), 'e': x.e, 'name': x.name}} for x in ev])[1] AS best, list_distinct(list_concat(k.names, names)) AS known,
          CASE WHEN force > k.force THEN CASE WHEN {RANK('k.name')} > {RANK('name')} THEN k.name ELSE name END ELSE CASE WHEN {RANK('name')} > {RANK('k.name')} THEN name ELSE k.name END END AS heard
          FROM (SELECT *, list_concat([x for x in k.events if NOT list_has_any([y.e for y in events if {WEIGHT('y')} > {WEIGHT('x')}], [x.e])],
              [y for y in events if NOT list_has_any([x.e for x in k.events if {WEIGHT('x')} >= {WEIGHT('y')}], [y.e])]) AS ev
            FROM (SELECT *, cl[hit] AS k FROM (SELECT s.conv_id, c.n, s.cl, c.turn, c.id, c.name, c.names, c.force, c.events, list_min([i for i in range(1, len(s.cl) + 1) if s.cl[i].id = c.id
                OR list_has_any(s.cl[i].names, [x for x in c.names if NOT {GENERIC('x')}])]) AS hit FROM fold s JOIN c ON c.conv_id = s.conv_id AND c.n = s.n + 1))))))),
done AS (SELECT conv_id, unnest(cl) AS x FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)
SELECT conv_id, CAST(unnest(x.held) AS BIGINT) AS turn, CAST(x.held[1] AS BIGINT) AS cluster_turn, len(x.held) = 1 AS alone, x.name AS told_name, x.id AS told_id FROM done"""


TIMELINE_ISLANDS = f"""WITH {oracles.MENTIONS},
s AS (SELECT event_id, at_s AS b, at_s + ((cents % 91) + 91) % 91 AS e, cents FROM m),
f AS (SELECT *, CASE WHEN b > max(e) OVER (ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 1 ELSE 0 END AS f FROM s),
i AS (SELECT *, CAST(sum(f) OVER (ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS island FROM f)
SELECT island, count(*) AS n_events, min(b) AS began, max(e) AS ended, max(cents) AS top_cents FROM i GROUP BY island"""

TIMELINE_NEAREST = f"""WITH {oracles.MENTIONS}, o AS (SELECT DISTINCT at_s FROM m WHERE event_type <> 'purchase'), p AS (SELECT event_id, at_s AS t FROM m WHERE event_type = 'purchase'),
lo AS (SELECT p.*, o.at_s AS lo FROM p ASOF LEFT JOIN o ON p.t >= o.at_s), both_sides AS (SELECT lo.*, o.at_s AS hi FROM lo ASOF LEFT JOIN o ON lo.t <= o.at_s)
SELECT event_id, t AS "at", CASE WHEN lo IS NOT NULL AND (hi IS NULL OR t - lo <= hi - t) THEN lo ELSE hi END AS nearest_at FROM both_sides"""

TIMELINE_WINDOWS = """WITH u AS (SELECT conv_id * 1000 + turn AS i, coalesce(text, '') AS text FROM conversations)
SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INT) AS center_index, array_to_string(list(i) OVER k, ',') AS segments, CAST(first_value(i) OVER k * 10.0 AS DOUBLE) AS start_sec, CAST(last_value(i) OVER k * 10.0 + 8.0 AS DOUBLE) AS end_sec,
  CAST(i * 10.0 + 4.0 AS DOUBLE) AS center_sec, CAST(length(array_to_string(list(text) OVER k, ' ')) AS INT) AS n_chars FROM u WINDOW k AS (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""

SCRIPT_OF_ALL = r"""WITH d AS (SELECT doc_id, doc_id % 5 = 0 AS omitted, string_split_regex(text, '\r\n|\r|\n') AS l FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INT) AS scene_idx, CAST(sum(CASE WHEN omitted THEN 0 ELSE 1 END) OVER (ORDER BY doc_id) - 1 AS INT) AS dense, CAST(doc_id % 99 + 1 AS INT) AS label FROM d)
SELECT scene_idx, CASE WHEN omitted THEN -1 ELSE dense END AS scene_idx_non_omitted, label AS scene_label_int, CASE WHEN omitted THEN 'OMITTED' ELSE 'INT.' END AS marker_type,
  CASE WHEN omitted THEN 'OMITTED ' || label ELSE 'INT. PLACE OF ' || doc_id || ' - DAY' END AS heading, CAST(doc_id AS INT) AS page_start, CAST(doc_id AS INT) AS page_end,
  CAST(len(l) - CASE WHEN l[len(l)] = '' THEN 1 ELSE 0 END AS INT) AS n_lines FROM n"""


D, CLAMP, R4 = (lambda x: f"CAST({x} AS DOUBLE)"), (lambda x: f"least(greatest({x}, CAST(0.0 AS DOUBLE)), CAST(1.0 AS DOUBLE))"), (lambda x: f"CAST(round(CAST({x} AS DECIMAL(24, 12)), 4) AS DOUBLE)")
_TOLD = lambda on, name: f"CASE WHEN {on} THEN '{name}' END"
_LISTED = lambda parts: f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"
_JOINED = lambda c: f"array_to_string({c}, ',')"

#: Every word of a conversation as an object: its turns, its gap in what the assistant says, how it scores as setup and payoff, and why.
NARRATIVE_CANDIDATES = f"""WITH {oracles.TURN_WORDS.replace('x -> ', 'lambda x: ')},
w AS (SELECT DISTINCT conv_id, turn, role = 'assistant' AS acted, object_id AS word FROM t WHERE role <> 'system'),{oracles.max_gaps_sql('ev0', '(SELECT * FROM w WHERE acted)', 'conv_id, word', 'turn')},
ev AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY gap_jump DESC, word) - 1 AS INT) AS event_idx FROM ev0),
c AS (SELECT conv_id, turn, role || ' ' || turn AS heading, least(CAST(floor(length(text) / 20) AS INT), 100) AS climax FROM conversations), tot AS (SELECT conv_id, max(turn) + 1 AS total FROM c GROUP BY conv_id),
q AS (SELECT conv_id, quantile_cont(gap_jump, 0.5) AS q50, quantile_cont(gap_jump, 0.75) AS q75 FROM ev GROUP BY conv_id),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY word DESC) - 1 AS pos FROM w),
r AS (SELECT w.conv_id, w.word, w.turn, w.acted, c.heading, c.climax, e.event_idx IS NOT NULL AND w.acted AS anchor, {GENERIC('w.word')} AS single FROM w JOIN c USING (conv_id, turn) LEFT JOIN ev e ON e.conv_id = w.conv_id AND e.word = w.word
  WHERE NOT {GENERIC('w.word')} OR e.event_idx IS NOT NULL AND w.acted), -- of a generic word there is the event alone
g AS (SELECT conv_id, word, list(turn ORDER BY turn) AS turns, count(*) AS n, min(turn) AS lo, max(turn) AS hi, bool_or(acted) AS any_acted, sum(CASE WHEN acted THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) / count(*) AS visual, sum(CASE WHEN acted THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END) / count(*) AS sure,
  list_sort(list_distinct(list(CASE WHEN acted THEN 'action' ELSE 'dialogue' END))) AS channels, bool_or(NOT anchor) AS loose, bool_or(NOT anchor AND acted) AS loose_acted, bool_or(NOT acted) AS spoken, bool_or(single) AS single FROM r GROUP BY conv_id, word HAVING count(*) >= 2),
gap AS (SELECT conv_id, word, turn AS a, nx AS b, nx - turn AS gap FROM (SELECT conv_id, word, turn, lead(turn) OVER (PARTITION BY conv_id, word ORDER BY turn) AS nx FROM r) WHERE nx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, word ORDER BY nx - turn DESC, turn) = 1),
s0 AS (SELECT g.*, e.event_idx, e.event_idx IS NOT NULL AS prior, coalesce(e.a, gap.a) AS a, coalesce(e.b, gap.b) AS b, CAST(coalesce(e.gap_jump, gap.gap) AS INT) AS gap_jump, CAST(coalesce(e.freq, g.n) AS INT) AS freq, coalesce(e.coverage, g.n / {D('greatest(g.hi - g.lo + 1, 1)')}) AS coverage,
  CASE WHEN e.event_idx IS NOT NULL THEN 0.6::DOUBLE WHEN any_acted THEN 0.6::DOUBLE ELSE 0.2275::DOUBLE END AS act, CASE WHEN e.event_idx IS NOT NULL THEN 0.7::DOUBLE ELSE {R4('visual')} END AS vis,
  CASE WHEN e.event_idx IS NOT NULL THEN 0.4::DOUBLE ELSE 0.35::DOUBLE END AS sta, CASE WHEN e.event_idx IS NOT NULL THEN 0.8::DOUBLE ELSE {R4('sure')} END AS con, total, coalesce(q50, 0) AS q50, coalesce(q75, 0) AS q75, {D('greatest(total - 1, 1)')} AS d
  FROM g JOIN gap USING (conv_id, word) JOIN tot USING (conv_id) LEFT JOIN q USING (conv_id) LEFT JOIN ev e ON e.conv_id = g.conv_id AND e.word = g.word),
s1 AS (SELECT s0.*, (SELECT max(climax) FROM r WHERE r.conv_id = s0.conv_id AND r.word = s0.word AND r.turn >= s0.b) AS climax FROM s0),
s2 AS (SELECT *, {CLAMP(f"{D('0.22')} * {CLAMP('gap_jump / greatest(q75, CAST(1.0 AS DOUBLE))')} + {D('0.15')} * {CLAMP(D('1.0') + ' - lo / d')} + {D('0.15')} * {CLAMP('hi / d')} + {D('0.16')} * {CLAMP('climax / ' + D('100.0'))} + {D('0.10')} * act + {D('0.08')} * vis + {D('0.05')} * sta + {D('0.04')} * con + {D('0.04')} * {CLAMP(D('1.0') + ' - coverage')} + {D('0.03')} * (CASE WHEN freq <= 5 THEN {D('1.0')} ELSE {CLAMP(D('1.0') + ' - (freq - 5) / ' + D('10.0'))} END) + (CASE WHEN loose THEN {D('0.04')} ELSE {D('0.0')} END) + (CASE WHEN loose_acted THEN {D('0.02')} ELSE {D('0.0')} END) + (CASE WHEN prior THEN {D('0.03')} ELSE {D('0.0')} END)")} AS raw FROM s1),
s AS (SELECT *, {R4('raw')} AS score, CASE WHEN len(list_filter(turns, lambda x: x <= a)) > 0 THEN list_filter(turns, lambda x: x <= a)[1:2] ELSE [lo] END AS setup, CASE WHEN len(list_filter(turns, lambda x: x >= b)) > 0 THEN list_filter(turns, lambda x: x >= b) ELSE [hi] END AS payoff FROM s2),
roles AS (SELECT s.conv_id, s.word, string_agg(array_to_string({_LISTED([
    _TOLD('list_contains(setup, turn)', 'setup_candidate'), _TOLD('list_contains(payoff, turn)', 'payoff_candidate'), _TOLD('turn = a', 'gap_anchor_a'), _TOLD('turn = b', 'gap_anchor_b'), _TOLD('r.climax >= 70', 'high_climax_scene'),
    _TOLD('NOT anchor', 'scene_inventory_loose_match'), "CASE WHEN r.single THEN NULL WHEN acted THEN 'action_supported_match' ELSE 'dialogue_only_match' END"])}, '+'), '|' ORDER BY turn) AS roles, string_agg(heading, '|' ORDER BY turn) AS headings FROM s JOIN r USING (conv_id, word) GROUP BY s.conv_id, s.word)
SELECT s.conv_id, CAST(row_number() OVER (PARTITION BY s.conv_id ORDER BY score DESC, gap_jump DESC, act DESC, vis DESC, single, CASE WHEN single THEN event_idx ELSE lo END, pos.pos) - 1 AS INT) AS candidate_index, s.word AS object_id, s.word AS canonical_name,
  CASE WHEN single THEN 'stage1_fallback' WHEN prior THEN 'inventory_with_stage1_prior' ELSE 'inventory_only' END AS candidate_source, score AS possible_chekhov_score, CASE WHEN raw >= 0.72 THEN 'high' WHEN raw >= 0.58 THEN 'medium' WHEN raw >= 0.45 THEN 'low' ELSE 'unlikely' END AS possible_chekhov_label,
  CAST(n AS INT) AS chain_size, gap_jump, freq AS freq_scenes, array_to_string({_LISTED([
    _TOLD('NOT prior', 'inventory_only_candidate'), _TOLD('single', 'stage1_fallback_candidate'), _TOLD('prior', 'stage1_prior_support'), _TOLD('total > 1 AND lo <= 0.35::DOUBLE * (total - 1)', 'early_setup_scene'),
    "CASE WHEN q75 > 0 AND gap_jump >= q75 THEN 'extreme_reappearance_gap' WHEN q50 > 0 AND gap_jump >= q50 THEN 'long_reappearance_gap' END", _TOLD('total > 1 AND hi >= 0.65::DOUBLE * (total - 1)', 'late_story_return'), _TOLD('climax >= 70', 'high_climax_payoff_scene'),
    _TOLD('coverage <= 0.35::DOUBLE', 'sparse_reoccurrence_pattern'), _TOLD('act >= 0.55::DOUBLE', 'action_central_object'), _TOLD('sta >= 0.35::DOUBLE', 'state_changeable_object'), _TOLD('loose', 'scene_inventory_loose_reinforcement'),
    _TOLD('loose_acted', 'action_channel_reinforcement'), _TOLD('spoken', 'dialogue_only_support')])}, '|') AS reasons,
  {_JOINED('setup')} AS setup, {_JOINED('payoff')} AS payoff, event_idx AS prior, CASE WHEN single THEN '' ELSE {_JOINED('turns')} END AS inventory, CASE WHEN single THEN '' ELSE array_to_string(channels, '|') END AS channels, roles, headings
FROM s JOIN roles USING (conv_id, word) JOIN pos ON pos.conv_id = s.conv_id AND pos.word = s.word AND pos.turn = s.lo WHERE score >= 0.4"""


def oracle_sql() -> dict[str, str]:
    vowels = "SELECT doc_id, 'vowels=' || length(regexp_replace(coalesce(text, ''), '[^aeiou]', '', 'g')) AS response FROM documents"
    return {"annotation_steps": vowels, "narrative_candidates": NARRATIVE_CANDIDATES, "timeline_islands": TIMELINE_ISLANDS, "timeline_nearest": TIMELINE_NEAREST, "timeline_windows": TIMELINE_WINDOWS, "script_of_all": SCRIPT_OF_ALL, "story_groups": STORY_GROUPS, "role_inventory": ROLE_INVENTORY, "candidate_dedup": CANDIDATE_DEDUP}
