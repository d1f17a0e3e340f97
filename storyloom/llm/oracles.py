"""DuckDB SQL for those queries of the training-data operators that SQL can express."""

from __future__ import annotations

import string

LOWERED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

EXACT_DEDUP = f"""
WITH n AS (SELECT doc_id, {LOWERED} AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) for i in range(4)] AS h FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m, coalesce(array_to_string(units[b + 1:], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM f
"""


def _crc32(text: str) -> str:
    """The checksum of a text of ASCII characters, four bits at a time."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    nibbles = f"flatten([[ascii({text}[i]) & 15, ascii({text}[i]) >> 4] for i in range(1, length({text}) + 1)])"
    step = f"xor({table}[CAST(xor(c, k) & 15 AS INTEGER) + 1], c >> 4)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {nibbles}::BIGINT[]), lambda c, k: {step}), 4294967295)"


def merkle() -> str:
    """Lists of nodes level by level, and each row's way up through them, first within its source and then over the sources."""
    shown = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    rest, text = " || ".join(shown(c) for c in ("doc_id", "source", "lang", "n_chars")), shown("text")
    above = "[sha256(array_to_string(nodes[i + 1:i + 3], '')) for i in range(0, len(nodes), 3)]"
    left, right = "array_to_string(u.nodes[w.pos // 3 * 3 + 1:w.pos], '')", "array_to_string(u.nodes[w.pos + 2:w.pos // 3 * 3 + 3], '')"
    step = f"w.pos // 3, sha256({left} || w.node || {right}), sha256({left} || w.forged || {right}), w.proof || {left} || {right}"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256({rest} || {text}) AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN sha256({rest} || {text.replace("text", "replace(text, chr(10), '')")}) ELSE sha256({rest} || {text}) END AS forged FROM documents),
r AS (SELECT *, coalesce('s' || source, '-') AS tree, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS pos, row_number() OVER () AS row FROM d),
up(tree, level, nodes) AS (SELECT tree, 0, list(leaf ORDER BY pos) FROM r GROUP BY tree UNION ALL SELECT tree, level + 1, {above} FROM up WHERE len(nodes) > 1),
subroots AS (SELECT tree, nodes[1] AS subroot, CAST(row_number() OVER (ORDER BY tree) - 1 AS BIGINT) AS pos FROM up WHERE len(nodes) = 1),
top(level, nodes) AS (SELECT 0, list(subroot ORDER BY pos) FROM subroots UNION ALL SELECT level + 1, {above} FROM top WHERE len(nodes) > 1),
walk(row, tree, level, pos, node, forged, proof) AS (SELECT row, tree, 0, pos, leaf, forged, '' FROM r
  UNION ALL SELECT w.row, w.tree, w.level + 1, {step} FROM walk w JOIN up u ON u.tree = w.tree AND u.level = w.level AND len(u.nodes) > 1),
ends AS (SELECT w.row, s.pos, w.node, w.forged, w.proof, s.subroot FROM walk w JOIN up u ON u.tree = w.tree AND u.level = w.level AND len(u.nodes) = 1 JOIN subroots s ON s.tree = w.tree),
climb(row, level, pos, node, forged, proof) AS (SELECT row, 0, pos, node, forged, proof FROM ends
  UNION ALL SELECT w.row, w.level + 1, {step} FROM climb w JOIN top u ON u.level = w.level AND len(u.nodes) > 1),
roots AS (SELECT level, nodes[1] AS root FROM top WHERE len(nodes) = 1)
SELECT r.doc_id, r.leaf, e.subroot, t.root, sha256(c.proof) AS proof_sha256, c.forged AS folded_root, c.forged = t.root AS verified
FROM climb c JOIN roots t ON t.level = c.level JOIN r ON r.row = c.row JOIN ends e ON e.row = c.row
"""


def _weight(label: str, weights: dict[str, int] | None) -> str:
    return "CASE " + " ".join(f"WHEN {label} = '{k}' THEN {w}" for k, w in (weights or {}).items()) + " ELSE 1 END" if weights else "1"


def mixing(weights: dict[str, dict[str, int]], permille: int, max_epochs: int, seed: int) -> str:
    """Budgets level by level with capped shares, then whole epochs and a prefix of one more."""
    steps, above = [], []
    for label in ("domain", "lang", "source"):
        path, name = [*above, label], f"b_{label}"
        parent = f"(SELECT sum(tokens) * {permille} // 1000 FROM leaves)" if not above else "max(p.budget)"
        join = "" if not above else f"JOIN b_{above[-1]} p USING ({', '.join(above)})"
        by = f"PARTITION BY {', '.join(above)}" if above else ""
        steps.append(f"""
{name}_c AS (SELECT {', '.join(path)}, CAST(sum(tokens) * {max_epochs} AS BIGINT) AS cap, {_weight(label, weights.get(label))} AS w, CAST({parent} AS BIGINT) AS pb
  FROM leaves {join} GROUP BY {', '.join(path)}),
{name}_s AS (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {label} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER ({by} ORDER BY cap / w, {label} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}_c),
{name}_f AS (SELECT *, cap * rest <= w * (pb - before) AS is_full FROM {name}_s),
{name}_u AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS used, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by}) AS open_w FROM {name}_f),
{name} AS (SELECT {', '.join(path)}, CAST(CASE WHEN is_full THEN cap ELSE w * (pb - used) // nullif(open_w, 0) END AS BIGINT) AS budget FROM {name}_u)""")
        above = path
    return f"""
WITH rows AS (SELECT doc_id, coalesce('d' || CAST(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 AS VARCHAR), '(none)') AS domain,
  coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM rows GROUP BY ALL),{','.join(steps)},
plan AS (SELECT domain, lang, source, budget, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS epochs,
  budget - (CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END) * tokens AS rest FROM leaves JOIN b_source USING (domain, lang, source)),
placed AS (SELECT *, md5('{seed}:' || CAST(epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '(none)')) AS place
  FROM rows JOIN plan USING (domain, lang, source)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS run FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, budget AS leaf_budget,
  CAST(epochs + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM summed
"""


def chat_tools(needs: dict[int, list[list[int]]]) -> str:
    """Calls reach what they need, directly or not: the latest turn reached is their key, the longest way among calls of equal key their level."""
    away = "CASE kind " + " ".join(f"WHEN {k} THEN CASE half " + " ".join(f"WHEN {h} THEN {d}::INTEGER[]" for h, d in enumerate(by_half)) + " END" for k, by_half in sorted(needs.items())) + " END"
    named = lambda turn: f"'t' || CASE WHEN kind = 0 THEN {turn} - ({turn}) % 4 ELSE {turn} END"
    return f"""
WITH RECURSIVE turns AS (SELECT DISTINCT conv_id, turn, role, text, ((conv_id % 5) + 5) % 5 AS kind, (turn // 2) % 4 AS half FROM conversations),
asks AS (SELECT *, {named('turn')} AS call_id, CASE WHEN turn % 10 = 8 THEN 'lookup' ELSE 'answer' END AS name FROM turns WHERE role <> 'assistant'),
wants AS (SELECT conv_id, turn, unnest({away}) AS d FROM asks),
heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn) AS r FROM asks) WHERE r = 1),
edge AS (SELECT DISTINCT h.conv_id, h.call_id AS k, a.call_id AS need FROM heads h JOIN wants w ON w.conv_id = h.conv_id AND w.turn = h.turn JOIN asks a ON a.conv_id = h.conv_id AND a.turn = w.turn + w.d),
reach(conv_id, k, n) AS (SELECT conv_id, k, need FROM edge UNION SELECT r.conv_id, r.k, e.need FROM reach r JOIN edge e ON e.conv_id = r.conv_id AND e.k = r.n),
keys AS (SELECT h.conv_id, h.call_id, greatest(h.turn, coalesce(max(x.turn), h.turn)) AS order_key FROM heads h LEFT JOIN reach r ON r.conv_id = h.conv_id AND r.k = h.call_id
  LEFT JOIN heads x ON x.conv_id = r.conv_id AND x.call_id = r.n GROUP BY h.conv_id, h.call_id, h.turn),
level_edge AS (SELECT e.* FROM edge e JOIN keys a ON a.conv_id = e.conv_id AND a.call_id = e.k JOIN keys b ON b.conv_id = e.conv_id AND b.call_id = e.need WHERE a.order_key = b.order_key),
level_reach(conv_id, k, n) AS (SELECT conv_id, k, need FROM level_edge UNION SELECT r.conv_id, r.k, e.need FROM level_reach r JOIN level_edge e ON e.conv_id = r.conv_id AND e.k = r.n),
circular AS (SELECT DISTINCT a.conv_id, a.k FROM level_reach a JOIN level_reach b ON b.conv_id = a.conv_id AND b.k = a.n AND b.n = b.k),
level(conv_id, k, d) AS (SELECT h.conv_id, h.call_id, 0 FROM heads h ANTI JOIN circular c ON c.conv_id = h.conv_id AND c.k = h.call_id
  UNION SELECT e.conv_id, e.k, l.d + 1 FROM level l JOIN level_edge e ON e.conv_id = l.conv_id AND e.need = l.k ANTI JOIN circular c ON c.conv_id = e.conv_id AND c.k = e.k),
levels AS (SELECT conv_id, k AS call_id, max(d) AS order_level FROM level GROUP BY conv_id, k),
answers AS (SELECT conv_id, call_id, turn AS answer_turn, coalesce(text, '') AS content FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, text) AS r FROM (SELECT *, {named('turn - 1')} AS call_id FROM turns WHERE role = 'assistant')) WHERE r = 1),
met AS (SELECT coalesce(q.conv_id, a.conv_id) AS conv_id, coalesce(q.call_id, a.call_id) AS call_id, q.turn AS asked, a.answer_turn, q.name, q.text AS question, a.content,
  q.turn IS NOT NULL AS call, a.answer_turn IS NOT NULL AS answered, q.kind FROM asks q FULL JOIN answers a ON a.conv_id = q.conv_id AND a.call_id = q.call_id),
judged AS (SELECT m.*, k.order_key, l.order_level, h.turn AS head, CASE WHEN NOT call THEN 0 WHEN m.name = 'lookup' THEN 1 WHEN question IS NULL THEN 1
  ELSE CAST(length(question) = 0 OR length(question) > 300 AS INTEGER) END + CASE WHEN call AND m.kind = 4 AND h.turn % 6 = 0 THEN 1 ELSE 0 END AS n_errors
  FROM met m LEFT JOIN keys k USING (conv_id, call_id) LEFT JOIN levels l USING (conv_id, call_id) LEFT JOIN heads h ON h.conv_id = m.conv_id AND h.call_id = m.call_id)
SELECT conv_id, call_id, coalesce(asked, answer_turn) AS turn, CASE WHEN call THEN order_key ELSE answer_turn END AS order_key, CAST(CASE WHEN call THEN order_level ELSE 0 END AS INTEGER) AS order_level,
  CASE WHEN NOT call THEN 'orphan' WHEN order_level IS NULL THEN 'circle' WHEN asked <> head THEN 'repeated' WHEN n_errors > 0 THEN 'invalid' WHEN answered THEN 'ok' ELSE 'open' END AS status, n_errors,
  sha256('{{"call":' || CASE WHEN call THEN '{{"arguments":{{' || coalesce('"question":' || to_json(question) || ',', '') || '"turn":' || asked || '}},"id":"' || call_id || '","name":"' || name || '"}}' ELSE 'null' END
    || ',"result":' || CASE WHEN answered THEN '{{"content":' || to_json(content) || ',"id":"' || call_id || '"}}' ELSE 'null' END || '}}') AS message_sha256
FROM judged
"""
