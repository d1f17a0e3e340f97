"""Mixing, tool calls, the pipeline and the registry."""

import hashlib
import json
import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from storyloom.llm import oracles
from storyloom.llm import queries as Q
from storyloom.llm.chat_tools import _checked, canonical, linked_calls, schema_errors
from storyloom.llm.mixing import leaf_budgets, mix, mixed_documents
from tests.llm.conftest import same

DOCS = "doc_id long, text string, lang string, source string, copies int, budget string, run int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", 1) for r in rows], DOCS)


def corpus(n=400, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        hot = r.random() < 0.4
        rows.append((i, " ".join("w" for _ in range(r.randrange(0, 60))) if r.random() > 0.05 else None, "en" if hot else r.choice(["en", "de", "fr", None]), "src0" if hot else r.choice(["src1", "src2", "src3", "other", None])))
    return rows


@pytest.mark.parametrize(("permille", "epochs"), [(900, 2), (400, 1), (1000, 1), (3000, 2), (0, 2)])
def test_mix_matches_sql(spark, tables, oracle, permille, epochs):
    d = docs(spark, [*corpus(), (7, "again w w", "en", "src0"), (7, "again w w", "en", "src0"), (None, "w w", "de", "src1")])
    folder = tables(documents=d)
    got = mix(d, Q.MIX_WEIGHTS, permille, epochs, 42, Q.source_domain())
    assert same(got, oracle(folder, oracles.mixing(Q.MIX_WEIGHTS, permille, epochs, 42), "documents"))
    rows = got.collect()
    leaves = {}
    for r in rows:
        leaves.setdefault((r.domain, r.lang, r.source), []).append(r)
    for leaf in leaves.values():
        assert sum(r.copies * r.n_tokens for r in leaf) <= leaf[0].leaf_budget
        assert max(r.copies for r in leaf) <= epochs


def plain_divide(budget, children):
    """Water-filling step by step: ``children`` are (weight, capacity)."""
    got, open_ = [0.0] * len(children), set(range(len(children)))
    left = float(budget)
    while open_ and left > 1e-9:
        share = left / sum(children[i][0] for i in open_)
        full = [i for i in open_ if children[i][1] <= share * children[i][0] + 1e-9]
        if not full:
            for i in open_:
                got[i] = share * children[i][0]
            return got
        for i in full:
            got[i] = children[i][1]
            left -= children[i][1]
            open_.remove(i)
    return got


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(0, 500)), min_size=1, max_size=10), st.integers(0, 2500))
def test_shortages_go_to_siblings_before_ancestors(spark, cells, permille):
    tokens = {}
    for d, l, t in cells:
        tokens[f"d{d}", f"l{l}", "s"] = tokens.get((f"d{d}", f"l{l}", "s"), 0) + t
    weights = {"domain": {"d0": 5, "d1": 2}, "lang": {"l0": 3}}
    df = spark.createDataFrame([(*k, t) for k, t in tokens.items()], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang): r.budget for r in leaf_budgets(df, weights, permille, 2).collect()}
    total = sum(tokens.values()) * permille // 1000
    doms = sorted({k[0] for k in tokens})
    cap = lambda d: sum(2 * t for k, t in tokens.items() if k[0] == d)
    for d, b in zip(doms, plain_divide(total, [(weights["domain"].get(d, 1), cap(d)) for d in doms])):
        langs = sorted({k[1] for k in tokens if k[0] == d})
        for l, x in zip(langs, plain_divide(b, [(weights["lang"].get(l, 1), 2 * tokens[d, l, "s"]) for l in langs])):
            assert abs(got[d, l] - x) <= 4  # rounded down at each level


def test_mix_odd_tables(spark):
    assert mix(docs(spark, []), {}, 500).count() == 0 and mixed_documents(docs(spark, []), weights={}, permille=500).count() == 0
    got = mix(docs(spark, [(1, None, None, None), (2, "", "en", "s")]), {}, 500).collect()
    assert sorted((r.doc_id, r.domain, r.lang, r.source, r.n_tokens, r.copies) for r in got) == [(1, "all", "(none)", "(none)", 0, 0), (2, "all", "en", "s", 0, 0)]
    with pytest.raises(ValueError):
        mix(docs(spark, [(1, "a", "en", "s")]), {"lang": {"en": 0}}, 500)
    one = mixed_documents(docs(spark, [(1, "a b", "en", "s"), (None, "c d", "en", "s")]), weights={}, permille=2000, max_epochs=2)
    assert sorted(r.text for r in one.collect()) == ["a b", "a b", "c d", "c d"] and one.columns == docs(spark, []).columns


def test_mix_ranges_are_bounded(spark):
    """The row-by-row sum touches the range in which a budget ends only."""
    d = docs(spark, [(i, "w w w", "en", "src0") for i in range(20000)])
    r = mix(d, {}, 500, 1)
    assert r.where("copies = 1").count() == 10000


# ---- chats ----

CALL = "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>, status string"
RESULT = "conv_id long, call_id string, turn long, content string, level int"
SCHEMAS = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": "number", "minimum": 0}, "tags": {"type": "array", "items": {"enum": ["a", "b"]}}}, "additionalProperties": False}}


def link(spark, calls, results, **how):
    c = spark.createDataFrame([(*x, "clash") for x in calls], CALL)
    r = spark.createDataFrame([(*x, 1) for x in results], RESULT)
    return linked_calls(c, r, SCHEMAS, **how).collect()


def test_links_order_and_status(spark):
    calls = [
        (1, "a", 0, "add", '{"x": 1.0, "tags": ["b"]}', None), (1, "b", 1, "add", '{"x": -1}', ["a"]), (1, "c", 2, "add", '{"x": 2}', ["z"]), (1, "d", 3, "mul", "{}", []), (1, "e", 4, "add", "not json", []),
        (1, "f", 5, "add", '{"x": 3}', ["h"]), (1, "h", 9, "add", '{"x": 3, "y": 1}', []), (1, "p", 6, "add", '{"x": 1}', ["q"]), (1, "q", 7, "add", '{"x": 1}', ["p"]), (1, "r", 8, "add", '{"x": 1}', ["p"]),
        (1, "a", 5, "add", '{"x": 9}', None), (2, "a", 0, "add", None, None), (None, "a", 0, "add", '{"x": 1}', None), (1, None, 0, "add", '{"x": 1}', None),
    ]
    results = [(1, "a", 3, "late"), (1, "a", 2, "first"), (1, "o", 4, None), (1, "b", 5, "r"), (None, "a", 1, "lost")]
    rows = link(spark, calls, results)
    got = {(r.conv_id, r.call_id, r.turn): r for r in rows}
    assert len(rows) == len(calls) + 1
    status = {k: r.status for k, r in got.items()}
    assert status == {
        (1, "a", 0): "ok", (1, "b", 1): "invalid", (1, "c", 2): "invalid", (1, "d", 3): "invalid", (1, "e", 4): "invalid", (1, "f", 5): "open", (1, "h", 9): "invalid", (1, "p", 6): "circle", (1, "q", 7): "circle",
        (1, "r", 8): "open", (1, "a", 5): "repeated", (2, "a", 0): "invalid", (None, "a", 0): "invalid", (1, None, 0): "invalid", (1, "o", 4): "orphan",
    }
    assert got[1, "c", 2].errors == ["needs z: not there"] and got[2, "a", 0].errors == ["$.x: missing"] and got[1, "b", 1].errors == ["$.x: minimum"]
    assert json.loads(got[1, "a", 0].message) == {"call": {"id": "a", "name": "add", "arguments": {"x": 1, "tags": ["b"]}}, "result": {"id": "a", "content": "first"}}
    assert got[1, "a", 0].message == '{"call":{"arguments":{"tags":["b"],"x":1},"id":"a","name":"add"},"result":{"content":"first","id":"a"}}'
    assert got[1, "o", 4].message == '{"call":null,"result":{"content":"","id":"o"}}'
    # f needs h, which a later turn makes: both stand at that turn, h first
    assert (got[1, "f", 5].key, got[1, "f", 5].level, got[1, "h", 9].key, got[1, "h", 9].level) == (9, 1, 9, 0)


def test_order_is_topological(spark):
    r = random.Random(4)
    calls = []
    for conv in range(6):
        place = list(range(12))
        r.shuffle(place)
        for i in range(12):
            calls.append((conv, f"c{i}", place[i], "add", '{"x": 1}', [f"c{j}" for j in r.sample(range(i), min(i, r.randrange(0, 3)))]))
    rows = link(spark, calls, [])
    order = {(x.conv_id, x.call_id): (x.key, x.level, x.turn) for x in rows}
    assert all(x.level is not None for x in rows)
    for conv, call, _, _, _, needs in calls:
        assert all(order[conv, n] < order[conv, call] for n in needs)


def test_chat_empty_and_limits(spark):
    assert link(spark, [], []) == []
    assert [r.status for r in link(spark, [], [(1, "x", 0, "c")])] == ["orphan"]


def test_long_chains_of_needs(spark):
    """5,000 calls that need the next, 5,000 that a later one holds back level by level, a chain that goes up and down, and a circle of 777 with a tail."""
    n = 5000
    order = list(range(900))
    random.Random(3).shuffle(order)
    calls = [(1, f"f{i}", i, "add", '{"x": 1}', [f"f{i + 1}"] if i < n - 1 else None) for i in range(n)]
    calls += [(2, f"b{i}", n - i if i else 2 * n, "add", '{"x": 1}', [f"b{i - 1}"] if i else None) for i in range(n)]
    calls += [(3, f"z{i}", order[i], "add", '{"x": 1}', [f"z{i + 1}"] if i < 899 else None) for i in range(900)]
    calls += [(4, f"o{i}", 1, "add", '{"x": 1}', [f"o{(i + 1) % 777}"] if i < 777 else [f"o{i - 1}"]) for i in range(800)]
    got = {(r.conv_id, r.call_id): (r.key, r.level) for r in link(spark, calls, [])}
    assert all(got[1, f"f{i}"] == (n - 1, n - 1 - i) and got[2, f"b{i}"] == (2 * n, i) for i in range(n))
    key, level = -1, 0
    for i in reversed(range(900)):
        key, level = (order[i], 0) if order[i] > key else (key, level + 1)
        assert got[3, f"z{i}"] == (key, level)
    assert all(got[4, f"o{i}"] == (1, None) for i in range(800))


def naive_order(calls):
    """Keys and levels by going every way, one conversation after another; a need that isn't there says nothing."""
    out = {}
    for conv in {c[0] for c in calls}:
        turn = {c[1]: c[2] for c in calls if c[0] == conv}
        needs = {c[1]: [n for n in c[5] or [] if n in turn] for c in calls if c[0] == conv}
        reach = {}
        for k in turn:
            seen, todo = set(), [k]
            while todo:
                for x in needs[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            reach[k] = seen
        key = {k: max([turn[k], *(turn[x] for x in reach[k])]) for k in turn}
        same_key = {k: [x for x in needs[k] if key[x] == key[k]] for k in turn}

        def level(k, way=()):
            if k in way:
                return None
            below = [level(x, (*way, k)) for x in same_key[k]]
            return None if None in below else 1 + max(below, default=-1)

        out.update({(conv, k): (key[k], level(k)) for k in turn})
    return out


def test_any_needs(spark):
    r = random.Random(6)
    calls = []
    for conv in range(60):
        n = r.choice([2, 5, 9])
        calls += [(conv, f"c{i}", r.randrange(n), "add", '{"x": 1}', [f"c{r.randrange(n + 1)}" for _ in range(r.choice([0, 0, 1, 1, 2]))]) for i in range(n)]
    got = {(x.conv_id, x.call_id): (x.key, x.level) for x in link(spark, calls, [])}
    assert got == naive_order(calls)


def test_chain_of_the_query_matches_sql(spark, tables, oracle):
    """A conversation of 600 turns in which 300 calls need each other."""
    rows = [(k, t, "user" if t % 2 == 0 else "assistant", "w") for k in (1, 2) for t in range(600)]
    folder = tables(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert same(Q.op9_chat_tools(spark, folder), oracle(folder, oracles.chat_tools(Q.NEEDS), "conversations"))


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8))
def test_canonical_json(value):
    text = canonical(value)
    assert canonical(json.loads(text)) == text
    shuffled = json.loads(json.dumps(value), object_pairs_hook=lambda p: dict(reversed(p)))
    assert canonical(shuffled) == text


def test_schema_rules():
    s = {"type": "object", "properties": {"n": {"type": ["integer", "null"], "maximum": 3}, "s": {"type": "string", "minLength": 2, "maxLength": 3}, "b": {"type": "boolean"}}}
    ok = lambda v: schema_errors(v, s)
    assert ok({"n": 3, "s": "ab", "b": True}) == [] and ok({"n": None}) == [] and ok({"n": 2.0}) == []
    assert ok({"n": 4}) == ["$.n: maximum"] and ok({"n": True}) == ["$.n: not integer or null"] and ok({"s": "a"}) == ["$.s: minLength"] and ok({"s": "abcd"}) == ["$.s: maxLength"] and ok([]) == ["$: not object"]
    assert _checked("add", '{"x": NaN}', SCHEMAS) == (None, ["arguments: not JSON"]) and _checked("add", '{"x": 1e999}', SCHEMAS)[1] == ["arguments: not JSON"]


def test_chat_query_matches_sql(spark, tables, oracle):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'q "1"\n\té'), (1, 2, "assistant", "a\\b"), (1, 3, "user", ""), (2, 0, "assistant", "alone"), (3, 0, "user", "x" * 301), (3, 1, "assistant", "y"), (4, 0, "user", "open")]
    rows += [(k, t, "user" if t % 2 == 0 else "assistant", f"words {k} {t}") for k in range(10, 20) for t in range(22)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    folder = tables(conversations=c)
    got = Q.op9_chat_tools(spark, folder)
    assert same(got, oracle(folder, oracles.chat_tools(Q.NEEDS), "conversations"))
    assert {r.status for r in got.collect()} == {"ok", "open", "invalid", "orphan", "circle", "repeated"} and {r.order_level for r in got.collect()} >= {None, 0, 1, 2, 3}


# ---- pipeline ----


@pytest.fixture
def story(spark, tables):
    r = random.Random(1)
    word = lambda: "".join(r.choice(["the", "an", "ing", "re", "st", "ou", "ti"]) for _ in range(r.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    clean = [(i, text(r.randrange(40, 160)), r.choice(["en", "de"]), f"src{i % 4}", 0) for i in range(240)]
    junk = [(1000 + i, " ".join(f"{word()}$$$ %%%" for _ in range(80)), "en", "src0", 0) for i in range(80)]
    exact = [(2000 + i, clean[i][1].upper(), "en", "src1", 0) for i in range(20)]
    near = [(3000 + i, clean[40 + i][1] + " extra", "en", "src2", 0) for i in range(20)]
    odd = [(4000, None, None, None, None), (4001, "", "en", "src0", 0), (4002, "y " * 30000, "en", "src0", 0)]
    docs = spark.createDataFrame(clean + junk + exact + near + odd, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(d[0], 1, 0) for d in clean] + [(d[0], 0, 0) for d in junk], "doc_id long, quality int, toxic int")
    return tables(documents=docs, labels=labels), docs


def test_stages(spark, story, tmp_path):
    folder, docs = story
    columns, kept, sizes = docs.columns, docs, []
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = ids(kept)
        out = stage(spark, kept, folder)
        out.write.parquet(str(tmp_path / "out" / name))
        kept = spark.read.parquet(str(tmp_path / "out" / name))
        now = ids(kept)
        assert now <= before
        sizes.append(len(now))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == columns
        if name == "quality":
            assert len(now & set(range(1000, 1080))) <= 2 and len(now & set(range(240))) >= 236
        if name == "exact_dedup":
            twins = {i for i in range(20) if 2000 + i in before}
            assert len(twins) > 5 and not now & twins and set(range(2000, 2020)) & before <= now and (set(range(240)) - twins) & before <= now
        if name == "near_dedup":
            assert not now & set(range(3000, 3020)) and set(range(20, 240)) & before <= now
        if name == "mixing":
            assert kept.count() == len(now)
    assert 0 < sizes[-1] == sizes[-2] < sizes[-3] and {"doc_id", "ids", "n_tokens"} <= set(kept.columns)
    run = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.n_tokens) for r in run.collect()) == sorted((r.doc_id, r.n_tokens) for r in kept.collect())


def test_stages_on_an_empty_table(spark, tables):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    folder = tables(documents=d, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    t = " ".join(f"w{i}" for i in range(100))
    rows = [(1, t), (1, t + " more"), (2, t + " end"), (2, "a text of its own that no other row has"), (3, "alone"), (None, t), (None, t + " x")]
    d = spark.createDataFrame([(i, x, "en", "src0", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, d, "").collect())
    assert [x for x in got if x[0] == 2] == [(2, rows[3][1])] and len([x for x in got if x[0] == 1]) == 1
    assert [x for x in got if x[0] in (0, 3)] == [(0, t), (0, t + " x"), (3, "alone")]


def test_near_dedup_links_by_fingerprint_and_by_sets(spark):
    """A paragraph that comes again and again outweighs two tails: their sets of shingles differ, their fingerprints hardly. An appended block changes the fingerprint and leaves sets of similarity 0.8."""
    from storyloom.llm.similarity import shingles
    from storyloom.llm.simhash import fingerprint

    r = random.Random(7)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    again = " ".join([words(31)] * 40)
    a, b = f"{again} {words(60)}", f"{again} {words(60)}"
    c = words(400)
    d, alone = f"{c} {words(70)}", words(300)
    sets = [set(shingles(x).tolist()) for x in (a, b, c, d)]
    assert (fingerprint(a) ^ fingerprint(b)).bit_count() <= 4 and len(sets[0] & sets[1]) < 0.5 * len(sets[0] | sets[1])
    assert (fingerprint(c) ^ fingerprint(d)).bit_count() > 4 and len(sets[2] & sets[3]) >= 0.8 * len(sets[2] | sets[3])
    rows = [(1, a), (2, b), (3, c), (4, d), (5, alone), (6, ""), (7, None), (None, b)]
    docs = spark.createDataFrame([(i, x, "en", "src0", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 1, 3, 5, 6]


def test_last_stage_decodes(spark):
    texts = ["", "Plain  words\n", "né 𝄞 \x00 日本", "x" * 5000]
    d = spark.createDataFrame([*((i, x, "en", "src0", 0) for i, x in enumerate(texts)), (9, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.tokenise(spark, d, "").collect()}
    assert got == {i: hashlib.sha256((x or "").encode()).hexdigest() for i, x in [*enumerate(texts), (9, "")]}


def test_registry():
    import __spark_entry__ as E

    names = list(E.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(E.oracle_sql()) <= set(names)
    assert hashlib.sha256(b"").hexdigest() and F is not None


def test_many_siblings_are_divided_in_linear_time(spark):
    """60,000 sources under one language: a frame to the end of the partition, summed anew for each row, would take minutes."""
    leaves = spark.range(60_000).select(F.lit("d").alias("domain"), F.lit("en").alias("lang"), F.concat(F.lit("s"), "id").alias("source"), (F.col("id") % 90 + 1).alias("tokens"))
    began = time.perf_counter()
    got = leaf_budgets(leaves, {}, 500, 1).agg(F.sum("budget").alias("b"), F.max(F.col("budget") - F.col("tokens")).alias("over"), F.count("*").alias("n")).first()
    total = sum(i % 90 + 1 for i in range(60_000))
    assert got.n == 60_000 and got.over <= 0 and total // 2 - 60_000 <= got.b <= total // 2 and time.perf_counter() - began < 60
