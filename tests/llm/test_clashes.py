"""Extra columns of any name: every operator and stage gives what it gives without them, and stages return them untouched."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from storyloom.llm import queries as Q
from storyloom.llm.chat_tools import _checked, canonical, linked_calls
from storyloom.llm.media import resolved, sequences

NAMES = [
    "_id", "_sha", "_key", "_lang", "_source", "_copies", "_copy", "of", "in", "of_id", "of_key", "of_sha", "of_lang", "of_source", "of_bytes", "copy", "copies", "place", "h", "key", "fp", "rep", "rep_id", "rep_key", "found", "salt",
    "budget", "epochs", "rest", "range", "end", "recipe", "chunk", "chunks", "text_key", "text_sha256", "component", "node", "quality", "quality_score", "digest", "media", "kind", "pos", "caption", "ids", "n_tokens", "decoded", "size",
    "first", "bytes", "run", "upto", "domain", "n", "count", "a.b", "with `tick`", "host", "url", "row", "story", "level", "url_", "kept", "component_id", "hub", "best", "deal", "deals", "asks", "OF_ID", "Quality_Score",
]


def words(r, n):
    return " ".join(r.choice(["the", "and", "nicht", "und", "der", "les", "est", "que", "of", "to"]) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = [(i, words(r, r.choice([3, 30, 60])), r.choice(["en", "de", None]), r.choice(["src0", "src1", None]), 1) for i in range(60)]
    return [*out, (60, out[1][1], "en", "src0", 1), (61, out[1][1] + " more", "en", "src0", 1), (61, "a text of its own", "en", "src0", 1), (None, None, None, None, None), (62, "", "en", "src0", 0)]


@pytest.fixture
def both(spark, rows, tmp_path):
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    names = list({n.lower(): n for n in NAMES}.values())
    wide = plain.withColumns({n: F.lit(k) for k, n in enumerate(names)})
    for name, docs in (("plain", plain), ("wide", wide)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.withColumns({n: F.lit("x") for n in ("of", "in", "text", "text_key")} if name == "wide" else {}).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    return f"{tmp_path}/plain", f"{tmp_path}/wide"


@pytest.mark.parametrize("name", ["op1_language_id", "op3_exact_dedup", "op4_quality", "op5_media_columns", "op6_bpe", "op7_simhash_near_dedup", "op8_mixing", "op11_fill_in_middle", "op12_best_fit_packing", "op13_merkle_manifest"])
def test_operators_ignore_other_columns(spark, both, name):
    query = Q.queries()[name]
    a, b = (sorted(query(spark, folder).collect(), key=repr) for folder in both)
    assert a == b and a


@pytest.mark.parametrize("k", range(5))
def test_stages_return_other_columns(spark, both, k):
    name, stage = corpus_pipeline.STAGES[k]
    plain, wide = (spark.read.parquet(f"{folder}/documents.parquet") for folder in both)
    a, b = stage(spark, plain, both[0]), stage(spark, wide, both[1])
    if k == 4:
        assert sorted(a.collect(), key=repr) == sorted(b.collect(), key=repr)
        return
    assert b.columns == wide.columns
    got = b.collect()
    assert sorted((r[:5] for r in got), key=repr) == sorted((tuple(r) for r in a.collect()), key=repr) and got
    assert all(list(r[5:]) == list(range(len(r) - 5)) for r in got), name


def test_payloads_of_any_column(spark):
    d = spark.createDataFrame([(1, "x<img src=sha256:aa>y")], "k long, html string")
    p = spark.createDataFrame([("aa", 10, "t", "p", 1, "z")], "digest string, size int, text string, caption string, k int, `a.b` string")
    got = resolved(sequences(d, "k"), "k", p)
    assert got.columns == ["k", "pos", "kind", "text", "digest", "caption", "size", "payload_text", "payload_caption", "payload_k", "a.b"]
    assert [(r.pos, r.size, r.payload_text) for r in sorted(got.collect())] == [(0, None, None), (1, 10, "t"), (2, None, None)]


BAD = ['{"a":[1e400]}', '{"a":"\\ud800"}', "[" * 3000 + "]" * 3000, '{"a":' * 500 + "1" + "}" * 500, "NaN", '{"a":-Infinity}', "1" * 5000, "", "{", '{"\\udfff":1}', '{"a":{"b":[{"c":1e999}]}}']


def test_bad_arguments_are_invalid(spark):
    calls = spark.createDataFrame([("c", f"k{i}", i, "t", x, None) for i, x in enumerate(BAD)] + [("c", "good", 99, "t", '{"a":"\\ud83d\\ude00"}', None)], "conv_id string, call_id string, turn long, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([], "conv_id string, call_id string, turn long, content string")
    got = {r.call_id: r for r in linked_calls(calls, results, {"t": {"type": "object"}}).collect()}
    assert all(got[f"k{i}"].status == "invalid" and '"arguments":null' in got[f"k{i}"].message for i in range(len(BAD)))
    assert got["good"].status == "open" and "\U0001f600" in got["good"].message


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=30)


@settings(max_examples=300, deadline=None)
@given(JSON.map(json.dumps) | st.text(max_size=40) | st.lists(st.sampled_from(["{", "}", "[", "]", ",", ":", '"a"', "1e400", "-0", "1E2", '"\\ud800"', "null", "NaN"]), max_size=12).map("".join))
def test_any_arguments_are_checked(text):
    value, errors = _checked("t", text, {"t": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "enum": [1, 2]}}}})
    line = canonical({"value": value, "errors": errors})
    line.encode("utf-8")
    assert json.loads(line)["errors"] == errors
