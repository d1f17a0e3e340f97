"""Fill-in-the-middle, packing and the Merkle manifest against SQL, brute force and their own definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storyloom.llm import oracles, packing
from storyloom.llm import queries as Q
from storyloom.llm.fim import STRETCH, fill_in_middle, restored
from storyloom.llm.merkle import fold, height, levels_of, merkle_manifest, siblings, without_line_ends
from storyloom.llm.packing import Supersteps, Words, _blocks, fewest, match_table, packed, placed
from storyloom.llm.ranks import ranked
from tests.llm.conftest import same

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, rank long, part int, block long, `a.b` int"


def text(r, n):
    return "".join(r.choice(["ab", "Cd", " ", "\n", "é", "中", "𝄞", "1", "<", ">", ".", "x" * 40]) for _ in range(n))


def odd_rows(r, n=160):
    rows = [(i, text(r, r.choice([0, 1, 5, 31, 32, 33, 64, 65, 300])), r.choice(["en", None]), r.choice(["s0", "s0", "s1", "é", "", None]), r.choice([3, None])) for i in range(n)]
    rows += [(n, None, None, None, None), (n + 1, "", "", "", 0), (n + 2, "has <P> in it", "en", "s0", 1), (n + 3, "<S>", "en", "s9", 1), (None, "no id\nat all", "en", "s0", 1), (None, None, None, None, None)]
    rows += [rows[7], rows[7], (7, "another text of id 7", "en", "s1", 2), (n + 4, "a" * 5000, "en", "s0", 1), (n + 5, text(r, 4000), "en", "s0", 1), (-3, "negative", "en", "s1", 1)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in rows], DOCS)


@pytest.fixture
def odd(spark):
    return table(spark, odd_rows(random.Random(11)))


# ---- ranks ----


def test_ranks_in_groups_of_any_size(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b", "hot", "hot", "hot"]), r.choice([None, 1, 2, 3, 900])) for _ in range(3000)] + [("hot", 5)] * 1500
    got, sizes = ranked(spark.createDataFrame(rows, "g string, v int").repartition(5), "g", ["v"])
    by = defaultdict(list)
    for x in got.collect():
        by[x.g].append((x["rank"], x.v, x.total))
    assert {x.g: x.total for x in sizes.collect()} == Counter(g for g, _ in rows)
    for g, found in by.items():
        found.sort(key=lambda x: x[0])
        assert [k for k, _, _ in found] == list(range(len(found))) and {t for *_, t in found} == {len(found)}
        values = [v for _, v, _ in found]
        assert values == sorted(values, key=lambda v: (v is not None, v or 0)) and Counter(values) == Counter(v for k, v in rows if k == g)


# ---- fill in the middle ----


def cut_by_hand(doc_id, t):
    t = t or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = [int(x, 16) for x in re.findall("." * 8, hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest())[:4]]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, t
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_by_hand_and_restored(spark, odd):
    got = fill_in_middle(odd).withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == odd.count()
    want = Counter((r.doc_id, r.text or "", *cut_by_hand(r.doc_id, r.text)) for r in odd.collect())
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert all(r.again == r.text for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_matches_sql(spark, odd, tables, oracle):
    folder = tables(documents=odd)
    assert same(Q.op11_fill_in_middle(spark, folder), oracle(folder, oracles.FILL_IN_MIDDLE, "documents"))


def test_fim_cuts_at_every_border(spark):
    """Texts of one to three stretches of single characters and of words, with many ids, so that cuts fall on all units."""
    rows = [(i, ("ab1" * 40)[: 2 * STRETCH + d], None, None, None) for i in range(60) for d in (-1, 0, 1, 3)]
    got = fill_in_middle(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((i, t, *cut_by_hand(i, t)) for i, t, *_ in rows)


def test_fim_empty_table(spark):
    assert fill_in_middle(table(spark, [])).count() == 0


# ---- packing ----

WORDS = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["Hello", " ", "  ", "\n", "\t", " ", "\x1c", "it's", "'S", "é", "́a", "ΑΣ", "Σ", "İ", "ß", "中文", "𝄞", "123", "<|endoftext|>", "<|start", "oftext|>", ",.", "\r\n", " ", "don't", "\x00"]), max_size=25).map("".join))
def test_ids_are_the_librarys(words):
    library = Tokenizer.from_file(WORDS)
    assert np.frombuffer(HELD.ids(["it's", words])[1], "<u4").tolist() == library.encode(words, add_special_tokens=False).ids


HELD = Words(WORDS, most=2000)


def test_long_texts_go_in_blocks():
    t = "abc, d\n" * 400_000
    assert "".join(_blocks(t)) == t and len(list(_blocks(t))) > 1 and list(_blocks("x" * 3_000_000)) == ["x" * 3_000_000] and list(_blocks("")) == [""]
    held = Words(WORDS)
    part = len(np.frombuffer(held.ids(["abc, d\n"])[0], "<u4"))
    assert len(np.frombuffer(held.ids([t])[0], "<u4")) == 400_000 * part


def test_words_of_plain_texts_are_held_in_lower_case():
    """Each once, whatever its case; a text with other letters keeps its own."""
    held, library = Words(WORDS), Tokenizer.from_file(WORDS)
    texts = ["Straße, word Word WORD\nÉtÀ wORD's", "Word \u0130 word"]
    assert [np.frombuffer(x, "<u4").tolist() for x in held.ids(texts[:1])] == [library.encode(texts[0], add_special_tokens=False).ids]
    assert "word" in held.words and not {"Word", "WORD"} & set(held.words)
    assert [np.frombuffer(x, "<u4").tolist() for x in held.ids(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("'stREvelmd a1.,\n\x01éÀÿ×€", max_size=30), max_size=5))
def test_runs_are_the_librarys(texts):
    library = Tokenizer.from_file(WORDS)
    assert [np.frombuffer(x, "<u4").tolist() for x in HELD.ids(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_runs_are_held_once_whatever_stands_beside_them():
    held = Words(WORDS)
    assert held.ids(["Dog. dog, (DOG)\nd\u014dg"]) and set(held.words) == {"dog", ".", ",", "(", ")", "\x01d\u014dg"}


def test_words_are_held_from_task_to_task(spark, monkeypatch):
    """A task comes to a worker as a copy; the words that the worker knows don't."""
    docs, tasks, made = table(spark, odd_rows(random.Random(1), 2)), [], []
    start = Words.__init__
    monkeypatch.setattr(packing, "checkpointed", lambda df: df)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, schema: tasks.append(task))
    monkeypatch.setattr(Words, "__init__", lambda self, *a: made.append(a) or start(self, *a))
    packing.tokenised(docs, WORDS, 256)
    for _ in range(3):
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["held"]})
        assert sum(b.num_rows for b in cloudpickle.loads(cloudpickle.dumps(tasks[0]))(iter([batch]))) == 1
    assert len(made) <= 1


def lay(lengths, capacity):
    """Sequence and offset of each piece, checked to be gapless and within the capacity; the number of sequences."""
    lengths = np.array(lengths, np.int64)
    steps = fewest(dict(Counter(lengths.tolist())), capacity)
    order = np.argsort(lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths)) - np.searchsorted(lengths[order], lengths[order])
    sequence, offset = placed(match_table(steps.matches), lengths, rank)
    end = Counter()
    for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True)):
        assert end[s] == o
        end[s] += n
    assert max(end.values()) <= capacity and len(end) == steps.sequences == max(end) + 1
    return steps.sequences


def one_by_one(lengths, capacity):
    """Best fit of the longest first."""
    gaps, n = Counter(), 0
    for x in sorted(lengths, reverse=True):
        g = min((g for g in gaps if g >= x and gaps[g]), default=None)
        if g is None:
            n, g = n + 1, capacity
        else:
            gaps[g] -= 1
        gaps[g - x] += 1
    return n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=300))
def test_supersteps_lay_every_piece(lengths):
    n = lay(lengths, 64)
    assert -(-sum(lengths) // 64) <= n <= one_by_one(lengths, 64) * 1.1 + 1


def test_supersteps_are_near_the_least():
    r = np.random.default_rng(1)
    mixed = np.clip(r.lognormal(5.8, 0.6, 20000), 1, 2048).astype(int).tolist()
    assert lay(mixed, 2048) <= one_by_one(mixed, 2048) * 1.002
    assert lay([700] * 300, 2048) == 150 and lay([2048] * 5 + [1] * 4096, 2048) == 7 and lay([1024] * 7, 2048) == 4


def test_matches_do_not_grow_with_the_pieces():
    counts = {int(n): 3 + int(n) % 7 for n in range(1, 2049)}
    few, many = (len(Supersteps({k: v * m for k, v in counts.items()}, 2048).matches) for m in (1, 10**6))
    assert many < 3 * few < 100_000


def test_packed_rows(spark, odd):
    library = Tokenizer.from_file(WORDS)
    got = packed(odd, WORDS, 256).collect()
    want = Counter()
    for d in odd.collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 0]
        for k, i in enumerate(range(0, len(ids), 256)):
            want[d.doc_id, k, i, len(ids[i : i + 256]), zlib.crc32(np.array(ids[i : i + 256], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    end = Counter()
    for s, o, n in sorted((r.sequence_id, r.offset, r.length) for r in got):
        assert end[s] == o
        end[s] += n
    assert max(end.values()) <= 256 and len(end) <= one_by_one([r.length for r in got], 256) + 1
    assert [(f.name, f.dataType.simpleString()) for f in packed(odd, WORDS).schema][1:] == [("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]


def test_packed_empty_table(spark):
    assert packed(table(spark, []), WORDS).count() == 0


# ---- Merkle manifest ----


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def manifest_by_hand(rows):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, source, n: sha("".join(map(shown, (i, source, lang, n, t))))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    trees = {s: sorted(v, key=lambda x: x[:3]) for s, v in by.items()}

    def up(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    levels = {s: up([x[2] for x in v]) for s, v in trees.items()}
    order = sorted(levels, key=lambda s: (s is not None, (s or "").encode()))
    top = up([levels[s][-1][0] for s in order])
    out = Counter()
    for s, v in trees.items():
        for i, (*_, own, r) in enumerate(v):
            chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node, forged, proof = own, leaf(r[0], r[1].replace("\n", ""), *r[2:]) if chosen else own, ""
            for tree, at in ((levels[s], i), (top, order.index(s))):
                for below in tree[:-1]:
                    first = at - at % 3
                    left, right = "".join(below[first:at]), "".join(below[at + 1 : first + 3])
                    node, forged, proof, at = sha(left + node + right), sha(left + forged + right), proof + left + right, at // 3
            assert node == top[-1][0]
            out[r[0], own, levels[s][-1][0], node, sha(proof), forged, forged == node] += 1
    return out


def manifest(df, **how):
    rows = merkle_manifest(df, without_line_ends(), **how).collect()
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, sha(r.proof), r.folded_root, r.verified) for r in rows)


@pytest.mark.parametrize(("levels", "top"), [(6, 4096), (1, 4096), (2, 10), (1, 1), (1, 3)])
def test_manifest_by_hand(spark, odd, levels, top):
    """Blocks reduced once and many times over, up to the driver building one node only."""
    rows = [tuple(r)[:5] for r in odd.collect()]
    got = manifest(odd, levels=levels, top=top)
    assert got == manifest_by_hand(rows) and {k[-1] for k in got} == {True, False}


def test_manifest_of_many_sources(spark):
    """More sources than the driver may get: their subroots are reduced in blocks as well."""
    rows = [(i, f"t{i}\n", "en", f"source {i % 37}", i) for i in range(150)]
    assert manifest(table(spark, rows), levels=1, top=2) == manifest_by_hand(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 27, 28])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "x\n" * i, "en", "s", i) for i in range(n)]
    assert manifest(table(spark, rows), levels=2, top=4) == (manifest_by_hand(rows) if n else Counter())


def test_manifest_matches_sql(spark, odd, tables, oracle):
    folder = tables(documents=odd)
    assert same(Q.op13_merkle_manifest(spark, folder), oracle(folder, oracles.merkle(), "documents"))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 100))
def test_every_node_folds_to_the_root(n):
    levels = levels_of([sha(str(i)) for i in range(n)], n, True)
    assert len(levels) - 1 == height(n) and all(fold(levels[0][i], siblings(levels, i)) == levels[-1][0] for i in range(n))
