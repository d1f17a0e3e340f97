"""Language identification, quality, byte-pair encoding."""

import hashlib
import random
import struct
import zlib
from collections import Counter
from unittest.mock import patch

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storyloom.llm import queries as Q
from storyloom.llm.bpe import Bpe, coded, codec, coding_digests
from storyloom.llm.language_id import LENGTH, grams_of, held_out, identified, learned, letters_of, profiles
from storyloom.llm.quality import CHUNK, ByteConvNet, chunked, scored, trained

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, score double"


# ---- languages ----


def runs(text):
    out, now = [], ""
    for c in text + " ":
        if c.isalpha():
            low = c.lower()
            now += low if len(low) == 1 and low.isalpha() else c
        elif now:
            out.append(now)
            now = ""
    return out


def plain_list(known, text):
    counts = {}
    for run in runs(text):
        s = [1, *(known.alphabet.get(ord(c), 2) for c in run), 1]
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                g = s[i : i + n]
                if g != [1]:
                    code = int.from_bytes(bytes(g), "big")
                    counts[code] = counts.get(code, 0) + 1
    return sorted(counts, key=lambda c: (-counts[c], c))[:LENGTH]


def plain_distance(known, text, k):
    profile = {c: r for c, r in zip(known.codes.tolist(), known.ranks[k].tolist()) if r < LENGTH}
    return sum(abs(profile[c] - i) if c in profile else LENGTH for i, c in enumerate(plain_list(known, text)))


SAMPLES = [("en", "the cat and the dog are on the mat, and then they went home"), ("de", "der Hund und die Katze sind auf der Straße, für Öl"), ("fr", "le chat et le chien sont à la maison, où êtes-vous")]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="theDER été, ßİ1 \n中", max_size=40), min_size=1, max_size=5))
def test_distances_by_definition(texts):
    known = profiles(SAMPLES)
    far, size = known.distances(known.table(), texts)
    for i, t in enumerate(texts):
        assert size[i] == len(plain_list(known, t))
        assert [far[i][k] for k in range(3)] == [plain_distance(known, t, k) for k in range(3)]


def test_a_very_long_text_counts_like_a_short_one():
    known = profiles(SAMPLES)
    t = "die Katze und der Hund " * 60000
    far, _ = known.distances(known.table(), [t])
    assert far[0].argmin() == known.languages.index("de")
    both, _ = known.distances(known.table(), [t, "the dog"])
    assert (both[0] == far[0]).all()
    assert len(letters_of("")) == 2 and len(grams_of(known._symbols(known.table(), ""))) == 0


def test_language_odd_rows(spark):
    d = spark.createDataFrame([(1, None, "en", "a", 0.1), (2, "", None, None, None), (3, "123 !?", "de", "x", 0.2), (4, "und der die", None, "x", 0.3), (4, "und der die", None, "x", 0.3), (None, "the and the", "fr", "x", 0.3)], DOCS)
    got = identified(d, profiles(SAMPLES)).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (None, "en")]
    assert all(0 <= r.score <= 1 for r in got) and got[0].score == 0
    assert identified(d, learned(d.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert identified(d.limit(0), profiles(SAMPLES)).count() == 0


def test_language_learns_from_allowed_rows_only(spark):
    rows = [(i, "und der die das" if zlib.crc32(str(i).encode()) % 4 == 2 else "the and of", "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "en", "s", 0.0) for i in range(60)]
    known = learned(spark.createDataFrame([*rows, (None, "a", "zz", "s", 0.0), (70, None, "yy", "s", 0.0), (71, "b", None, "s", 0.0)], DOCS))
    assert known.languages == ["en"]
    assert spark.createDataFrame(rows, DOCS).where(held_out(F.col("doc_id"))).count() == sum(r[2] == "xx" for r in rows)
    assert len(learned(spark.createDataFrame([r for r in rows if r[2] == "en"] * 30, DOCS), rows=5).languages) == 1


def spark_hash(doc_id, text):
    h = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42))
    return h - (1 << 64) if h >> 63 else h


def answers_by_hand(rows, most):
    """Sample, profiles and answers by their definitions."""
    sample = []
    free = {(i, lang, t) for i, t, lang in rows if i is not None and lang is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2}
    for lang in {x[1] for x in free}:
        sample += sorted((x for x in free if x[1] == lang), key=lambda x: (spark_hash(x[0], x[2]), x[0]))[:most]
    letters = Counter(c for _, _, t in sample for run in runs(t) for c in run)
    alphabet = {c: 3 + k for k, c in enumerate(sorted(letters, key=lambda c: (-letters[c], c))[:250])}

    def ranks(texts):
        counts = Counter()
        for run in (run for t in texts for run in runs(t)):
            s = [1, *(alphabet.get(c, 2) for c in run), 1]
            counts.update(bytes(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n] != [1])
        return {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], int.from_bytes(g, "big")))[:LENGTH])}

    known = {lang: ranks([t for _, of, t in sample if of == lang]) for lang in sorted({x[1] for x in sample})}
    for i, t, _ in rows:
        own = ranks([t or ""])
        far = sorted((sum(abs(p[g] - k) if g in p else LENGTH for g, k in own.items()), lang) for lang, p in known.items())
        yield (i, far[0][1], 1 - far[0][0] / (far[1][0] if len(far) > 1 else len(own) * LENGTH)) if own and far else (i, "und", 0.0)


@pytest.mark.parametrize("most", [3, 1000])
def test_language_query_by_hand(spark, most):
    r = random.Random(8)
    words = {"en": "the and of cat Dog house".split(), "de": "der und die Öl Straße nicht".split(), "fr": "le été chat où les sont".split()}
    rows = [(r.choice([i, 7, 8, 9]), " ".join(r.choices(words[lang], k=r.choice([2, 9, 30]))), r.choice([lang, lang, None])) for i in range(160) for lang in words]
    rows += rows[:40] * 3 + [(1, None, "en"), (2, "", None), (3, "1 2", "de"), (None, "the cat", "en")]
    d = spark.createDataFrame([(i, t, lang, "s", 0.0) for i, t, lang in rows], DOCS).repartition(5)
    got = [(x.doc_id, x.lang_pred, round(x.score, 9)) for x in identified(d, learned(d, rows=most)).collect()]
    assert sorted(got, key=repr) == sorted(((i, lang, round(max(0.0, min(1.0, s)), 9)) for i, lang, s in answers_by_hand(rows, most)), key=repr)


def test_repeated_ids_neither_fill_nor_empty_the_sample(spark):
    """20,000 rows of one doc_id, equal ones and different ones, beside a few of another language."""
    for i in (1, 2, 3, 4, 5):
        if zlib.crc32(str(i).encode()) % 4 == 2:
            continue
        same = spark.range(20000).select(F.lit(i).alias("doc_id"), F.lit("the and of").alias("text"), F.lit("en").alias("lang"))
        other = spark.range(20000).select(F.lit(i).alias("doc_id"), F.concat(F.lit("der und "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
        assert learned(same).languages == ["en"]
        with patch("storyloom.llm.language_id.profiles", side_effect=list) as seen:
            sample = learned(same.union(other))
            assert seen.called and Counter(lang for lang, _ in sample) == {"en": 1, "de": 400}


def test_language_held_out_accuracy(spark):
    got = Q.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() / got.count() > 0.98


# ---- quality ----


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 900), min_size=1, max_size=5))
def test_chunks_cover_every_byte(sizes):
    r = random.Random(sum(sizes))
    texts = ["".join(r.choice("abcé") for _ in range(n)) for n in sizes]
    chunks, full, first = chunked(texts)
    for k, t in enumerate(texts):
        raw = t.encode()
        mine = chunks[first[k] : first[k + 1] if k + 1 < len(texts) else len(chunks)]
        assert bytes(mine[0][: len(raw)]) == raw[:CHUNK]
        if len(raw) > CHUNK:
            assert bytes(mine[-1]) == raw[-CHUNK:] and len(mine) == 1 + -(-(len(raw) - CHUNK) // (CHUNK - 8))
            windows = {bytes(c[i : i + 8]) for c in mine for i in range(CHUNK - 7)}
            assert {raw[i : i + 8] for i in range(len(raw) - 7)} <= windows
        else:
            assert full[first[k]] == np.float32(len(raw) / CHUNK)


def test_gradients_against_differences():
    net = ByteConvNet(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    texts, y = ["the cat sat on the mat " * 30, "$$$ buy now!!", ""], np.array([1.0, 0.0, 1.0])
    loss = lambda: -float(np.mean(y * np.log(net.predict(texts)) + (1 - y) * np.log(1 - net.predict(texts))))
    chunks, full, first = chunked(texts)
    grads = net._gradients(chunks, full, first, y)
    r = np.random.default_rng(0)
    for name, w in net.w.items():
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in w.shape)
            kept = w[at]
            w[at] = kept + 1e-5
            up = loss()
            w[at] = kept - 1e-5
            down = loss()
            w[at] = kept
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=2e-4), name


def test_quality_odd_rows(spark):
    net = ByteConvNet(1)
    d = spark.createDataFrame([(1, None, "en", "s", 0.1), (2, "", "en", "s", 0.1), (3, "é" * 200000, "en", "s", 0.1), (3, "x", None, None, None), (None, "x", None, None, None)], DOCS).withColumn("quality_score", F.lit("old"))
    got = scored(d, net).collect()
    assert [r.doc_id for r in got] == [1, 2, 3, 3, None] and got[0].quality_score == got[1].quality_score and got[3].quality_score == got[4].quality_score
    assert all(0 <= r.quality_score <= 1 for r in got) and got[0].score == 0.1
    assert scored(d.limit(0), net).count() == 0


def test_quality_training_rows(spark):
    d = spark.createDataFrame([(i, "good words" if i % 2 else "bad $$$", "en", "s", 0.0) for i in range(50)], DOCS)
    rows = [(i, i % 2, 0) for i in range(50)] + [(None, 1, 0), (7, None, 0), (8, 5, 0)]
    net = trained(d, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    p = net.predict(["good words", "bad $$$"])
    assert p[0] > 0.8 > 0.2 > p[1]
    none = trained(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.predict(["x"])[0] == pytest.approx(0.5)
    one = trained(d, spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int"))
    assert one.predict(["x"])[0] > 0.99


def test_quality_held_out_ranking(spark):
    got = Q.op4_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out and quality is not null").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


# ---- BPE ----

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="the anding'sre 0\n\t<|endoftext|>é", max_size=80))
def test_encoding_equals_the_library(text):
    t, b = Tokenizer.from_file(PATH) if not hasattr(test_encoding_equals_the_library, "t") else test_encoding_equals_the_library.t, codec(PATH)
    test_encoding_equals_the_library.t = t
    text = text.encode("utf-8", "ignore").decode()
    ids = b.encode_batch([text])[0].tolist()
    assert ids == t.encode(text, add_special_tokens=False).ids
    assert b.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_compatibility_by_definition():
    """A pair is compatible if and only if exact merging of its bytes gives it back."""
    b, r = codec(PATH), random.Random(6)
    tokens = [t for t in b.guessable.values()]
    short = [t for t in tokens if len(b.bytes_of[t]) <= 3]
    pairs = [(r.choice(tokens), r.choice(tokens)) for _ in range(1500)] + [(r.choice(short), r.choice(short)) for _ in range(4000)] + [(t, t) for t in short[:500]]
    bad = b._crossed(np.array([x for x, _ in pairs]), np.array([y for _, y in pairs]), True)
    for (x, y), crossed in zip(pairs, bad):
        assert (b.exact(b.bytes_of[x] + b.bytes_of[y]) != [x, y]) == crossed


def test_both_exact_mergers_agree():
    b, r = codec(PATH), random.Random(2)
    for n in (0, 1, 2, 30, 48, 49, 400):
        for _ in range(30):
            w = bytes(r.choice(b"thaeinrs \xc3\xa9") for _ in range(n))
            assert b._exact_short([b.byte_id[x] for x in w]) == b.exact(w)


def test_guesses_are_mended_and_memory_is_bounded(library, monkeypatch):
    b = Bpe(PATH)
    monkeypatch.setattr("storyloom.llm.bpe.REMEMBERED", 50)
    docs = [f"reheated word{i} thandble ingsh {i * 7919}" for i in range(100)] + ["a" * 5000, "ab" * 3000]
    got = [x.tolist() for i in range(0, len(docs), 7) for x in b.encode_batch(docs[i : i + 7])]
    assert got == [library.encode(d, add_special_tokens=False).ids for d in docs]
    assert b.merged_exactly and len(b.known) < 120


def test_coding_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "Hello  world\n<|endoftext|> né"), (3, "Hello  world\n<|endoftext|> né"), (None, "x" * 100000)]
    d = spark.createDataFrame([(i, t, "en", "s", 0.0) for i, t in rows], DOCS)
    got = coded(d, PATH, ("doc_id", "lang")).collect()
    assert [r.ids for r in got] == [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    assert [r.decoded for r in got] == [t or "" for _, t in rows] and [r.n_tokens for r in got] == [len(r.ids) for r in got] and got[0].lang == "en"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for a, b in zip(got, coding_digests(d, PATH).collect()):
        assert (b.doc_id, b.n_tokens, b.ids_sha256, b.decoded_sha256) == (a.doc_id, a.n_tokens, sha(",".join(map(str, a.ids))), sha(a.decoded))
    assert coded(d.limit(0), PATH).count() == 0 and coding_digests(d.limit(0), PATH).count() == 0
    assert "decoded" not in coded(d, PATH, decode=False).columns


def test_bpe_query_against_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in Q.op6_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
