"""Exact and near duplicates, components."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyloom.llm import oracles
from storyloom.llm.exact_dedup import ascii_lower, chunks_of, exact_duplicates
from storyloom.llm.simhash import BITS, fingerprint, group_bits, links, plan_partitions, probes, signature, signatures, simhash_components, similar_components, spanning_links, _factors
from tests.llm.conftest import same

DOCS = "doc_id long, text string, source string, of string, h long"


def docs(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "s", "x", 1) for i, t in rows], DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


ODD = [(1, "Hello World"), (2, "hello world"), (3, ""), (4, None), (5, "ÄÖ É"), (6, "äö é"), (7, "ÄÖ É"), (8, "x" * 50000), (9, "X" * 50000), (10, "x" * 49999 + "y"), (11, "hello world"), (11, "hello world"), (12, " "), (13, "İI ⅠA ΑΣ"), (14, "İi ⅠA ΑΣ")]


def test_exact_odd_texts_match_sql(spark, tables, oracle):
    d = docs(spark, ODD)
    folder = tables(documents=d)
    got = exact_duplicates(d)
    assert same(got, oracle(folder, oracles.EXACT_DEDUP, "documents"))
    r = {x.doc_id: x for x in got.collect()}
    assert r[1].keep_id == 11 and r[1].group_size == 4 and r[11].kept and not r[1].kept
    assert r[3].keep_id == 4 and r[5].keep_id == 7 and r[6].kept
    assert r[13].keep_id == 14
    assert r[8].text_sha256 == hashlib.sha256(("x" * 50000).encode()).hexdigest() and r[8].keep_id == 9 and r[10].kept


def test_no_letter_beyond_ascii_is_lowered(spark):
    """Every code point, alone and beside a capital, by itself and through the whole operator."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = spark.createDataFrame([(c, chr(c) + "Zz") for c in points], "c int, t string").repartition(8)
    wrong = texts.where(ascii_lower(F.col("t")) != F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    assert wrong.count() == 0 and texts.count() == len(points)


def test_texts_that_newer_letters_tell_apart_stay(spark):
    pairs = [("Ⱟ y", "ⱟ y"), ("Ꟁ", "ꟁ"), ("Ʂ", "ʂ"), ("ẞ", "ß"), ("\U00010570", "\U00010597"), ("Ა", "ა"), ("Ä", "ä")]
    rows = [(2 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    got = exact_duplicates(docs(spark, rows)).collect()
    assert all(r.kept and r.group_size == 1 for r in got) and len(got) == len(rows)


def test_exact_with_forced_digest_collisions(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("ab. \n") for _ in range(r.randrange(0, 200)))) for i in range(120)]
    rows += [(1000 + i, t.upper()) for i, t in rows[:60]] + [(5000, None), (5001, "")]
    d = docs(spark, rows)
    key = lambda df: sorted((x.doc_id, x.keep_id, x.group_size, x.kept) for x in df.collect())
    assert key(exact_duplicates(d, least=8, most=32, digest_bits=8)) == key(exact_duplicates(d))


def test_exact_empty_table_and_null_ids(spark):
    assert exact_duplicates(docs(spark, [])).count() == 0
    rows = {(x.doc_id, x.kept) for x in exact_duplicates(docs(spark, [(None, "a"), (2, "A"), (None, "z")])).collect()}
    assert rows == {(None, False), (2, True), (None, True)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aA .\nÉé𝄞", max_size=60), min_size=1, max_size=6))
def test_chunks_join_to_the_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chunks_of(F.col("t"), 5, 12).alias("c"), ascii_lower(F.col("t")).alias("l")).collect()
    for r in rows:
        assert "".join(r.c) == r.t and all(0 < len(c) <= 12 for c in r.c) and r.l == lower(r.t)


# ---- SimHash ----


def plain_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(BITS) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\x1c\x0b\x85\xa0é", max_size=40))
def test_fingerprint_by_definition(text):
    assert fingerprint(text) == plain_fingerprint(text)


def closure(fps, radius=4):
    ids = list(fps)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def near_copies(n=140, seed=4):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(200)]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(1, 90))) for _ in range(n // 3)]
    rows = list(enumerate(base))
    while len(rows) < n:
        t = r.choice(base).split()
        for _ in range(r.randrange(0, 3)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((len(rows), " ".join(t).upper() if r.random() < 0.3 else " ".join(t)))
    return rows


def test_components_against_all_pairs(spark):
    rows = [*near_copies(), (900, None), (901, ""), (902, " \n"), (903, "One")]
    want = closure({i: plain_fingerprint(t) for i, t in rows})
    for block in (4096, 3):  # in blocks of three, every bucket is dealt as pairs of blocks
        got = simhash_components(docs(spark, rows), block=block).collect()
        assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert {r.fingerprint for r in got if r.doc_id in (900, 901, 902)} == {"0" * 16}
    assert all(r.fingerprint == f"{plain_fingerprint(dict(rows)[r.doc_id]):016x}" for r in got)


def test_simhash_repeated_rows_nulls_and_empty(spark):
    got = simhash_components(docs(spark, [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (2, "q r s t u v"), (None, "lonely words here now")])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.component_id) == [(-1, 5), (2, 2), (5, 5), (5, 5)] and len(got) == 5
    assert simhash_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 4, 8])
@pytest.mark.parametrize("n", [50, 10**6, 10**10])
def test_plan_is_a_pigeonhole(radius, n):
    r = np.random.default_rng(radius)
    bits = (r.random((4000, BITS)) < r.random(BITS)).astype(float)
    bits[:, 1] = bits[:, 0]  # two bits that always agree
    plan = plan_partitions(n, bits.T @ bits * (n / 4000), radius)
    used = [b for g, _ in plan for b in g]
    assert len(used) == len(set(used)) and sum(t + 1 for _, t in plan) == radius + 1 and all(t >= 0 for _, t in plan)
    groups = group_bits(np.abs(np.corrcoef(bits.T)) - np.eye(BITS), 4)
    assert sorted(b for g in groups for b in g) == list(range(BITS)) and any({0, 1} <= set(g) for g in groups)


def test_links_span_every_linked_pair(spark):
    r = random.Random(9)
    seeds = [r.getrandbits(64) for _ in range(6)]
    fps = {}
    while len(fps) < 160:
        f = r.choice(seeds)
        for _ in range(r.randrange(0, 9)):
            f ^= 1 << r.randrange(64)
        fps[len(fps)] = f
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    c = spark.createDataFrame([(signed(f), i) for i, f in fps.items()], "fp long, rep long")
    want = closure(fps)
    for plan in ([(list(range(0, 20)), 1), (list(range(20, 40)), 1), (list(range(40, 64)), 0)], [(list(range(0, 32)), 2), (list(range(32, 64)), 1)]):
        for block in (4096, 5):
            e = [(x.a, x.b) for x in links(c, plan, 4, block).collect()]
            assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in e)
            up = {i: i for i in fps}

            def root(x, up=up):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in e:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
            assert {i: root(i) for i in fps} == want
    assert probes(c.withColumn("sketch", F.lit(None).cast("binary")), [(list(range(10)), 1)]).count() == 160 * 11


def test_a_large_bucket_gives_a_forest():
    fps = np.array([(1 << (i % 60)) if i else 0 for i in range(300)], np.uint64)
    links_ = spanning_links(np.unique(fps), 4)
    assert sum(len(n) for _, n in links_) == len(np.unique(fps)) - 1


def test_similarity_of_shingles(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [r.choices(words, k=r.randrange(60, 400)) for _ in range(40)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        near, far = list(b), list(b)
        near[r.randrange(len(near))] = "new"
        for k in range(0, len(far), 6):
            far[k] = f"x{k}"
        rows += [(100 + i, " ".join(near).upper()), (200 + i, " ".join(far))]
    rows += [(900, None), (901, ""), (902, "tiny"), (903, "TINY"), (904, "tiny text")]
    got = {x.doc_id: x.component_id for x in similar_components(docs(spark, rows)).collect()}
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows if t}
    sure = [(i, 100 + i) for i in range(40) if len(sets[i] & sets[100 + i]) / len(sets[i] | sets[100 + i]) >= 0.9]
    assert len(sure) > 30 and all(got[a] == got[b] for a, b in sure)
    assert all(got[200 + i] == 200 + i for i in range(40))
    assert got[901] == 900 and got[903] == 902 and got[904] == 904


def test_sketch_estimates_similarity(spark):
    f = _factors(128, 42)
    a = [f"a{i}" for i in range(1000)]
    b = a[:900] + [f"b{i}" for i in range(100)]
    x, y = (np.frombuffer(signature(" ".join(t), 5, f)[1], np.uint8) for t in (a, b))
    assert abs((x == y).mean() - 896 / 1096) < 0.12
    assert signature(None, 5, f) == (0, bytes(128)) and signatures(docs(spark, [])).count() == 0


def jaccard(a, b, width=5):
    x, y = ({tuple(t.lower().split()[k : k + width]) for k in range(max(1, len(t.split()) - width + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def brute(rows, least=0.8):
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if jaccard(a, b) >= least:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def test_cut_appended_and_inserted_blocks_meet(spark):
    r = random.Random(12)
    words = [f"w{i}" for i in range(2000)]
    line = [r.choice(words) for _ in range(30)]
    rows, met = [], 0
    for i in range(48):
        base = r.choices(words, k=r.choice([40, 120, 400])) + (line if i % 2 else [])
        cut = max(1, round(len(base) * (1 - r.uniform(0.8, 0.95))))
        new, at = r.choices(words, k=cut), r.randrange(len(base))
        copy = [base[:-cut], base + new, base[:at] + new + base[at:]][i % 3]
        rows += [(i, " ".join(base)), (100 + i, " ".join(copy))]
        met += jaccard(rows[-1][1], rows[-2][1]) >= 0.8
    want = brute(rows)
    assert met > 30 and len(set(want.values())) < len(rows) - 30
    # whole components, and dealt as slices and pairs of blocks; with and without counts
    for block, sample, small, slice_ in ((1 << 20, 8_000, 64, 256), (500, 10, 1, 256), (1 << 20, 10, 1, 3)):
        assert {x.doc_id: x.component_id for x in similar_components(docs(spark, rows), block=block, sample=sample, small=small, slice_=slice_).collect()} == want


def test_a_large_group_meets_through_pivots(spark):
    """Copies that drift away step by step, copies about one text, and texts that only share a passage: one candidate component, many slices."""
    r = random.Random(14)
    words = [f"w{i}" for i in range(3000)]
    now, rows = r.choices(words, k=100), []
    for i in range(60):
        rows.append((i, " ".join(now)))
        at = r.randrange(95)
        now = now[:at] + r.choices(words, k=1 if i % 20 else 40) + now[at + 1 :]
    base = r.choices(words, k=100)
    for i in range(60):
        at = r.randrange(100)
        rows.append((100 + i, " ".join(base[:at] + [f"x{i}"] + base[at + 1 :])))
    passage = r.choices(words, k=60)
    rows += [(200 + i, " ".join(passage + r.choices(words, k=r.choice([5, 40])))) for i in range(40)]
    want = brute(rows)
    assert 3 < len(set(want.values())) < 60
    for slice_, one_of in ((5, 1), (16, 2)):
        assert {x.doc_id: x.component_id for x in similar_components(docs(spark, rows), small=4, slice_=slice_, one_of=one_of).collect()} == want


def test_the_threshold_is_exact(spark):
    r = random.Random(13)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(120):
        base = r.sample(words, 104)  # 100 shingles, all different
        at = round(100 * (1 - 2 * (s := 0.70 + 0.2 * i / 120) / (1 + s)))
        rows += [(i, " ".join(base)), (1000 + i, " ".join(base[:-at] + [f"n{i}x{k}" for k in range(at)]))]
    base = r.sample(words, 94)  # 90 shingles; 80 of them in common with 90 others: 80 of 100
    rows += [(500, " ".join(base)), (501, " ".join([*base[:84], *(f"e{k}" for k in range(10))]))]
    assert jaccard(rows[-1][1], rows[-2][1]) == 0.8
    got = {x.doc_id: x.component_id for x in similar_components(docs(spark, rows)).collect()}
    assert got == brute(rows) and got[501] == 500
    assert sum(got[1000 + i] == i for i in range(120)) in range(50, 70)


def test_texts_that_nobody_asks_for_are_not_shuffled(spark):
    """With more ids than are sent at once the texts are fetched turn by turn; each that is named comes once."""
    from storyloom.functions.session import checkpointed
    from storyloom.llm.similarity import texts_of

    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).withColumn("text_key", F.xxhash64("text"))
    wanted = checkpointed(rows.where("doc_id % 10 = 3").select(F.col("doc_id").alias("rep_id"), F.col("text_key").alias("rep_key"), F.lit(1).alias("more")))
    for most in (1000, 30):
        found = texts_of(rows, wanted, most)
        assert sorted(r.doc_id for r in found.collect()) == list(range(3, 2000, 10))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LeftSemi") == -(-200 // most) and plan.count("strategy=broadcast") == plan.count("LeftSemi")
