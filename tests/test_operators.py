"""Operators against plain Python, and their behaviour on odd input."""

import random
import time
from bisect import bisect_left

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyloom.functions.numeric import rounded
from storyloom.operators.components import connected_components
from storyloom.operators.gaps import gap_quantiles, majority, max_gaps, top_values
from storyloom.operators.joins import band_join, nearest
from storyloom.operators.sequences import islands, running_index

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def components(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (7, 8), (8, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    want = components(edges)
    for small in (0, 10_000):
        got = connected_components(df, small=small).collect()
        assert {x.node: x.component for x in got} == want and len(got) == len(want)
    assert connected_components(df.limit(0)).count() == 0


@QUICK
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=15))
def test_components_property(spark, edges):
    df = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "a string, b string")
    got = {x.node: x.component for x in connected_components(df).collect()}
    assert got == components([(str(a), str(b)) for a, b in edges])


def test_max_gaps(spark):
    rows = [("a", 1), ("a", 1), ("a", 5), ("a", 9), ("b", 3), ("c", 1), ("c", 10), ("c", 12), ("a", None), (None, 4)]
    got = {r.k: r for r in max_gaps(spark.createDataFrame(rows, "k string, p int"), ["k"], "p").collect()}
    assert set(got) == {"a", "c"}
    assert (got["a"].gap_jump, got["a"].position_a, got["a"].position_b, got["a"].freq, got["a"].positions) == (4, 1, 5, 3, [1, 5, 9])
    assert got["a"].coverage == 3 / 9 and got["c"].gap_absent == 8


def test_quantiles_of_committed_example(spark):
    df = spark.createDataFrame([(1, g) for g in (7, 12, 35, 82)], "k int, gap_jump int")
    r = gap_quantiles(df, ["k"]).first()
    assert (r.q50, r.q75) == (23.5, 46.75)


def test_majority_and_top_values(spark):
    rows = [(1, "x", 3), (1, "y", 1), (1, "y", 5), (1, "x", 4), (1, "z", 0)]
    df = spark.createDataFrame(rows, "k int, v string, o int")
    assert majority(df, ["k"], "v", "o", "m").first().m == "y"
    assert top_values(df, ["k"], "v", "o", "t", 2).first().t == ["y", "x"]


@QUICK
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 15)), min_size=1, max_size=25), st.integers(0, 5))
def test_islands_property(spark, spans, gap):
    rows = [(1, i, float(s), float(s + d)) for i, (s, d) in enumerate(spans)]
    got = {r.i: r.island for r in islands(spark.createDataFrame(rows, "k int, i int, s double, e double"), ["k"], "s", "e", gap).collect()}
    order, group, reach = sorted(rows, key=lambda r: (r[2], r[3])), -1, None
    want = {}
    for _, i, s, e in order:
        if reach is None or s > reach + gap:
            group, reach = group + 1, e
        reach = max(reach, e)
        want[i] = group
    # rows of equal bounds may come in either order but are in one island
    assert got == want


@QUICK
@given(st.lists(st.integers(0, 40), min_size=1, max_size=10), st.lists(st.integers(-3, 45), min_size=1, max_size=10))
def test_nearest_property(spark, marks, asks):
    marks = sorted(set(marks))

    def want(t):
        p = bisect_left(marks, t)
        near = [m for m in marks[max(0, p - 1) : p + 1]]
        return min(near, key=lambda m: (abs(m - t), m))

    a = spark.createDataFrame([("k", i, t) for i, t in enumerate(asks)], "k string, i int, t int")
    m = spark.createDataFrame([("k", x) for x in marks], "k string, v int")
    assert {r.i: r.nearest for r in nearest(a, m, "t", "v", ["k"]).collect()} == {i: want(t) for i, t in enumerate(asks)}


def test_nearest_without_marks(spark):
    a = spark.createDataFrame([("k", 1), ("q", 2)], "k string, t int")
    m = spark.createDataFrame([("k", 5)], "k string, v int")
    assert {(r.k, r.nearest) for r in nearest(a, m, "t", "v", ["k"]).collect()} == {("k", 5), ("q", None)}


def test_band_join(spark):
    r = random.Random(2)
    left = [(i, r.uniform(-50, 50)) for i in range(60)]
    right = [(i, r.uniform(-50, 50)) for i in range(60)] + [(99, left[0][1] + 7.0)]
    got = band_join(spark.createDataFrame(left, "a int, x double"), spark.createDataFrame(right, "b int, y double"), "x", "y", 7.0)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((a, b) for a, x in left for b, y in right if abs(y - x) <= 7.0)


def test_running_index_over_the_whole_table(spark):
    rows = [(i * 7, i % 3 != 0) for i in range(-50, 400)]
    df = spark.createDataFrame(rows, "o long, on boolean").repartition(5)
    want, n = {}, 0
    for o, on in sorted(rows):
        want[o], n = (n, n + 1) if on else (-1, n)
    assert {r.o: r.ix for r in running_index(df, "o", F.col("on"), "ix", width=64).collect()} == want


def test_exact_rounding(spark):
    df = spark.createDataFrame([(2.675,), (0.12345,), (None,)], "x double")
    assert [r.r for r in df.select(rounded(F.col("x"), 2, exact=True).alias("r")).collect()] == [2.67, 0.12, None]
    assert df.select(rounded(F.col("x"), 2).alias("r")).first().r == 2.68


def test_nearest_of_a_million_marks(spark):
    """One key: time grows with the marks, not with their square."""
    marks = spark.range(1_000_000).select(F.lit("k").alias("k"), (F.col("id") * 10).alias("v"))
    asks = spark.range(1000).select(F.lit("k").alias("k"), (F.col("id") * 9973 + 5).alias("t"))
    began = time.perf_counter()
    rows = nearest(asks, marks, "t", "v", ["k"]).collect()
    assert time.perf_counter() - began < 60 and len(rows) == 1000
    assert all(r.nearest == min((r.t // 10 * 10, r.t // 10 * 10 + 10), key=lambda v: (abs(v - r.t), v)) for r in rows if r.t < 9_999_990)
