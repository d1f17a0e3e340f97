"""Running values over keys that lie in many parts, against windows over whole keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from storyloom.operators.joins import nearest
from storyloom.operators.sequences import islands, neighbour_windows
from storyloom.operators.stretches import Stretches
from storyloom.plans.scenes import page_lines, split_scenes


def rows_of(seed, n=700):
    """Keys of very different sizes, ties, nulls."""
    r = random.Random(seed)
    keys = ["hot"] * 12 + ["a", "b", "c", None]
    return [(r.choice(keys), r.choice([None, *range(60)]), i, r.choice([None, 1, 2, 5, -3])) for i in range(n)]


@pytest.mark.parametrize("kind", ["sum", "max", "min", "last"])
@pytest.mark.parametrize("backward", [False, True])
def test_running_values(spark, kind, backward):
    df = spark.createDataFrame(rows_of(1), "k string, t int, i int, v int").repartition(3, "i")
    w = Window.partitionBy("k").orderBy(*((F.desc_nulls_last("t"), F.desc("i")) if backward else (F.asc_nulls_first("t"), F.asc("i")))).rowsBetween(Window.unboundedPreceding, 0)
    whole = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[kind]
    want = {r.i: r.x for r in df.select("i", whole("v").over(w).alias("x")).collect()}
    s = Stretches(df, ["k"], [F.col("t").asc_nulls_first(), F.col("i").asc()], parts=9)
    assert s.rows.select("_part").distinct().count() > 5
    got = s.running("x", kind, F.col("v"), backward=backward).done()
    assert {r.i: r.x for r in got.collect()} == want and got.columns == ["k", "t", "i", "v", "x"]


def test_without_keys_and_rows(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "t int, i int")
    got = Stretches(df, [], [F.col("i").asc()], parts=4).running("n", "sum", F.lit(1), before=True).done()
    assert {r.i: r.n for r in got.collect()} == {i: i or None for i in range(100)}
    assert Stretches(df.limit(0), ["t"], [F.col("i").asc()]).running("n", "max", F.col("i")).done().count() == 0


@pytest.mark.parametrize("seed", [2, 3])
def test_islands_of_a_hot_key(spark, seed):
    r = random.Random(seed)
    spans = [(r.choice(["hot", "hot", "hot", "x"]), s := r.randrange(4000), s + r.choice([0, 1, 3, 40]), i) for i in range(900)]
    df = spark.createDataFrame(spans, "k string, s int, e int, i int")
    plain, spread = (sorted(tuple(x) for x in islands(df, ["k"], "s", "e", 2, spread=how).select("i", "island").collect()) for how in (False, True))
    assert plain == spread and max(x[1] for x in plain) > 20


def test_nearest_of_a_hot_key(spark):
    r = random.Random(4)
    asks = spark.createDataFrame([(r.choice(["hot", "hot", "x", "none"]), r.choice([None, *range(0, 3000, 7)]), i) for i in range(400)], "k string, target int, i int")
    marks = spark.createDataFrame([(r.choice(["hot", "hot", "hot", "x"]), r.choice([None, *range(3000)])) for _ in range(500)], "k string, at int")
    plain, spread = (sorted((tuple(x) for x in nearest(asks, marks, "target", "at", ["k"], spread=how).select("i", "nearest").collect()), key=repr) for how in (False, True))
    assert plain == spread and len(plain) == 400


@pytest.mark.parametrize("n", [0, 1, 4])
def test_neighbours_over_borders(spark, n):
    rows = [("hot" if i % 10 else "x", i, i * 2.0, i * 2.0 + 1, f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, index int, start_sec double, end_sec double, text string")
    plain, spread = (sorted(tuple(map(str, x)) for x in neighbour_windows(df, ["k"], "index", n, spread=how, block=16).collect()) for how in (False, True))
    assert plain == spread and len(plain) == 300


def test_scenes_of_one_long_story(spark):
    r = random.Random(5)
    pages = [("s", p, "\n".join(r.choice([f"{r.randrange(1, 99)} INT. PLACE {p} - DAY", f"{p} OMITTED", "words", "", "ANN", "Rev. 1"]) for _ in range(r.randrange(9)))) for p in range(120)]
    lines = page_lines(spark.createDataFrame(pages, "story_id string, page_no int, text string"))
    plain, spread = (sorted(tuple(map(str, x)) for x in split_scenes(lines, spread=how).collect()) for how in (False, True))
    assert plain == spread and len(plain) > 50


def test_a_hot_key_lies_in_many_tasks(spark):
    """One key of 300,000 rows in 50 parts or more, each a share of them."""
    df = spark.range(300_000).select(F.lit("one").alias("k"), F.col("id").alias("t"))
    s = Stretches(df, ["k"], [F.col("t").asc()], parts=64)
    sizes = [r["count"] for r in s.rows.groupBy("_part").count().collect()]
    assert len(sizes) >= 50 and max(sizes) < 20_000
    assert s.running("n", "sum", F.lit(1)).done().where("n <> t + 1").count() == 0
