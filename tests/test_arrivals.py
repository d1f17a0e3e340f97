"""Groups in order of arrival against replaying the rows one by one."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.operators import arrivals
from storyloom.operators.arrivals import merge_order, ordered_distinct


def replayed(rows):
    """``{(story, row): (first row, position)}``: lists of rows that are appended to each other."""
    groups, out = {}, {}
    for story, row, names in sorted(rows, key=lambda x: x[:2]):
        held = groups.setdefault(story, [])
        names = {n for n in names or [] if n is not None}
        met = [g for g in held if names & g["names"]]
        if met:
            home = met[0]
            for other in met[1:]:
                home["rows"] += other["rows"]
                home["names"] |= other["names"]
                held.remove(other)
        else:
            home = {"names": set(), "rows": []}
            held.append(home)
        home["names"] |= names
        home["rows"].append(row)
    for story, held in groups.items():
        for g in held:
            out.update({(story, r): (g["rows"][0], k) for k, r in enumerate(g["rows"])})
    return out


def placed(spark, rows, small):
    df = spark.createDataFrame(rows, "s string, n long, names array<string>").repartition(3)
    got = merge_order(df, F.col("s"), F.col("n"), F.col("names"), small).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.s, r.first_row), []).append(([tuple(x) for x in r.place], r.n))
    return {(s, n): (first, k) for (s, first), held in by.items() for k, (_, n) in enumerate(sorted(held))}


@pytest.mark.parametrize(("seed", "stories", "small"), [(0, 6, 1000), (1, 6, 1000), (2, 2, 3)])
def test_any_rows(spark, seed, stories, small):
    """With merges put in order on the driver, and by rounds down to three."""
    r = random.Random(seed)
    kinds = [(25, 50), (6, 30), (40, 60), (90, 120)]
    rows = []
    for s in range(stories):
        n_names, n = kinds[s % 4]
        rows += [(f"s{s}", 3 * i + s, r.choice([None, []]) if r.random() < 0.08 else [r.choice([f"n{r.randrange(n_names)}", None]) if r.random() < 0.1 else f"n{r.randrange(n_names)}" for _ in range(r.choice([1, 1, 2, 3]))]) for i in range(n)]
    assert placed(spark, rows, small) == replayed(rows)


@pytest.mark.parametrize(("small", "n"), [(1000, 12), (0, 4)])
def test_chains_of_groups(spark, small, n):
    """Groups taken in one after another from the last to the first, from the first to the last, and all at once."""
    back = [("back", i, [f"g{i}"]) for i in range(n)] + [("back", n + k, [f"g{n - 1 - k}", f"g{n - 2 - k}"]) for k in range(n - 1)]
    forth = [("forth", i, [f"g{i}"]) for i in range(n)] + [("forth", n + k, [f"g{k}", f"g{k + 1}"]) for k in range(n - 1)]
    at_once = [("once", i, [f"g{i}"]) for i in range(n)] + [("once", n + i, [f"g{i}", "x"]) for i in (n - 1, 1)] + [("once", 3 * n, [f"g{i}" for i in range(n)])]
    rows = back + forth + at_once
    assert placed(spark, rows, small) == replayed(rows)


def test_one_name_for_all(spark):
    rows = [("a", i, ["x"]) for i in range(300)]
    assert placed(spark, rows, 0) == replayed(rows)


def test_first_distinct_values(spark):
    r = random.Random(2)
    rows = [(r.randrange(4), i, [r.choice(["a", "b", "c", "d", "e", None]) for _ in range(r.randrange(4))]) for i in range(80)]
    df = spark.createDataFrame(rows, "k int, at int, v array<string>")
    for most in (None, 2):
        got = {x.k: x.out for x in ordered_distinct(df, ["k"], [F.col("at")], F.filter("v", lambda x: x.isNotNull()), "out", most).collect()}
        want = {}
        for k, _, v in sorted(rows, key=lambda x: x[1]):
            held = want.setdefault(k, [])
            held += [x for x in dict.fromkeys(v) if x is not None and x not in held]
        assert got == {k: v[:most] for k, v in want.items() if v}


def test_rows_that_meet_none_are_left_out_of_the_steps(spark, monkeypatch):
    """Of 507 rows six meet; the tables between hold their links and no other rows."""
    rows = [("a", i, [f"n{i}", f"m{i}"]) for i in range(500)] + [("a", 600, ["n3", "n9"]), ("a", 601, ["m3"]), ("a", 602, ["n7"]), ("a", 603, []), ("a", 604, None), (None, 605, ["n3"]), ("b", 1, ["n3"])]
    held = []
    monkeypatch.setattr(arrivals, "written", lambda df, f=arrivals.written: held.append(f(df)) or held[-1])
    df = spark.createDataFrame(rows, "s string, n long, names array<string>")
    got = merge_order(df, F.col("s"), F.col("n"), F.col("names")).collect()
    assert held and max(t.count() for t in held) <= 12
    assert {(r.s, r.n) for r in got if not r.alone} == {("a", n) for n in (3, 7, 9, 600, 601, 602)}
    assert all(r.first_row == r.n and r.place == [] for r in got if r.alone) and len(got) == len(rows) - 1
    want = replayed([r for r in rows if r[0]])
    assert all(want[r.s, r.n][0] == r.first_row for r in got)
