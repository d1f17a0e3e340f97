"""Annotation that keeps its answers step by step."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from storyloom.plans.annotate import annotated_by_steps, cached


def test_a_run_that_fails_goes_on_where_it_stopped(spark, tmp_path):
    log, broken = tmp_path / "log", tmp_path / "broken"
    log.mkdir()
    broken.touch()
    requests = spark.createDataFrame([(i, f"text {i // 2}" if i else None) for i in range(120)], "i int, text string")

    def ask(asked):
        import uuid

        if broken.exists() and len(list(log.iterdir())) >= 5:
            raise ValueError("the model is down")
        (log / uuid.uuid4().hex).write_text("\n".join(str(r["text"]) for r in asked))
        return [f"answer to {r['text']}" for r in asked]

    asked = lambda: Counter(t for f in log.iterdir() for t in f.read_text().split("\n"))
    how = {"parts": ["text"], "batch": 100, "model": "m", "per_task": 6, "width": 2}
    folder = str(tmp_path / "kept")
    with pytest.raises(Exception, match="down"):
        annotated_by_steps(requests, folder, ask, **how)
    before = asked()
    kept = {r.response for r in cached(spark, folder).collect()}
    assert 0 < len(kept) < 61 and {f"answer to {t}" for t in before} >= kept
    broken.unlink()
    done = annotated_by_steps(requests, folder, ask, **how)
    assert {(r.i, r.response) for r in done.collect()} == {(i, f"answer to {f'text {i // 2}' if i else None}") for i in range(120)}
    again = asked() - before
    # what was kept is never asked again, and what was not, once
    assert all(again[t.removeprefix("answer to ")] == 0 for t in kept) and set(again.values()) == {1} and len(again) == 61 - len(kept)
    assert annotated_by_steps(requests, folder, ask, **how).where(F.col("response").isNull()).count() == 0 and asked() - before == again
    other = annotated_by_steps(requests.limit(3), folder, ask, **{**how, "model": "another"})
    assert other.count() == 3 and sum((asked() - before - again).values()) >= 2


def test_nothing_to_ask(spark, tmp_path):
    none = spark.createDataFrame([], "i int, text string")
    assert annotated_by_steps(none, str(tmp_path / "kept"), lambda asked: [], ["text"]).count() == 0
