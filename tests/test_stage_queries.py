"""Whole stages against their SQL, on the smallest tables."""

import duckdb
import pytest

from storyloom import group_oracles, group_queries, queries, stage_oracles, stage_queries

FOLDER = "/root/testdata/sf0.001"


QUERIES = stage_queries.queries() | stage_queries.literal_stories() | group_queries.queries() | {"narrative_candidates": queries.narrative_candidates}
SQL = stage_oracles.oracle_sql() | stage_oracles.literal_sql() | group_oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_stage_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "conversations", "benchmark", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cur = con.execute(SQL[name])
    theirs = [d[0] for d in cur.description]
    df = QUERIES[name](spark, FOLDER)
    order = sorted(df.columns)
    assert sorted(theirs) == order
    want = sorted(repr(tuple(r[theirs.index(c)] for c in order)) for r in cur.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == want and want
