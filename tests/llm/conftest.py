from __future__ import annotations

import duckdb
import pytest


@pytest.fixture
def tables(spark, tmp_path):
    """Writes small tables and gives their folder; DuckDB can run a query's SQL on the same rows."""

    def make(**frames):
        for name, df in frames.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


@pytest.fixture
def oracle(spark):
    def run(folder: str, sql: str, *names: str):
        con = duckdb.connect()
        for n in names:
            con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet/*.parquet'")
        cur = con.execute(sql)
        return [d[0] for d in cur.description], cur.fetchall()

    return run


def same(df, columns_rows) -> bool:
    columns, rows = columns_rows
    order = sorted(columns)
    assert sorted(df.columns) == order
    ours = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(r[columns.index(c)] for c in order) for r in rows), key=repr)
    return ours == theirs
