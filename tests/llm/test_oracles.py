"""Registered SQL twins against the operators over whole tables."""

import duckdb
import pytest

from tallyspark.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin_returns_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    made = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(made.columns)
    found = con.execute(queries.ORACLES[name])
    assert sorted(d[0] for d in found.description) == columns
    order = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted(tuple(row[k] for k in order) for row in found.fetchall())
    assert sorted(tuple(r) for r in made.select(*columns).collect()) == want
