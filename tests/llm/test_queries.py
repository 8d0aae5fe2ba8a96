"""Each query of the subpackage that SQL can tell, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from florilex.llm import queries

SF = "/root/testdata/sf0.001"


def plain(value):
    return None if value is None or isinstance(value, float) and math.isnan(value) else round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in x) for x in df.select(*columns).collect()), key=repr)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert got == sorted((tuple(plain(v) for v in x) for x in want), key=repr) and got
