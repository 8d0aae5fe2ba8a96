"""Each query of the catalogue against its SQL, on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from florilex.plans import catalogue, file_queries  # noqa: F401 - registers its queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    return None if value is None or isinstance(value, float) and math.isnan(value) else round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in x) for x in df.select(*columns).collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert got == sorted((tuple(plain(v) for v in x) for x in want), key=repr)


def test_triplets_of_all_turns(spark, tmp_path):
    from florilex.functions.vectors import letter_encoder

    said = [(c, t, "user" if t % 2 == 0 else "assistant", f"the {w} text about {w} number {c}") for c in range(3) for t, w in enumerate(["sea", "tree", "stone"])]
    items = [(k, f"a passage on {w}s and {w} lore") for k, w in enumerate(["sea", "tree", "stone", "cloud"])]
    spark.createDataFrame([*said, (9, 1, "user", " ")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (letter_encoder([x[3] for x in said]), letter_encoder([x[1] for x in items]))]
    scores = unit[0] @ unit[1].T
    want = sorted((x[3], x[3], items[k][1], round(float(s[k]), 4)) for x, s in zip(said, scores, strict=True) for k in [int(s.round(12).argmax())])
    assert sorted(tuple(x) for x in catalogue.QUERIES["triplet_mining"](spark, str(tmp_path)).collect()) == want
