"""Each query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest
from conftest import SMALL

import gleaner.plans.queries_corpus
import gleaner.plans.queries_evaluation
import gleaner.plans.queries_retrieval  # noqa: F401
from gleaner.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return None if math.isnan(v) else round(v, 5)
    return str(v)


def in_order(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = in_order(tuple(r) for r in df.select(cols).collect())
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == in_order(tuple(r[i] for i in at) for r in result.fetchall())
