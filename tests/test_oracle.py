"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import decimal
import math

import duckdb
import pytest

from kelpie.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return repr(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 6) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_only_what_sql_cannot_say_has_none():
    # both are held against brute force: tests/test_index.py, tests/test_proposals.py
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"keyword_score_fuzzy", "near_duplicate_proposals"}


def test_fuzzy_scores(spark):
    """Close matches only add to the plain scores, and the index gives the same rows."""
    from kelpie.plans import queries as Q

    plain_ = {(r["query_id"], r["path"]): r["score"] for r in registry.queries()["keyword_score"](spark, SF).collect()}
    fuzzy = {(r["query_id"], r["path"]): r["score"] for r in registry.queries()["keyword_score_fuzzy"](spark, SF).collect()}
    assert set(plain_) <= set(fuzzy) and all(fuzzy[k] >= v for k, v in plain_.items())
    again = Q._keyword(spark, SF, fuzzy=True, index=Q._indexed(spark, SF))
    assert {(r["query_id"], r["path"]): round(r["score"], 6) for r in again.collect()} == fuzzy


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
