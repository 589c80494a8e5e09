"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from segqa.oracles import oracle_sql
from segqa.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = sorted(set(QUERIES) & set(oracle_sql()))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    """Tokens of free text are compared with a plain scan instead, in test_tokens.py."""
    assert set(QUERIES) - set(oracle_sql()) == {"t1_tokens_documents", "t4_token_inventory_documents"}


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns

    def plain(value):
        return round(value, 6) if isinstance(value, float) else value

    expected = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected
