import os

import duckdb
import pytest

import __spark_entry__ as E
from strandspark.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def text(v):
    return "[" + ",".join(map(text, v)) + "]" if isinstance(v, (list, tuple)) else repr(float(v)) if isinstance(v, float) else str(v)


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted("|".join(text(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        r = con.execute(SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted("|".join(text(x[i]) for i in at) for x in r.fetchall())


def test_nothing_else_imports_the_training_package():
    root = os.path.join(os.path.dirname(E.__file__), "strandspark")
    for d, _, files in os.walk(root):
        for f in files:
            if os.path.basename(d) != "llm" and f.endswith(".py"):
                with open(os.path.join(d, f)) as text_:
                    assert "llm" not in text_.read()
