"""Registered queries run, and agree with their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in TABLES:
        path = f"{DATA}/{name}.parquet"
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(x):
    return x.isoformat() if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", CORE)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in entry.oracle_sql():
        got = db.sql(entry.oracle_sql()[name])
        assert sorted(got.columns) == columns
        assert rows == sorted((tuple(plain(dict(zip(got.columns, r, strict=True))[c]) for c in columns) for r in got.fetchall()), key=repr)
    else:
        assert rows


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_works_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['tapelark.llm'] = None\nimport importlib.util as u\nreal = u.find_spec\nu.find_spec = lambda n, *a: None if n.startswith('tapelark.llm') or n == 'corpus_pipeline' else real(n, *a)\nimport __spark_entry__ as e\nassert e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline'] and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), check=False).returncode == 0
