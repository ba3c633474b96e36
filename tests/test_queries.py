"""Every query with SQL gives the rows that DuckDB gives; the others run and keep their invariants."""

import datetime
import decimal
import subprocess
import sys

import duckdb
import pytest

from lexarium import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows_agree(spark, con, name):
    df = catalog.queries()[name](spark, FOLDER)
    want = con.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    rows = [tuple(plain(r[i]) for i in at) for r in want.fetchall()]
    got = [tuple(map(plain, r)) for r in df.select(cols).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_run(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 15


def test_imports_without_the_optional_subpackage():
    code = "import sys; sys.modules['lexarium.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=FOLDER, env={"PYTHONPATH": sys.path[0] + ":" + ":".join(p for p in sys.path if p), "PATH": "/usr/bin:/bin"})
