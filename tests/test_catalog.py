"""Every named query against its SQL, over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from lodeseek.plans import catalog

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, duck, query, sql):
    df = query(spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@needs_data
@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query(spark, duck, name):
    compare(spark, duck, catalog.QUERIES[name], catalog.SQL[name])


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_llm():
    """A copy of the repository without the folders of the subpackage imports, and has all other queries."""
    import shutil
    import subprocess
    import sys
    import tempfile
    from pathlib import Path

    root = Path(entry.__file__).resolve().parent
    with tempfile.TemporaryDirectory() as d:
        shutil.copy(root / "__spark_entry__.py", d)
        shutil.copytree(root / "lodeseek", Path(d) / "lodeseek", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=d, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": d})
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.SQL))]
