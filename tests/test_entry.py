import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e
from corpuscount.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert e.entry(spark).count() == 20


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    one = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return sorted([one(r[k]) for k in order] for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, DATA)
    want = con.execute(catalogue.ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), names)


def test_works_without_the_optional_folder():
    """Nothing outside imports it, and the entry does without it."""
    code = "import sys, importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if 'llm' in n or n == 'corpus_pipeline' else f(n, *a)\nimport __spark_entry__ as e; assert 'wordcount' in e.queries() and not [m for m in sys.modules if 'llm' in m]; e.oracle_sql()"
    root = Path(e.__file__).resolve().parent
    assert not subprocess.run([sys.executable, "-c", code], cwd=root).returncode
