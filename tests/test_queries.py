"""Every query with an oracle gives the oracle's rows; without the corpus operators too."""

import math
import os
import shutil
import subprocess
import sys

import pytest

from groundplan.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return found


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    try:
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    except TypeError:
        return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in df.collect())
    result = duck.sql(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted([plain(r[k]) for k in order] for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_everything_else_without_corpus_operators(tmp_path):
    """The corpus operators, their tests and the pipeline deleted: the entry point, and queries and tests of the rest, still work."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git", "*.json", "corpus_pipeline.py")
    shutil.copytree(root, tmp_path / "rest", ignore=skip)
    env = os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, [str(tmp_path / "rest"), *(p for p in sys.path if p and os.path.abspath(p) != root)]))}
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "rest", check=True, env=env)
    chosen = "not test_everything_else_without_corpus_operators and (not test_oracle or _01)"
    files = ["tests/test_lookup.py", "tests/test_properties.py", "tests/test_queries.py"]  # the others take long and import no more
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "-k", chosen, *files], cwd=tmp_path / "rest", check=True, env=env)
