"""The registered queries against their SQL on the smallest tables, and the entry points."""

import math
import os

import pytest

import __spark_entry__ as entry
from strandkit import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(plans.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    theirs = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert ours == theirs


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["lang", "kmer", "n", "rank"]


def test_entry_without_a_module_that_the_corpus_operators_need():
    import pathlib
    import subprocess
    import sys

    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=pathlib.Path(plans.__file__).parents[2], capture_output=True, text=True)
    assert done.stdout.split() == [str(len(plans.queries())), str(len(plans.oracle_sql()))], done.stderr


def test_library_does_not_need_the_corpus_operators():
    import pathlib

    root = pathlib.Path(plans.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text().replace("llm__", ""), path
