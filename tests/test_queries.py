"""Every query against its SQL in DuckDB, by rows as multisets, and the entry module without the optional parts."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from lodestone import extract_queries, reference_queries, registry  # noqa: F401

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted([repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r] for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = [[r[names.index(c)] for c in columns] for r in cursor.fetchall()]
    assert plain(df.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_without_optional_parts(tmp_path):
    code = "import sys\nfor x in ('lodestone.llm', 'corpus_pipeline'): sys.modules[x] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())\nassert e.oracle_sql().keys() <= e.queries().keys()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
