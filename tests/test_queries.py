"""Every registered query against its SQL, and those without SQL for rows and a stable schema."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from conftest import ROOT

from lodestone import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(smallest):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{smallest}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, smallest, duck, name):
    df = registry.queries()[name](spark, smallest)
    rows = df.collect()
    if name not in registry.oracle_sql():
        assert rows and len(set(df.columns)) == len(df.columns)
        return
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert columns == sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_client_listing_is_whole_and_in_order(spark, smallest, duck):
    got = [tuple(r) for r in registry.queries()["listing_clients"](spark, smallest).collect()]
    assert got == duck.sql("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS u FROM customer ORDER BY u DESC NULLS FIRST, c_custkey DESC").fetchall()
    assert len(got) == duck.sql("SELECT count(*) FROM customer").fetchall()[0][0]


def test_containment_reaches_every_nation(spark, smallest, duck):
    got = {r["c_custkey"] for r in registry.queries()["range_containment"](spark, smallest).collect()}
    left_out = duck.sql("SELECT DISTINCT c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice BETWEEN c_acctbal * 10 AND c_acctbal * 40 AND c_nationkey > 20").fetchall()
    assert left_out and {c for (c,) in left_out} <= got


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_stands_without_the_corpus_folders(tmp_path):
    """In a copy without the corpus operators the entry still imports and registers everything else."""
    for name in ("lodestone", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "lodestone" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == str(sorted(registry.queries()))
