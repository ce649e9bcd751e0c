"""Every registered query of the library against its SQL on the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pytest
from conftest import SMALL
from lorekeep.plans import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return float(f"{float(v):.9g}") if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(([plain(r[names.index(c)]) for c in cols] for r in found.fetchall()), key=repr)
    assert got == want


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["page", "host", "backlinks", "forward", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(registry.QUERIES) > 100


def test_entry_stands_without_the_training_data_part(tmp_path):
    """The library imports and lists its queries with the subpackage and the pipeline gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("lorekeep", "__spark_entry__.py"):
        source = os.path.join(root, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, timeout=120).returncode == 0
