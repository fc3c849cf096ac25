"""Every query runs, and gives the rows of its SQL where it has SQL."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from glossa.plans import catalogue, source_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=repr)
    if name in catalogue.ORACLE_SQL:
        found = duck.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        assert rows == sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in found.fetchall()), key=repr)


def test_entry_works_without_the_optional_modules(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for p in ("glossa", "__spark_entry__.py"):
        os.system(f"cp -r {root / p} {tmp_path}")
    os.system(f"rm -rf {tmp_path}/glossa/llm")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) < set(q) and 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) == len(catalogue.QUERIES), done.stderr
