"""Every registered query of the catalog against its DuckDB oracle, and the independence from the llm subpackage."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from textloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    if name not in catalog.ORACLES:
        assert cols
        return
    cur = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(cell(r[i]) for i in at) for r in cur.fetchall())


def test_nothing_but_the_entry_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "textloom")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as fh:
                    assert "textloom.llm" not in fh.read(), f


def test_entry_imports_without_llm(tmp_path):
    """A copy of the repository without the llm folders and the pipeline still imports and lists its queries."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "textloom"), tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, o, llm = out.stdout.split()
    assert int(n) == len(catalog.QUERIES) and int(o) == len(catalog.ORACLES) and llm == "False"
