"""Every query with an SQL twin against DuckDB at the smallest scale; every other one runs and keeps its schema."""

import datetime
import glob
import importlib
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
CORE = {k: v for k, v in entry.queries().items() if not k[0] == "p" or not k[1].isdigit() or k.startswith("p6")}


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for p in glob.glob(small + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fix = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(CORE)))
def test_matches_sql(name, spark, duck, small):
    df = CORE[name](spark, small)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    res = duck.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == canon(res.fetchall(), cols)


@pytest.mark.parametrize("name", sorted(set(CORE) - set(entry.oracle_sql())))
def test_gives_the_same_again(name, spark, small):
    """Without a twin: there are rows, and however the work is dealt out they are the same."""
    df = CORE[name](spark, small)
    first = canon([tuple(r) for r in df.collect()], df.columns)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = CORE[name](spark, small)
        assert again.dtypes == df.dtypes and canon([tuple(r) for r in again.collect()], again.columns) == first and first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_llm_is_optional(tmp_path):
    """Without the subpackage and its tests the rest imports, runs and collects."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = tmp_path / "copy"
    shutil.copytree(root, to, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", ".hypothesis"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p6_found' in q and 'flagship_report' in q and not any(k[:2] in ('p1', 'p5') for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(to)}
    subprocess.run([sys.executable, "-c", code], cwd=to, env=env, check=True, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=to, env=env, check=True, timeout=120, stdout=subprocess.DEVNULL)


def test_broken_llm_is_no_silence(monkeypatch):
    def broken(name):
        raise ImportError(name)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    if entry.importlib.util.find_spec("verdigris.llm") is not None:
        with pytest.raises(ImportError):
            entry.queries()
