import importlib
import os

import pytest

DATA = "/root/testdata/sf0.001"
CORE = sorted(importlib.import_module("scholarmill.plans.catalogue").queries())


def canon(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, list):
        return "[" + ",".join(map(canon, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in os.listdir(DATA):
        con.execute(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{p}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_core_query(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    assert len(df.columns) == len(set(df.columns))
    if sql := entry.oracle_sql().get(name):
        rel = duck.sql(sql)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert sorted(tuple(canon(r[i]) for i in at) for r in rel.fetchall()) == got


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_runs_without_the_subpackage():
    from pathlib import Path

    import scholarmill

    root = Path(scholarmill.__file__).parent
    for p in root.rglob("*.py"):
        if p.relative_to(root).parts[0] != "llm":
            assert "scholarmill.llm" not in p.read_text(), p
