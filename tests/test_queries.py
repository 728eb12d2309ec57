"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import pytest

from quillspark.plans import tables

DATA = os.environ.get("QUILL_DATA", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(tables.ORACLES))
def test_same_rows(spark, duck, name):
    df = tables.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = duck.execute(tables.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    assert plain(df.select(cols).collect()) == plain([r[at[c]] for c in cols] for r in cur.fetchall())


def test_entry_imports_without_optional_parts(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "quillspark.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    try:
        assert set(entry.queries()) == set(tables.QUERIES) and set(entry.oracle_sql()) == set(tables.ORACLES)
    finally:
        sys.modules.pop("__spark_entry__", None)


def test_scores_plan_stays_in_whole_stage_code(spark):
    """The score projection is one generated stage and reads only what it needs."""
    df = tables.normalize_cdf(spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "*(1) Project" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
