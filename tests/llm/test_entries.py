"""The registered operator queries: SQL twins, plans, odd tables."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import rows_of
from vetta.llm import entries
from vetta.sources.views import TABLES


@pytest.mark.parametrize("key", sorted(entries.SQL))
def test_matches_duckdb(spark, sf_dir, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(E.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    df = E.queries()[key](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("key", sorted(entries.QUERIES))
def test_no_pair_product_in_plan(spark, sf_dir, key):
    plan = E.queries()[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key", ["op3_exact_dedup", "op9_mixing"])
def test_native_queries_have_no_python(spark, sf_dir, key):
    plan = E.queries()[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_every_operator_is_registered():
    assert {k.split("_")[0] for k in entries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in E.queries()
