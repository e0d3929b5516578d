"""Spark vs DuckDB on sf0.001 for a representative set of keys (the full
set runs at sf0.01 with tools/oracle_check.py)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import rows_of
from vetta.sources.views import TABLES

KEYS = ["kendall_per_source", "kendall_per_lp", "pearson_report", "soft_pairwise_accuracy",
        "score_profile", "score_histogram", "stats_grouping_sets", "per_source_detail",
        "pair_agreement", "gold_quintiles", "preference_pairs", "doc_context", "span_features",
        "weight_sweep", "balanced_folds", "clean_text", "text_features", "spearman_props"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, sf_dir, duck, key):
    df = E.queries()[key](spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, srows) == rows_of(dcols, cur.fetchall())
