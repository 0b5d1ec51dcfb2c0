"""The driver contract: queries against their SQL twins at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"
NAMES = ["panel_dense", "cache_refresh_keep_last", "membership_pit", "mask_membership", "f_vol_21d", "f_gaps_padded", "xs_combine", "xs_ewma", "neut_full", "rank_deciles", "w_sticky", "per_decile", "m_summary", "w_sticky_wide_exit", "f_idio_vol_60d", "f_signed_vol_20d", "compare_variants", "grid_pivot", "r_metrics", "r_violations", "k_summary", "v_line_diff"]


def shown(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return str(v) if type(v).__name__ in ("date", "datetime") else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = contract.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([shown(r[c]) for c in columns]) for r in df.collect())
    rows = con.execute(contract.oracle_sql()[name])
    at = {c[0]: k for k, c in enumerate(rows.description)}
    assert sorted(at) == columns
    assert got == sorted(repr([shown(r[at[c]]) for c in columns]) for r in rows.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_entry_and_plans(spark):
    assert contract.entry(spark).count() == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())
    for name in ("xs_combine", "w_sticky", "neut_full"):  # no Python in the plans of expressions
        plan = contract.queries()[name](spark, DATA)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan
