"""The contract: names, SQL twins, schemas, and values of some queries against their SQL."""

import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
SAMPLE = ("score_unigram_ppl", "filter_reasons", "select_balanced", "normalize_reasoning", "mask_labels", "smart_truncate", "tool_report", "pack_sorted", "mix_weighted", "cadft_loss", "run_summary", "plateau_ranges", "parabola_fit", "config_rules")


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 100


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)

    def rows(df):
        return sorted(tuple("null" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))

    assert rows(got) == rows(want)
