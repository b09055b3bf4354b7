"""Driver contract: entry runs, every query has a callable, oracle keys are a subset."""

import __spark_entry__ as E

from conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"ticker", "bar_ts", "scaled"} <= set(df.columns)


def test_oracle_keys_subset_and_sql_present():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 50


def test_small_queries_run(spark):
    for name in ("bars_hourly", "tail_n", "kv_upsert_latest", "page_paragraph_text",
                 "lexicon_sentiment", "run_asof_bar", "trigger_first_fire"):
        assert E.queries()[name](spark, SF_SMALL).count() > 0
