"""Driver contract: entry runs, every query has a callable, oracle keys exist."""

import __spark_entry__ as E


def test_contract(spark):
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0


def test_small_queries_run(spark):
    qs = E.queries()
    for name in ("author_velocity", "hot_files", "parse_label", "cosine_pairs"):
        assert qs[name](spark, "/root/testdata/sf0.001").count() > 0
