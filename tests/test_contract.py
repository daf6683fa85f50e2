"""The driver's contract: names, SQL and the flagship query."""

import __spark_entry__ as entry


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert {"subject", "precision", "recall", "f1"} <= set(df.columns)
    assert df.count() > 0


def test_queries_equal_sql(spark, sf_dir):
    """A few queries of each kind against DuckDB; the driver compares all of them."""
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    for name in ("a8_validation", "b7_top_k", "c9_artifact_diff", "d2_reliability", "e6_stimulus_events", "j7_ecdf", "k1_mixup", "l2_block_prior_shift", "m6_leave_one_domain_out", "n3_paired_sign_flip"):
        got = entry.queries()[name](spark, sf_dir)
        columns = sorted(got.columns)
        mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
        found = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in found.description]
        other = sorted((tuple(row[names.index(c)] for c in columns) for row in found.fetchall()), key=str)
        assert mine == other, name
