"""Every registered query runs on the smallest driver tables, and the
ones with an oracle agree with DuckDB."""
import os
import sys

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

QUICK = ["pattern_edge", "pattern_without", "masked_dataset", "exception_legacy", "minimal_pairs",
         "ood_pairs", "task_batch", "ngram_token_score", "accuracy", "entropy_topk", "surprisal_distribution"]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", QUICK)
def test_against_oracle(spark, name, tmp_path):
    import duckdb

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    import __spark_entry__ as E
    from oracle_check import TABLES, multiset

    con = duckdb.connect()
    con.sql(f"SET temp_directory='{tmp_path}'; SET max_temp_directory_size='2GB'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    scols, srows = sdf.columns, sdf.collect()
    ocols, orows = rel.columns, rel.fetchall()
    assert sorted(scols) == sorted(ocols)
    assert multiset(scols, srows, True) == multiset(ocols, orows, True)
