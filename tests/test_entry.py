import pytest

import __spark_entry__ as entry


def test_entry_runs(spark, sf_small):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["dataset", "paper_key", "title", "metric_match", "metric_thres", "conference"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline"))
def test_query_smoke(spark, sf_small, name):
    df = entry.queries()[name](spark, sf_small)
    assert df.count() > 0
