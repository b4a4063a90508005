"""Every registered query against its SQL answer."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, con, folder):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        assert differences(df, con, SQL[name]) == []
    else:
        assert df.count() > 0


def test_answers_belong_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 20 and rows[0].risk_score >= rows[-1].risk_score
