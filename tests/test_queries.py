"""Every query against its SQL on the smallest tables."""

import pytest

from paperloom.queries import QUERIES
from tests.conftest import same_rows


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    query, sql = QUERIES[name]
    same_rows(query(spark, sf_dir).toPandas(), duck.sql(sql).df())


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["batch_id", "file", "page", "pattern", "match_count"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_assigned_numbers_longer_than_their_digits():
    """The SQL keeps all digits of a number beyond 999999, as the query does."""
    import duckdb

    c = duckdb.connect()
    c.sql("create view customer as select range as c_custkey from range(750002)")
    rows = c.sql(f"select path, first_label, last_label from ({QUERIES['assign_again'][1]}) where path in ('f749999.pdf', 'f750001.pdf') order by path").fetchall()
    assert rows == [("f749999.pdf", "PLM 999999", "PLM 1000000"), ("f750001.pdf", "PLM 1000001", "PLM 1000002")]
