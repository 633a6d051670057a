"""Every registered query that has SQL, against DuckDB on the same tables."""

import pytest
from compare import spark_rows, sql_rows

from usageloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    got, want = spark_rows(registry.QUERIES[name](spark, sf_dir)), sql_rows(registry.ORACLE[name], sf_dir)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)
