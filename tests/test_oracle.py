"""Differential test: every registered query against its DuckDB SQL twin.

Runs on the sf0.001 driver tables (the driver's own check uses sf0.01).
Values are compared exactly, floats bit for bit.
"""

from __future__ import annotations

import os

import pytest

from tests.conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    from tools.check_oracle import duck_conn
    return duck_conn(SF_SMALL)


# Keys whose output has no SQL twin (Parquet file sizes depend on the writer).
NO_ORACLE = {"export_sizes"}


def _keys():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


def test_every_query_has_an_oracle():
    """Of the library's own queries; those of the optional folder name theirs themselves."""
    import __spark_entry__ as E
    from souk.plans.queries import all_queries
    from souk.testing.oracle_queries import all_oracle_sql
    assert set(all_queries()) - NO_ORACLE == set(all_oracle_sql())
    assert set(all_queries()) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_export_sizes(spark):
    import __spark_entry__ as E
    rows = E.queries()["export_sizes"](spark, SF_SMALL).collect()
    assert [r["export_order"] for r in rows] == list(range(1, 13))
    assert all(r["num_files"] >= 1 and r["size_bytes"] > 0 for r in rows)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["year_month", "num_orders", "total_revenue", "avg_order_value"]
    assert df.count() > 0


@pytest.mark.parametrize("key", _keys())
def test_query_matches_oracle(spark, duck, key):
    import __spark_entry__ as E
    from tools.check_oracle import rows_of
    sdf = E.queries()[key](spark, SF_SMALL).toPandas()
    ddf = duck.execute(E.oracle_sql()[key]).df()
    sc, sr = rows_of(sdf)
    dc, dr = rows_of(ddf)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr
