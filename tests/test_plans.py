"""Plan properties that matter at scale, checked on Parquet raw tables."""

from __future__ import annotations

import os

import pytest

from tests.conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="no driver tables")


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    from souk.plans.registry import Marketplace
    from souk.sources.csv_source import materialize_raw
    from souk.sources.testdata import driver_tables
    base = str(tmp_path_factory.mktemp("raw"))
    raw = {}
    for name, df in driver_tables(spark, SF_SMALL).items():
        raw[name] = spark.read.parquet(materialize_raw(df, f"{base}/{name}"))
    return Marketplace(raw)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_status_filter_and_column_pruning_reach_the_scan(model):
    plan = _plan(model.sales_monthly_trend)
    orders_scan = next(line for line in plan.splitlines()
                       if "FileScan parquet" in line and "raw_orders" in line)
    assert "order_status" in orders_scan.split("PushedFilters:")[1]
    read_schema = orders_scan.split("ReadSchema:")[1]
    assert "order_delivered_customer_date" not in read_schema
    assert "order_approved_at" not in read_schema


def test_no_python_evaluation_in_marts(model):
    from souk.sources.marts import EXPORTED_MARTS
    for name in EXPORTED_MARTS:
        plan = _plan(model.view(name))
        assert "EvalPython" not in plan and "PythonUDF" not in plan, name


def test_modal_spelling_limits_before_the_shuffle(model):
    plan = _plan(model._geo_mode)
    assert "WindowGroupLimit" in plan and "Partial" in plan
