"""Property tests: delay, duration, on-time and buckets vs a plain-Python model."""

from __future__ import annotations

import datetime as dt
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from souk.functions import buckets as B
from souk.functions.exprs import bucket_order
from souk.operators import clean

BASE = dt.datetime(2018, 1, 10)
FMT = "%Y-%m-%d %H:%M:%S"


def _model_bucket(d, buckets):
    for i, (lo, hi, _label) in enumerate(buckets[:-1], start=1):
        if d is None:
            break
        if (lo is None or d >= lo) and (hi is None or d <= hi):
            return i
    return len(buckets)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.integers(min_value=-40 * 86400, max_value=40 * 86400), min_size=60,
                max_size=60),
       st.lists(st.integers(min_value=0, max_value=60 * 86400), min_size=60, max_size=60))
def test_delay_duration_on_time_match_python(spark, offsets, purchase_back):
    rows = []
    for i, (off, back) in enumerate(zip(offsets, purchase_back)):
        delivered = BASE + dt.timedelta(seconds=off)
        purchased = delivered - dt.timedelta(seconds=back)
        rows.append((str(i), "c", "delivered", purchased.strftime(FMT), None, None,
                     delivered.strftime(FMT), BASE.strftime(FMT)))
    cols = ("order_id string, customer_id string, order_status string, "
            "order_purchase_timestamp string, order_approved_at string, "
            "order_delivered_carrier_date string, order_delivered_customer_date string, "
            "order_estimated_delivery_date string")
    out = {r["order_id"]: r for r in clean.clean_orders(spark.createDataFrame(rows, cols)).collect()}
    for i, (off, back) in enumerate(zip(offsets, purchase_back)):
        r = out[str(i)]
        assert r["delivery_delay_days"] == math.trunc(off / 86400)
        assert r["is_on_time"] == (1 if off <= 0 else 0)
        assert r["delivery_duration_days"] == back / 86400


@settings(max_examples=1, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(min_value=-60, max_value=60)),
                min_size=80, max_size=80))
def test_buckets_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "d int")
    for buckets in (B.DELAY_BUCKETS_7, B.DELAY_BUCKETS_5, B.INSTALLMENT_BUCKETS):
        got = [r[0] for r in df.select(bucket_order("d", buckets)).collect()]
        assert got == [_model_bucket(v, buckets) for v in values]
