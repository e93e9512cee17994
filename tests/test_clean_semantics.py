"""Edge rows of the cleaning layer: one row per quirk (dates, delay, flags)."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.functions import buckets as B
from souk.functions.exprs import bucket_label, bucket_order
from souk.operators import clean

ORDER_COLS = ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
              "order_approved_at", "order_delivered_carrier_date",
              "order_delivered_customer_date", "order_estimated_delivery_date"]
EST = "2018-01-10 00:00:00"


def _orders(spark, rows):
    full = [(str(i), "c", "delivered", "2018-01-01 00:00:00", None, None, d, e)
            for i, (d, e) in enumerate(rows)]
    return spark.createDataFrame(full, ",".join(f"{c} string" for c in ORDER_COLS))


def _by_id(df):
    return {r["order_id"]: r for r in df.collect()}


def test_delay_truncates_toward_zero_and_on_time_uses_instants(spark):
    rows = [
        ("2018-01-10 23:00:00", EST),  # 23 h late: delay 0, not on time
        ("2018-01-09 01:00:00", EST),  # 23 h early: delay 0, on time
        ("2018-01-08 23:00:00", EST),  # 25 h early: delay -1
        (EST, EST),                    # exactly on the estimate
        ("2018-01-11 01:00:00", EST),  # 25 h late: delay 1
    ]
    out = _by_id(clean.clean_orders(_orders(spark, rows)))
    assert [(out[str(i)]["delivery_delay_days"], out[str(i)]["is_on_time"]) for i in range(5)] == [
        (0, 0), (0, 1), (-1, 1), (0, 1), (1, 0)]


def test_not_delivered_bad_text_and_missing_estimate(spark):
    rows = [
        (None, EST),                   # not delivered
        ("bad", EST),                  # unparsable delivery text
        ("", EST),                     # empty delivery text
        ("2018-01-12 00:00:00", None),  # estimate missing
    ]
    out = _by_id(clean.clean_orders(_orders(spark, rows)))
    nd, bad, empty, noest = (out[str(i)] for i in range(4))
    assert (nd["delivery_delay_days"], nd["delivery_duration_days"], nd["is_on_time"]) == (
        None, None, None)
    assert nd["order_delivered_customer_ts"] is None
    # Text present but unparsable: timestamps and durations NULL, on-time 0.
    for r in (bad, empty):
        assert r["order_delivered_customer_ts"] is None
        assert r["delivery_delay_days"] is None and r["delivery_duration_days"] is None
        assert r["is_on_time"] == 0
    assert noest["delivery_delay_days"] is None
    assert noest["delivery_duration_days"] == 11.0
    assert noest["is_on_time"] == 0


def test_duration_is_fractional_days(spark):
    out = _by_id(clean.clean_orders(_orders(spark, [("2018-01-02 12:00:00", EST)])))
    assert out["0"]["delivery_duration_days"] == 1.5


def test_bucket_edges(spark):
    delays = [-15, -14, -8, -7, -1, 0, 1, 7, 8, 14, 15, None]
    df = spark.createDataFrame([(d,) for d in delays], "d int")
    got7 = [r[0] for r in df.select(bucket_order("d", B.DELAY_BUCKETS_7)).collect()]
    got5 = [r[0] for r in df.select(bucket_order("d", B.DELAY_BUCKETS_5)).collect()]
    assert got7 == [1, 2, 2, 3, 3, 4, 5, 5, 6, 6, 7, 7]
    assert got5 == [1, 1, 1, 2, 2, 3, 4, 4, 5, 5, 5, 5]
    labels = [r[0] for r in df.select(
        bucket_label(bucket_order("d", B.DELAY_BUCKETS_7), B.DELAY_BUCKETS_7)).collect()]
    assert labels[0] == "15+ days early" and labels[5] == "On time" and labels[-1] == "15+ days late"


def test_installment_buckets_zero_and_null_fall_in_last(spark):
    vals = [0, 1, 2, 4, 5, 8, 9, None]
    df = spark.createDataFrame([(v,) for v in vals], "n bigint")
    got = [r[0] for r in df.select(bucket_label(bucket_order("n", B.INSTALLMENT_BUCKETS),
                                                B.INSTALLMENT_BUCKETS)).collect()]
    assert got == ["9+", "1 (single payment)", "2-4", "2-4", "5-8", "5-8", "9+", "9+"]


def test_comment_flags_trim_spaces_only(spark):
    rows = [("1", "o", 5, t, None, "2018-01-01 00:00:00", "bad")
            for t in (None, "", "  ", "\t", "x")]
    df = spark.createDataFrame(rows, "review_id string, order_id string, review_score bigint, "
                                     "review_comment_title string, review_comment_message string,"
                                     " review_creation_date string, review_answer_timestamp string")
    out = clean.clean_reviews(df).collect()
    assert [r["has_title"] for r in out] == [0, 0, 0, 1, 1]
    assert all(r["has_message"] == 0 for r in out)
    assert all(r["review_answer_ts"] is None for r in out)


def test_category_coalesce_arms(spark):
    products = spark.createDataFrame(
        [("p1", "cama"), ("p2", "raro"), ("p3", None)],
        "product_id string, product_category_name string").select(
        "*", *[F.lit(1.0).alias(c) for c in ("product_name_lenght", "product_description_lenght",
                                             "product_photos_qty", "product_weight_g",
                                             "product_length_cm", "product_height_cm",
                                             "product_width_cm")])
    tr = spark.createDataFrame([("cama", "bed")],
                               "product_category_name string, product_category_name_english string")
    out = {r["product_id"]: r for r in clean.clean_products(products, tr).collect()}
    assert out["p1"]["category_english"] == "bed"
    assert out["p2"]["category_english"] == "raro"
    assert (out["p3"]["category_english"], out["p3"]["category_original"]) == ("unknown", "unknown")


def test_payments_drop_placeholder_and_null_type(spark):
    df = spark.createDataFrame(
        [("o1", 1, "credit_card", 1, 10.0), ("o2", 1, "not_defined", 1, 5.0),
         ("o3", 1, None, 1, 5.0)],
        "order_id string, payment_sequential bigint, payment_type string, "
        "payment_installments bigint, payment_value double")
    assert [r["order_id"] for r in clean.clean_payments(df).collect()] == ["o1"]


def test_geo_mode_tie_goes_to_smallest_spelling(spark):
    rows = [(1, 1.0, 2.0, "b", "X"), (1, 3.0, 4.0, "a", "X"), (1, 5.0, 6.0, "b", "X"),
            (1, 7.0, 8.0, "a", "X"), (2, 1.0, 1.0, "z", "Y")]
    df = spark.createDataFrame(rows, "geolocation_zip_code_prefix bigint, geolocation_lat double,"
                                     " geolocation_lng double, geolocation_city string,"
                                     " geolocation_state string")
    out = {r["zip_code_prefix"]: r for r in clean.clean_geolocation(df).collect()}
    assert (out[1]["city"], out[1]["lat"], out[1]["lng"]) == ("a", 4.0, 5.0)
    assert out[2]["city"] == "z"


def test_rounding_is_half_away_from_zero_on_decimal_text(spark):
    df = spark.createDataFrame([(2.675, 2), (0.125, 2), (1.005, 2), (4.45, 1), (0.35, 1)],
                               "x double, k int")
    got = [r[0] for r in df.select(
        F.when(F.col("k") == 2, F.round("x", 2)).otherwise(F.round("x", 1))).collect()]
    assert got == [2.68, 0.13, 1.01, 4.5, 0.4]


def test_durations_ignore_session_time_zone(spark):
    # 2017-10-15 00:30 does not exist in Sao Paulo (DST gap); the text has no
    # zone, so the duration is the wall-clock difference: one hour.
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        df = _orders(spark, [("2017-10-15 00:30:00", "2017-10-15 00:00:00")]).withColumn(
            "order_purchase_timestamp", F.lit("2017-10-14 23:30:00"))
        r = clean.clean_orders(df).collect()[0]
        assert r["delivery_duration_days"] == 3600 / 86400
        assert (r["delivery_delay_days"], r["is_on_time"]) == (0, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_clean_geolocation_has_no_row_for_a_null_zip(spark):
    from souk.operators.clean import clean_geolocation
    from souk.schemas import RAW_SCHEMAS
    schema = RAW_SCHEMAS["raw_geolocation"]
    row = {"geolocation_lat": 1.0, "geolocation_lng": 2.0, "geolocation_city": "c",
           "geolocation_state": "s"}
    zips = [f for f in schema.fields if f.name == "geolocation_zip_code_prefix"]
    known = "7" if zips[0].dataType.simpleString() == "string" else 7
    rows = [tuple({**row, "geolocation_zip_code_prefix": z}[f.name] for f in schema.fields)
            for z in (None, known)]
    got = clean_geolocation(spark.createDataFrame(rows, schema)).collect()
    assert [r.zip_code_prefix for r in got] == [known]


def test_sums_below_a_cent_and_means_of_infinity(spark):
    from souk.functions.exprs import exact_mean, money_mean, money_sum
    r = spark.range(1000).selectExpr("0.125D as x").agg(
        money_sum("x").alias("s"), money_mean("x").alias("m")).first()
    assert (r.s, r.m) == (125.0, 0.125)
    inf = float("inf")
    rows = spark.createDataFrame([(1, inf), (1, 1.0), (2, 1.0), (2, 2.0), (3, None)], "k int, x double")
    got = {r.k: r.m for r in rows.groupBy("k").agg(exact_mean("x").alias("m")).collect()}
    assert got == {1: inf, 2: 1.5, 3: None}
