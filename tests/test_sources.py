"""CSV ingestion, raw materialization, profiling and mart export/load."""

from __future__ import annotations

import os

import pytest

from souk.operators import profile as P
from souk.schemas import RAW_SCHEMAS
from souk.sources.csv_source import materialize_raw, read_raw_csv
from souk.sources.marts import export_marts, load_mart


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_na_tokens_become_null_but_blank_text_stays(spark, tmp_dir):
    header = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"
    body = 's1,1,,SP\ns2,NA,NA,SP\ns3,3,null,SP\ns4,4,n/a,SP\ns5,5,   ,SP\ns6,6,"x",SP\n'
    p = _write(os.path.join(tmp_dir, "sellers.csv"), header + body)
    rows = {r["seller_id"]: r for r in read_raw_csv(spark, p, "raw_sellers").collect()}
    assert [rows[k]["seller_city"] for k in ("s1", "s2", "s3", "s4", "s5", "s6")] == [
        None, None, None, None, "   ", "x"]
    assert rows["s2"]["seller_zip_code_prefix"] is None  # NA in a numeric column
    assert rows["s1"]["seller_zip_code_prefix"] == 1


def test_multiline_quoted_comment_is_one_field(spark, tmp_dir):
    header = ("review_id,order_id,review_score,review_comment_title,review_comment_message,"
              "review_creation_date,review_answer_timestamp\n")
    body = ('r1,o1,5,,"line one\nline ""two""",2018-01-01 00:00:00,2018-01-02 00:00:00\n'
            'r2,o2,4,ok,,2018-01-01 00:00:00,2018-01-02 00:00:00\n')
    p = _write(os.path.join(tmp_dir, "order_reviews.csv"), header + body)
    rows = read_raw_csv(spark, p, "raw_order_reviews").orderBy("review_id").collect()
    assert len(rows) == 2
    assert rows[0]["review_comment_message"] == 'line one\nline "two"'
    assert rows[0]["review_comment_title"] is None
    assert rows[1]["review_score"] == 4


def test_raw_materialize_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([("a", "b")], RAW_SCHEMAS["raw_category_translation"])
    path = materialize_raw(df, os.path.join(tmp_dir, "raw_category_translation"))
    assert spark.read.parquet(path).collect() == df.collect()
    materialize_raw(df, path)  # idempotent overwrite
    assert spark.read.parquet(path).count() == 1


def test_duplicates_treat_null_as_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", None), ("b", None)],
                               "x string, y string")
    assert P.duplicate_rows(df).collect()[0]["duplicate_rows"] == 2


def test_profile_nulls_only_lists_columns_with_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", "c")], "x string, y string")
    rows = P.profile_nulls({"t": df}).collect()
    assert [(r["table_name"], r["column_name"], r["null_count"]) for r in rows] == [("t", "y", 1)]


def test_reconcile_counts(spark):
    a = spark.range(5)
    rows = P.reconcile_counts({"t": a}, {"t": a.where("id < 4")}).collect()
    assert (rows[0]["source_rows"], rows[0]["stored_rows"], rows[0]["matches"]) == (5, 4, False)


def test_load_mart_errors_and_roundtrip(spark, tmp_dir):
    with pytest.raises(ValueError):
        load_mart(spark, "x", tmp_dir)
    with pytest.raises(FileNotFoundError):
        load_mart(spark, "sales_monthly_trend", tmp_dir)
    df = spark.createDataFrame([("2018-01", 1, 2.0, 2.0)],
                               "year_month string, num_orders bigint, total_revenue double, "
                               "avg_order_value double")
    export_marts({"sales_monthly_trend": df}, tmp_dir, names=("sales_monthly_trend",))
    assert load_mart(spark, "sales_monthly_trend", tmp_dir).collect() == df.collect()


def test_profile_handles_odd_column_names(spark):
    df = spark.createDataFrame([(None, 1)], "`it's` string, `a\\\\b` int")
    rows = P.profile_nulls({"t": df}).collect()
    assert [(r["column_name"], r["null_count"]) for r in rows] == [("it's", 1)]


def test_csv_columns_are_taken_by_header_name(spark, tmp_path):
    from souk.sources.csv_source import read_raw_csv
    path = tmp_path / "sellers.csv"
    path.write_text("seller_state,seller_id,seller_zip_code_prefix,seller_city\n"
                    "SP,a,100.0,campinas\nRJ,b,7.5,rio\n")
    got = sorted(map(tuple, read_raw_csv(spark, str(path), "raw_sellers").collect()))
    assert got == [("a", 100, "campinas", "SP"), ("b", None, "rio", "RJ")]
    path = tmp_path / "bad.csv"
    path.write_text("seller_state,seller_id,zip,seller_city\nSP,a,100,campinas\n")
    with pytest.raises(ValueError):
        read_raw_csv(spark, str(path), "raw_sellers")


ITEMS = "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"


def test_load_reports_what_it_lost(spark, tmp_path):
    """One broken row, one 3.5 and one abc in a column of whole numbers: three losses."""
    from souk.plans.build import ingest_raw, load_raw
    path = tmp_path / "items.csv"
    path.write_text(ITEMS + "a,1,p,s,2018-01-01 00:00:00,10.0,1.0\n"
                    "a,2.0,p,s,2018-01-01 00:00:00,NA,1.0\n"
                    "b,3.5,p,s,2018-01-01 00:00:00,10.0,1.0\n"
                    "c,abc,p,s,2018-01-01 00:00:00,10.0,1.0\n"
                    "d,1,p\n")
    paths = {"raw_order_items": str(path)}
    stored, accounts = load_raw(spark, paths, str(tmp_path / "raw"))
    found = {tuple(r) for r in P.load_losses(spark, accounts).collect()}
    assert found == {("raw_order_items", None, "broken row", 1),
                     ("raw_order_items", "order_item_id", "number does not fit", 1),
                     ("raw_order_items", "order_item_id", "not a value of its type", 1)}
    report = P.reconcile_loads(accounts, stored).first()
    assert (report.source_rows, report.stored_rows, report.broken_rows, report.lost_values) == (5, 5, 1, 2)
    assert not report.same_contents and not report.matches
    _, again = ingest_raw(spark, paths, str(tmp_path / "raw2"), widen=True)
    assert (again.first().lost_values, again.first().matches) == (1, False)
    # without the damage everything matches, however numbers are written
    path.write_text(ITEMS + "a,2.0,p,s,2018-01-01 00:00:00,NA,1e1\n\"x,\"\"y\",7,,s,,010.50,-0.0\n")
    _, clean = ingest_raw(spark, paths, str(tmp_path / "raw3"))
    assert clean.first().matches and clean.first().stored_rows == 2


def test_widening_keeps_numbers_that_are_not_whole(spark, tmp_path):
    from souk.plans.build import load_raw
    path = tmp_path / "items.csv"
    path.write_text(ITEMS + "a,1,p,s,2018-01-01 00:00:00,10.0,1.0\nb,3.5,p,s,2018-01-01 00:00:00,1.0,1.0\n")
    stored, accounts = load_raw(spark, {"raw_order_items": str(path)}, str(tmp_path / "raw"), widen=True)
    assert sorted(r.order_item_id for r in stored["raw_order_items"].collect()) == [1.0, 3.5]
    assert accounts["raw_order_items"].losses() == []


def test_one_changed_value_is_reported(spark):
    a = spark.createDataFrame([(1, "x", None), (1, "x", None), (2, None, 0.5)], "k long, t string, v double")
    b = spark.createDataFrame([(2, None, 0.5), (1, "x", None), (1, "x", None)], "k long, t string, v double")
    c = spark.createDataFrame([(1, "x", None), (1, "x", None), (2, None, 0.25)], "k long, t string, v double")
    d = spark.createDataFrame([(1, "x", None), (1, None, None), (2, "x", 0.5)], "k long, t string, v double")
    rows = {r.table_name: r for r in P.reconcile_counts(
        {"order": a, "value": a, "moved": a}, {"order": b, "value": c, "moved": d}).collect()}
    assert {n: (r.source_rows, r.stored_rows, r.same_contents, r.matches) for n, r in rows.items()} == {
        "order": (3, 3, True, True), "value": (3, 3, False, False), "moved": (3, 3, False, False)}


def test_a_failed_rebuild_leaves_the_last_tables(spark, tmp_path):
    from pyspark.sql import functions as F
    from souk.sources.publish import manifest, publish, read_published
    base = str(tmp_path)
    publish({"a": spark.range(3), "b": spark.range(5)}, base)
    broken = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error("lost")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish({"a": spark.range(7), "b": broken}, base)
    assert [read_published(spark, base, n, check=True).count() for n in "ab"] == [3, 5]
    publish({"a": spark.range(8)}, base)
    publish({"a": spark.range(9)}, base)
    assert read_published(spark, base, "a", check=True).count() == 9
    assert read_published(spark, base, "b", check=True).count() == 5
    assert {n: (e.version, e.num_rows) for n, e in manifest(spark, base).items()} == {"a": (3, 9), "b": (1, 5)}
    with pytest.raises(FileNotFoundError):
        read_published(spark, base, "c")


def test_a_damaged_mart_is_refused(spark, tmp_path):
    from souk.sources.publish import DamagedTable
    df = spark.createDataFrame([(f"2018-{m:02d}", m, 2.0, 2.0) for m in range(1, 13)],
                               "year_month string, num_orders bigint, total_revenue double, avg_order_value double")
    export_marts({"sales_monthly_trend": df}, str(tmp_path), names=("sales_monthly_trend",))
    folder = tmp_path / "sales_monthly_trend.parquet" / "slot-0"
    (part,) = folder.glob("*.parquet")
    whole = part.read_bytes()
    part.write_bytes(whole[:len(whole) // 2])
    with pytest.raises(DamagedTable):
        load_mart(spark, "sales_monthly_trend", str(tmp_path))
    # as many bytes and rows, another value
    other = df.replace("2018-07", "2018-70")
    other.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "other"))
    (swapped,) = (tmp_path / "other").glob("*.parquet")
    part.write_bytes(swapped.read_bytes())
    (folder / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(DamagedTable):
        load_mart(spark, "sales_monthly_trend", str(tmp_path))


def test_duplicates_shuffle_digests(spark):
    """Whole rows stay out of the main exchange: it carries two digests and a count."""
    df = spark.range(1000).selectExpr("id % 900 as k", "concat('text ', id % 900) as t")
    counted = P.duplicate_rows(df)
    assert counted.first().duplicate_rows == 100
    plan = counted._jdf.queryExecution().executedPlan().toString()
    main = [x for x in plan.split("\n") if "Exchange hashpartitioning(_digest_a" in x]
    assert any("k#" not in x and " t#" not in x for x in main)
