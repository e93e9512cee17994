"""DuckDB SQL twins of the source, profile and registry queries."""

from __future__ import annotations

from souk.schemas import NA_TOKENS, RAW_KEYS, RAW_SCHEMAS
from souk.testing.oracle_sql import with_ctes

_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)

# Columns of the adapter's raw tables that are text; ids are integers in the
# adapter and become text when read back from CSV with the declared schema.
_ID_COLS = {"customer_id", "order_id", "product_id", "seller_id", "review_id"}


def _csv_roundtrip(table: str) -> str:
    cols = []
    for f in RAW_SCHEMAS[table].fields:
        c = f.name
        if f.dataType.simpleString() == "string":
            src = f"CAST({c} AS VARCHAR)" if c in _ID_COLS else c
            cols.append(f"CASE WHEN {src} IN ({_TOKENS}) THEN NULL ELSE {src} END AS {c}")
        else:
            cols.append(c)
    return f"SELECT {', '.join(cols)} FROM {table}"


def _spark_type(col: str) -> str:
    return (f"CASE typeof(any_value({col})) WHEN 'BIGINT' THEN 'bigint' "
            f"WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' "
            f"WHEN 'INTEGER' THEN 'int' ELSE lower(typeof(any_value({col}))) END")


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _shape() -> str:
    return _union([f"SELECT '{t}' AS table_name, COUNT(*) AS num_rows, "
                   f"{len(s.fields)} AS num_columns FROM {t}"
                   for t, s in RAW_SCHEMAS.items()])


def _dtypes() -> str:
    return _union([
        f"SELECT '{t}' AS table_name, {i} AS position, '{f.name}' AS column_name, "
        f"{_spark_type(f.name)} AS data_type, COUNT({f.name}) AS non_null_count FROM {t}"
        for t, s in RAW_SCHEMAS.items() for i, f in enumerate(s.fields, start=1)])


def _nulls() -> str:
    inner = _union([
        f"SELECT '{t}' AS table_name, '{f.name}' AS column_name, "
        f"COUNT(*) - COUNT({f.name}) AS null_count FROM {t}"
        for t, s in RAW_SCHEMAS.items() for f in s.fields])
    return f"SELECT * FROM ({inner}) WHERE null_count > 0"


def _duplicates() -> str:
    return _union([
        f"SELECT '{t}' AS table_name, "
        f"CAST((SELECT COUNT(*) FROM {t}) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {t}))"
        f" AS BIGINT) AS duplicate_rows"
        for t in RAW_SCHEMAS])


def _reconcile() -> str:
    return _union([f"SELECT '{t}' AS table_name, COUNT(*) AS source_rows, COUNT(*) AS stored_rows, "
                   "CAST(0 AS BIGINT) AS broken_rows, CAST(0 AS BIGINT) AS lost_values, "
                   f"true AS same_contents, true AS matches FROM {t}" for t in RAW_SCHEMAS])


def _reconcile_changed() -> str:
    """Contents compared as multisets of rows."""
    changed = """
changed AS (
  SELECT * REPLACE (CASE WHEN order_id = (SELECT min(order_id) FROM raw_order_payments)
                          AND payment_sequential = 1
                    THEN payment_value + CAST(0.01 AS DOUBLE) ELSE payment_value END AS payment_value)
  FROM raw_order_payments)"""
    parts = []
    for t in RAW_SCHEMAS:
        other = "changed" if t == "raw_order_payments" else t
        same = f"NOT EXISTS (SELECT * FROM {t} EXCEPT ALL SELECT * FROM {other})"
        n, m = f"(SELECT COUNT(*) FROM {t})", f"(SELECT COUNT(*) FROM {other})"
        parts.append(f"SELECT '{t}' AS table_name, {n} AS source_rows, {m} AS stored_rows, "
                     f"{same} AS same_contents, {same} AND {n} = {m} AS matches")
    return f"SELECT * FROM (WITH {changed} {_union(parts)})"


# The damage planted in the order items, as conditions on their rows.
_NOT_WHOLE = "order_item_id = 1 AND order_id % 11 = 0"
_NO_NUMBER = "order_item_id = 2 AND order_id % 7 = 0"
_SURPLUS = "order_item_id = 3 AND order_id % 5 = 0"


def _load_losses() -> str:
    return "SELECT * FROM (" + _union([
        f"SELECT 'raw_order_items' AS table_name, {column} AS column_name, '{reason}' AS reason, "
        f"COUNT(*) FILTER ({planted}) AS num_lost FROM raw_order_items"
        for column, reason, planted in (
            ("'order_item_id'", "number does not fit", _NOT_WHOLE),
            ("'price'", "not a value of its type", _NO_NUMBER),
            ("CAST(NULL AS VARCHAR)", "broken row", _SURPLUS))]) + ") WHERE num_lost > 0"


def _load_reconcile() -> str:
    lost = f"COUNT(*) FILTER ({_NOT_WHOLE}) + COUNT(*) FILTER ({_NO_NUMBER})"
    broken = f"COUNT(*) FILTER ({_SURPLUS})"
    return (f"SELECT 'raw_order_items' AS table_name, COUNT(*) AS source_rows, COUNT(*) AS stored_rows, "
            f"{broken} AS broken_rows, {lost} AS lost_values, {lost} + {broken} = 0 AS same_contents, "
            f"{lost} + {broken} = 0 AS matches FROM raw_order_items")


def _load_widened() -> str:
    return (f"SELECT CASE WHEN {_NOT_WHOLE} THEN CAST(1.5 AS DOUBLE) ELSE CAST(order_item_id AS DOUBLE) END "
            "AS order_item_id, COUNT(*) AS num_items FROM raw_order_items GROUP BY 1")


# Text and number columns of the exported marts.
_MART_COLUMNS = (
    ("sales_monthly_trend", "year_month", "num_orders total_revenue avg_order_value"),
    ("sales_by_category", "category_english",
     "num_orders num_items_sold total_revenue avg_item_price"),
    ("sales_by_state", "customer_state", "num_orders total_revenue avg_order_value"),
    ("sales_payment_breakdown", "payment_type", "num_orders total_paid avg_installments"),
    ("logistics_delivery_by_state", "customer_state",
     "num_delivered_orders avg_delivery_days avg_delay_days pct_on_time"),
    ("logistics_delay_distribution", "delay_bucket", "sort_order num_orders"),
    ("logistics_freight_ratio", "category_english",
     "num_items avg_price avg_freight freight_pct_of_price"),
    ("logistics_route_performance", "seller_state customer_state",
     "num_orders avg_delivery_days pct_on_time"),
    ("reviews_score_distribution", "", "review_score num_reviews pct_of_total"),
    ("reviews_score_by_delay", "delay_bucket", "sort_order num_reviews avg_review_score"),
    ("reviews_score_by_category", "category_english", "num_reviews avg_review_score"),
    ("reviews_score_by_payment", "payment_type installments_bucket", "num_reviews avg_review_score"),
)


def _mart_values() -> str:
    parts = []
    for mart, texts, numbers in _MART_COLUMNS:
        key = " || '|' || ".join(f"ifnull({c}, '-')" for c in texts.split()) or "''"
        parts += [f"SELECT '{mart}' AS mart, {key} AS row_key, '{c}' AS column_name, "
                  f"CAST({c} AS DOUBLE) AS value FROM {mart}" for c in numbers.split()]
    return _union(parts)


# The view DAG in build order (name, layer, exported).
_VIEWS = (
    ("clean_orders", "clean", False), ("clean_products", "clean", False),
    ("_geo_avg", "helper", False), ("_geo_mode", "helper", False),
    ("clean_geolocation", "clean", False), ("clean_order_items", "clean", False),
    ("clean_payments", "clean", False), ("clean_reviews", "clean", False),
    ("sales_monthly_trend", "sales", True), ("sales_by_category", "sales", True),
    ("sales_by_state", "sales", True), ("sales_payment_breakdown", "sales", True),
    ("logistics_delivery_by_state", "logistics", True),
    ("logistics_delay_distribution", "logistics", True),
    ("logistics_freight_ratio", "logistics", True),
    ("logistics_route_performance", "logistics", True),
    ("reviews_score_distribution", "reviews", True), ("reviews_score_by_delay", "reviews", True),
    ("reviews_score_by_category", "reviews", True), ("reviews_score_by_payment", "reviews", True),
)


def _registry() -> str:
    return _union([f"SELECT {i} AS position, '{n}' AS view_name, '{layer}' AS layer, "
                   f"{str(exp).lower()} AS exported, COUNT(*) AS num_rows FROM {n}"
                   for i, (n, layer, exp) in enumerate(_VIEWS, start=1)])


def _catalog() -> str:
    return _union([f"SELECT '{n}' AS view_name, COUNT(*) AS num_rows FROM {n}"
                   for n, _, _ in sorted(_VIEWS)])


def _manifest() -> str:
    exported = [n for n, _, e in _VIEWS if e]
    return _union([f"SELECT {i} AS export_order, '{n}' AS mart, COUNT(*) AS num_rows, "
                   f"CAST((SELECT COUNT(*) FROM (DESCRIBE {n})) AS INTEGER) AS num_columns FROM {n}"
                   for i, n in enumerate(exported, start=1)])


def _sample(table: str) -> str:
    key = list(RAW_KEYS[table])
    order = key + [f.name for f in RAW_SCHEMAS[table].fields if f.name not in key]
    return (f"SELECT * FROM {table} ORDER BY "
            + ", ".join(f"{c} ASC NULLS FIRST" for c in order) + " LIMIT 3")


def source_oracle_sql() -> dict[str, str]:
    samples = {f"profile_sample_{t[len('raw_'):]}": with_ctes(_sample(t))
               for t in RAW_KEYS if t != "raw_orders"}
    ingests = {f"csv_ingest_{t[len('raw_'):]}": with_ctes(_csv_roundtrip(t))
               for t in RAW_KEYS if t not in ("raw_orders", "raw_order_reviews")}
    return {
        **samples,
        **ingests,
        "csv_ingest": with_ctes(_csv_roundtrip("raw_order_reviews")),
        "csv_ingest_orders": with_ctes(_csv_roundtrip("raw_orders")),
        "raw_materialize": with_ctes(_csv_roundtrip("raw_orders")),
        "raw_materialize_all": with_ctes(_shape()),
        "reconcile_counts": with_ctes(_reconcile()),
        "reconcile_changed": with_ctes(_reconcile_changed()),
        "load_losses": with_ctes(_load_losses()),
        "load_reconcile": with_ctes(_load_reconcile()),
        "load_widened": with_ctes(_load_widened()),
        "profile_shape": with_ctes(_shape()),
        "profile_dtypes": with_ctes(_dtypes()),
        "profile_nulls": with_ctes(_nulls()),
        "profile_duplicates": with_ctes(_duplicates()),
        "profile_sample": with_ctes(_sample("raw_orders")),
        "view_registry": with_ctes(_registry()),
        "view_names": _union([f"SELECT '{n}' AS view_name" for n, _, _ in _VIEWS]),
        "view_catalog": with_ctes(_catalog()),
        "mart_export_all": with_ctes(_mart_values()),
        "mart_export": with_ctes("SELECT * FROM logistics_route_performance"),
        "export_manifest": with_ctes(_manifest()),
        "mart_load": with_ctes("SELECT * FROM reviews_score_by_payment"),
    }
