"""Filters, search, sort and paging (FLT-1 to FLT-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import table
from lucarne.operators import filters, profile
from lucarne.operators.anomalies import detect_anomalies
from lucarne.operators.pages import SortedPages

#: Together they tell line items apart.
PAGE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def filter_eq(spark, sf):
    return filters.apply_filters(table(spark, sf, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "nowhere": 1})


def filter_in(spark, sf):
    return filters.apply_filters(
        table(spark, sf, "lineitem"), {"l_returnflag": ["A", "R"], "l_linenumber": [1, 2, 3], "l_linestatus": []}
    )


def filter_boolean(spark, sf):
    events = table(spark, sf, "events").select("event_id", (F.col("event_type") == "error").alias("is_error"))
    return filters.apply_filters(events, {"is_error": "Oui"})


def drop_nulls(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("segment"))
    return filters.drop_nulls(rows, ["segment"])


def search_any(spark, sf):
    return filters.search(table(spark, sf, "part"), "WidGet")


def search_text(spark, sf):
    return filters.search(table(spark, sf, "documents"), "Example.COM").select("doc_id", "lang", "n_chars")


def distinct_values(spark, sf):
    return filters.distinct_values(table(spark, sf, "orders"), "o_custkey")


def distinct_keys(spark, sf):
    """Distinct keys: some close together, counted by bitmaps, some far apart."""
    keys = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orders"), F.col("l_partkey").alias("parts"), (F.col("l_orderkey") * 1000003).alias("apart"))
    counts = profile.distinct_counts(keys)
    return counts.agg(*[F.max(F.when(F.col("column") == c, F.col("uniques"))).alias(c) for c in keys.columns])


def distinct_total(spark, sf):
    rows = table(spark, sf, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return filters.distinct_total(rows, "priority")


def distinct_search(spark, sf):
    return filters.distinct_values(table(spark, sf, "part"), "p_name", search="RING")


def sort_rows(spark, sf):
    return filters.sort_rows(table(spark, sf, "orders"), [("o_orderpriority", False), "o_totalprice"], ["o_orderkey"])


def page_sorted(spark, sf):
    return filters.page(table(spark, sf, "orders"), [("o_totalprice", False)], ["o_orderkey"], number=3)


def page_after(spark, sf):
    return filters.page_after(table(spark, sf, "orders"), "o_orderkey", 100, size=20)


def page_deep(spark, sf):
    """The third page from the end of the line items by price."""
    pages = SortedPages(table(spark, sf, "lineitem"), [("l_extendedprice", False)], PAGE_KEY)
    return pages.page(pages.total // 15 - 2)


def head_text(spark, sf):
    return filters.preview(table(spark, sf, "customer"), key=["c_custkey"])


def anomaly_only_rows(spark, sf):
    events = table(spark, sf, "events")
    found = detect_anomalies(events, "iqr", "standard", ["value"], ["event_id"])
    return filters.anomaly_rows_only(events, found.anomalies, ["event_id"])


def severity_filter(spark, sf):
    found = detect_anomalies(table(spark, sf, "events"), "iqr", "standard", ["value"], ["event_id"])
    return filters.by_severity(found.anomalies, "high").select("event_id", "severity")


_EVENT_IQR = """
WITH s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3 FROM events)
"""

def preview_numbers(spark, sf):
    """Large and small numbers as users write them."""
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * 1024).alias("large"), ((F.col("o_custkey") + 1000) / 1e7).alias("small"))
    return filters.preview(orders, key=["o_orderkey"])


def search_number(spark, sf):
    """Orders whose amount, above ten million, shows the wanted digits."""
    orders = table(spark, sf, "orders").select("o_orderkey", (F.floor("o_totalprice") * 100000.0).alias("amount"))
    return filters.search(orders.select("amount"), "5700000")


QUERIES = {
    "preview_numbers": (preview_numbers, """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice * 1024 AS VARCHAR) AS large,
               CAST((o_custkey + 1000) / 1e7 AS VARCHAR) AS small
        FROM orders ORDER BY orders.o_orderkey LIMIT 2000"""),
    "search_number": (search_number, "SELECT floor(o_totalprice) * 100000.0 AS amount FROM orders WHERE contains(CAST(floor(o_totalprice) * 100000.0 AS VARCHAR), '5700000')"),
    "filter_eq": (filter_eq, "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "filter_in": (filter_in, "SELECT * FROM lineitem WHERE l_returnflag IN ('A','R') AND l_linenumber IN (1,2,3)"),
    "filter_boolean": (filter_boolean, "SELECT event_id, true AS is_error FROM events WHERE event_type = 'error'"),
    "drop_nulls": (drop_nulls, "SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'"),
    "search_any": (search_any, "SELECT * FROM part WHERE contains(lower(p_name), 'widget') OR contains(lower(p_brand), 'widget') OR contains(lower(p_type), 'widget')"),
    "search_text": (search_text, "SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'example.com') OR contains(lower(lang), 'example.com') OR contains(lower(source), 'example.com')"),
    "distinct_values": (distinct_values, "SELECT DISTINCT o_custkey AS value FROM orders WHERE o_custkey IS NOT NULL ORDER BY 1 LIMIT 1000"),
    "distinct_keys": (distinct_keys, "SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS orders, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS parts, (SELECT count(DISTINCT l_orderkey * 1000003) FROM lineitem) AS apart"),
    "distinct_total": (distinct_total, "SELECT count(*) AS total_unique FROM (SELECT DISTINCT nullif(o_orderpriority, '5-LOW') FROM orders)"),
    "distinct_search": (distinct_search, "SELECT DISTINCT p_name AS value FROM part WHERE contains(lower(p_name), 'ring') ORDER BY 1 LIMIT 1000"),
    "sort_rows": (sort_rows, "SELECT * FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey"),
    "page_sorted": (page_sorted, "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 45"),
    "page_after": (page_after, "SELECT * FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 20"),
    "page_deep": (page_deep, f"""
        SELECT * FROM lineitem ORDER BY l_extendedprice DESC, {', '.join(PAGE_KEY)}
        LIMIT 15 OFFSET (SELECT (count(*) // 15 - 2) * 15 FROM lineitem)"""),
    "head_text": (head_text, "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 2000"),
    "anomaly_only_rows": (anomaly_only_rows, _EVENT_IQR + """
SELECT e.* FROM events e WHERE EXISTS (SELECT 1 FROM s WHERE e.value < q1 - 2*(q3-q1) OR e.value > q3 + 2*(q3-q1))"""),
    "severity_filter": (severity_filter, _EVENT_IQR + """
SELECT event_id, 'high' AS severity FROM events, s
WHERE (value < q1 - 2*(q3-q1) OR value > q3 + 2*(q3-q1)) AND least(abs((value - m)/(q3-q1))/6, 1) >= 0.75"""),
}
