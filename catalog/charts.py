"""Chart data (CHT-1 to CHT-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import table
from lucarne.operators import charts


def _rounded(df):
    return df.withColumn("value", F.bround("value", 2))


def freq_top(spark, sf):
    return charts.frequency(table(spark, sf, "events"), "event_type")


def freq_many(spark, sf):
    return charts.frequency(table(spark, sf, "lineitem"), "l_partkey", limit=5000)


def bar_sum(spark, sf):
    return _rounded(charts.chart(table(spark, sf, "orders"), "bar", "o_orderpriority", "o_totalprice"))


def bar_top50(spark, sf):
    return _rounded(charts.chart(table(spark, sf, "orders"), "bar", "o_custkey", "o_totalprice"))


def bar_filtered(spark, sf):
    return _rounded(charts.chart(
        table(spark, sf, "orders"), "line", "o_orderpriority", "o_totalprice", {"o_orderstatus": ["F", "O"]}
    ))


def pie_sum(spark, sf):
    return _rounded(charts.chart(table(spark, sf, "customer"), "pie", "c_mktsegment", "c_acctbal"))


def pie_top20(spark, sf):
    return _rounded(charts.chart(table(spark, sf, "customer"), "pie", "c_nationkey", "c_acctbal"))


def bar_count_text(spark, sf):
    return charts.chart(table(spark, sf, "orders"), "bar", "o_orderstatus", "o_orderpriority")


POINT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def scatter_head(spark, sf):
    return charts.chart(table(spark, sf, "lineitem"), "scatter", "l_quantity", "l_extendedprice", key=POINT_KEY)


def boxplot(spark, sf):
    return charts.chart(table(spark, sf, "lineitem"), "boxplot", "l_returnflag", "l_extendedprice")


def boxplot_skewed(spark, sf):
    return charts.boxplot(table(spark, sf, "events"), "event_type", "value")


def boxplot_outliers(spark, sf):
    return charts.boxplot_outliers(table(spark, sf, "events"), "event_type", "value")


def chart_summary(spark, sf):
    bars = charts.grouped_value(table(spark, sf, "orders"), "o_custkey", "o_totalprice")
    s = charts.chart_summary(bars)
    return s.select(
        F.bround("min", 2).alias("min"), F.bround("max", 2).alias("max"), "mean", "trend",
        F.concat_ws("|", F.transform("top_values", lambda p: p["label"])).alias("top_labels"),
    )


def _box_sql(source: str, x: str, y: str, outliers: bool) -> str:
    ranked = f"""
WITH r AS (
  SELECT {x} AS category, {y} AS y,
         row_number() OVER (PARTITION BY {x} ORDER BY {y}) - 1 AS rn,
         count(*) OVER (PARTITION BY {x}) AS n
  FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL
    AND {x} IN (SELECT DISTINCT {x} FROM {source} WHERE {x} IS NOT NULL ORDER BY 1 LIMIT 30)
), q AS (
  SELECT category, max(n) AS n,
         max(CASE WHEN rn = CAST(floor((n-1)*0.25+0.5) AS BIGINT) THEN y END) AS q1,
         max(CASE WHEN rn = CAST(floor((n-1)*0.5+0.5) AS BIGINT) THEN y END) AS q2,
         max(CASE WHEN rn = CAST(floor((n-1)*0.75+0.5) AS BIGINT) THEN y END) AS q3
  FROM r GROUP BY category
)"""
    low, high = "q1 - 1.5*(q3-q1)", "q3 + 1.5*(q3-q1)"
    if outliers:
        return ranked + f"""
SELECT category, CAST(rank AS INTEGER) AS rank, y, total FROM (
  SELECT r.category, y, row_number() OVER (PARTITION BY r.category ORDER BY greatest({low} - y, y - ({high})) DESC, y) AS rank,
         count(*) OVER (PARTITION BY r.category) AS total
  FROM r JOIN q USING (category) WHERE y < {low} OR y > {high}
) WHERE rank <= 50"""
    return ranked + f"""
SELECT category, max(q.n) AS n, min(CASE WHEN y BETWEEN {low} AND {high} THEN y END) AS whisker_low,
       max(q1) AS q1, max(q2) AS q2, max(q3) AS q3,
       max(CASE WHEN y BETWEEN {low} AND {high} THEN y END) AS whisker_high
FROM r JOIN q USING (category) GROUP BY category"""


def _sum_sql(source: str, x: str, y: str, limit: int, where: str = "") -> str:
    return (
        f"SELECT CAST({x} AS VARCHAR) AS label, round(sum({y}), 2) AS value FROM {source} {where} "
        f"GROUP BY 1 ORDER BY sum({y}) DESC, label LIMIT {limit}"
    )


def scatter_sample(spark, sf):
    """A third of the orders, drawn by the hash of their key."""
    return charts.scatter(table(spark, sf, "orders"), "o_totalprice", "o_custkey", key=["o_orderkey"], sample=True)


def scatter_grid(spark, sf):
    """Up to 50 orders from each cell of a 10 by 10 grid."""
    return charts.scatter(table(spark, sf, "orders"), "o_totalprice", "o_custkey", key=["o_orderkey"], sample=True, grid=10)


QUERIES = {
    "scatter_sample": (scatter_sample, "SELECT o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 5000"),
    "scatter_grid": (scatter_grid, """
        SELECT x, y FROM (
          SELECT x, y, row_number() OVER (PARTITION BY least(floor((x - lx) / (hx - lx) * 10), 9), least(floor((y - ly) / (hy - ly) * 10), 9) ORDER BY md5(CAST(k AS VARCHAR)), k) AS place
          FROM (SELECT o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y, o_orderkey AS k FROM orders),
               (SELECT min(o_totalprice) AS lx, max(o_totalprice) AS hx, CAST(min(o_custkey) AS DOUBLE) AS ly, CAST(max(o_custkey) AS DOUBLE) AS hy FROM orders))
        WHERE place <= 50"""),
    "freq_top": (freq_top, "SELECT event_type AS label, count(*) AS value FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5000"),
    "freq_many": (freq_many, "SELECT CAST(l_partkey AS VARCHAR) AS label, count(*) AS value FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5000"),
    "bar_sum": (bar_sum, _sum_sql("orders", "o_orderpriority", "o_totalprice", 50)),
    "bar_top50": (bar_top50, _sum_sql("orders", "o_custkey", "o_totalprice", 50)),
    "bar_filtered": (bar_filtered, _sum_sql("orders", "o_orderpriority", "o_totalprice", 50, "WHERE o_orderstatus IN ('F','O')")),
    "pie_sum": (pie_sum, _sum_sql("customer", "c_mktsegment", "c_acctbal", 20)),
    "pie_top20": (pie_top20, _sum_sql("customer", "c_nationkey", "c_acctbal", 20)),
    "bar_count_text": (bar_count_text, "SELECT o_orderstatus AS label, CAST(count(o_orderpriority) AS DOUBLE) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"),
    "scatter_head": (scatter_head, f"SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem ORDER BY {', '.join(POINT_KEY)} LIMIT 5000"),
    "boxplot": (boxplot, _box_sql("lineitem", "l_returnflag", "l_extendedprice", False)),
    "boxplot_skewed": (boxplot_skewed, _box_sql("events", "event_type", "value", False)),
    "boxplot_outliers": (boxplot_outliers, _box_sql("events", "event_type", "value", True)),
    "chart_summary": (chart_summary, """
WITH b AS (SELECT CAST(o_custkey AS VARCHAR) AS label, sum(o_totalprice) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50),
     r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rank FROM b)
SELECT round(min(value), 2) AS min, round(max(value), 2) AS max, floor(avg(value) + 0.5) AS mean,
       CASE WHEN max(CASE WHEN rank = 1 THEN value END) < min(value) THEN 'ascendant' ELSE 'descendant' END AS trend,
       string_agg(CASE WHEN rank <= 3 THEN label END, '|' ORDER BY rank) AS top_labels
FROM r"""),
}
