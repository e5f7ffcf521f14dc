"""Cross-tabs and group summaries (PVT-1 to PVT-9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import table, union_all
from lucarne.operators.pivot import pivot, sorted_pivot


def flagship(spark, sf):
    """Price and discount by return flag, spread over the line status, with totals."""
    result = pivot(
        table(spark, sf, "lineitem"), ["l_returnflag"],
        [("l_extendedprice", "sum"), ("l_discount", "mean")], ["l_linestatus"],
        filters={"l_linestatus": ["O", "F"]},
    )
    return sorted_pivot(result, ["l_returnflag"]).toDF(
        "l_returnflag", "sum_price_f", "sum_price_o", "mean_discount_f", "mean_discount_o", "is_total"
    )


def pivot_single(spark, sf):
    result = pivot(table(spark, sf, "lineitem"), ["l_returnflag"], [("l_extendedprice", "sum")], ["l_linestatus"], totals=None)
    return result.toDF("l_returnflag", "f", "o", "is_total")


def pivot_names(spark, sf):
    """The columns of a pivot over two keys and two measures, by name and place, with the rows that have a value in each."""
    result = pivot(
        table(spark, sf, "orders"), ["o_orderpriority"], [("o_totalprice", "sum"), ("o_orderkey", "count")], ["o_orderstatus"], totals=None,
    )
    cells = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(c).alias("name"), F.count(F.col(f"`{c}`")).alias("filled")) for i, c in enumerate(result.columns)
    ])
    return result.agg(cells.alias("c")).selectExpr("inline(c)")


def pivot_multi_key(spark, sf):
    result = pivot(
        table(spark, sf, "lineitem"), ["l_returnflag"], [("l_orderkey", "count")], ["l_linestatus", "l_linenumber"]
    )
    return result.toDF("l_returnflag", *[f"{s}_{i}" for s in "fo" for i in range(1, 8)], "is_total")


def pivot_totals(spark, sf):
    result = pivot(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
        [{"col": "l_extendedprice"}, {"col": "l_discount", "agg": "mean"}, {"col": "l_quantity", "agg": "max"},
         {"col": "l_tax", "agg": "min"}, {"col": "l_orderkey", "agg": "count"}],
    )
    return result.toDF("l_returnflag", "l_linestatus", "sum_price", "mean_discount", "max_quantity", "min_tax", "n", "is_total")


def pivot_recomputed(spark, sf):
    result = pivot(table(spark, sf, "orders"), ["o_orderpriority"], [("o_totalprice", "mean")], ["o_orderstatus"], totals="recompute")
    return result.toDF("o_orderpriority", "f", "o", "p", "is_total")


def group_summary(spark, sf):
    return pivot(table(spark, sf, "orders"), ["o_custkey"], value_col="o_totalprice", agg_func="sum", totals=None)


def pivot_null_groups(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
    )
    result = pivot(orders, ["priority"], [("price", "sum")], ["status"], totals=None)
    return result.toDF("priority", "f", "o", "missing", "is_total")



_FLAG = """
WITH t AS (
  SELECT l_returnflag,
    CAST(printf('%.2f', sum(l_extendedprice) FILTER (WHERE l_linestatus='F')) AS DOUBLE) AS sum_price_f,
    CAST(printf('%.2f', sum(l_extendedprice) FILTER (WHERE l_linestatus='O')) AS DOUBLE) AS sum_price_o,
    CAST(printf('%.2f', avg(l_discount) FILTER (WHERE l_linestatus='F')) AS DOUBLE) AS mean_discount_f,
    CAST(printf('%.2f', avg(l_discount) FILTER (WHERE l_linestatus='O')) AS DOUBLE) AS mean_discount_o
  FROM lineitem WHERE l_linestatus IN ('O','F') GROUP BY 1)
SELECT *, false AS is_total FROM t
UNION ALL SELECT 'TOTAL', CAST(printf('%.2f', sum(sum_price_f)) AS DOUBLE), CAST(printf('%.2f', sum(sum_price_o)) AS DOUBLE),
  CAST(printf('%.2f', sum(mean_discount_f)) AS DOUBLE), CAST(printf('%.2f', sum(mean_discount_o)) AS DOUBLE), true FROM t"""

_MULTI = [f"{s}_{i}" for s in "fo" for i in range(1, 8)]
_MULTI_SQL = (
    "WITH t AS (SELECT l_returnflag, "
    + ", ".join(
        f"CAST(nullif(count(*) FILTER (WHERE l_linestatus='{s.upper()}' AND l_linenumber={i}), 0) AS BIGINT) AS {s}_{i}"
        for s in "fo" for i in range(1, 8)
    )
    + " FROM lineitem GROUP BY 1) SELECT *, false AS is_total FROM t UNION ALL SELECT 'TOTAL', "
    + ", ".join(f"CAST(sum({c}) AS BIGINT)" for c in _MULTI) + ", true FROM t"
)

QUERIES = {
    "flagship_pivot": (flagship, _FLAG),
    "pivot_names": (pivot_names, """
        WITH cells AS (SELECT o_orderstatus AS status, count(DISTINCT o_orderpriority) AS filled, row_number() OVER (ORDER BY o_orderstatus) AS pos FROM orders GROUP BY 1),
        named AS (
          SELECT 0 AS place, 'o_orderpriority' AS name, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS filled
          UNION ALL SELECT pos, 'sum(o_totalprice)_' || status, filled FROM cells
          UNION ALL SELECT pos + (SELECT count(*) FROM cells), 'count(o_orderkey)_' || status, filled FROM cells
          UNION ALL SELECT 2 * (SELECT count(*) FROM cells) + 1, 'is_total', (SELECT count(DISTINCT o_orderpriority) FROM orders))
        SELECT CAST(place AS INTEGER) AS place, name, filled FROM named"""),
    "pivot_single": (pivot_single, """
SELECT l_returnflag, CAST(printf('%.2f', sum(l_extendedprice) FILTER (WHERE l_linestatus='F')) AS DOUBLE) AS f,
       CAST(printf('%.2f', sum(l_extendedprice) FILTER (WHERE l_linestatus='O')) AS DOUBLE) AS o, false AS is_total
FROM lineitem GROUP BY 1"""),
    "pivot_multi_key": (pivot_multi_key, _MULTI_SQL),
    "pivot_totals": (pivot_totals, """
WITH t AS (
  SELECT l_returnflag, l_linestatus, CAST(printf('%.2f', sum(l_extendedprice)) AS DOUBLE) AS sum_price, CAST(printf('%.2f', avg(l_discount)) AS DOUBLE) AS mean_discount,
         CAST(printf('%.2f', max(l_quantity)) AS DOUBLE) AS max_quantity, CAST(printf('%.2f', min(l_tax)) AS DOUBLE) AS min_tax, count(*) AS n
  FROM lineitem GROUP BY 1, 2)
SELECT *, false AS is_total FROM t
UNION ALL SELECT 'TOTAL', '', CAST(printf('%.2f', sum(sum_price)) AS DOUBLE), CAST(printf('%.2f', sum(mean_discount)) AS DOUBLE), CAST(printf('%.2f', sum(max_quantity)) AS DOUBLE),
  CAST(printf('%.2f', sum(min_tax)) AS DOUBLE), CAST(sum(n) AS BIGINT), true FROM t"""),
    "pivot_recomputed": (pivot_recomputed, union_all([
        f"SELECT {label} AS o_orderpriority, "
        + ", ".join(f"CAST(printf('%.2f', avg(o_totalprice) FILTER (WHERE o_orderstatus='{s}')) AS DOUBLE) AS {s.lower()}" for s in "FOP")
        + f", {total} AS is_total FROM orders {group}"
        for label, total, group in (("o_orderpriority", "false", "GROUP BY 1"), ("'TOTAL'", "true", ""))
    ])),
    "group_summary": (group_summary, "SELECT o_custkey, CAST(printf('%.2f', sum(o_totalprice)) AS DOUBLE) AS o_totalprice, false AS is_total FROM orders GROUP BY 1"),
    "pivot_null_groups": (pivot_null_groups, """
SELECT nullif(o_orderpriority, '5-LOW') AS priority,
       CAST(printf('%.2f', sum(o_totalprice) FILTER (WHERE o_orderstatus='F')) AS DOUBLE) AS f,
       CAST(printf('%.2f', sum(o_totalprice) FILTER (WHERE o_orderstatus='O')) AS DOUBLE) AS o,
       CAST(0 AS DOUBLE) AS missing, false AS is_total
FROM orders GROUP BY 1"""),
}
