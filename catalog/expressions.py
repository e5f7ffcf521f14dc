"""Calculated fields (EXP-1 to EXP-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import table
from lucarne.functions.arithmetic import is_bad
from lucarne.functions.formula import formula
from lucarne.operators import calculated

KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


def calc_arith(spark, sf):
    df = calculated.add_field(_lines(spark, sf), "charge", "l_extendedprice * (1 - f['l_discount']) * (1 + \"l_tax\")")
    return df.select(*KEY, "charge")


def calc_minus(spark, sf):
    df = calculated.add_field(_lines(spark, sf), "x", "-l_quantity ** 2 ** 2 - -l_tax")
    return df.select(*KEY, F.bround("x", 6).alias("x"))


def calc_div_safe(spark, sf):
    x = formula("l_discount / l_tax", _lines(spark, sf).columns)
    kind = F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), "inf").otherwise("finite")
    return _lines(spark, sf).select(*KEY, kind.alias("kind"), F.when(~is_bad(x), x).alias("ratio"))


def calc_log(spark, sf):
    df = _lines(spark, sf)
    parts = {"a": "LOG(l_extendedprice)", "b": "ln(l_quantity)", "c": "LOG(l_quantity, 2)", "d": "EXP(l_tax)", "e": "SQRT(ABS(l_discount - l_tax))"}
    return df.select(*KEY, *[F.bround(formula(f, df.columns), 6).alias(n) for n, f in parts.items()])


def calc_round(spark, sf):
    df = _lines(spark, sf)
    return df.select(*KEY, formula("ROUND(l_extendedprice * l_discount / 7, 2)", df.columns).alias("two"),
                     formula("round(l_extendedprice / 3)", df.columns).alias("none"))


def calc_force(spark, sf):
    df = calculated.add_field(_lines(spark, sf), "x", "LN(l_discount) / l_tax", force=True)
    return df.select(*KEY, F.bround("x", 6).alias("x"))


def calc_check(spark, sf):
    return calculated.math_check(_lines(spark, sf), "l_discount / l_tax")


def calc_text_operand(spark, sf):
    df = table(spark, sf, "orders")
    df = df.withColumn("rank", F.substring("o_orderpriority", 1, 1)).withColumn("word", F.substring("o_orderpriority", 3, 20))
    return calculated.add_field(df, "x", "rank * 2 + word").select("o_orderkey", "x", formula("rank * 2", df.columns).alias("y"))


def select_columns(spark, sf):
    return calculated.select_columns(table(spark, sf, "part"), ["p_size", "nothing", "p_name"])


_K = ", ".join(KEY)

QUERIES = {
    "calc_arith": (calc_arith, f"SELECT {_K}, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem"),
    "calc_minus": (calc_minus, f"SELECT {_K}, round(pow(pow(-l_quantity, 2), 2) + l_tax, 6) AS x FROM lineitem"),
    "calc_div_safe": (calc_div_safe, f"""
SELECT {_K}, CASE WHEN l_tax = 0 AND l_discount = 0 THEN 'nan' WHEN l_tax = 0 THEN 'inf' ELSE 'finite' END AS kind,
       CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS ratio FROM lineitem"""),
    "calc_log": (calc_log, f"""
SELECT {_K}, round(log10(l_extendedprice), 6) AS a, round(ln(l_quantity), 6) AS b, round(log2(l_quantity), 6) AS c,
       round(exp(l_tax), 6) AS d, round(sqrt(abs(l_discount - l_tax)), 6) AS e FROM lineitem"""),
    "calc_round": (calc_round, f"SELECT {_K}, round_even(l_extendedprice * l_discount / 7, 2) AS two, round_even(l_extendedprice / 3, 0) AS none FROM lineitem"),
    "calc_force": (calc_force, f"SELECT {_K}, CASE WHEN l_discount > 0 AND l_tax > 0 THEN round(ln(l_discount) / l_tax, 6) END AS x FROM lineitem"),
    "calc_check": (calc_check, """
SELECT count(*) AS total_rows, CAST(0 AS BIGINT) AS null_rows, count(*) FILTER (WHERE l_tax = 0 AND l_discount = 0) AS nan_rows,
       count(*) FILTER (WHERE l_tax = 0 AND l_discount <> 0) AS inf_rows, count(*) FILTER (WHERE l_tax = 0) AS affected_rows FROM lineitem"""),
    "calc_text_operand": (calc_text_operand, "SELECT o_orderkey, CAST(NULL AS DOUBLE) AS x, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) * 2 AS y FROM orders"),
    "select_columns": (select_columns, "SELECT p_size, p_name FROM part"),
}
