"""Casts, inference, overrides, recasts, header and cell cleaning (TYP-*, CLN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import table, union_all
from lucarne.functions import casts
from lucarne.operators import cleaning, inference
from lucarne.session import small_table

# Month names used to spell the order dates, and the SQL that spells them alike.
FRENCH = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]


def _messy_numbers(spark, sf):
    """Order totals as people type them: blanks, currency signs, decimal commas, words."""
    price = F.format_string("%.2f", "o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("  "), F.replace(price, F.lit("."), F.lit(",")), F.lit(" €")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("$"), price))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("unknown"))
        .otherwise(price).alias("price"),
    )


_PRICE_KNOWN = "NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')"


def clean_number(spark, sf):
    return _messy_numbers(spark, sf).select("o_orderkey", casts.clean_number(F.col("price")).alias("price"))


def clean_integer(spark, sf):
    return _messy_numbers(spark, sf).select("o_orderkey", casts.clean_integer(F.col("price")).alias("price"))


def _answers(spark, sf):
    kind = F.col("event_type")
    answer = (
        F.when(kind == "click", "  OUI ").when(kind == "error", "Faux").when(kind == "purchase", "1")
        .when(kind == "signup", "peut-être").otherwise(F.lit(None).cast("string"))
    )
    return table(spark, sf, "events").select("event_id", answer.alias("answer"))


def to_bool_lenient(spark, sf):
    return _answers(spark, sf).select("event_id", casts.to_boolean_lenient(F.col("answer")).alias("flag"))


def to_bool_strict(spark, sf):
    return _answers(spark, sf).select("event_id", casts.to_boolean_strict(F.col("answer")).alias("flag"))


def _spelled_dates(spark, sf):
    day, month = F.dayofmonth("o_orderdate").cast("string"), F.element_at(F.lit(FRENCH), F.month("o_orderdate"))
    d = F.col("o_orderdate")
    spelled = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(d, "yyyy/MM/dd"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(d, "dd.MM.yyyy"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat_ws(" ", day, F.initcap(month), F.year(d).cast("string")))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format(d, " yyyy M d "))
        .otherwise("later")
    )
    return table(spark, sf, "orders").select("o_orderkey", spelled.alias("day"))


def to_date_multi(spark, sf):
    return _spelled_dates(spark, sf).select("o_orderkey", casts.to_date(F.col("day")).cast("string").alias("day"))


def _spelled_times(spark, sf):
    kind, ts = F.col("event_type"), F.col("ts")
    spelled = (
        F.when(kind == "click", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == "error", F.date_format(ts, "dd/MM/yyyy HH:mm:ss"))
        .when(kind == "purchase", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == "signup", F.date_format(ts, "yyyy/MM/dd HH:mm:ss.SSSSSS"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm"))
    )
    return table(spark, sf, "events").select("event_id", spelled.alias("moment"))


def to_ts_multi(spark, sf):
    moment = casts.to_timestamp(F.col("moment"))
    return _spelled_times(spark, sf).select("event_id", F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"))


def unix_ts(spark, sf):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    text = F.when(F.col("event_type") == "click", F.floor(millis / 1000)).otherwise(millis).cast("string")
    moment = casts.unix_to_timestamp(text)
    return table(spark, sf, "events").select("event_id", F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSS").alias("moment"))


def _as_text(spark, sf):
    """Orders as they would come from a text file."""
    orders = table(spark, sf, "orders")
    return orders.select(*[
        F.date_format(c, "dd/MM/yyyy").alias(c) if t == "timestamp_ntz"
        else F.format_string("%.2f", c).alias(c) if t == "double" else F.col(c).cast("string").alias(c)
        for c, t in orders.dtypes
    ])


def infer_cast(spark, sf):
    typed = inference.infer_and_cast(_as_text(spark, sf))
    return typed.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in typed.dtypes])


def _late(spark, sf):
    """Orders as text, with one odd cell per column in the row with the largest key."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    last = F.col("o_orderkey") == orders.agg(F.max("o_orderkey")).first()[0]
    return orders.select(
        F.col("o_orderkey"),
        F.when(last, "maybe").when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no").alias("answer"),
        F.when(last, "2001.75 kg").otherwise(F.col("o_custkey").cast("string")).alias("code"),
    )


def infer_late_word(spark, sf):
    return inference.infer_and_cast(_late(spark, sf).select("o_orderkey", "answer"))


def infer_late_fraction(spark, sf):
    return inference.infer_and_cast(_late(spark, sf).select("o_orderkey", "code"))


def suggested_types(spark, sf):
    text = _as_text(spark, sf)
    found = inference.suggested_overrides(text, inference.infer_and_cast(text))
    rows = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("rows"))
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("target")) for c, t in found.items()])
    return rows.select("rows", F.explode(listed).alias("s")).select("rows", "s.column", "s.target")


def schema_overrides(spark, sf):
    typed = inference.apply_overrides(_as_text(spark, sf), {
        "o_orderkey": "Int64", "o_totalprice": "Float64", "o_orderdate": "Date", "o_orderstatus": "Boolean", "absent": "Date",
    })
    return typed.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


def recast_report(spark, sf):
    messy = _messy_numbers(spark, sf).join(_spelled_dates(spark, sf), "o_orderkey")
    return inference.recast_report(messy, [("price", "Float64"), ("day", "Date"), ("day", "Datetime"), ("o_orderkey", "String"), ("none", "Date")])


def recast_rows(spark, sf):
    recast, _ = inference.recast(_messy_numbers(spark, sf), [("price", "Int64"), ("o_orderkey", "String")])
    return recast


def null_tokens(spark, sf):
    lang = F.col("lang")
    text = F.when(lang == "fr", "N/A").when(lang == "en", "").when(lang == "de", "None").otherwise(lang)
    rows = table(spark, sf, "documents").select("doc_id", text.alias("lang"), "source")
    return cleaning.null_tokens_to_null(rows)


def error_tokens(spark, sf):
    status = F.col("o_orderstatus")
    text = F.when(status == "F", "#DIV/0!").when(status == "O", "#N/A").otherwise(status)
    return cleaning.error_tokens_to_null(table(spark, sf, "orders").select("o_orderkey", text.alias("status")))


def flatten_nested(spark, sf):
    flat = cleaning.flatten_nested(table(spark, sf, "embeddings"))
    return flat.select("vec_id", F.json_array_length("embedding").cast("bigint").alias("dimensions"), "label")


def flatten_struct(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.struct("o_custkey", "o_orderstatus").alias("who"), F.array("o_orderkey", "o_custkey").alias("pair"))
    return cleaning.flatten_nested(rows)


def clean_names(spark, sf):
    raw = table(spark, sf, "nation").toDF("﻿n_key ", " n_key", "  ")
    return cleaning.clean_column_names(raw)


def header_fill(spark, sf):
    raw = table(spark, sf, "nation")
    return raw.toDF(*cleaning.clean_names(cleaning.fill_header(["nation", "Unnamed: 1", " "])))


def table_gaps(spark, sf):
    """Rows and cells per column behind the table check."""
    df = cleaning.validate_table(table(spark, sf, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW"))))
    counts = cleaning.null_counts(df)
    return small_table(spark, [(c, counts[""], counts[c]) for c in df.columns], "column string, rows bigint, cells bigint")


_CASES = "CASE event_type WHEN 'click' THEN true WHEN 'error' THEN false WHEN 'purchase' THEN true WHEN 'signup' THEN {other} END"
_DAY = "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END"
_ALL = "(SELECT count(*) FROM orders)"

QUERIES = {
    "clean_number": (clean_number, f"SELECT o_orderkey, CASE WHEN {_PRICE_KNOWN} THEN o_totalprice END AS price FROM orders"),
    "clean_integer": (clean_integer, f"SELECT o_orderkey, CASE WHEN {_PRICE_KNOWN} THEN CAST(trunc(o_totalprice) AS BIGINT) END AS price FROM orders"),
    "to_bool_lenient": (to_bool_lenient, "SELECT event_id, " + _CASES.format(other="false") + " AS flag FROM events"),
    "to_bool_strict": (to_bool_strict, "SELECT event_id, " + _CASES.format(other="NULL") + " AS flag FROM events"),
    "to_date_multi": (to_date_multi, f"SELECT o_orderkey, {_DAY} AS day FROM orders"),
    "to_ts_multi": (to_ts_multi, """
SELECT event_id, strftime(CASE WHEN event_type IN ('click','error','purchase') THEN date_trunc('second', ts)
  WHEN event_type = 'signup' THEN ts ELSE date_trunc('minute', ts) END, '%Y-%m-%d %H:%M:%S.%f') AS moment FROM events"""),
    "unix_ts": (unix_ts, """
SELECT event_id, strftime(CASE WHEN event_type = 'click' THEN date_trunc('second', ts) ELSE date_trunc('millisecond', ts) END,
  '%Y-%m-%d %H:%M:%S.%g') AS moment FROM events"""),
    "infer_cast": (infer_cast, "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, CAST(o_custkey AS {custkey}) AS o_custkey, CAST(o_orderkey AS BIGINT) AS o_orderkey) FROM orders".format(custkey="BIGINT")),
    "infer_late_word": (infer_late_word, "SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'maybe' WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS answer FROM orders"),
    "infer_late_fraction": (infer_late_fraction, "SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN '2001.75 kg' ELSE CAST(o_custkey AS VARCHAR) END AS code FROM orders"),
    "suggested_types": (suggested_types, union_all([
        f"SELECT {_ALL} AS rows, '{c}' AS \"column\", '{t}' AS target"
        for c, t in (("o_orderkey", "Int64"), ("o_custkey", "Int64"), ("o_totalprice", "Float64"), ("o_orderdate", "Date"))
    ])),
    "schema_overrides": (schema_overrides, "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, lower(o_orderstatus) IN ('1','true','vrai','oui','yes','y','t') AS o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"),
    "recast_report": (recast_report, f"""
WITH n AS (SELECT count(*) AS rows, count(*) FILTER (WHERE {_PRICE_KNOWN}) AS prices, count(*) FILTER (WHERE o_orderpriority <> '5-LOW') AS days FROM orders)
SELECT 'price' AS "column", 'Float64' AS target, rows, rows AS non_null_before, prices AS non_null_after, 'ok' AS status FROM n
UNION ALL SELECT 'day', 'Datetime', rows, rows, 0, 'rejected' FROM n
UNION ALL SELECT 'day', 'Date', rows, rows, days, 'ok' FROM n
UNION ALL SELECT 'o_orderkey', 'String', rows, rows, rows, 'ok' FROM n"""),
    "recast_rows": (recast_rows, f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN {_PRICE_KNOWN} THEN CAST(trunc(o_totalprice) AS BIGINT) END AS price FROM orders"),
    "null_tokens": (null_tokens, "SELECT doc_id, CASE WHEN lang IN ('fr','en','de') THEN NULL ELSE lang END AS lang, source FROM documents"),
    "error_tokens": (error_tokens, "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F','O') THEN NULL ELSE o_orderstatus END AS status FROM orders"),
    "flatten_nested": (flatten_nested, "SELECT vec_id, len(embedding) AS dimensions, label FROM embeddings"),
    "flatten_struct": (flatten_struct, """
SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS who, '[' || o_orderkey || ',' || o_custkey || ']' AS pair FROM orders"""),
    "clean_names": (clean_names, "SELECT n_nationkey AS n_key, n_name AS n_key_1, n_regionkey AS \"column\" FROM nation"),
    "header_fill": (header_fill, "SELECT n_nationkey AS nation, n_name AS nation_1, n_regionkey AS nation_2 FROM nation"),
    "table_gaps": (table_gaps, union_all([
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count({e}) AS cells FROM orders"
        for c, e in (("o_orderkey", "1"), ("o_custkey", "1"), ("o_orderstatus", "1"), ("o_totalprice", "1"), ("o_orderdate", "1"), ("o_orderpriority", "nullif(o_orderpriority, '5-LOW')"))
    ])),
}
