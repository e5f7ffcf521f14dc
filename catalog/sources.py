"""Readers, detection, writers (SRC-*, SNK-*, CLN-8): tables written out and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import scratch, table
from lucarne.operators.filters import ordering
from lucarne.plans.ingest import ingest
from lucarne.session import stage
from lucarne.sources import detection, sinks, tables


def _lines(df, path, sep, encoding="UTF-8"):
    df.write.options(header=True, sep=sep, encoding=encoding).csv(path)
    return path


def _with_last(df, key):
    """``df`` with ``last``: whether a row has the largest key. That key is one row, so no task gets the whole table."""
    largest = df.agg(F.max(key).alias("largest"))
    return df.crossJoin(F.broadcast(largest)).withColumn("last", F.col(key) == F.col("largest")).drop("largest")


def csv_scan(spark, sf):
    return tables.read_table(spark, _lines(table(spark, sf, "part"), scratch(spark, ".csv"), ";"))


def csv_scan_quoted(spark, sf):
    """Cells that hold the separator, quotes and null tokens."""
    part = table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.col("p_name"), F.lit(', "'), F.col("p_brand"), F.lit('"')).alias("title"),
        F.when(F.col("p_size") > 25, "NA").otherwise(F.col("p_size").cast("string")).alias("size"),
    )
    path = scratch(spark, ".csv")
    sinks.write_csv(part, path)
    return tables.read_table(spark, path, separator=",")


def csv_two_headers(spark, sf):
    """Files with their columns in two orders, and one with a row longer than its header."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    path = scratch(spark)
    _lines(part.filter("p_partkey % 2 = 0"), f"{path}/even", ",")
    _lines(part.filter("p_partkey % 2 = 1").select("p_size", "p_partkey", "p_name"), f"{path}/odd", ",")
    spark.range(1).select(F.lit("p_partkey,p_name,p_size\n0,long,1,beyond")).write.text(f"{path}/long")
    read = tables.read_table(spark, f"{path}/*", format="csv", separator=",")
    (beyond,) = [c for c in read.columns if c not in part.columns]
    return read.select(*part.columns, F.col(beyond).alias("beyond"))


def csv_late_bad_cell(spark, sf):
    """Whole numbers but for one cell in the last row: the column stays text and loses nothing."""
    part = _with_last(table(spark, sf, "part"), "p_partkey").select(
        "p_partkey", F.when(F.col("last"), "12.5 EUR").otherwise(F.col("p_size").cast("string")).alias("size"),
    )
    return tables.read_table(spark, _lines(part.orderBy("p_partkey"), scratch(spark, ".csv"), ","), separator=",")


def csv_latin1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("café "), F.col("lang")).alias("thé"))
    return tables.read_table(spark, _lines(docs, scratch(spark, ".csv"), ",", "ISO-8859-1")).toDF("doc_id", "the")


def csv_large_ids(spark, sf):
    """Ids of 18 to 38 digits, and whole numbers of 18 digits but for one fraction: no two of them become one value."""
    key = F.col("o_orderkey").cast("string")
    ids = _with_last(table(spark, sf, "orders"), "o_orderkey").select(
        "o_orderkey",
        *[F.concat(F.lit(lead), F.lpad(key, digits - 1, "0")).alias(f"id{digits}") for digits, lead in ((18, "9"), (19, "9"), (20, "1"), (38, "7"))],
        F.concat(F.lit("3"), F.lpad(key, 17, "0"), F.when(F.col("last"), F.lit(".5")).otherwise("")).alias("mostly_whole"),
        F.concat(F.lit("0.1"), F.lpad(key, 20, "0"), F.lit("1")).alias("fine"),
    )
    read = tables.read_table(spark, _lines(ids, scratch(spark, ".csv"), ","), separator=",")
    types = dict(read.dtypes)
    return read.select(*[F.col(c).cast("string").alias(c) if t.startswith("decimal") else F.col(c) for c, t in types.items()], *[
        F.lit(types[c]).alias(f"type_{c}") for c in ("id18", "id19", "id20", "id38", "mostly_whole", "fine")
    ])


def csv_line_breaks(spark, sf):
    """Files with and without line breaks inside quotes, in one folder; inch marks inside cells open no quote."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    path = scratch(spark)
    inches = F.concat("p_name", F.lit(' 5" wide')).alias("p_name")
    plain = part.filter("p_partkey % 2 = 0").select("p_partkey", inches, "p_size")
    broken = part.filter("p_partkey % 2 = 1").select("p_partkey", F.concat(F.lit('"'), "p_name", F.lit('\nin ""two"" lines, really"')).alias("p_name"), "p_size")
    for name, df in (("plain", plain), ("broken", broken)):
        lines = df.select(F.concat_ws(",", *df.columns).alias("value"))
        header = spark.range(1).select(F.lit(",".join(df.columns)).alias("value"))
        header.unionByName(lines).coalesce(1).write.text(f"{path}/{name}")
    return tables.read_table(spark, f"{path}/*", format="csv", separator=",")


def detect_marks(spark, sf):
    """Files with and without a byte-order mark, in three encodings."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("é "), F.col("source")).alias("value"))
    found = []
    for name, encoding, mark in (("plain", "UTF-8", ""), ("marked", "UTF-8", "\ufeff"), ("wide", "UTF-16LE", "\ufeff"), ("wide_be", "UTF-16BE", "\ufeff")):
        path = scratch(spark)
        docs.select(F.concat(F.lit(mark), "value").alias("value")).write.options(encoding=encoding, quote="\0").csv(path)
        found.append(detection.detect_encoding(spark, path).select("encoding", "has_bom").distinct().withColumn("written", F.lit(name)))
    return found[0].union(found[1]).union(found[2]).union(found[3])


def tsv_scan(spark, sf):
    return tables.read_table(spark, _lines(table(spark, sf, "customer"), scratch(spark, ".tsv"), "\t"))


def json_lines_scan(spark, sf):
    path = scratch(spark, ".jsonl")
    table(spark, sf, "supplier").write.json(path)
    return tables.read_table(spark, path)


def json_array_scan(spark, sf):
    """One array document per nation, read as a folder."""
    suppliers = table(spark, sf, "supplier").withColumn("part", F.col("s_nationkey"))
    arrays = suppliers.groupBy("part").agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))).alias("value"))
    path = scratch(spark)
    arrays.repartition("part").write.partitionBy("part").text(path)
    return tables.read_table(spark, f"{path}/*", format="json").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


def parquet_scan(spark, sf):
    return tables.read_table(spark, f"{sf}/nation.parquet")


def parquet_positions(spark, sf):
    return tables.read_parquet_rows(spark, f"{sf}/orders.parquet").select("o_orderkey", "row_index")


def detect_sep(spark, sf):
    path = _lines(table(spark, sf, "customer"), scratch(spark, ".csv"), "|")
    return detection.separator_scores(spark.read.text(path)).select(
        F.when(F.col("separator") == "\t", "TAB").otherwise(F.col("separator")).alias("separator"), F.bround("score", 4).alias("score")
    )


def detect_encoding(spark, sf):
    """Files of accented text by encoding: how many of each kind are recognised as what."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("é "), F.col("source")).alias("value"))
    found = []
    for encoding in ("UTF-8", "ISO-8859-1"):
        path = scratch(spark)
        docs.write.options(encoding=encoding).csv(path)
        seen = detection.detect_encoding(spark, path).select("encoding", "has_bom").distinct()
        found.append(seen.withColumn("written", F.lit(encoding)))
    return found[0].unionByName(found[1])


def csv_export(spark, sf):
    path = scratch(spark, ".csv")
    sinks.export_csv(table(spark, sf, "orders").drop("o_orderdate"), path, {"o_orderstatus": "F"}, "urgent")
    return tables.read_table(spark, path)


def parquet_version(spark, sf):
    root = scratch(spark)
    first = sinks.save_version(table(spark, sf, "part"), root)
    second = sinks.save_version(spark.read.parquet(first).withColumn("p_size", F.col("p_size") + 1), root)
    return spark.read.parquet(second)


def staged(spark, sf):
    return stage(table(spark, sf, "customer").filter("c_acctbal > 0"))


def arrow_head(spark, sf):
    orders = table(spark, sf, "orders").orderBy(*ordering([], ["o_orderkey"]))
    return spark.createDataFrame(sinks.to_arrow(orders.select("o_orderkey", "o_totalprice", "o_orderpriority")))


def ingest_csv(spark, sf):
    """Read, names, checks, types in one go, from text files with dates spelled day first."""
    orders = table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "dd/MM/yyyy"))
    typed = ingest(spark, _lines(orders, scratch(spark, ".csv"), ","), overrides={"o_custkey": "String"}).table
    return typed.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


def header_warning(spark, sf):
    """Files whose first row may be data: with a header, without one but with words, and without either."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    files = {"named": (orders, True), "words": (orders, False), "numbers": (orders.drop("o_orderpriority"), False)}
    found = None
    for name, (rows, header) in files.items():
        path = scratch(spark, ".csv")
        rows.coalesce(1).write.options(header=header, sep=",").csv(path)
        got = ingest(spark, path, separator=",")
        one = got.table.agg(F.lit(name).alias("file"), F.lit(got.header_warning).alias("warning"), F.count(F.lit(1)).alias("rows"))
        found = one if found is None else found.union(one)
    return found


QUERIES = {
    "csv_scan": (csv_scan, "SELECT * REPLACE (CAST(p_size AS BIGINT) AS p_size) FROM part"),
    "csv_scan_quoted": (csv_scan_quoted, "SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS title, CASE WHEN p_size <= 25 THEN CAST(p_size AS BIGINT) END AS size FROM part"),
    "csv_two_headers": (csv_two_headers, "SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, NULL::VARCHAR AS beyond FROM part UNION ALL SELECT 0, 'long', 1, 'beyond'"),
    "csv_late_bad_cell": (csv_late_bad_cell, "SELECT p_partkey, CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part) THEN '12.5 EUR' ELSE CAST(p_size AS VARCHAR) END AS size FROM part"),
    "csv_latin1": (csv_latin1, "SELECT doc_id, 'café ' || lang AS the FROM documents"),
    "header_warning": (header_warning, """
        SELECT 'named' AS file, false AS warning, count(*) AS rows FROM orders UNION ALL SELECT 'words', false, count(*) - 1 FROM orders
        UNION ALL SELECT 'numbers', true, count(*) - 1 FROM orders"""),
    "csv_large_ids": (csv_large_ids, """
        SELECT o_orderkey, CAST('9' || lpad(CAST(o_orderkey AS VARCHAR), 17, '0') AS BIGINT) AS id18, CAST('9' || lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS BIGINT) AS id19,
               '1' || lpad(CAST(o_orderkey AS VARCHAR), 19, '0') AS id20, '7' || lpad(CAST(o_orderkey AS VARCHAR), 37, '0') AS id38,
               '3' || lpad(CAST(o_orderkey AS VARCHAR), 17, '0') || CASE WHEN o_orderkey = max(o_orderkey) OVER () THEN '.5' ELSE '.0' END AS mostly_whole,
               '0.1' || lpad(CAST(o_orderkey AS VARCHAR), 20, '0') || '1' AS fine,
               'bigint' AS type_id18, 'bigint' AS type_id19, 'decimal(20,0)' AS type_id20, 'decimal(38,0)' AS type_id38, 'decimal(19,1)' AS type_mostly_whole, 'decimal(22,22)' AS type_fine
        FROM orders"""),
    "csv_line_breaks": (csv_line_breaks, """
        SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' 5" wide' ELSE p_name || chr(10) || 'in "two" lines, really' END AS p_name, CAST(p_size AS BIGINT) AS p_size FROM part"""),
    "detect_marks": (detect_marks, """
        SELECT * FROM (VALUES ('UTF-8', false, 'plain'), ('UTF-8', true, 'marked'), ('UTF-16LE', true, 'wide'), ('UTF-16BE', true, 'wide_be')) v(encoding, has_bom, written)
        WHERE EXISTS (SELECT 1 FROM documents)"""),
    "tsv_scan": (tsv_scan, "SELECT * REPLACE (CAST(c_nationkey AS BIGINT) AS c_nationkey) FROM customer"),
    "json_lines_scan": (json_lines_scan, "SELECT * REPLACE (CAST(s_nationkey AS BIGINT) AS s_nationkey) FROM supplier"),
    "json_array_scan": (json_array_scan, "SELECT * REPLACE (CAST(s_nationkey AS BIGINT) AS s_nationkey) FROM supplier"),
    "parquet_scan": (parquet_scan, "SELECT * FROM nation"),
    "parquet_positions": (parquet_positions, "SELECT o_orderkey, o_orderkey - (SELECT min(o_orderkey) FROM orders) AS row_index FROM orders"),
    "detect_sep": (detect_sep, "SELECT unnest([',', ';', '|', 'TAB']) AS separator, unnest([0.0, 0.0, 4.0, 0.0]::DOUBLE[]) AS score FROM (SELECT count(*) FROM customer)"),
    "detect_encoding": (detect_encoding, "SELECT encoding, false AS has_bom, encoding AS written FROM (SELECT unnest(['UTF-8', 'ISO-8859-1']) AS encoding FROM (SELECT count(*) FROM documents))"),
    "csv_export": (csv_export, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'urgent')"),
    "parquet_version": (parquet_version, "SELECT * REPLACE (CAST(p_size + 1 AS INTEGER) AS p_size) FROM part"),
    "staged": (staged, "SELECT * FROM customer WHERE c_acctbal > 0"),
    "arrow_head": (arrow_head, "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 2000"),
    "ingest_csv": (ingest_csv, "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"),
}
