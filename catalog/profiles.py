"""Column statistics and table quality (PRF-1 to PRF-14, QNT-1, QNT-2, TYP-2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.common import nearest_sql, table, union_all
from lucarne.functions.vocabulary import FALSE_MARKERS, ID_WORDS, MEASURE_WORDS, TRUE_MARKERS
from lucarne.operators import inference, profile
from lucarne.operators.quantiles import LINEAR, NEAREST, approximate_quantiles, column_quantiles, typed_quantiles
from lucarne.session import small_table

# Columns of the given tables and their types.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _columns(name: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ")) for part in SCHEMAS[name].split(",")]


# Orders with gaps: the given tables have no nulls, so null paths need made-up ones.
GAPS = {
    "o_orderpriority": ("nullif(o_orderpriority, '5-LOW')", lambda: F.nullif("o_orderpriority", F.lit("5-LOW"))),
    "o_totalprice": (
        "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END",
        lambda: F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")),
    ),
}
GAPPY_SQL = "(SELECT * REPLACE (" + ", ".join(f"{sql} AS {c}" for c, (sql, _) in GAPS.items()) + ") FROM orders)"


def gappy_orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").withColumns({c: made() for c, (_, made) in GAPS.items()})


# --- queries ---------------------------------------------------------------------------------


def col_base_stats(spark, sf):
    return profile.base_stats(gappy_orders(spark, sf)).drop("ordinal")


def value_counts(spark, sf):
    return profile.value_counts(gappy_orders(spark, sf), ["o_orderstatus", "o_orderpriority", "o_custkey"])


def numeric_stats(spark, sf):
    stats = profile.numeric_stats(table(spark, sf, "lineitem"), NUMBERS)
    return stats.select("column", "n", *[F.bround(c, 6).alias(c) for c in MEASURES])


def numeric_stats_gaps(spark, sf):
    stats = profile.numeric_stats(gappy_orders(spark, sf), ["o_totalprice"])
    return stats.select("column", "n", *[F.bround(c, 6).alias(c) for c in MEASURES])


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MEASURES = ["min", "max", "mean", "std", "median", "q1", "q3", "mode"]


def num_hist(spark, sf):
    return profile.numeric_histogram(table(spark, sf, "lineitem"), NUMBERS)


def num_hist_gaps(spark, sf):
    return profile.numeric_histogram(gappy_orders(spark, sf), ["o_totalprice"])


def temporal_stats(spark, sf):
    return profile.temporal_stats(table(spark, sf, "events")).unionByName(profile.temporal_stats(table(spark, sf, "orders")))


def temporal_hist(spark, sf):
    return profile.temporal_histogram(table(spark, sf, "events")).unionByName(
        profile.temporal_histogram(table(spark, sf, "orders"))
    )


TOP = ["p_name", "p_brand", "p_type"]


def cat_top10(spark, sf):
    return profile.frequent_values(table(spark, sf, "part"), TOP)


def frequent_texts(spark, sf):
    """The ten most frequent keys, words and whole texts of documents: many values, one of them a third of all, long ones."""
    docs = table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.floor(F.sqrt(F.col("doc_id") * 100)).cast("string"))).alias("skewed"),
        F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("unique"), "text", "lang",
    )
    found = profile.frequent_values(docs, docs.columns)
    return found.select("column", "rank", F.sha2("value", 256).alias("value_sha256"), "count", "pct")


def cat_modes(spark, sf):
    return profile.modes(profile.value_counts(gappy_orders(spark, sf), ["o_orderstatus", "o_orderpriority"]))


def bool_stats(spark, sf):
    return profile.boolean_stats(table(spark, sf, "labels"), ["quality", "toxic"])


def id_stats(spark, sf):
    return profile.identifier_stats(table(spark, sf, "customer"), ["c_custkey", "c_name"])


def insights(spark, sf):
    parts = []
    for df, columns in ((table(spark, sf, "events"), ["value", "user_id"]), (gappy_orders(spark, sf), ["o_totalprice"])):
        stats = profile.numeric_stats(df, columns, with_mode=False).join(profile.base_counts(df).select("column", "null_pct"), "column")
        parts.append(profile.insights(stats))
    both = reduce(DataFrame.unionByName, parts)
    return both.select("column", F.concat_ws(",", "insights").alias("insights"))


def summary(spark, sf):
    return profile.dataset_summary(gappy_orders(spark, sf)).withColumn("col_warnings", F.concat_ws(",", "col_warnings"))


def kpi_buckets(spark, sf):
    return profile.kpi_buckets(profile.dataset_summary(gappy_orders(spark, sf)))


def catalogue(spark, sf):
    return _all_tables(spark, sf, lambda df: profile.column_catalogue(df).drop("ordinal"))


def classify_columns(spark, sf):
    return _all_tables(spark, sf, lambda df: inference.semantic_types(df).select("column", "dtype", "semantic_type"))


def _all_tables(spark, sf, of):
    return reduce(DataFrame.unionByName, [of(table(spark, sf, t)).withColumn("table_name", F.lit(t)) for t in SCHEMAS])


def type_advice(spark, sf):
    advice = profile.type_advice_profile(gappy_orders(spark, sf))
    return advice.select("column", "dtype", "null_count", "unique_count", "min", "max", F.bround("mean", 4).alias("mean"))


def _quantiles(spark, sf, kind):
    found = column_quantiles(table(spark, sf, "lineitem"), NUMBERS + ["l_orderkey"], PROBS, kind)
    rows = [(c, n, *values) for c, (n, values) in found.items()]
    return small_table(spark, rows, "column string, n bigint, " + ", ".join(f"q{int(q * 100)} double" for q in PROBS))


PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]


def quantile_nearest(spark, sf):
    return _quantiles(spark, sf, NEAREST)


def quantile_linear(spark, sf):
    return _quantiles(spark, sf, LINEAR).select("column", "n", *[F.bround(f"q{int(q * 100)}", 6).alias(f"q{int(q * 100)}") for q in PROBS])


def quantile_typed(spark, sf):
    """Quantiles of keys near 2^60, days and prices as decimals, each in its own type."""
    df = table(spark, sf, "orders").select(
        (F.col("o_orderkey") * 7 + 2**60).alias("key"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderdate").alias("moment"),
        F.col("o_totalprice").cast("decimal(15,2)").alias("price"),
    )
    rows = [(c, n, *map(str, values)) for c, (n, values) in typed_quantiles(df, df.columns, PROBS).items()]
    return small_table(spark, rows, "column string, n bigint, " + ", ".join(f"q{int(q * 100)} string" for q in PROBS))


def quantile_approx(spark, sf):
    """Whether the sketch's quantiles lie within its stated error, by ranks counted in the table."""
    items = table(spark, sf, "lineitem")
    names = ["l_orderkey", "l_extendedprice", "l_shipdate"]
    found, error = approximate_quantiles(items, names, PROBS)
    checks = []
    for c in names:
        n, values = found[c]
        for q, v in zip(PROBS, values, strict=True):
            below, upto = F.count_if(F.col(c) < F.lit(v)), F.count_if(F.col(c) <= F.lit(v))
            checks.append(F.struct(F.lit(c).alias("column"), F.lit(n).cast("bigint").alias("n"), F.lit(q).alias("q"), ((below <= (q + error) * n) & (upto >= (q - error) * n)).alias("within")))
    return items.agg(F.array(*checks).alias("c")).selectExpr("inline(c)")


# --- SQL ---------------------------------------------------------------------------------------


def _words(words: list[str], name: str) -> bool:
    return any(w in name for w in words)


def type_sql(name: str, dtype: str) -> str:
    """The type tree for one column over the facts ``n, k, d, yes, no`` (rows, cells, distinct, markers)."""
    if dtype == "timestamp_ntz":
        return "CASE WHEN n = 0 THEN 'numeric' WHEN k = 0 THEN 'categorical' ELSE 'datetime' END"
    measure, identity = _words(MEASURE_WORDS, name), _words(ID_WORDS, name)
    steps = ["WHEN n = 0 THEN 'numeric'", "WHEN k = 0 THEN 'categorical'", "WHEN d = 2 AND yes AND no THEN 'boolean'"]
    if not measure and not identity:
        steps.append("WHEN d <= 30 THEN 'categorical'")
    if dtype == "string":
        if measure:
            steps.append("WHEN digit THEN 'numeric'")
        if identity:
            steps.append("WHEN digits THEN 'discrete'")
        steps.append("WHEN d > 0.95 * k THEN 'identifier' ELSE 'categorical'")
    elif dtype == "double":
        steps.append("ELSE 'continuous'")
    else:
        if identity:
            steps.append("WHEN d > 0.95 * k THEN 'identifier'")
        steps.append("ELSE 'discrete'")
    return "CASE " + " ".join(steps) + " END"


def facts_sql(source: str, name: str, dtype: str) -> str:
    text = f"lower(CAST({name} AS VARCHAR))"
    yes, no = (", ".join(f"'{m}'" for m in ms) for ms in (TRUE_MARKERS, FALSE_MARKERS))
    look = ""
    if dtype == "string":
        look = f", coalesce(bool_or(regexp_matches({name}, '[0-9]')), false) AS digit, coalesce(bool_and(regexp_full_match({name}, '[0-9]+')), false) AS digits"
    return (
        f"SELECT '{name}' AS \"column\", '{dtype}' AS dtype, count(*) AS n, count({name}) AS k, count(DISTINCT {name}) AS d, "
        f"coalesce(bool_or({text} IN ({yes})), false) AS yes, coalesce(bool_or({text} IN ({no})), false) AS no{look} FROM {source}"
    )


def typed_sql(select: str, names: list[str], extra: str = "") -> str:
    return union_all([
        f"SELECT {select.format(kind=type_sql(c, t), table=name)} FROM ({facts_sql(name, c, t)}){extra}"
        for name in names for c, t in _columns(name)
    ])


def _numeric_sql(source: str, column: str, name: str | None = None) -> str:
    mode = f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    return (
        f"SELECT '{column}' AS \"column\", count({column}) AS n, round(min({column}),6) AS min, round(max({column}),6) AS max, "
        f"round(avg({column}),6) AS mean, round(stddev_samp({column}),6) AS std, round(quantile_cont({column}, 0.5),6) AS median, "
        f"round({nearest_sql(source, column, 0.25)},6) AS q1, round({nearest_sql(source, column, 0.75)},6) AS q3, "
        f"CAST({mode} AS DOUBLE) AS mode FROM {source}"
    )


def _hist_sql(source: str, column: str) -> str:
    return f"""
SELECT '{column}' AS "column", CAST(g.b AS INTEGER) AS bin,
       printf('%.1f-%.1f', lo + g.b*step, lo + (g.b+1)*step) AS label,
       coalesce(c.n, 0) AS count, CAST(printf('%.1f', coalesce(c.n, 0)*1.0/k*100) AS DOUBLE) AS pct
FROM (SELECT unnest(range(20)) AS b) g
CROSS JOIN (SELECT min({column}) AS lo, (max({column})-min({column}))/20 AS step, count({column}) AS k FROM {source}) s
LEFT JOIN (
  SELECT least(floor(({column} - lo)/step), 19) AS bin, count(*) AS n
  FROM {source}, (SELECT min({column}) AS lo, (max({column})-min({column}))/20 AS step FROM {source})
  WHERE {column} IS NOT NULL GROUP BY 1) c ON c.bin = g.b"""


def _time_hist_sql(source: str, column: str) -> str:
    bounds = f"SELECT min(epoch_ms({column})) AS lo, (max(epoch_ms({column}))-min(epoch_ms({column}))) // 20 AS step, count({column}) AS k FROM {source}"
    return f"""
SELECT '{column}' AS "column", CAST(g.b AS INTEGER) AS bin,
       strftime(make_timestamp_ms(lo + g.b*step), '%Y-%m-%d %H:%M') AS label,
       coalesce(c.n, 0) AS count, CAST(printf('%.1f', coalesce(c.n, 0)*1.0/k*100) AS DOUBLE) AS pct
FROM (SELECT unnest(range(20)) AS b) g CROSS JOIN ({bounds}) s
LEFT JOIN (
  SELECT least((epoch_ms({column}) - lo) // step, 19) AS bin, count(*) AS n FROM {source}, ({bounds}) GROUP BY 1
) c ON c.bin = g.b"""


def _time_sql(source: str, column: str) -> str:
    return f"""
SELECT '{column}' AS "column", CAST(lo AS VARCHAR) AS min, CAST(hi AS VARCHAR) AS max,
       CASE WHEN us // 86400000000 > 0 THEN (us // 86400000000) || CASE WHEN us // 86400000000 = 1 THEN ' day, ' ELSE ' days, ' END ELSE '' END
       || ((us // 3600000000) % 24) || ':' || lpad(CAST((us // 60000000) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((us // 1000000) % 60 AS VARCHAR), 2, '0')
       || CASE WHEN us % 1000000 > 0 THEN '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') ELSE '' END AS duration
FROM (SELECT min({column}) AS lo, max({column}) AS hi, epoch_us(max({column})) - epoch_us(min({column})) AS us FROM {source})"""


def _insight_sql(source: str, column: str) -> str:
    return f"""
SELECT '{column}' AS "column", coalesce(nullif(concat_ws(',',
    CASE WHEN p > 20 THEN 'many_nulls' WHEN p > 5 THEN 'some_nulls' END,
    CASE WHEN sd > 0.5*m THEN 'wide_spread' END,
    CASE WHEN q3 - q1 < 0.3*sd THEN 'skewed' END), ''), 'standard') AS insights
FROM (SELECT CAST(printf('%.1f', (count(*) - count({column}))*1.0/count(*)*100) AS DOUBLE) AS p, avg({column}) AS m, stddev_samp({column}) AS sd,
      {nearest_sql(source, column, 0.25)} AS q1, {nearest_sql(source, column, 0.75)} AS q3 FROM {source})"""


def _gappy_types() -> str:
    return union_all([
        f"SELECT \"column\", dtype, n, k, d, {type_sql(c, t)} AS kind FROM ({facts_sql(GAPPY_SQL, c, t)})" for c, t in _columns("orders")
    ])


_SUMMARY = f"""
WITH t AS ({_gappy_types()}),
s AS (SELECT max(n) AS row_count, count(*) AS col_count, CAST(printf('%.1f', sum(n-k)*1.0/sum(n)*100) AS DOUBLE) AS null_rate,
  count(*) FILTER (WHERE kind IN ('continuous','discrete')) AS numeric_count,
  count(*) FILTER (WHERE kind = 'categorical') AS categorical_count,
  count(*) FILTER (WHERE kind = 'datetime') AS datetime_count, count(*) FILTER (WHERE kind = 'date') AS date_count,
  count(*) FILTER (WHERE kind = 'boolean') AS boolean_count, count(*) FILTER (WHERE kind = 'identifier') AS identifier_count,
  count(*) FILTER (WHERE (n-k) > 0.1*n) AS warned,
  string_agg(CASE WHEN (n-k) > 0.1*n THEN "column" END, ',' ORDER BY "column" DESC) AS col_warnings FROM t)"""

QUERIES = {
    "col_base_stats": (col_base_stats, f"""
WITH t AS ({_gappy_types()})
SELECT "column", dtype, n AS count, n - k AS nulls, CAST(printf('%.1f', (n-k)*1.0/n*100) AS DOUBLE) AS null_pct, d AS uniques,
       kind AS semantic_type, kind = 'identifier' AS is_identifier FROM t"""),
    "value_counts": (value_counts, union_all([
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {GAPPY_SQL} WHERE {c} IS NOT NULL GROUP BY 2"
        for c in ("o_orderstatus", "o_orderpriority", "o_custkey")
    ])),
    "numeric_stats": (numeric_stats, union_all([_numeric_sql("lineitem", c) for c in NUMBERS])),
    "numeric_stats_gaps": (numeric_stats_gaps, _numeric_sql(GAPPY_SQL, "o_totalprice")),
    "num_hist": (num_hist, union_all([_hist_sql("lineitem", c) for c in NUMBERS])),
    "num_hist_gaps": (num_hist_gaps, _hist_sql(GAPPY_SQL, "o_totalprice")),
    "temporal_stats": (temporal_stats, union_all([_time_sql("events", "ts"), _time_sql("orders", "o_orderdate")])),
    "temporal_hist": (temporal_hist, union_all([_time_hist_sql("events", "ts"), _time_hist_sql("orders", "o_orderdate")])),
    "cat_top10": (cat_top10, union_all([f"""
SELECT '{c}' AS "column", CAST(rank AS INTEGER) AS rank, value, count, CAST(printf('%.1f', count*1.0/total*100) AS DOUBLE) AS pct FROM (
  SELECT {c} AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank,
         sum(count(*)) OVER () AS total FROM part GROUP BY 1) WHERE rank <= 10""" for c in TOP])),
    "frequent_texts": (frequent_texts, union_all([f"""
SELECT '{c}' AS "column", CAST(rank AS INTEGER) AS rank, sha256(value) AS value_sha256, count, CAST(printf('%.1f', count*1.0/total*100) AS DOUBLE) AS pct FROM (
  SELECT value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, value) AS rank, sum(count(*)) OVER () AS total
  FROM (SELECT {sql} AS value FROM documents) WHERE value IS NOT NULL GROUP BY 1) WHERE rank <= 10""" for c, sql in (
        ("skewed", "CASE WHEN doc_id % 3 = 0 THEN 'hot' ELSE 'k' || CAST(CAST(floor(sqrt(doc_id * 100)) AS BIGINT) AS VARCHAR) END"),
        ("unique", "'u' || CAST(doc_id AS VARCHAR)"), ("text", "text"), ("lang", "lang"))])),
    "cat_modes": (cat_modes, union_all([
        f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS mode FROM {GAPPY_SQL} WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY count(*) DESC, 2 LIMIT 1)"
        for c in ("o_orderstatus", "o_orderpriority")
    ])),
    "bool_stats": (bool_stats, union_all([
        f"""SELECT '{c}' AS "column", '1' AS label_true, '0' AS label_false, count(*) FILTER (WHERE {c}=1) AS true_count,
count(*) FILTER (WHERE {c}=0) AS false_count, CAST(printf('%.1f', count(*) FILTER (WHERE {c}=1)*1.0/count(*)*100) AS DOUBLE) AS true_pct,
CAST(printf('%.1f', count(*) FILTER (WHERE {c}=0)*1.0/count(*)*100) AS DOUBLE) AS false_pct FROM labels""" for c in ("quality", "toxic")
    ])),
    "id_stats": (id_stats, union_all([
        f"SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM customer" for c in ("c_custkey", "c_name")
    ])),
    "insights": (insights, union_all([
        _insight_sql("events", "value"), _insight_sql("events", "user_id"), _insight_sql(GAPPY_SQL, "o_totalprice")
    ])),
    "summary": (summary, _SUMMARY + """
SELECT row_count, CAST(col_count AS INTEGER) AS col_count, null_rate,
  CAST(numeric_count AS INTEGER) AS numeric_count, CAST(categorical_count AS INTEGER) AS categorical_count,
  CAST(datetime_count AS INTEGER) AS datetime_count, CAST(date_count AS INTEGER) AS date_count,
  CAST(boolean_count AS INTEGER) AS boolean_count, CAST(identifier_count AS INTEGER) AS identifier_count, col_warnings,
  CAST(greatest(0, round_even(100 - null_rate - 2*warned, 0)) AS INTEGER) AS quality_score FROM s"""),
    "kpi_buckets": (kpi_buckets, _SUMMARY + """
SELECT null_rate, CASE WHEN null_rate < 5 THEN 'excellent' WHEN null_rate < 15 THEN 'acceptable' ELSE 'poor' END AS null_rate_level,
  quality_score, CASE WHEN quality_score >= 80 THEN 'good' WHEN quality_score >= 60 THEN 'fair' ELSE 'poor' END AS quality_level
FROM (SELECT null_rate, CAST(greatest(0, round_even(100 - null_rate - 2*warned, 0)) AS INTEGER) AS quality_score FROM s)"""),
    "catalogue": (catalogue, "SELECT *, semantic_type IN ('continuous','discrete','numeric') AS is_numeric, semantic_type = 'identifier' AS is_identifier FROM ("
                  + typed_sql("\"column\", dtype, {kind} AS semantic_type, n AS row_count, '{table}' AS table_name", list(SCHEMAS)) + ")"),
    "classify_columns": (classify_columns, typed_sql("\"column\", dtype, {kind} AS semantic_type, '{table}' AS table_name", list(SCHEMAS))),
    "type_advice": (type_advice, union_all([
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, "
        + (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean" if t in ("bigint", "int", "double")
           else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean")
        + f" FROM {GAPPY_SQL}" for c, t in _columns("orders")
    ])),
    "quantile_nearest": (quantile_nearest, union_all([
        f"SELECT '{c}' AS \"column\", (SELECT count({c}) FROM lineitem) AS n, " + ", ".join(f"{nearest_sql('lineitem', c, q)} AS q{int(q * 100)}" for q in PROBS)
        for c in NUMBERS + ["l_orderkey"]
    ])),
    "quantile_typed": (quantile_typed, union_all([
        f"SELECT '{name}' AS \"column\", count(*) AS n, " + ", ".join(
            f"(SELECT CAST(v AS VARCHAR) FROM (SELECT {sql} AS v, row_number() OVER (ORDER BY {sql}) - 1 AS rn, count(*) OVER () AS n FROM orders) WHERE rn = CAST(floor((n - 1) * {q} + 0.5) AS BIGINT)) AS q{int(q * 100)}"
            for q in PROBS) + " FROM orders"
        for name, sql in (("key", "o_orderkey * 7 + 1152921504606846976"), ("day", "CAST(o_orderdate AS DATE)"), ("moment", "o_orderdate"), ("price", "CAST(o_totalprice AS DECIMAL(15,2))"))
    ])),
    "quantile_approx": (quantile_approx, f"""
        SELECT c AS "column", (SELECT count(*) FROM lineitem) AS n, CAST(q AS DOUBLE) AS q, true AS within
        FROM (SELECT unnest(['l_orderkey', 'l_extendedprice', 'l_shipdate']) AS c), (SELECT unnest({PROBS}) AS q)"""),
    "quantile_linear": (quantile_linear, union_all([
        f"SELECT '{c}' AS \"column\", count({c}) AS n, " + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {q}), 6) AS q{int(q * 100)}" for q in PROBS) + " FROM lineitem"
        for c in NUMBERS + ["l_orderkey"]
    ])),
}
