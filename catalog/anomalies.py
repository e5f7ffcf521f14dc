"""Outlier screens and detectors (ANO-1 to ANO-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import nearest_sql, table, union_all
from lucarne.operators.anomalies import detect_anomalies, iqr_screen, norms, robust_scaled
from lucarne.sources.sinks import anomaly_report

COLUMNS = ["value", "user_id"]


def _events(spark, sf):
    return table(spark, sf, "events")


def _gappy_events(spark, sf):
    value = F.when(F.col("event_type") != "click", F.col("value"))
    return _events(spark, sf).withColumn("value", value).withColumn("flat", F.lit(7.0))


def _told(found):
    """Flagged rows with their lists as text."""
    return found.select(
        "event_id", "severity", "severity_label", "score", "score_label",
        F.concat_ws(",", "contributing_columns").alias("contributing"),
    )


def screen(spark, sf):
    return iqr_screen(_events(spark, sf))


def zscore_rows(spark, sf):
    return _told(detect_anomalies(_events(spark, sf), "zscore", "standard", COLUMNS, ["event_id"]).ordered(["event_id"]))


def zscore_gaps(spark, sf):
    found = detect_anomalies(_gappy_events(spark, sf), "zscore", "strict", [*COLUMNS, "flat"], ["event_id"])
    return _told(found.anomalies)


def iqr_rows(spark, sf):
    return _told(detect_anomalies(_events(spark, sf), "iqr", "standard", COLUMNS, ["event_id"]).ordered(["event_id"]))


def iqr_gaps(spark, sf):
    return _told(detect_anomalies(_gappy_events(spark, sf), "iqr", "strict", [*COLUMNS, "flat"], ["event_id"]).anomalies)


def iqr_values(spark, sf):
    """The flagged rows' own values and the usual range of the leading column."""
    found = detect_anomalies(_events(spark, sf), "iqr", "loose", ["value"], ["event_id"]).anomalies
    norm = F.col("normal_ranges")["value"]
    return found.select(
        "event_id", "values.user_id", "values.event_type", "values.value",
        *[F.bround(norm[m], 6).alias(m) for m in ("median", "q1", "q3")],
    )


def anomaly_summary(spark, sf):
    found = detect_anomalies(_events(spark, sf), "iqr", "standard", COLUMNS, ["event_id"])
    return found.summary().withColumn("top_columns", F.concat_ws(",", "top_columns"))


def normal_ranges(spark, sf):
    found = detect_anomalies(_events(spark, sf), "iqr", "standard", COLUMNS).normal_ranges()
    return found.select("column", *[F.bround(m, 6).alias(m) for m in ("median", "q1", "q3")])


def contributing(spark, sf):
    """How often each column takes part, counted from the flagged rows."""
    found = detect_anomalies(_events(spark, sf), "zscore", "strict", ["value", "user_id", "event_id"], ["event_id"])
    return found.anomalies.select(F.explode("contributing_columns").alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("rows"))


def robust_scaling(spark, sf):
    events = _gappy_events(spark, sf)
    n, known = norms(events, ["value", "flat"])
    scaled = robust_scaled(events, ["value", "flat"], known, n)
    return events.select("event_id", *[F.bround(s, 6).alias(c) for s, c in zip(scaled, ("value", "flat"))])


def anomaly_csv_rows(spark, sf):
    return anomaly_report(detect_anomalies(_events(spark, sf), "iqr", "standard", ["value"], ["event_id"]).anomalies, ["event_id"])


FOREST_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
FOREST_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def iforest_rows(spark, sf):
    found = detect_anomalies(table(spark, sf, "lineitem"), "isolation_forest", "standard", FOREST_COLUMNS, FOREST_KEY)
    return found.anomalies.select(*FOREST_KEY, "severity", "score", F.concat_ws(",", "contributing_columns").alias("contributing"))


def iforest_summary(spark, sf):
    found = detect_anomalies(_events(spark, sf), "isolation_forest", "strict", COLUMNS, ["event_id"])
    return found.summary().select("method", "total_rows", "anomaly_count", "severity")


# --- SQL -----------------------------------------------------------------------------------------

_LABEL = """CASE WHEN {v} IS NULL OR {m} = 0 THEN 'Valeur atypique sur ' || {c}
  WHEN abs({v}/{m}) >= 2 THEN '×' || printf('%.1f', abs({v}/{m})) || ' la médiane'
  ELSE printf('%.0f', abs(({v}-{m})/{m})*100) || '% d''écart à la médiane' END"""
_SEVERITY = "CASE WHEN {s} >= 0.75 THEN 'high' WHEN {s} >= 0.45 THEN 'moderate' ELSE 'low' END"
_SEVERITY_LABEL = "CASE WHEN {s} >= 0.75 THEN 'Critique' WHEN {s} >= 0.45 THEN 'Modéré' ELSE 'Faible' END"
_GAPPY = "(SELECT * REPLACE (CASE WHEN event_type <> 'click' THEN value END AS value) FROM events)"


def _stats_sql(source: str) -> str:
    parts = []
    for c in COLUMNS:
        filled = f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {source}))"
        parts.append(
            f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) AS {c}_q3, "
            f"avg({filled}) AS {c}_a, stddev_pop({filled}) AS {c}_s"
        )
    return f"SELECT {', '.join(parts)} FROM {source}"


def _rows_sql(source: str, method: str, level: float, constant: bool = False) -> str:
    """Two analysed columns; a constant third one never outranks a column that has a score."""
    if method == "zscore":
        score = {c: f"abs((coalesce({c}, {c}_m) - {c}_a)/{c}_s)" for c in COLUMNS}
        hit, norm = f"worst > {level}", f"least(worst/{level * 2}, 1)"
    else:
        score = {c: f"abs(({c} - {c}_m)/({c}_q3 - {c}_q1))" for c in COLUMNS}
        hit = " OR ".join(f"coalesce({c} < {c}_q1 - {level}*({c}_q3-{c}_q1) OR {c} > {c}_q3 + {level}*({c}_q3-{c}_q1), false)" for c in COLUMNS)
        norm = f"least(worst/{level * 3}, 1)"
    # A constant column scores 0 by fences (it ranks before a null cell) and nothing by z-score.
    second = "'flat'" if constant and method == "iqr" else None
    lead = "CASE WHEN value_d IS NULL OR user_id_d >= value_d THEN 'user_id' ELSE 'value' END"
    other = "CASE WHEN value_d IS NULL OR user_id_d >= value_d THEN 'value' ELSE 'user_id' END"
    if second:
        other = f"CASE WHEN value_d IS NULL OR value_d = 0 OR user_id_d = 0 THEN 'flat' ELSE {other} END"
    v, m = "CASE WHEN lead = 'value' THEN value ELSE user_id END", "CASE WHEN lead = 'value' THEN value_m ELSE user_id_m END"
    return f"""
WITH s AS ({_stats_sql(source)}),
d AS (SELECT *, {', '.join(f'{e} AS {c}_d' for c, e in score.items())} FROM {source}, s),
w AS (SELECT *, greatest(value_d, user_id_d) AS worst, {lead} AS lead, {other} AS other FROM d),
x AS (SELECT *, {norm} AS sc, ({v}) AS v, ({m}) AS m FROM w WHERE {hit})
SELECT event_id, {_SEVERITY.format(s='sc')} AS severity, {_SEVERITY_LABEL.format(s='sc')} AS severity_label,
       round(sc, 4) AS score, {_LABEL.format(v='v', m='m', c='lead')} AS score_label, lead || ',' || other AS contributing FROM x"""


def _filled_sql(column: str) -> str:
    return f"SELECT event_id, coalesce({column}, (SELECT quantile_cont({column}, 0.5) FROM {_GAPPY})) AS x FROM {_GAPPY}"


_Z3 = {c: f"abs(({c} - (SELECT avg({c}) FROM events))/(SELECT stddev_pop({c}) FROM events))" for c in ("value", "user_id", "event_id")}

QUERIES = {
    "iqr_screen": (screen, f"""
WITH s AS (SELECT {nearest_sql('events', 'value', 0.25)} AS q1, {nearest_sql('events', 'value', 0.75)} AS q3),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE value < q1 - 1.5*(q3-q1) OR value > q3 + 1.5*(q3-q1)) AS k FROM events, s)
SELECT 'value' AS "column", 'continuous' AS type, k AS count, CAST(printf('%.1f', k*1.0/n*100) AS DOUBLE) AS pct,
       CASE WHEN k > 0.05*n THEN 'high' ELSE 'medium' END AS severity FROM c WHERE k > 0"""),
    "zscore_rows": (zscore_rows, _rows_sql("events", "zscore", 3.0)),
    "zscore_gaps": (zscore_gaps, _rows_sql(_GAPPY, "zscore", 2.5)),
    "iqr_rows": (iqr_rows, _rows_sql("events", "iqr", 2.0)),
    "iqr_gaps": (iqr_gaps, _rows_sql(_GAPPY, "iqr", 1.5, constant=True)),
    "iqr_values": (iqr_values, """
WITH s AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, user_id, event_type, value, round(m, 6) AS median, round(a, 6) AS q1, round(b, 6) AS q3
FROM events, s WHERE value < a - 3*(b-a) OR value > b + 3*(b-a)"""),
    "anomaly_summary": (anomaly_summary, f"""
WITH r AS ({_rows_sql('events', 'iqr', 2.0)}), n AS (SELECT count(*) AS n FROM events),
a AS (SELECT count(*) AS k, count(*) FILTER (WHERE severity='high') AS high, count(*) FILTER (WHERE severity='moderate') AS moderate,
  count(*) FILTER (WHERE severity='low') AS low FROM r)
SELECT 'iqr' AS method, 'IQR (Tukey)' AS method_label, n AS total_rows, k AS anomaly_count, round_even(k*1.0/n, 6) AS anomaly_rate,
  CASE WHEN k >= 0.05*n THEN 'high' WHEN k >= 0.01*n THEN 'moderate' ELSE 'low' END AS severity,
  CASE WHEN k >= 0.05*n THEN 'Élevé' WHEN k >= 0.01*n THEN 'Modéré' ELSE 'Faible' END AS severity_label,
  high, moderate, low, 'value,user_id' AS top_columns FROM a, n"""),
    "normal_ranges": (normal_ranges, union_all([
        f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.75), 6) AS q3 FROM events"
        for c in COLUMNS
    ])),
    "contributing": (contributing, f"""
WITH d AS (SELECT {', '.join(f'{e} AS {c}_d' for c, e in _Z3.items())} FROM events),
f AS (SELECT *, least(value_d, user_id_d, event_id_d) AS lowest FROM d WHERE greatest(value_d, user_id_d, event_id_d) > 2.5)
SELECT * FROM (""" + union_all([f"SELECT '{c}' AS \"column\", count(*) AS rows FROM f WHERE {c}_d > lowest" for c in _Z3]) + ") WHERE rows > 0"),
    "robust_scaling": (robust_scaling, f"""
WITH f AS ({_filled_sql('value')}), s AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS b FROM f)
SELECT event_id, round((x - m)/(b - a), 6) AS value, CAST(0 AS DOUBLE) AS flat FROM f, s"""),
    "anomaly_csv_rows": (anomaly_csv_rows, """
WITH s AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events),
x AS (SELECT event_id, value AS v, m, least(abs((value-m)/(b-a))/6, 1) AS sc FROM events, s WHERE value < a - 2*(b-a) OR value > b + 2*(b-a))
SELECT event_id, """ + _SEVERITY_LABEL.format(s="sc") + " AS severity, round(sc, 4) AS score, 'value' AS columns, "
        + _LABEL.format(v="v", m="m", c="'value'") + " AS deviation FROM x"),
    "iforest_rows": (iforest_rows, None),
    "iforest_summary": (iforest_summary, None),
}
