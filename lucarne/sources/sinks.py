"""Writers and exports (SNK-1 to SNK-7)."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucarne.functions.vocabulary import PREVIEW_ROWS
from lucarne.operators.cleaning import cell, flatten_nested
from lucarne.operators.filters import apply_filters, search


def write_csv(df: DataFrame, path: str, quote_all: bool = False, mode: str = "errorifexists") -> None:
    """CSV part files with a header each (SNK-1); nested columns as JSON text."""
    flatten_nested(df).write.options(header=True, quoteAll=quote_all, escape='"', emptyValue="").mode(mode).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet part files (SNK-2)."""
    df.write.mode(mode).parquet(path)


def save_version(df: DataFrame, root: str, format: str = "parquet") -> str:
    """Write the table to a new path below ``root`` and return it (SNK-3).

    A table is never written over the files it is being read from; the caller switches to the
    returned path once this has come back.
    """
    moment = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S")
    path = f"{root.rstrip('/')}/{moment}-{uuid.uuid4().hex[:8]}.{format}"
    {"parquet": write_parquet, "csv": write_csv}[format](df, path)
    return path


def to_arrow(df: DataFrame, rows: int = PREVIEW_ROWS) -> pa.Table:
    """The first rows as an Arrow table (SNK-4)."""
    return df.limit(rows).toArrow()


def export_csv(df: DataFrame, path: str, filters: Mapping[str, Any] | None = None, text: str = "") -> None:
    """All rows that pass the filters and the search, every field quoted (SNK-5)."""
    write_csv(search(apply_filters(df, filters), text), path, quote_all=True)


def anomaly_report(anomalies: DataFrame, key: Sequence[str]) -> DataFrame:
    """One line per flagged row: key, severity, score, columns involved, deviation (SNK-6)."""
    return anomalies.select(
        *[cell(k) for k in key],
        F.col("severity_label").alias("severity"),
        "score",
        F.concat_ws("; ", "contributing_columns").alias("columns"),
        F.col("score_label").alias("deviation"),
    )


def export_anomalies(anomalies: DataFrame, path: str, key: Sequence[str]) -> None:
    """The anomaly report as CSV (SNK-6)."""
    write_csv(anomaly_report(anomalies, key), path)
