"""Table access and SQL pieces shared by the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lucarne.session import staging_root, use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, ending: str = "") -> str:
    """A new path in the shared folder for a query that writes and reads back."""
    return f"{staging_root(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}{ending}"


def nearest_sql(source: str, column: str, q: float) -> str:
    """Element floor((n-1)q + 0.5) of the sorted column, by plain ranking."""
    return (
        f"(SELECT v FROM (SELECT CAST({column} AS DOUBLE) AS v, row_number() OVER (ORDER BY {column}) - 1 AS rn, "
        f"count(*) OVER () AS n FROM {source} WHERE {column} IS NOT NULL) "
        f"WHERE rn = CAST(floor((n - 1) * {q} + 0.5) AS BIGINT))"
    )


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
