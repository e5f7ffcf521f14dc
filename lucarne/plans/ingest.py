"""Reading a table in the fixed order: read, names, checks, error texts, nested cells, types (CLN-8)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lucarne.operators import cleaning, inference
from lucarne.operators.filters import preview
from lucarne.operators.profile import column_catalogue
from lucarne.sources.tables import read_table, table_format


@dataclass
class Ingested:
    """A typed table and what the import dialogue shows about it."""

    table: DataFrame
    suggested_overrides: dict[str, str]
    header_warning: bool

    def catalogue(self) -> DataFrame:
        return column_catalogue(self.table)

    def preview(self) -> DataFrame:
        return preview(self.table)


def prepare(df: DataFrame, kind: str = "parquet", overrides: Mapping[str, str] | None = None) -> Ingested:
    """Clean and type a table that has been read already (steps two to six)."""
    df = cleaning.validate_table(cleaning.clean_column_names(df))
    if kind == "xlsx":
        df = cleaning.error_tokens_to_null(df)
    if kind == "parquet":
        df = cleaning.flatten_nested(df)
    typed = inference.infer_and_cast(df)
    suggested = inference.suggested_overrides(df, typed)
    return Ingested(inference.apply_overrides(typed, overrides), suggested, cleaning.first_row_looks_like_data(typed.columns))


def ingest(spark: SparkSession, path: str, format: str | None = None,
           overrides: Mapping[str, str] | None = None, **options) -> Ingested:
    """Read a file, folder or glob and make it ready for use."""
    kind = format or table_format(path)
    return prepare(read_table(spark, path, kind, **options), kind, overrides)
