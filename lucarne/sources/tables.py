"""Table readers by format (SRC-1 to SRC-6)."""

from __future__ import annotations

import csv
import io
import os
import sys
from collections.abc import Iterator
from functools import partial, reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucarne.operators.cleaning import TableError, cell, clean_names, null_tokens_to_null
from lucarne.operators.inference import infer_delimited
from lucarne.sources.detection import CP1252, LATIN1, UTF16_BE, UTF16_LE, detect_separator, files_by_kind, from_cp1252
from lucarne.sources.workbook import read_sheet

FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "ndjson", ".ndjson": "ndjson",
           ".xlsx": "xlsx", ".parquet": "parquet"}

#: Column for records whose cells are fewer or more than the schema's.
RAW = "_raw_record"


class UnsupportedFormat(ValueError):
    """The file name has none of the known endings."""


class JsonStructureError(ValueError):
    """The JSON is not a list of flat objects."""


def table_format(path: str) -> str:
    """The format a file name stands for; anything unknown is refused (SRC-1)."""
    ending = os.path.splitext(path.rstrip("/*"))[1].lower()
    if ending not in FORMATS:
        raise UnsupportedFormat(f"cannot read {ending or 'a path without an ending'}: pass format=... or use {sorted(FORMATS)}")
    return FORMATS[ending]


def read_table(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Read a file, a folder or a glob (SRC-1). Options go to the reader of that format."""
    kind = format or table_format(path)
    if kind in ("csv", "tsv"):
        if kind == "tsv":
            options.setdefault("separator", "\t")
        return read_delimited(spark, path, **options)
    if kind in ("json", "ndjson"):
        return read_json(spark, path, lines=kind == "ndjson", **options)
    if kind == "xlsx":
        return infer_delimited(null_tokens_to_null(read_sheet(spark, path, **options)))
    if kind == "parquet":
        return spark.read.parquet(path)
    raise UnsupportedFormat(f"unknown format {kind!r}")


def read_delimited(
    spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None,
    infer: bool = True, multi_line: bool | None = None, on_bad_cell: str = "text",
) -> DataFrame:
    """CSV or TSV with a header line in every file (SRC-2, SRC-3).

    Files are read under their own header, names cleaned, and put together by name; a column that a file does not have is null
    there. Cells beyond the header's length get columns of their own, named like columns without a name.
    Files with line breaks inside quotes are found in the scan for encodings and read whole records at a time, which makes them
    unsplittable; all others split. ``multi_line`` says so for all files, and with ``encoding`` spares the scan.
    """
    if not spark.read.text(path).take(1):
        raise TableError("the file is empty")
    separator = separator or detect_separator(spark, path)
    if encoding and multi_line is not None:
        groups = {(encoding, multi_line): None}
    else:
        groups = files_by_kind(spark, path, separator)
    parts = []
    for (kind, broken), files in groups.items():
        kind, broken = encoding or kind, broken if multi_line is None else multi_line
        windows = kind.lower() == CP1252
        options = {"sep": separator, "encoding": LATIN1 if windows else kind, "multiLine": broken, "quote": '"', "escape": '"'}
        if kind in (UTF16_LE, UTF16_BE):
            options["lineSep"] = "\n"    # the line break is two bytes in these encodings
        for header, source, widest in _files_by_header(spark, files or path, options, windows):
            width = _width(spark, source, options, len(header)) if widest > len(header) else len(header)
            names = clean_names([*header, *[""] * (width - len(header))])
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
            part = spark.read.schema(schema).options(header=True, enforceSchema=True, mode="PERMISSIVE", **options).csv(source)
            parts.append(part.select(*[from_cp1252(cell(n)).alias(n) for n in names]) if windows else part)
    df = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), parts)
    if any(kind in (UTF16_LE, UTF16_BE) for kind, _ in groups):
        df = df.select(*[F.regexp_replace(cell(n), r"\r$", "").alias(n) for n in df.columns])
    df = null_tokens_to_null(df)
    return infer_delimited(df, on_bad_cell) if infer else df


def _files_by_header(spark: SparkSession, source: str | list[str], options: dict, windows: bool) -> list[tuple[list[str], str | list[str], int]]:
    """Headers with their files, in the order of paths, and a bound on the cells of a row; one scan, one row per file to the driver."""
    # All but rows of one cell are bad records under this schema and come as they are written.
    lines = spark.read.schema(f"cell string, {RAW} string").options(header=False, mode="PERMISSIVE", columnNameOfCorruptRecord=RAW, **options).csv(source)
    raw = F.coalesce(F.col(RAW), F.lit(""))
    cells = F.floor((F.length(raw) - F.length(F.replace(raw, F.lit(options["sep"])))) / len(options["sep"])) + 1
    text = [from_cp1252(F.col(c)).alias(c) if windows else F.col(c) for c in ("cell", RAW)]
    seen = lines.select(
        F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("head"),
        F.monotonically_increasing_id().alias("at"), F.struct(*text).alias("row"), cells.alias("cells"),
    )
    first = F.min_by(F.when(F.col("head"), F.col("row")), F.when(F.col("head"), F.col("at")))
    found = seen.groupBy("file").agg(first.alias("first"), F.max("cells").alias("cells")).orderBy("file").collect()
    groups: dict[tuple[str, ...], list] = {}
    for file, row, most in found:
        header = [row["cell"]] if row[RAW] is None else _cells(row[RAW], options["sep"])
        held = groups.setdefault(tuple((h or "").strip("\ufeff\r\0") for h in header), [[], 0])
        held[0].append(unquote(file))
        held[1] = max(held[1], most)
    if len(groups) == 1:
        return [(list(header), source, most) for header, (_, most) in groups.items()]
    return [(list(header), files, most) for header, (files, most) in groups.items()]


def _cells(record: str, separator: str) -> list[str]:
    csv.field_size_limit(sys.maxsize)
    return next(csv.reader(io.StringIO(record, newline=""), delimiter=separator), [])


def _width(spark: SparkSession, source: str | list[str], options: dict, header: int) -> int:
    """Cells of the longest row, at least as many as the header has."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(header)] + [T.StructField(RAW, T.StringType())])
    rows = spark.read.schema(schema).options(header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=RAW, **options).csv(source)
    separator = options["sep"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            yield pd.DataFrame({"n": [len(next(csv.reader(io.StringIO(r, newline=""), delimiter=separator), [])) for r in batch[RAW]]})

    # Rows with as many cells as the header are no bad records and are not looked at.
    longest = rows.filter(F.col(RAW).isNotNull()).mapInPandas(run, "n int").agg(F.max("n")).first()[0]
    return max(header, longest or 0)


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of flat objects, or one flat object per line (SRC-4, SRC-5).

    An array file is one document and takes one task per file; the line form splits.
    """
    raw = spark.read.text(path, wholetext=not lines)
    first = raw.filter(F.trim(F.regexp_replace("value", r"^[﻿\s]+", "")) != "")
    start = first.select(F.substring(F.regexp_replace("value", r"^[﻿\s]+", ""), 1, 1)).take(1)
    if not start:
        raise TableError("the file is empty")
    if not lines and start[0][0] != "[":
        raise JsonStructureError("the JSON document must be a list of objects")
    df = spark.read.option("multiLine", not lines).json(path)
    fields = [f for f in df.schema.fields if f.name != "_corrupt_record"]
    if "_corrupt_record" in df.columns and not fields:
        raise JsonStructureError("the JSON cannot be read as objects")
    if not fields:
        raise TableError("the JSON list is empty")
    nested = [f.name for f in fields if isinstance(f.dataType, (T.StructType, T.ArrayType))]
    if nested:
        raise JsonStructureError(f"nested values in {nested}: flatten them first")
    # Inference sorts the names; the first object has them in their own order.
    record = F.col("value") if lines else F.get_json_object("value", "$[0]")
    keys = first.select(F.json_object_keys(record)).first()[0] or []
    order = [k for k in keys if k in df.columns] + [f.name for f in fields if f.name not in keys]
    return df.select(*[cell(n) for n in order])


def read_parquet_rows(spark: SparkSession, path: str, index: str = "row_index") -> DataFrame:
    """Parquet with the position of each row in its file, for callers without a key (SRC-6)."""
    try:
        return spark.read.parquet(path).select(
            "*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias(index)
        )
    except AnalysisException as error:
        raise TableError(str(error)) from error
