"""Spreadsheet workbooks as rows of text cells (SRC-10, SRC-11): one task per workbook."""

from __future__ import annotations

import datetime as dt
import io
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucarne.functions.vocabulary import SHEET_PREVIEW_ROWS
from lucarne.operators.cleaning import TableError, clean_names, fill_header

# Ship the helpers of this module with the task instead of expecting them on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = "path string, sheet string, sheet_idx int, row_idx bigint, cells array<string>"
BATCH_ROWS = 5_000
# Built-in number formats that show dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


class SheetRequired(ValueError):
    """The workbook has several sheets and none was named."""

    def __init__(self, sheets: list[str]):
        super().__init__(f"name one of the sheets {sheets}")
        self.sheets = sheets


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _named(root: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in root.iter() if _tag(e) == name)


def _text(element: ElementTree.Element) -> str:
    """All text runs below the element, phonetic hints left out."""
    parts = []
    for child in element:
        if _tag(child) == "t":
            parts.append(child.text or "")
        elif _tag(child) == "r":
            parts.append(_text(child))
    return "".join(parts)


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _moment(serial: float, base_1904: bool) -> str:
    start = dt.datetime(1904, 1, 1) if base_1904 else dt.datetime(1899, 12, 30)
    moment = start + dt.timedelta(seconds=round(serial * 86_400))
    if serial < 1:
        return moment.strftime("%H:%M:%S")
    return moment.strftime("%Y-%m-%d" if moment.time() == dt.time() else "%Y-%m-%d %H:%M:%S")


class _Workbook:
    def __init__(self, content: bytes, cells: bool = True):
        self.files = zipfile.ZipFile(io.BytesIO(content))
        book = self._xml("xl/workbook.xml")
        links = {e.get("Id"): e.get("Target") for e in _named(self._xml("xl/_rels/workbook.xml.rels"), "Relationship")}
        link_key = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        self.sheets = []
        for e in _named(book, "sheet"):
            target = links[e.get(link_key)]
            self.sheets.append((e.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        self.base_1904 = any(e.get("date1904") in ("1", "true") for e in _named(book, "workbookPr"))
        names = set(self.files.namelist()) if cells else set()
        self.strings = []
        if "xl/sharedStrings.xml" in names:
            self.strings = [_text(e) for e in self._xml("xl/sharedStrings.xml") if _tag(e) == "si"]
        self.date_styles = self._date_styles() if "xl/styles.xml" in names else set()

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.files.read(name))

    def _date_styles(self) -> set[int]:
        root = self._xml("xl/styles.xml")
        dates = set(DATE_FORMATS)
        for e in _named(root, "numFmt"):
            code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", e.get("formatCode", "")).lower()
            if re.search(r"[ymdhs]", code) and "general" not in code:
                dates.add(int(e.get("numFmtId")))
        styles = next(_named(root, "cellXfs"), [])
        return {i for i, x in enumerate(styles) if int(x.get("numFmtId", 0)) in dates}

    def _value(self, c: ElementTree.Element) -> str | None:
        kind = c.get("t", "n")
        parts = {_tag(e): e for e in c}
        if kind == "inlineStr":
            return _text(parts["is"]) if "is" in parts else None
        text = parts["v"].text if "v" in parts else None
        if text is None:
            return None
        if kind == "s":
            return self.strings[int(text)]
        if kind == "b":
            return "true" if text == "1" else "false"
        if kind == "n" and int(c.get("s", 0)) in self.date_styles:
            return _moment(float(text), self.base_1904)
        return text

    def rows(self, member: str) -> Iterator[tuple[int, list[str | None]]]:
        """Row number (from 0) and cells of one sheet, read as a stream."""
        number = -1
        with self.files.open(member) as stream:
            for _, e in ElementTree.iterparse(stream):
                if _tag(e) != "row":
                    continue
                number = int(e.get("r")) - 1 if e.get("r") else number + 1
                cells: list[str | None] = []
                for c in e:
                    at = _column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    cells.append(self._value(c))
                yield number, cells
                e.clear()


def workbook_rows(spark: SparkSession, path: str, sheet: str | None = None, first_rows: int | None = None) -> DataFrame:
    """``(path, sheet, sheet_idx, row_idx, cells)`` of the sheets of every workbook (SRC-10).

    Rows above the first filled one are skipped, so ``row_idx`` 0 is always the heading. Naming a
    sheet, or the last row wanted, keeps the task from reading the rest.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "sheet", "sheet_idx", "row_idx", "cells"]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                held = []
                book = _Workbook(content)
                for sheet_idx, (title, member) in enumerate(book.sheets):
                    if sheet is not None and title != sheet:
                        continue
                    first = None
                    for number, cells in book.rows(member):
                        if first is None:
                            if not any(cells):
                                continue
                            first = number
                        if first_rows is not None and number - first > first_rows:
                            break
                        held.append((name, title, sheet_idx, number - first, cells))
                        if len(held) == BATCH_ROWS:
                            yield pd.DataFrame(held, columns=columns)
                            held = []
                if held:
                    yield pd.DataFrame(held, columns=columns)

    return files.mapInPandas(unpack, ROWS)


def workbook_sheets(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sheet, sheet_idx)`` of every workbook; no sheet is read for it (SRC-10)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = [(name, title, i) for i, (title, _) in enumerate(_Workbook(content, cells=False).sheets)]
                yield pd.DataFrame(rows, columns=["path", "sheet", "sheet_idx"])

    return files.mapInPandas(listed, "path string, sheet string, sheet_idx int")


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    """The different sheets of the workbooks in their order."""
    rows = workbook_sheets(spark, path).groupBy("sheet").agg(F.min("sheet_idx").alias("i")).orderBy("i", "sheet").collect()
    return [r["sheet"] for r in rows]


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, first_sheet: bool = False) -> DataFrame:
    """One sheet as a table of text columns under its heading (SRC-10, CLN-2, CLN-1).

    With several sheets one must be named, unless ``first_sheet`` settles it.
    """
    names = sheet_names(spark, path)
    if sheet is None:
        if len(names) > 1 and not first_sheet:
            raise SheetRequired(names)
        sheet = names[0]
    if sheet not in names:
        raise ValueError(f"no sheet {sheet!r} among {names}")
    rows = workbook_rows(spark, path, sheet)
    heading = workbook_rows(spark, path, sheet, first_rows=0).select("cells").first()
    if heading is None:
        raise TableError(f"sheet {sheet!r} is empty")
    titles = clean_names(fill_header([h or "" for h in heading["cells"]]))
    body = rows.filter("row_idx > 0")
    return body.select(*[F.get("cells", F.lit(i)).alias(t) for i, t in enumerate(titles)])


def sheet_previews(spark: SparkSession, path: str, rows: int = SHEET_PREVIEW_ROWS) -> DataFrame:
    """Heading and first rows of every sheet, as arrays of text (SRC-11)."""
    return workbook_rows(spark, path, first_rows=rows).select(
        "path", "sheet", "row_idx", (F.col("row_idx") == 0).alias("is_heading"), "cells"
    )
