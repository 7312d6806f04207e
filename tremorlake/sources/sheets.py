"""Sheets of workbooks (zipped XML), read as a stream of rows."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

#: The numbers of the built-in formats of dates and times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}

#: Rows that are handed on at once.
ROWS_AT_ONCE = 5000


def _column(reference: str) -> int:
    """The number of a cell's column from its name, A as 0."""
    n = 0
    for letter in re.match("[A-Z]*", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _text(element: ElementTree.Element) -> str:
    """The text of a string with all its runs, without phonetic hints."""
    return "".join(t.text or "" for child in element for t in ([child] if child.tag == f"{_MAIN}t" else child.iter(f"{_MAIN}t") if child.tag == f"{_MAIN}r" else []))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The styles whose numbers are dates or times."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iter(f"{_MAIN}numFmt")}
    plain = lambda code: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
    dates = DATE_FORMATS | {n for n, code in own.items() if re.search("[ymdhs]", plain(code), re.IGNORECASE)}
    styles = root.find(f"{_MAIN}cellXfs")
    return {k for k, f in enumerate(styles if styles is not None else []) if int(f.get("numFmtId", 0)) in dates}


def _sheet(book: zipfile.ZipFile, name: str | None) -> tuple[str, datetime.datetime]:
    """The part that holds a sheet, the first one if no name is given, and the day 0 of the book."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    old = next(root.iter(f"{_MAIN}workbookPr"), None)
    day = datetime.datetime(1904, 1, 1) if old is not None and old.get("date1904") in ("1", "true") else datetime.datetime(1899, 12, 30)
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in root.iter(f"{_MAIN}sheet"):
        if name is None or sheet.get("name") == name:
            target = targets[sheet.get(_LINK)]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}", day
    raise ValueError(f"no sheet is named {name}")


def _value(cell: ElementTree.Element, shared: list[str], dates: set[int], day: datetime.datetime) -> str | None:
    kind, held = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        inner = cell.find(f"{_MAIN}is")
        return _text(inner) if inner is not None else None
    if held is None or held.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(held.text)]
    if kind == "b":
        return "true" if held.text == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        return (day + datetime.timedelta(microseconds=round(float(held.text) * 86_400_000) * 1000)).isoformat(sep=" ")
    return held.text


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet as texts, blank cells as null; dates and times as ISO text, to the millisecond. Rows that are not there are left out."""
    book = zipfile.ZipFile(io.BytesIO(content))
    part, day = _sheet(book, sheet)
    dates, shared = _date_styles(book), []
    if "xl/sharedStrings.xml" in book.namelist():
        for _, element in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
            if element.tag == f"{_MAIN}si":
                shared.append(_text(element))
                element.clear()
    for _, element in ElementTree.iterparse(book.open(part)):
        if element.tag == f"{_MAIN}row":
            row: list[str | None] = []
            for k, cell in enumerate(element.iter(f"{_MAIN}c")):
                at = _column(cell.get("r")) if cell.get("r") else max(k, len(row))
                row += [None] * (at - len(row)) + [_value(cell, shared, dates, day)]
            element.clear()
            yield row


def read_sheet(spark: SparkSession, path: str, schema: str, sheet: str | None = None, suffix: str = ".xlsx") -> DataFrame:
    """The rows of a sheet of each workbook at `path`, by the names in its first row, as the types of `schema`.

    Columns that the sheet lacks are null, others are left out; what is no value of its type is null, as are blank cells
    and errors. Numbers and texts are told by the types of `schema`. A workbook is opened by one task, in any store that
    Spark reads, and its rows are handed on as they are parsed.
    """
    wanted = T.StructType.fromDDL(schema)
    names = wanted.names

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = sheet_rows(content, sheet)
                header = next(found, [])
                places = [header.index(n) if n in header else None for n in names]
                held: list[list[str | None]] = []
                for row in found:
                    held.append([row[p] if p is not None and p < len(row) else None for p in places])
                    if len(held) == ROWS_AT_ONCE:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                yield pd.DataFrame(held, columns=names, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    texts = files.select("content").mapInPandas(rows, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    whole = lambda f: F.col(f"`{f.name}`").try_cast("double").try_cast(f.dataType) if isinstance(f.dataType, T.IntegralType) else F.col(f"`{f.name}`").try_cast(f.dataType)
    return texts.select(*[whole(f).alias(f.name) for f in wanted.fields])
