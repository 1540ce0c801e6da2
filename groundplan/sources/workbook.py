"""Workbooks as rows of cells: a zip of XML parts, read by tasks from Spark's binary files.

Parts are read and written row by row, so a task holds a batch of rows and the packed
workbook, however many rows its sheets have.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import groupby, islice
from operator import itemgetter
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of a batch that a task gives back at once.
BATCH = 4096
SCHEMA = "path string, sheet string, sheet_idx int, row_idx int, cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _text(node: ElementTree.Element | None) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t")) if node is not None else ""


def _column(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _elements(part: io.BufferedIOBase, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a name in a part, one at a time; what was given is let go."""
    above: list[ElementTree.Element] = []
    for event, node in ElementTree.iterparse(part, ("start", "end")):
        if event == "start":
            above.append(node)
            continue
        above.pop()
        if node.tag == f"{_MAIN}{tag}":
            yield node
            if above:
                above[-1].remove(node)


def sheets(data: bytes, first_only: bool = False) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """(sheet, sheet number, row number, cells) of every row that is not blank; formulas give their stored values."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as part:
                shared = [_text(s) for s in _elements(part, "si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for k, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
            if first_only and k:
                return
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            with book.open(target if target.startswith("xl/") else f"xl/{target}") as part:
                for nth, row in enumerate(_elements(part, "row")):
                    cells: list[str | None] = []
                    for c in row.iter(f"{_MAIN}c"):
                        at = _column(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        value = c.find(f"{_MAIN}v")
                        if c.get("t") == "s" and value is not None:
                            cells[at] = shared[int(value.text)]
                        elif c.get("t") == "inlineStr":
                            cells[at] = _text(c.find(f"{_MAIN}is"))
                        elif value is not None:
                            cells[at] = value.text
                    if any(x not in (None, "") for x in cells):
                        yield sheet.get("name"), k, int(row.get("r") or nth + 1) - 1, cells


def _rows(batches: Iterator[pa.RecordBatch], first_only: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            given, found = path.as_py(), sheets(content.as_py(), first_only)
            while part := list(islice(found, BATCH)):
                columns = [[given] * len(part), *([r[k] for r in part] for k in range(4))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "sheet", "sheet_idx", "row_idx", "cells"])


def rows_of(files: DataFrame, first_sheet_only: bool = False) -> DataFrame:
    """All rows that are not blank of workbooks given as (path, content)."""
    return files.select("path", "content").mapInArrow(partial(_rows, first_only=first_sheet_only), SCHEMA)


def workbooks(spark: SparkSession, path: str, first_sheet_only: bool = False) -> DataFrame:
    """All rows of all workbooks under ``path``, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return rows_of(files, first_sheet_only)


def _sheet(out: zipfile.ZipFile, k: int, rows: Iterable[tuple[int, list[str | None]]]) -> None:
    """Writes the part of the ``k``-th sheet, row by row."""
    cells = lambda row: "".join("<c/>" if v is None else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' for v in row)
    with out.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as part:
        part.write(f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
        for n, row in rows:
            part.write(f'<row r="{n + 1}">{cells(row)}</row>'.encode())
        part.write(b"</sheetData></worksheet>")


def book(sheets_of_rows: Iterable[tuple[str, Iterable[tuple[int, list[str | None]]]]]) -> bytes:
    """A workbook of named sheets of (row number, cells), each read once; text cells only."""
    main, rel = _MAIN[1:-1], _REL[1:-1]
    data, named = io.BytesIO(), []
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
        for k, (name, rows) in enumerate(sheets_of_rows, 1):
            named.append(name)
            _sheet(out, k, rows)
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(named, 1))
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(named) + 1)) + "</Relationships>")
    return data.getvalue()


def _books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Workbooks of rows that come in the order of path, sheet and row."""
    rows = (r for batch in batches for start in range(0, batch.num_rows, BATCH) for r in zip(*(c.to_pylist() for c in batch.slice(start, BATCH).columns), strict=True))
    for path, of_book in groupby(rows, itemgetter(0)):
        content = book((name, ((r[3], r[4]) for r in of_sheet)) for (_, name), of_sheet in groupby(of_book, itemgetter(2, 1)))
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary())], names=["path", "content"])


def made(rows: DataFrame) -> DataFrame:
    """(path, content) of workbooks from rows as ``workbooks`` gives them; a workbook is made in one task, of sorted rows as they come."""
    ordered = rows.select("path", "sheet", "sheet_idx", "row_idx", "cells").repartition("path").sortWithinPartitions("path", "sheet_idx", "sheet", "row_idx")
    return ordered.mapInArrow(_books, "path string, content binary")
