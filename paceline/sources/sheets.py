"""Many CSV files and Excel workbooks at once: each is decoded by itself, in the task that holds it.

A workbook is zipped XML: its active sheet, with shared strings, the values that formulas had when it was saved, and dates by number format. All cells are text.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.runtime import ship

SCHEMA = "source string, heads array<string>, n int, cells array<string>, failure string"
#: Fixed values of the workbook format: number formats that are dates or times, the day 0.
DATES = {*range(14, 23), *range(45, 48)}
DAY_0 = dt.datetime(1899, 12, 30)


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def children(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in node.iter() if local(x.tag) == name]


def said(node: ElementTree.Element) -> str:
    """The text of a string item: its runs, without phonetic ones."""
    spoken = {t for p in children(node, "rPh") for t in p.iter()}
    return "".join(t.text or "" for t in children(node, "t") if t not in spoken)


def date_styles(root: ElementTree.Element | None) -> set[int]:
    """Numbers of the cell styles whose number format shows days or hours."""
    if root is None:
        return set()
    own = {int(f.get("numFmtId", 0)): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "") for f in children(root, "numFmt")}
    dates = DATES | {k for k, code in own.items() if re.search("[dmyhs]", code, re.I)}
    formats = [x for xfs in children(root, "cellXfs") for x in xfs]
    return {k for k, x in enumerate(formats) if int(x.get("numFmtId", 0)) in dates}


def number_text(raw: str, is_date: bool) -> str:
    value = float(raw)
    if is_date:
        at = DAY_0 + dt.timedelta(seconds=round(value * 86400))
        return str(at.time() if 0 <= value < 1 else at)
    return str(int(value)) if re.fullmatch(r"-?\d+", raw) else str(value)


def workbook_rows(content: bytes) -> list[list[str]]:
    """Rows of a workbook's active sheet, all of one length; rows and cells that it leaves out are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else None
        book = part("xl/workbook.xml")
        active = int(next((v.get("activeTab", 0) for v in children(book, "workbookView")), 0))
        sheet = children(book, "sheet")[active]
        link = next(v for k, v in sheet.attrib.items() if local(k) == "id" and k != "sheetId")
        target = next(r.get("Target") for r in children(part("xl/_rels/workbook.xml.rels"), "Relationship") if r.get("Id") == link)
        strings = part("xl/sharedStrings.xml")
        shared = [said(x) for x in strings if local(x.tag) == "si"] if strings is not None else []
        dates = date_styles(part("xl/styles.xml"))
        grid = part(target.lstrip("/") if target.startswith("/") else f"xl/{target}")

    def text(c: ElementTree.Element) -> str:
        kind, raw = c.get("t", "n"), next((v.text for v in c if local(v.tag) == "v"), None)
        if kind == "inlineStr":
            return said(c)
        if raw is None:
            return ""
        if kind == "s":
            return shared[int(raw)]
        if kind == "b":
            return str(raw == "1")
        return number_text(raw, int(c.get("s", 0)) in dates) if kind == "n" else raw

    cells: dict[tuple[int, int], str] = {}
    row = 0
    for r in children(grid, "row"):
        row, col = int(r.get("r", row + 1)), 0
        for c in r:
            if local(c.tag) == "c":
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                col = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) or col + 1
                cells[row, col] = text(c).strip()
    high, wide = (max((k[i] for k in cells), default=0) for i in (0, 1))
    return [[cells.get((r, c), "") for c in range(1, wide + 1)] for r in range(1, high + 1)]


def csv_rows(content: bytes) -> list[list[str]]:
    """Rows of a CSV file in UTF-8, with or without a mark, or else in Windows-1252."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("cp1252", "replace")
    return [[c.strip() for c in r] for r in csv.reader(io.StringIO(text, newline=""))]


def headings(first: list[str]) -> list[str]:
    """Names of columns: ``Colonne N`` for an empty one, counted from 1; further equal ones get `` (2)``, `` (3)``."""
    seen: dict[str, int] = {}
    out = []
    for k, cell in enumerate(first, 1):
        name = cell or f"Colonne {k}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return out


READERS = {"csv": csv_rows, "xlsx": workbook_rows}


def sheet_rows(docs: DataFrame) -> DataFrame:
    """``source, heads, n, cells, failure`` of files ``source, content``: a row for each line below the first, numbered from 1, as long as the headings.

    The end of ``source`` tells the format. A file that is neither, or that can't be read, gives one row with its ``failure`` and no cells; the others go on. An
    empty file gives none.
    """
    ship(docs.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.string(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                source, content = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                try:
                    reader = READERS.get((source or "").lower().rpartition(".")[2])
                    if reader is None:
                        raise ValueError("neither CSV nor XLSX")
                    lines = reader(content or b"")
                    heads = headings(lines[0]) if lines else []
                    found = [(source, heads, n, (r + [""] * len(heads))[: len(heads)], None) for n, r in enumerate(lines[1:], 1) if r]
                except Exception as e:  # whatever is wrong with a file is told beside the rows of the others
                    found = [(source, None, None, None, f"{type(e).__name__}: {e}")]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return docs.select("source", "content").mapInArrow(run, SCHEMA)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """`sheet_rows` of every file under ``path``."""
    files = spark.read.format("binaryFile").load(path)
    return sheet_rows(files.select(F.col("path").alias("source"), "content"))


def as_maps(sheets: DataFrame) -> DataFrame:
    """``source, n, cells`` with the cells as a map from heading to text; failures are left out."""
    return sheets.where("failure IS NULL").select("source", "n", F.map_from_arrays("heads", "cells").alias("cells"))
