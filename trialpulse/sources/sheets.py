"""A data source of workbooks (SRC-1, SRC-6): spark.read.format("workbook").load(folder).

A partition is a sheet, planned from the small directory parts of each file. Its
task pulls row after row out of the compressed sheet, so memory holds one batch
of rows and the file's shared strings, which are read once, side by side in one
buffer. Filters on ``sheet`` and ``path`` (=, IN, contains, begins, ends) are
taken over where Spark pushes them down, and drop partitions; the option
``sheets`` is a pattern of names that does the same.

A file that can't be read is one row with its error. Files must lie where the
executors can open them: a path, or an address that pyarrow's file systems know.
"""

from __future__ import annotations

import re
import zipfile
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

ROWS = "path string, sheet string, row long, cells array<string>, error string"
_SCHEMA = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of a batch.
BATCH = 2048


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Strings:
    """A workbook's shared strings: their bytes in one buffer and where each ends."""

    def __init__(self, source):
        self.bytes, self.ends = bytearray(), array("Q", [0])
        if source is None:
            return
        for _, item in ElementTree.iterparse(source):
            if item.tag == f"{MAIN}si":
                self.bytes += "".join(t.text or "" for t in item.iter(f"{MAIN}t")).encode()
                self.ends.append(len(self.bytes))
                item.clear()

    def __getitem__(self, i: int) -> str:
        return self.bytes[self.ends[i] : self.ends[i + 1]].decode()


def _place(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def rows_of(source, strings: Strings) -> Iterator[list[str | None]]:
    """The cells of each row, pulled out of a sheet one row at a time."""
    parser = ElementTree.iterparse(source, events=("start", "end"))
    data = None
    for event, node in parser:
        if event == "start":
            data = node if node.tag == f"{MAIN}sheetData" else data
            continue
        if node.tag != f"{MAIN}row":
            continue
        cells: list[str | None] = []
        for cell in node.iter(f"{MAIN}c"):
            at = _place(cell.get("r")) if cell.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            value, inline = cell.find(f"{MAIN}v"), cell.find(f"{MAIN}is")
            if cell.get("t") == "s" and value is not None:
                cells[at] = strings[int(value.text)]
            elif inline is not None:
                cells[at] = "".join(t.text or "" for t in inline.iter(f"{MAIN}t"))
            elif value is not None:
                cells[at] = value.text
        yield cells
        if data is not None:
            data.clear()  # rows that are done


def sheet_parts(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet of an open workbook."""
    links = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(_LINK)}
    found = [(s.get("name"), links[s.get(_ID)]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
    return [(name, part if part.startswith("xl/") else f"xl/{part}") for name, part in found]


@dataclass
class Sheet(InputPartition):
    path: str
    name: str | None
    part: str | None
    error: str | None = None


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.pattern, self.filters = options["path"], options.get("sheets"), []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringContains, StringStartsWith, StringEndsWith)) and f.attribute in (("sheet",), ("path",)):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, sheet: Sheet) -> bool:
        if sheet.error:
            return not any(f.attribute == ("sheet",) for f in self.filters)
        if self.pattern and not re.search(self.pattern, sheet.name, re.IGNORECASE):
            return False
        for f in self.filters:
            x = sheet.name if f.attribute == ("sheet",) else sheet.path
            hit = x == f.value if isinstance(f, EqualTo) else x in f.value if isinstance(f, In) else f.value in x if isinstance(f, StringContains) else x.startswith(f.value) if isinstance(f, StringStartsWith) else x.endswith(f.value)
            if not hit:
                return False
        return True

    def _sheets(self) -> Iterator[Sheet]:
        system, at = _system(self.root)
        info = system.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        for f in sorted(files, key=lambda f: f.path):
            if f.type != fs.FileType.File or not f.path.lower().endswith(".xlsx"):
                continue
            try:
                with system.open_input_file(f.path) as source, zipfile.ZipFile(source) as z:
                    yield from [Sheet(f.path, name, part) for name, part in sheet_parts(z)]
            except Exception as e:  # the error is a row of the result
                yield Sheet(f.path, None, None, f"{type(e).__name__}: {e}")

    def partitions(self) -> list[Sheet]:
        return [s for s in self._sheets() if self._wanted(s)]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        if partition is None or not partition.path:
            return
        error = partition.error
        rows: list[list] = []
        done = 0
        if not error:
            try:
                system, _ = _system(self.root)
                with system.open_input_file(partition.path) as source, zipfile.ZipFile(source) as z:
                    names = set(z.namelist())
                    with z.open("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in names else _nothing() as shared:
                        strings = Strings(shared)
                    with z.open(partition.part) as sheet:
                        for cells in rows_of(sheet, strings):
                            rows.append(cells)
                            if len(rows) == BATCH:
                                yield self._batch(partition, done, rows)
                                done, rows = done + BATCH, []
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        if rows:
            yield self._batch(partition, done, rows)
        if error:
            yield pa.RecordBatch.from_pylist([{"path": partition.path, "sheet": partition.name, "row": None, "cells": None, "error": error}], schema=_SCHEMA)

    @staticmethod
    def _batch(sheet: Sheet, done: int, rows: list[list]) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([sheet.path] * n), pa.array([sheet.name] * n), pa.array(range(done, done + n), pa.int64()), pa.array(rows, pa.list_(pa.string())), pa.nulls(n, pa.string())], schema=_SCHEMA)


class _nothing:
    def __enter__(self):
        return None

    def __exit__(self, *_):
        return False


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)


def read(spark: SparkSession, root: str, sheets: str | None = None):
    """Cells of all workbooks below ``root``; ``sheets``: a pattern for sheet names. Turns Spark's filter pushdown to Python sources on, without which it refuses sources that take filters."""
    spark.dataSource.register(Workbook)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("workbook")
    return (reader.option("sheets", sheets) if sheets else reader).load(root)
