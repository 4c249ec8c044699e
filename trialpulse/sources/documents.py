"""One document from many tasks (SNK-3, SNK-4): df.write.format("document").

Rows are (section, line). Every task writes the lines of each section to a part
of its own beside the target; the commit puts the parts together in the order of
sections and partitions, between what opens and closes the document, and moves
the whole into place. Nothing is gathered in one group, parts of failed attempts
are never named in a commit, and until the commit the target isn't there.

Options: ``layout``, a JSON text of [{"name", "open", "close", "between"}] (the
sections in order), and ``open`` and ``close`` of the document.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import sinks


@dataclass
class Parts(WriterCommitMessage):
    partition: int
    files: dict[str, str]


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.layout = json.loads(options["layout"])
        self.open, self.close = options.get("open", ""), options.get("close", "")
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        os.makedirs(self.parts)  # a task that outlives an abort finds no place to write

    def write(self, rows: Iterator[Row]) -> Parts:
        between = {s["name"]: s.get("between", "") for s in self.layout}
        files: dict[str, str] = {}
        out: dict = {}
        try:
            for section, line in rows:
                if section not in out:
                    files[section] = f"{self.parts}/{uuid.uuid4().hex}"
                    out[section] = open(files[section], "w", encoding="utf-8")
                else:
                    out[section].write(between[section])
                out[section].write(line)
        finally:
            for f in out.values():
                f.close()
        return Parts(TaskContext.get().partitionId(), files)

    def commit(self, messages: list[Parts | None]) -> None:
        whole = f"{self.path}.{uuid.uuid4().hex}"
        try:
            with open(whole, "wb") as out:
                out.write(self.open.encode())
                for section in self.layout:
                    out.write(section.get("open", "").encode())
                    files = [m.files[section["name"]] for m in sorted((m for m in messages if m), key=lambda m: m.partition) if section["name"] in m.files]
                    for i, f in enumerate(files):
                        out.write(section.get("between", "").encode() if i else b"")
                        with open(f, "rb") as part:
                            shutil.copyfileobj(part, out, 1 << 20)
                    out.write(section.get("close", "").encode())
                out.write(self.close.encode())
            os.replace(whole, self.path)
        finally:
            if os.path.exists(whole):
                os.remove(whole)
            shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[Parts | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class Document(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document"

    def schema(self) -> str:
        return "section string, line string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, overwrite)


def _write(rows: DataFrame, path: str, layout: list[dict], before: str, after: str) -> None:
    rows.sparkSession.dataSource.register(Document)
    rows.write.format("document").option("layout", json.dumps(layout)).option("open", before).option("close", after).mode("overwrite").save(path)


def write_json(path: str, **tables: DataFrame) -> None:
    """SNK-3: one JSON object with a list of objects for each table; numbers stay numbers, missing values are left out. Rows keep their partitions' order."""
    rows = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("line"))
        rows = one if rows is None else rows.union(one)
    names = list(tables)
    layout = [{"name": n, "open": ("{" if i == 0 else ",") + f"\n{json.dumps(n)}: [\n", "between": ",\n", "close": "\n]"} for i, n in enumerate(names)]
    _write(rows, path, layout, "", "\n}\n")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SNK-4: one GraphML document, nodes before edges; no sort of either."""
    lines = sinks.graphml(nodes, edges)
    head, foot = (lines.where(F.col("place") == p).first().line for p in (0, 3))  # two fixed lines
    rows = lines.where("place in (1, 2)").select(F.col("place").cast("string").alias("section"), "line")
    _write(rows, path, [{"name": p, "between": "\n", "close": "\n"} for p in ("1", "2")], head + "\n", foot + "\n")
