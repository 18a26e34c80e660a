"""Documents written from partitions: a Python Data Source whose tasks write files or parts, and documents joined from parts.

A row never goes through the driver. With `as` = files each row (path, text) is a file below the root; with `as` = parts a task
writes its rows (text) into one part, and the commit lists the parts in order. `join` strings texts and listed parts together
into one document, a block of bytes at a time.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from relscope.functions import scalars as S
from relscope.sources.script_source import opened

FORMAT = "documents"
MANIFEST = "_parts.json"
#: Bytes that join copies at once.
BLOCK = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its place among the parts, the files and the number of rows."""

    place: int
    files: list[str]
    rows: int


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options["path"], self.options.get("as", "files"), self.options.get("separator", "\n"))


class DocumentWriter(DataSourceWriter):
    def __init__(self, root: str, kind: str, separator: str):
        self.root, self.kind, self.separator = root.rstrip("/"), kind, separator

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        store, base = opened(self.root)
        place, attempt = context.partitionId(), context.taskAttemptId()
        store.create_dir(base, recursive=True)
        files, n = [], 0
        if self.kind == "files":
            for row in iterator:
                target = f"{base}/{row['path']}"
                if "/" in row["path"]:
                    store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{target}.{attempt}") as f:
                    f.write((row["text"] or "").encode())
                store.move(f"{target}.{attempt}", target)  # a second attempt writes the same
                files.append(row["path"])
                n += 1
            return Written(place, files, n)
        name, out = f"part-{place:05d}-{attempt}", None
        try:
            for row in iterator:
                if out is None:
                    out = store.open_output_stream(f"{base}/{name}")
                else:
                    out.write(self.separator.encode())
                out.write((row["text"] or "").encode())
                n += 1
        finally:
            if out is not None:
                out.close()
        return Written(place, [name] if n else [], n)

    def commit(self, messages: list[Written]) -> None:
        if self.kind == "parts":
            done = sorted((m for m in messages if m is not None), key=lambda m: m.place)
            store, base = opened(self.root)
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{MANIFEST}") as f:
                f.write(json.dumps({"parts": [x for m in done for x in m.files], "rows": sum(m.rows for m in done)}).encode())

    def abort(self, messages: list[Written]) -> None:
        store, base = opened(self.root)
        for m in messages:
            for name in m.files if m is not None else []:
                if store.get_file_info(f"{base}/{name}").type == pafs.FileType.File:
                    store.delete_file(f"{base}/{name}")


def _rooted(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else os.path.abspath(path)


def _save(df: DataFrame, root: str, kind: str, separator: str) -> None:
    df.sparkSession.dataSource.register(DocumentSink)
    df.write.format(FORMAT).mode("append").option("as", kind).option("separator", separator).save(_rooted(root))


def write_files(rows: DataFrame, root: str) -> None:
    """A file for each row (path, text), written by the task that has the row."""
    _save(rows.select("path", "text"), root, "files", "")


def join(path: str, *pieces: str | DataFrame, separator: str = "\n") -> int:
    """Write one document of texts and of frames (text), whose rows keep their order; returns how many rows it has."""
    path, n = _rooted(path), 0
    store, target = opened(path)
    if "/" in target.strip("/"):
        store.create_dir(target.rpartition("/")[0], recursive=True)
    folders = []
    for k, piece in enumerate(pieces):
        if not isinstance(piece, str):
            folders.append((k, f"{path}.{uuid.uuid4().hex}"))
            _save(piece.select("text"), folders[-1][1], "parts", separator)
    parts = dict(folders)
    with store.open_output_stream(target) as out:
        for k, piece in enumerate(pieces):
            if isinstance(piece, str):
                out.write(piece.encode())
                continue
            _, base = opened(parts[k])
            with store.open_input_stream(f"{base}/{MANIFEST}") as f:
                listed = json.loads(f.read())
            n += listed["rows"]
            for i, name in enumerate(listed["parts"]):
                if i:
                    out.write(separator.encode())
                with store.open_input_stream(f"{base}/{name}") as f:
                    while block := f.read(BLOCK):
                        out.write(block)
            store.delete_dir(base)
    return n


# ---- texts of rows ------------------------------------------------------------------------------------------------


def _cell(name: str, kind: str) -> Column:
    value = F.col(f"`{name}`")
    text = F.array_join(value.cast("array<string>"), ", ", "") if kind.startswith("array") else value.cast("string")
    return F.concat(F.lit("<td>"), S.html_encode(F.coalesce(text, F.lit(""))), F.lit("</td>"))


def table(df: DataFrame) -> list[str | DataFrame]:
    """Pieces of an HTML table with all rows of df, in its order."""
    head = "".join(f"<th>{c}</th>" for c in df.columns)
    rows = df.select(F.concat(F.lit("<tr>"), *[_cell(*c) for c in df.dtypes], F.lit("</tr>")).alias("text"))
    return [f"<table><tr>{head}</tr>\n", rows, "</table>"]


def json_rows(df: DataFrame, *columns: Column | str) -> DataFrame:
    """(text): each row as a JSON object, nulls kept."""
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}).alias("text"))
