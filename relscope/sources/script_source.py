"""A Python Data Source for folders of scripts: units, and rows for what couldn't be read.

    register(spark)
    spark.read.format("sqlscripts").option("skip", "archive").load("/path/to/sql")

The driver lists folders, never those that are skipped or that a pushed filter rules out; files are read in tasks, a list of
files each. Paths are URIs of any file system that pyarrow knows, or local paths.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass


import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from relscope.functions.scalars import decoded

# File extensions that are read and folders that are not.
EXTENSIONS = ["sql", "ddl", "tsql", "psql"]
SKIPPED_FOLDERS = [".git", "bin", "obj", "node_modules"]
FORMAT = "sqlscripts"
SCHEMA = "rel_path string, content string, size_bytes long, problem string"
#: Files and bytes that one task reads; folders that are listed at once.
FILES, BYTES, LISTERS = 1000, 32 << 20, 16


@dataclass
class Files(InputPartition):
    """Paths with sizes, and problems that listing has met already."""

    files: list[tuple[str, str, int]]
    problems: list[tuple[str, str]]


@dataclass
class Entry:
    """A file or folder as a listing shows it."""

    path: str
    name: str
    folder: bool
    size: int | None
    problem: str = ""


class ScriptFolder(DataSource):
    """Options: path; skip and extensions, comma-separated; files and bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ScriptReader(dict(self.options))


def listed(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


class ScriptReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.skip = {x.lower() for x in [*SKIPPED_FOLDERS, *listed(options.get("skip"))]}
        self.extensions = {x.lower().lstrip(".") for x in listed(options.get("extensions")) or EXTENSIONS}
        self.most_files, self.most_bytes = int(options.get("files", FILES)), int(options.get("bytes", BYTES))
        self.wanted: list[tuple[str, object]] = []

    # what follows runs in the driver's planner

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 (the API's name)
        """Conditions on rel_path decide which folders are listed and which files are opened; the rest stays with Spark."""
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("rel_path",):
                self.wanted.append((kinds[type(f)], f.value))
            else:
                yield f

    def wants(self, path: str) -> bool:
        tests = {"is": lambda v: path == v, "in": lambda v: path in v, "starts": path.startswith, "ends": path.endswith, "contains": lambda v: v in path}
        return all(v is not None and tests[kind](v) for kind, v in self.wanted)

    def may_hold(self, folder: str) -> bool:
        """Whether the folder, or what lies below it, can have a wanted path."""
        below = folder + "/"
        for kind, value in self.wanted:
            values = list(value) if kind == "in" else [value]
            if kind in ("is", "in") and not any(v is not None and (v.startswith(below) or v == folder) for v in values):
                return False
            if kind == "starts" and not (below.startswith(value) or value.startswith(below)):
                return False
        return True

    def entries(self, store: pafs.FileSystem, folder: str) -> list[Entry]:
        if not isinstance(store, pafs.LocalFileSystem):
            return [Entry(i.path, i.base_name, i.type == pafs.FileType.Directory, i.size) for i in store.get_file_info(pafs.FileSelector(folder, recursive=False))]
        found = []
        for e in os.scandir(folder):  # shows links to nothing, too
            try:
                found.append(Entry(e.path, e.name, e.is_dir(), e.stat().st_size))
            except OSError as why:
                found.append(Entry(e.path, e.name, False, None, str(why)))
        return found

    def partitions(self) -> list[Files]:
        store, base = opened(self.root)
        if store.get_file_info(base).type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"{self.root}: no such folder")
        found: list[tuple[str, str, int]] = []
        problems: list[tuple[str, str]] = []

        def look(folder: tuple[str, str]) -> list[Entry] | Exception:
            try:
                return self.entries(store, folder[0])
            except OSError as e:
                return e

        level = [(base, "")]
        with ThreadPoolExecutor(LISTERS) as pool:
            while level:
                below = []
                for (_, rel), got in zip(level, pool.map(look, level), strict=True):
                    if isinstance(got, Exception):
                        problems.append((rel or ".", f"Could not read directory {rel or '.'}: {got}"))
                        continue
                    for info in got:
                        path = f"{rel}/{info.name}" if rel else info.name
                        if info.folder:
                            if info.name.lower() not in self.skip and self.may_hold(path):
                                below.append((info.path, path))
                        elif "." in info.name and info.name.rpartition(".")[2].lower() in self.extensions:
                            if info.problem:
                                problems.append((path, f"Could not stat {path}: {info.problem}"))
                            else:
                                found.append((info.path, path, info.size or 0))
                level = below
        return list(self.dealt(sorted(f for f in found if self.wants(f[1])), sorted(p for p in problems if self.wants(p[0])))) or [Files([], [])]

    def dealt(self, files: list[tuple[str, str, int]], problems: list[tuple[str, str]]) -> Iterator[Files]:
        if problems:
            yield Files([], problems)
        part: list[tuple[str, str, int]] = []
        size = 0
        for f in files:
            if part and (len(part) >= self.most_files or size + f[2] > self.most_bytes):
                yield Files(part, [])
                part, size = [], 0
            part.append(f)
            size += f[2]
        if part:
            yield Files(part, [])

    # what follows runs in tasks

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, why in partition.problems:
            yield path, None, None, why
        store, _ = opened(self.root)
        for path, rel, size in partition.files:
            try:
                with store.open_input_stream(path) as f:
                    data = f.read()
            except OSError as e:
                yield rel, None, size, f"Could not read {rel}: {e}"
                continue
            yield rel, decoded(data), len(data), None


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    store, path = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)
    return store, path.rstrip("/") or "/"


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark hand it conditions."""
    spark.dataSource.register(ScriptFolder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, root: str, skip: Iterable[str] = (), **options: str) -> DataFrame:
    """Rows of SCHEMA for the scripts below root; content is null where problem says why."""
    register(spark)
    return spark.read.format(FORMAT).options(skip=",".join(skip), **options).load(root)


__all__ = ["ScriptFolder", "ScriptReader", "read", "register"]
