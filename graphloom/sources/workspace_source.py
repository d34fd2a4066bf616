"""The Python files of a folder tree as a data source: ``spark.read.format("workspace").load(root)``.

The root is a path or an address that Arrow's file systems know (file, hdfs, s3, gs); with the option ``store``, a
``module:function`` that opens the address, any other file system that Arrow can wrap. The driver lists folders only until
there are enough of them for all tasks; each task lists and reads what lies below its own. Conditions on rel_path
(equal, in, begins with) and mtime (below, above, equal) are tested before a file is opened, and folders that hold
no such path are not entered.

Options: ``content`` = false leaves the sources out, for a list of paths and times; ``partitions`` (200) is how many folders
the driver looks for; ``patterns``, separated by blanks, are ignored besides those of the root's ignore file.

Rows are those of ``workspace.scan``: rel_path, mtime and source, which is null where a file can't be read or is no UTF-8.
A root that does not exist raises FileNotFoundError. Links are followed but not back to a folder around them.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from graphloom.sources.workspace import IGNORED

PATH, TIME = ("rel_path",), ("mtime",)
BATCH_FILES = 100


class Store:
    """A file system and the root in it; opened anew by each task."""

    def __init__(self, root: str, opener: str | None = None):
        if opener:
            module, _, function = opener.partition(":")
            self.files, self.root = getattr(importlib.import_module(module), function)(root)
        elif "://" in root:
            self.files, self.root = pafs.FileSystem.from_uri(root)
        else:
            self.files, self.root = pafs.LocalFileSystem(), os.path.abspath(root.removeprefix("file:"))
        self.root = self.root.rstrip("/")
        self.local = isinstance(self.files, pafs.LocalFileSystem)

    def at(self, path: str) -> str:
        return f"{self.root}/{path}" if path else self.root

    def listed(self, folder: str) -> list[pafs.FileInfo]:
        """What a folder holds, by name; links stand for what they lead to, and those that lead nowhere are left out."""
        found = self.files.get_file_info(pafs.FileSelector(self.at(folder)))
        return sorted((x for x in found if x.type in (pafs.FileType.File, pafs.FileType.Directory)), key=lambda x: x.base_name)

    def text(self, path: str) -> str | None:
        """A file's text with line ends as Python reads them."""
        try:
            with self.files.open_input_stream(self.at(path)) as f:
                return f.read().decode().replace("\r\n", "\n").replace("\r", "\n")
        except (OSError, UnicodeDecodeError):
            return None

    def place(self, folder: str) -> str:
        """What a folder is, whatever links lead to it."""
        return os.path.realpath(self.at(folder)) if self.local else self.at(folder)


def ignored_names(store: Store, patterns: str = "") -> frozenset[str]:
    lines = (store.text(".gitignore") or "").split("\n")
    return frozenset({*IGNORED, *patterns.split(), *(y.rstrip("/") for x in lines if (y := x.strip()) and not y.startswith("#"))})


class Below(NamedTuple):
    """Folders to list with all that is below, and folders of which only the files count."""

    whole: list[str]
    files_only: list[str]


class Conditions:
    """What is asked of rel_path and mtime; other filters are Spark's."""

    def __init__(self) -> None:
        self.paths: list[frozenset[str]] = []
        self.prefixes: list[str] = []
        self.times: list[tuple[type, float]] = []

    def take(self, f: ds.Filter) -> bool:
        if isinstance(f, ds.EqualTo) and f.attribute == PATH:
            self.paths.append(frozenset([f.value]))
        elif isinstance(f, ds.In) and f.attribute == PATH:
            self.paths.append(frozenset(x for x in f.value if x is not None))
        elif isinstance(f, ds.StringStartsWith) and f.attribute == PATH:
            self.prefixes.append(f.value)
        elif isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.EqualTo)) and f.attribute == TIME:
            self.times.append((type(f), f.value))
        else:
            # These columns are never null.
            return isinstance(f, ds.IsNotNull) and f.attribute in (PATH, TIME)
        return True

    def hold(self, path: str, mtime: float) -> bool:
        compare = {ds.GreaterThan: float.__gt__, ds.GreaterThanOrEqual: float.__ge__, ds.LessThan: float.__lt__, ds.LessThanOrEqual: float.__le__, ds.EqualTo: float.__eq__}
        return all(path in p for p in self.paths) and all(map(path.startswith, self.prefixes)) and all(compare[k](mtime, float(v)) for k, v in self.times)

    def may_hold_below(self, folder: str) -> bool:
        inside = folder + "/" if folder else ""
        return all(any(x.startswith(inside) for x in p) for p in self.paths) and all(p.startswith(inside) or inside.startswith(p) for p in self.prefixes)


class WorkspaceReader(ds.DataSourceReader):
    def __init__(self, schema, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("name the root: spark.read.format('workspace').load(root)")
        self.root, self.opener = options["path"], options.get("store")
        self.content = options.get("content", "true").lower() != "false"
        self.wanted, self.patterns = int(options.get("partitions", 200)), options.get("patterns", "")
        self.conditions = Conditions()

    def pushFilters(self, filters: list[ds.Filter]):
        for f in filters:
            if not self.conditions.take(f):
                yield f

    def folders_in(self, store: Store, folder: str, ignored: frozenset[str], around: frozenset[str]) -> list[str]:
        """Folders directly below a folder that have to be listed; around: places of the folders around and of itself."""
        names = [x.base_name for x in store.listed(folder) if x.type == pafs.FileType.Directory and x.base_name not in ignored]
        below = [f"{folder}/{x}" if folder else x for x in names]
        return [x for x in below if self.conditions.may_hold_below(x) and not (store.local and store.place(x) in around)]

    def partitions(self):
        store = Store(self.root, self.opener)
        if store.files.get_file_info(store.root).type != pafs.FileType.Directory:
            raise FileNotFoundError(self.root)
        ignored = ignored_names(store, self.patterns)
        # A level at a time, as long as there are too few folders and more below them.
        level, files_only = [("", frozenset([store.place("")]))], []
        while level and len(level) + len(files_only) < self.wanted:
            found = [(x, around | {store.place(x)}) for folder, around in level for x in self.folders_in(store, folder, ignored, around)]
            files_only += [folder for folder, _ in level]
            level = found
        parts = [ds.InputPartition((Below([x], []), ignored)) for x, _ in level]
        each = max(1, -(-len(files_only) // self.wanted))
        return parts + [ds.InputPartition((Below([], files_only[k : k + each]), ignored)) for k in range(0, len(files_only), each)]

    def found(self, store: Store, below: Below, ignored: frozenset[str]) -> Iterator[tuple[str, float]]:
        def around(folder: str) -> frozenset[str]:
            parts = folder.split("/")
            return frozenset(store.place("/".join(parts[:k])) for k in range(len(parts) + 1))

        todo = [(x, None) for x in below.files_only] + [(x, around(x)) for x in below.whole]
        while todo:
            folder, places = todo.pop()
            for x in store.listed(folder):
                path = f"{folder}/{x.base_name}" if folder else x.base_name
                mtime = x.mtime_ns / 1e9 if x.mtime_ns is not None else 0.0
                if x.type == pafs.FileType.File and x.base_name.endswith(".py") and x.base_name not in ignored and self.conditions.hold(path, mtime):
                    yield path, mtime
            if places is not None:
                todo += [(x, places | {store.place(x)}) for x in self.folders_in(store, folder, ignored, places)]

    def read(self, partition: ds.InputPartition):
        below, ignored = partition.value
        store, rows = Store(self.root, self.opener), []

        def batch():
            columns = [pa.array([p for p, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.float64())]
            if self.content:
                columns.append(pa.array([store.text(p) for p, _ in rows], pa.string()))
            return pa.RecordBatch.from_arrays(columns, names=["rel_path", "mtime", "source"][: len(columns)])

        for row in self.found(store, below, ignored):
            rows.append(row)
            if len(rows) == BATCH_FILES:
                yield batch()
                rows = []
        if rows:
            yield batch()


class WorkspaceSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return "rel_path string, mtime double" + (", source string" if self.options.get("content", "true").lower() != "false" else "")

    def reader(self, schema) -> WorkspaceReader:
        return WorkspaceReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkspaceSource)
