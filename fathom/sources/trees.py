"""Source trees as a Python data source: executors walk the folders and read the files.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("path", root).load().where("not is_test and file_path like 'internal/%'")

The driver lists folders down to a small depth, one partition for each; all below is walked where it is
read. Filters on is_test and on the beginning of file_path are pushed: folders and files that they rule out
are neither walked nor opened.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, Not, StringStartsWith
from pyspark.sql.types import StructType

SCHEMA = "file_path string, full_path string, size_bytes long, mod_time timestamp, content_hash binary, content binary, error string, is_test boolean"
_ARROW = pa.schema(
    [("file_path", pa.string()), ("full_path", pa.string()), ("size_bytes", pa.int64()), ("mod_time", pa.timestamp("us", "UTC")), ("content_hash", pa.binary()), ("content", pa.binary()), ("error", pa.string()), ("is_test", pa.bool_())]
)
#: Folders above this depth are partitions of their own files, those at it of all below them.
DEPTH = 2
#: Rows and bytes of content after which a batch is passed on.
ROWS, BYTES = 256, 8 << 20


@dataclass
class Folder(InputPartition):
    path: str
    below: bool


def hidden(name: str, vendor: bool) -> bool:
    return name.startswith(".") and name not in (".", "..") or name == "vendor" and not vendor


class SourceTree(DataSource):
    """Options: path, suffix (.go), tests (true), vendor (false), depth, content (true; if false, content and hash are null)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        on = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.root, self.suffix = os.path.normpath(options["path"]), options.get("suffix", ".go")
        self.tests, self.vendor, self.content = on("tests", True), on("vendor", False), on("content", True)
        self.depth, self.prefix = int(options.get("depth", DEPTH)), ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case EqualTo(("is_test",), False) | Not(EqualTo(("is_test",), True)):
                    self.tests = False
                case StringStartsWith(("file_path",), prefix) if not self.prefix:
                    self.prefix = prefix
                case _:
                    yield f

    def _may_hold(self, folder: str) -> bool:
        """Whether paths below a folder can begin with the prefix."""
        below = "" if folder == self.root else os.path.relpath(folder, self.root) + "/"
        return below.startswith(self.prefix) or self.prefix.startswith(below)

    def _folders(self, folder: str) -> list[str]:
        with os.scandir(folder) as entries:
            inside = sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and not hidden(e.name, self.vendor))
        return [f for f in inside if self._may_hold(f)]

    def partitions(self) -> list[InputPartition]:
        if hidden(os.path.basename(self.root), self.vendor) or not os.path.isdir(self.root):
            return [Folder("", False)]
        out, level = [], [self.root]
        for depth in range(self.depth + 1):
            out += [Folder(f, depth == self.depth) for f in level]
            level = [x for f in level for x in self._readable(f)] if depth < self.depth else []
        return out

    def _readable(self, folder: str) -> list[str]:
        try:
            return self._folders(folder)
        except OSError:
            return []

    def _files(self, partition: Folder) -> Iterator[str]:
        left = [partition.path] if partition.path else []
        while left:
            folder = left.pop()
            try:
                with os.scandir(folder) as entries:
                    names = sorted(e.name for e in entries if not e.is_dir(follow_symlinks=False))
                left += self._folders(folder) if partition.below else []
            except OSError:  # as a folder that cannot be listed has no files for anyone
                continue
            for name in names:
                path = os.path.join(folder, name)
                if name.endswith(self.suffix) and (self.tests or not name.endswith(f"_test{self.suffix}")) and os.path.relpath(path, self.root).startswith(self.prefix) and not os.path.isdir(path):
                    yield path

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in self._files(partition):
            name, is_test = os.path.relpath(path, self.root), path.endswith(f"_test{self.suffix}")
            try:
                stat, data = os.stat(path), None
                if self.content:
                    with open(path, "rb") as f:
                        data = f.read()
                digest = hashlib.sha256(data).digest() if data is not None else None
                rows.append((name, path, stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc), digest, data, None, is_test))
                size += len(data or b"")
            except OSError as e:
                rows.append((name, path, None, None, None, None, str(e), is_test))
            if len(rows) >= ROWS or size >= BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """Files below root, a row each: path, stat, content, hash, error. The session's setting for filter pushdown is switched on."""
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("source_tree").option("path", root)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    return reader.load()
