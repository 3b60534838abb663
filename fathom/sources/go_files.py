"""Source trees: discovery, reading, parsing, module files."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.sources.go_parser import parse_go
from fathom.sources.trees import read_tree

_READ = "file_path string, full_path string, size_bytes long, mod_time timestamp, content_hash binary, content binary, error string"
_SYMBOL = "name string, kind string, signature string, doc_comment string, receiver string, start_line int, start_col int, end_line int, end_col int"
_PARSED = f"file_path string, package string, imports array<struct<path:string,alias:string>>, symbols array<struct<{_SYMBOL.replace(' ', ':').replace(',:', ',')}>>, errors array<string>, lines int"


class PathProblem(ValueError):
    """A path that cannot be indexed."""


def check_path(path: str) -> str:
    """The path itself if it is absolute, a readable folder and has a .go file somewhere; else a PathProblem."""
    if not path:
        raise PathProblem("path is empty")
    if not os.path.isabs(path):
        raise PathProblem("path is not absolute")
    if not os.path.exists(path):
        raise PathProblem("path does not exist")
    if not os.path.isdir(path) or not os.access(path, os.R_OK | os.X_OK):
        raise PathProblem("path is not a readable folder")
    if not any(f.endswith(".go") for _, _, names in os.walk(path) for f in names):
        raise PathProblem("no Go file below the path")
    return path


def list_files(root: str, tests: bool = True, vendor: bool = False) -> list[str]:
    """Paths below root, in lexical order: .go files, without folders that are hidden or vendored."""
    hidden = lambda d: d.startswith(".") and d not in (".", "..") or d == "vendor" and not vendor
    if hidden(os.path.basename(os.path.normpath(root))):
        return []
    out = []
    for folder, folders, names in os.walk(root, followlinks=False):
        folders[:] = sorted(d for d in folders if not hidden(d))
        out += [os.path.join(folder, n) for n in names if n.endswith(".go") and (tests or not n.endswith("_test.go"))]
    return sorted(out)


def discover(spark: SparkSession, root: str, tests: bool = True, vendor: bool = False) -> DataFrame:
    """Files below root with content, hash and stat; executors read them, so root must be where they can see it.

    A file that cannot be read has an error and nothing else. An empty tree gives no rows.
    """
    return read_tree(spark, str(root), tests=tests, vendor=vendor).select(*[c.split(" ")[0] for c in _READ.split(", ")])


def parse(files: DataFrame) -> DataFrame:
    """(file_path, package, imports, symbols, errors, lines) of files (file_path, content)."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["file_path"], batch["content"]):
                text = bytes(content or b"").decode("utf-8", "replace")
                r = parse_go(text)
                rows.append((path, r.package, [{"path": p, "alias": a} for p, a in r.imports], r.symbols, r.errors, text.count("\n") + 1))
            yield pd.DataFrame(rows, columns=["file_path", "package", "imports", "symbols", "errors", "lines"])

    return files.select("file_path", "content").mapInPandas(run, _PARSED)


def go_mod(lines: DataFrame) -> DataFrame:
    """One row (module_name, go_version) from (line_no, value): the last line of each kind counts."""
    line = F.trim("value")
    last = lambda word: F.max_by(F.trim(F.regexp_extract(line, rf"^{word}\s+(.*)$", 1)), F.when(line.startswith(f"{word} "), F.col("line_no")))
    return lines.agg(last("module").alias("module_name"), last("go").alias("go_version"))
