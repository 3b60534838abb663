"""The three entry points: index_codebase, search_code, get_status."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fathom import schema
from fathom.functions.text import sanitize_text
from fathom.operators import tables as T
from fathom.operators.embedding import Provider, from_env
from fathom.operators.filters import SearchFilters
from fathom.plans.index import index_tree, project_id
from fathom.plans.results import StoredResults
from fathom.plans.search import ResultCache, Searcher, SearchRequest
from fathom.plans.store import WORDS, IndexingInProgress, Store
from fathom.sources.go_files import PathProblem, check_path

# Error codes of the wire protocol, kinds that a search may name.
INVALID_PARAMS, INTERNAL, NOT_FOUND, IN_PROGRESS, NOT_INDEXED, EMPTY_QUERY = -32602, -32603, -32001, -32002, -32003, -32004
SEARCH_KINDS = ("function", "method", "struct", "interface", "type", "const", "var")


def flag(args: dict, name: str, default: bool) -> bool:
    """A boolean argument; what is missing or of another type is the default."""
    return args[name] if isinstance(args.get(name), bool) else default


def number(args: dict, name: str, default: float) -> float:
    """A numeric argument, likewise; booleans are no numbers."""
    value = args.get(name)
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) else default


def string(args: dict, name: str, default: str = "") -> str:
    """A string argument, likewise."""
    return args[name] if isinstance(args.get(name), str) else default


class ApiError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Engine:
    """The engine over one store. provider embeds chunks and queries; by default the environment decides, see embedding.from_env(). With keep_results results of searches are stored beside the snapshot and serve other processes too."""

    def __init__(self, spark: SparkSession, store_path: str, provider: Provider | None = None, keep_results: bool = False):
        self.spark, self.store, self.cache = spark, Store(spark, store_path), ResultCache()
        self.provider = provider or from_env()
        self.results = StoredResults(self.store) if keep_results else None
        self._read: tuple | None = None

    def search_symbols(self, args: dict) -> list[dict]:
        """Symbols of an indexed project that match all words of args["query"]."""
        path = self._path(args)
        project = self._project(path)
        if project is None:
            raise ApiError(NOT_INDEXED, "the project is not indexed")
        found = Searcher(self._tables(path), provider=self.provider).symbols(string(args, "query"), project["id"], int(number(args, "limit", 10)))
        return [r.asDict() for r in found.select("name", "kind", "signature", "scope", "bm25").collect()]

    def _tables(self, path: str) -> dict:
        """A project's tables in the latest snapshot, and the keyword indexes. Tables are made anew once another writer, maybe in another process, has committed; then results kept so far go."""
        version = (self.store.versions() or [0])[-1]
        if self._read and self._read[0] != version:
            self._read = None
            self.cache.clear()
        if self._read is None:
            self._read = (version, self.store.snapshot(), {})
        _, snapshot, by_path = self._read
        if path not in by_path:
            pid = project_id(self.spark, path)
            by_path[path] = self.store.read(snapshot=snapshot, project=pid) | {n: self.store.index(snapshot, n) for n in WORDS}
        return by_path[path]

    def _path(self, args: dict) -> str:
        try:
            return check_path(string(args, "path"))
        except PathProblem as e:
            raise ApiError(NOT_FOUND if "no Go file" in str(e) else INVALID_PARAMS, str(e)) from e

    def _project(self, path: str):
        return next(iter(self._tables(path)["projects"].where(F.col("root_path") == path).limit(1).collect()), None)

    def index_codebase(self, args: dict) -> dict:
        path, began = self._path(args), time.monotonic()
        try:
            s = index_tree(self.spark, self.store, path, flag(args, "force_reindex", False), flag(args, "include_tests", True), flag(args, "include_vendor", False), flag(args, "prune", False), self.provider)
        except IndexingInProgress as e:
            raise ApiError(IN_PROGRESS, "indexing is in progress") from e
        self._read = None
        self.cache.clear()
        out = {"indexed": True, "files_indexed": s.files_indexed, "files_skipped": s.files_skipped, "files_failed": s.files_failed, "symbols_extracted": s.symbols_extracted, "chunks_created": s.chunks_created, "duration_ms": int((time.monotonic() - began) * 1000)}
        if s.errors:
            out["errors"] = s.errors[:5]
            if len(s.errors) > 5:
                out["error_count"] = len(s.errors)
        return out

    def _filters(self, given: dict | None) -> SearchFilters | None:
        if not given:
            return None
        for k in given.get("symbol_types", []):
            if k not in SEARCH_KINDS:
                raise ApiError(INVALID_PARAMS, f"unknown symbol type {k}")
        for p in given.get("ddd_patterns", []):
            if p not in schema.PATTERNS:
                raise ApiError(INVALID_PARAMS, f"unknown pattern {p}")
        least = float(number(given, "min_relevance", 0.0))
        if not 0 <= least <= 1:
            raise ApiError(INVALID_PARAMS, "min_relevance lies between 0 and 1")
        return SearchFilters(list(given.get("symbol_types", [])), string(given, "file_pattern"), list(given.get("ddd_patterns", [])), list(given.get("packages", [])), least, flag(given, "resolve_kinds", False))

    def search_code(self, args: dict) -> dict:
        path, query = self._path(args), string(args, "query").strip()
        if not query:
            raise ApiError(EMPTY_QUERY, "the query is empty")
        project = self._project(path)
        if project is None:
            raise ApiError(NOT_INDEXED, "the project is not indexed")
        limit, mode = int(number(args, "limit", 10)), string(args, "search_mode", "hybrid")
        if not 1 <= limit <= 100:
            raise ApiError(INVALID_PARAMS, "limit lies between 1 and 100")
        if mode not in schema.MODES:
            raise ApiError(INVALID_PARAMS, f"unknown mode {mode}")
        filters = self._filters(args.get("filters"))
        try:
            response = Searcher(self._tables(path), self.cache, self.provider, self.results, self._read[0]).search(SearchRequest(sanitize_text(query), project["id"], limit, mode, filters, use_cache=True))
        except ValueError as e:
            raise ApiError(INTERNAL, str(e)) from e
        results = [
            {"rank": r["rank"], "relevance_score": r["relevance_score"], "symbol": r["symbol"].asDict() if r["symbol"] else None, "content": r["content"], "context": r["context"],
             "file": {"path": r["file_path"], "package": r["package_name"], "start_line": r["start_line"], "end_line": r["end_line"]}}
            for r in response.results
        ]
        return {"query": query, "search_mode": mode, "results": results, "statistics": {"total_results": len(results), "returned_results": len(results), "search_duration_ms": int(response.seconds * 1000), "cache_hit": response.cache_hit}}

    def get_status(self, args: dict) -> dict:
        path = self._path(args)
        project = self._project(path)
        if project is None:
            return {"indexed": False, "path": path, "message": "The project has not been indexed."}
        t, mine = self._tables(path), F.col("project_id") == project["id"]
        files = t["files"].where(mine).select(F.col("id").alias("file_id"), "project_id")
        chunks = t["chunks"].select("id", "file_id").join(files, "file_id")
        vectors = t["embeddings"].select(F.col("chunk_id").alias("id")).join(chunks, "id")
        n = T.counts_by(files, "project_id", {"files": files, "symbols": t["symbols"].select("file_id").join(files, "file_id"), "chunks": chunks, "embeddings": vectors}).first()
        count = lambda k: n[k] if n else 0
        everywhere = self.store.read()["chunks"]  # the index is over all projects
        indexed = t["chunk_words"].corpus.select(F.col("rows").alias("indexed")).crossJoin(everywhere.agg(F.count("*").alias("chunks")))
        flags = T.health(indexed.withColumn("embeddings", F.lit(count("embeddings")))).select("database_accessible", "embeddings_available", "fts_indexes_built")
        return {
            "indexed": True,
            "project": {"path": path, "module": project["module_name"], "go_version": project["go_version"], "last_indexed_at": project["last_indexed_at"].strftime("%Y-%m-%dT%H:%M:%SZ")},
            "statistics": {"files_count": count("files"), "symbols_count": count("symbols"), "chunks_count": count("chunks"), "embeddings_count": count("embeddings"), "index_size_mb": f"{self.store.bytes() / (1 << 20):.2f}"},
            "health": flags.first().asDict(),
        }
