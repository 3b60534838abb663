"""The search facade: request, modes, cache."""

from __future__ import annotations

import hashlib
import threading
import time
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fathom.functions import code
from fathom.functions import text as T
from fathom.functions.vector import local_embedding
from fathom.operators import filters as filtering
from fathom.operators import search as S
from fathom.operators.embedding import Provider, retry
from fathom.operators.filters import SearchFilters
from fathom.plans.results import StoredResults
from fathom.schema import MODES

MAX_LIMIT, DEFAULT_LIMIT, TTL, ENTRIES = 100, 10, 3600.0, 1000


@dataclass
class SearchRequest:
    query: str
    project_id: int = 0
    limit: int = DEFAULT_LIMIT
    mode: str = "hybrid"
    filters: SearchFilters | None = None
    rrf_k: int = S.RRF_K
    use_cache: bool = False
    ttl: float = TTL
    strict: bool = False

    def __post_init__(self):
        if not self.query:
            raise ValueError("empty query")
        if self.mode and self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")
        self.mode = self.mode or "hybrid"
        self.limit = DEFAULT_LIMIT if self.limit <= 0 else min(self.limit, MAX_LIMIT)
        self.rrf_k = self.rrf_k or S.RRF_K
        self.ttl = self.ttl or TTL

    def key(self) -> str:
        f = self.filters
        parts = [self.query, self.mode, str(self.project_id)]
        if f:
            parts += ["filters:" + ",".join(f.symbol_types), f.file_pattern, ",".join(f.ddd_patterns), ",".join(f.packages), f"{f.min_relevance:.2f}"]
        return hashlib.sha256("|".join([*parts, str(self.limit), str(self.rrf_k), *["strict"] * self.strict]).encode()).hexdigest()


def keys_of(query: Column, mode: Column, project: Column, filters: Column) -> Column:
    """SearchRequest.key() of rows; filters is a struct with fields of SearchFilters, or null."""

    @F.udf("string")
    def key(query, mode, project, filters):
        return SearchRequest(query, project, mode=mode, filters=SearchFilters(**filters.asDict()) if filters else None).key()

    return key(query, mode, project, filters)


@dataclass
class SearchResponse:
    results: list[Row]
    mode: str
    cache_hit: bool = False
    seconds: float = 0.0
    arms: list[str] = field(default_factory=list)


class ResultCache:
    """Least recently used results with a time to live; empty results are not kept."""

    def __init__(self, size: int = ENTRIES):
        self.size, self.lock, self.rows = size, threading.Lock(), OrderedDict()

    def get(self, key: str) -> list[Row] | None:
        with self.lock:
            found = self.rows.get(key)
            if found is None or found[0] < time.monotonic():
                self.rows.pop(key, None)
                return None
            self.rows.move_to_end(key)
            return list(found[1])

    def put(self, key: str, rows: list[Row], ttl: float) -> None:
        if rows:
            with self.lock:
                self.rows[key] = (time.monotonic() + ttl, list(rows))
                self.rows.move_to_end(key)
                while len(self.rows) > self.size:
                    self.rows.popitem(last=False)

    def clear(self) -> None:
        with self.lock:
            self.rows.clear()

    def resize(self, size: int) -> None:
        """Another capacity; the least recently used results above it go."""
        if size <= 0:
            raise ValueError("a cache holds one result at least")
        with self.lock:
            self.size = size
            while len(self.rows) > size:
                self.rows.popitem(last=False)


class Searcher:
    """Searches an index given as tables: chunks, files, embeddings, symbols, and the keyword indexes chunk_words and symbol_words.

    provider embeds queries; it must be the one that the vectors come from. Without one that is the local expression.
    """

    def __init__(self, tables: dict[str, DataFrame], cache: ResultCache | None = None, provider: Provider | None = None, stored: StoredResults | None = None, version: int = 0):
        self.tables, self.cache, self.provider, self.stored, self.version = tables, cache or ResultCache(), provider, stored, version

    def _candidates(self, request: SearchRequest) -> DataFrame:
        t = self.tables
        files = t["files"].where(F.col("project_id") == request.project_id).select(F.col("id").alias("file_id"), "file_path", "package_name")
        chunks = t["chunks"].select(F.col("id").alias("chunk_id"), "file_id", "symbol_id", "chunk_type")
        return filtering.apply(chunks.join(files, "file_id"), request.filters, t["symbols"]).select("chunk_id")

    def _vector_arm(self, request: SearchRequest, limit: int) -> DataFrame:
        stored = self.tables["embeddings"].where(F.col("provider") == (self.provider.name if self.provider else "local"))
        vectors = stored.select("chunk_id", "vector").join(self._candidates(request), "chunk_id", "left_semi")
        q = F.array(*map(F.lit, retry(lambda: self.provider.embed([request.query]))[0])).cast("array<float>") if self.provider else local_embedding(F.lit(request.query))
        query = vectors.sparkSession.range(1).select(q.alias("q"))
        return S.vector_search(vectors, query, limit, request.filters.min_relevance if request.filters else 0.0)

    def _text_arm(self, request: SearchRequest, limit: int) -> DataFrame:
        terms = T.query_terms(request.query, request.strict)
        if not terms:
            raise ValueError("the query has no term")
        return S.indexed_search(self.tables["chunk_words"], terms, limit, self._candidates(request), request.filters.min_relevance if request.filters else 0.0)

    def symbols(self, query: str, project_id: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """(symbol columns, bm25): symbols of a project by name, signature and comment, best first. Only the symbols found are read whole."""
        t = self.tables
        files = t["files"].where(F.col("project_id") == project_id).select(F.col("id").alias("file_id"))
        own = t["symbols"].select(F.col("id").alias("chunk_id"), "file_id").join(files, "file_id", "left_semi")
        best = S.indexed_search(t["symbol_words"], T.query_terms(query), limit, own).select(F.col("chunk_id").alias("id"), "bm25")
        return F.broadcast(best).join(t["symbols"], "id").orderBy("bm25", "id")  # at most `limit` rows

    def plan(self, request: SearchRequest) -> DataFrame:
        """One plan: hits (chunk_id, score, rank) joined with chunk, file and symbol."""
        if request.mode == "vector":
            hits = S.ranked(self._vector_arm(request, request.limit), F.col("similarity").desc(), F.col("chunk_id")).withColumnRenamed("similarity", "relevance_score")
        elif request.mode == "keyword":
            hits = S.ranked(self._text_arm(request, request.limit), F.col("bm25"), F.col("chunk_id")).drop("bm25")
        else:
            try:
                text = self._text_arm(request, 2 * request.limit)
            except T.QuerySyntaxError:
                raise
            except ValueError:  # a query without a term still has a vector
                if request.filters and request.filters.ddd_patterns:
                    self._candidates(request)
                text = None
            vector = self._vector_arm(request, 2 * request.limit)
            if text is None:
                hits = S.ranked(vector, F.col("similarity").desc(), F.col("chunk_id"))
                hits = hits.select("chunk_id", (1 / (F.col("rank") + request.rrf_k)).alias("relevance_score"), "rank").where(F.col("rank") <= request.limit)
            else:
                hits = S.hybrid_search(vector, text, request.limit, request.rrf_k).withColumnRenamed("rrf_score", "relevance_score")
        t = self.tables
        chunks = t["chunks"].select(F.col("id").alias("chunk_id"), "file_id", "symbol_id", "content", "chunk_type", "start_line", "end_line", code.context_text(F.col("context_before"), F.col("context_after")).alias("context"))
        files = t["files"].select(F.col("id").alias("file_id"), "file_path", "package_name")
        symbols = t["symbols"].select(F.col("id").alias("symbol_id"), F.struct(F.col("name"), F.col("kind"), F.col("signature"), F.col("scope")).alias("symbol"))
        return S.hydrate(hits, chunks, files, symbols).orderBy("rank")

    def search(self, request: SearchRequest) -> SearchResponse:
        """The rows of a request: with use_cache from this process's results, then from those stored for the snapshot by any process."""
        began, key = time.monotonic(), request.key()
        if request.use_cache:
            rows = self.cache.get(key)
            if rows is None and self.stored and (rows := self.stored.get(self.version, key)) is not None:
                self.cache.put(key, rows, request.ttl)
            if rows is not None:
                return SearchResponse(rows, request.mode, True, time.monotonic() - began)
        rows = self.plan(request).collect()  # at most 100
        if request.use_cache:
            self.cache.put(key, rows, request.ttl)
            if self.stored:
                self.stored.put(self.version, key, request.query, request.mode, rows, request.ttl)
        return SearchResponse(rows, request.mode, False, time.monotonic() - began)
