"""Search operators: keyword scores, nearest vectors, rank fusion, hydration."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.functions import vector as V
from fathom.operators import segments

RRF_K = 60


def with_counts(rows: DataFrame, columns: list[str], terms: list[str]) -> DataFrame:
    """rows with their length in tokens over all columns (dl) and the count of each term (f0, f1, ...)."""
    each = [T.tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    toks = rows.withColumn("__tokens", F.array(*each))
    counts = {f"f{k}": reduce(add, [T.term_count(F.element_at("__tokens", c + 1), t) for c in range(len(columns))]) for k, t in enumerate(terms)}
    length = reduce(add, [F.size(F.element_at("__tokens", c + 1)) for c in range(len(columns))])
    return toks.withColumns({"dl": length} | counts).drop("__tokens")


def corpus_statistics(counted: DataFrame, terms: list[str]) -> DataFrame:
    """One row: rows, mean length, and how many rows have each term."""
    return counted.agg(F.count("*").alias("rows"), F.avg("dl").alias("mean"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(terms))])


def keyword_scores(rows: DataFrame, columns: list[str], terms: list[str], candidates=lambda df: df, digits: int = 9) -> DataFrame:
    """rows that hold every term, with bm25: lower is better.

    Statistics are over all rows; `candidates` then narrows. They are one row, so the join with them
    moves nothing. Counts need only ids and text columns: the scan is pruned to those.
    """
    if not terms:
        raise ValueError("a query needs a term")
    counted = with_counts(rows, columns, terms)
    stats = corpus_statistics(with_counts(rows.select(*columns), columns, terms), terms)
    found = candidates(counted).where(reduce(and_, [F.col(f"f{k}") > 0 for k in range(len(terms))])).crossJoin(F.broadcast(stats))
    part = lambda k: F.round(T.term_score(T.idf(F.col("rows"), F.col(f"n{k}")), F.col(f"f{k}"), F.col("dl"), F.col("mean")), 12)
    score = F.round(-reduce(add, map(part, range(len(terms)))), digits)
    return found.withColumn("bm25", score).drop("dl", "rows", "mean", *[f"{x}{k}" for k in range(len(terms)) for x in "fn"])


def top(rows: DataFrame, score: Column, limit: int, tie: str = "chunk_id") -> DataFrame:
    """The first `limit` rows by score, then id; no row for a limit that is not positive."""
    return rows.orderBy(score, F.col(tie)).limit(max(limit, 0))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows, already cut to a limit, with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def keyword_search(rows: DataFrame, columns: list[str], terms: list[str], limit: int, candidates=lambda df: df, min_relevance: float = 0.0) -> DataFrame:
    """(chunk_id, bm25, relevance_score): best first, cut to limit, and only then those below min_relevance go."""
    best = top(keyword_scores(rows, columns, terms, candidates), F.col("bm25").asc(), limit).select("chunk_id", "bm25")
    best = best.withColumn("relevance_score", T.relevance(F.col("bm25")))
    return best.where(F.col("relevance_score") >= min_relevance) if min_relevance > 0 else best


def indexed_search(index: segments.Index, terms: list[str], limit: int, candidates: DataFrame | None = None, min_relevance: float = 0.0) -> DataFrame:
    """keyword_search() over a stored index: no text is read, and only blocks of rows that may be among the best."""
    best = top(segments.plan_top(index, terms, limit, candidates).scored, F.col("bm25").asc(), limit)
    best = best.withColumn("relevance_score", T.relevance(F.col("bm25")))
    return best.where(F.col("relevance_score") >= min_relevance) if min_relevance > 0 else best


def vector_search(vectors: DataFrame, query: DataFrame, limit: int, min_relevance: float = 0.0) -> DataFrame:
    """(chunk_id, similarity) of vectors (chunk_id, vector) nearest to the one row of query (q); other lengths are skipped.

    Exact and brute force: one pass, partial top lists by task, min_relevance before the limit.
    """
    scored = vectors.crossJoin(F.broadcast(query)).where(F.size("vector") == F.size("q"))
    scored = scored.select("chunk_id", V.cosine(F.col("vector"), F.col("q")).alias("similarity"))
    if min_relevance > 0:
        scored = scored.where(F.col("similarity") >= min_relevance)
    return top(scored, F.col("similarity").desc(), limit)


def fuse(vector_ranks: DataFrame, text_ranks: DataFrame, k: int = RRF_K) -> DataFrame:
    """(chunk_id, rrf_score, rank): sums of 1 / (k + rank) over both lists of (chunk_id, rank); k = 0 means the default."""
    k = k or RRF_K
    both = vector_ranks.select("chunk_id", "rank").unionByName(text_ranks.select("chunk_id", "rank"))
    summed = both.groupBy("chunk_id").agg(F.round(F.sum(1 / (F.col("rank") + k)), 12).alias("rrf_score"))
    return ranked(summed, F.col("rrf_score").desc(), F.col("chunk_id"))


def hybrid_search(vector_hits: DataFrame, text_hits: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """(chunk_id, rrf_score, rank): the two arms, each fetched to twice the limit, fused and cut."""
    v = ranked(vector_hits, F.col("similarity").desc(), F.col("chunk_id"))
    t = ranked(text_hits, F.col("bm25").asc(), F.col("chunk_id"))
    return fuse(v, t, k).where(F.col("rank") <= limit)


def hydrate(hits: DataFrame, chunks: DataFrame, files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """hits with their chunk and file, and with their symbol where there is one; hits without a chunk or file go, ranks stay."""
    out = F.broadcast(hits).join(chunks, "chunk_id").join(files, "file_id")
    return out.join(symbols, "symbol_id", "left") if symbols is not None else out
