"""The catalogue of queries over the driver's tables, each with its DuckDB counterpart.

Parameters are fixed so that both sides agree. Each query is registered with its SQL by @query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom import schema
from fathom.functions import code, text, vector
from fathom.operators import chunking, embedding, migrations, postings, vector_cells
from fathom.operators import search as S
from fathom.operators import tables as T
from fathom.operators.filters import SearchFilters, apply
from fathom.sources import adapters as A
from fathom.sources.trees import read_tree
from fathom.streaming.watch import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TERMS = ["that", "esat"]
LIMIT = 10
FOLD = "strip_accents(lower({}))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _tok(column: str) -> str:
    return f"regexp_extract_all({FOLD.format(column)}, '[\\p{{L}}\\p{{N}}]+')"


def _count(toks: str, term: str) -> str:
    words = term.split(" ")
    if len(words) == 1:
        return f"len(list_filter({toks}, lambda x: x = '{term}'))"
    same = " AND ".join(f"{toks}[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"len(list_filter(range(1, len({toks}) - {len(words) - 2}), lambda i: {same}))"


def bm25_sql(terms: list[str], source: str = "SELECT doc_id AS chunk_id, lang AS package_name, source || '/' || lang || '/' || doc_id || '.txt' AS file_path, text AS c0 FROM documents", columns: int = 1, where: str = "true") -> str:
    """Common table expressions up to scored(chunk_id, ..., bm25)."""
    toks = ", ".join(f"{_tok(f'c{c}')} AS t{c}" for c in range(columns))
    dl = " + ".join(f"len(t{c})" for c in range(columns))
    fs = ", ".join(" + ".join(_count(f"t{c}", t) for c in range(columns)) + f" AS f{k}" for k, t in enumerate(terms))
    ns = ", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(len(terms)))
    idf = lambda k: f"CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) > 0 THEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) ELSE 1e-6 END"
    part = " + ".join(f"round(({idf(k)}) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / a)), 12)" for k in range(len(terms)))
    every = " AND ".join(f"f{k} > 0" for k in range(len(terms)))
    return f"""WITH raw AS ({source}), toks AS (SELECT *, {toks} FROM raw), d AS (SELECT *, {dl} AS dl, {fs} FROM toks),
        s AS (SELECT count(*) AS n, avg(dl) AS a, {ns} FROM d),
        scored AS (SELECT d.*, round(-({part}), 9) AS bm25 FROM d, s WHERE {every} AND {where})"""


def _keyword(spark: SparkSession, sf_dir: str, terms: list[str] = TERMS, limit: int = LIMIT, filters: SearchFilters | None = None, **more) -> DataFrame:
    """Through the written index; without filters only its postings are read."""
    candidates = apply(A.whole_chunks(spark, sf_dir), filters) if filters else None
    return S.indexed_search(A.keyword_index(spark, sf_dir), terms, limit, candidates, **more)


@query(f"SELECT count(*) AS rows, sum(len({_tok('text')}))::BIGINT AS tokens FROM documents")
def keyword_index_corpus(spark, sf_dir):
    """The one row of statistics; the first query of a session over a folder writes the index."""
    return A.keyword_index(spark, sf_dir).corpus


@query(f"WITH t AS (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS chunks, count(*) AS places FROM t GROUP BY term HAVING count(DISTINCT doc_id) >= 20")
def keyword_index_terms(spark, sf_dir):
    p = A.keyword_index(spark, sf_dir).live("postings").where("term <> ''")
    return p.groupBy("term").agg(F.count("*").alias("chunks"), F.sum(F.size("positions")).alias("places")).where("chunks >= 20")


TOP = f"SELECT chunk_id, bm25 FROM scored ORDER BY bm25, chunk_id LIMIT {LIMIT}"


@query(f"{bm25_sql(TERMS)} {TOP}")
def keyword_bm25_topk(spark, sf_dir):
    return _keyword(spark, sf_dir).select("chunk_id", "bm25")


@query(f"{bm25_sql(TERMS)}, b AS ({TOP}) SELECT chunk_id, row_number() OVER (ORDER BY bm25, chunk_id) AS rank, round(1 / (1 + abs(bm25) / 50), 9) AS relevance_score FROM b")
def keyword_normalized_score(spark, sf_dir):
    best = S.ranked(_keyword(spark, sf_dir), F.col("bm25"), F.col("chunk_id"))
    return best.select("chunk_id", "rank", F.round("relevance_score", 9).alias("relevance_score"))


@query(f"{bm25_sql(TERMS)}, b AS ({TOP}) SELECT chunk_id, bm25 FROM b WHERE 1 / (1 + abs(bm25) / 50) >= 0.875")
def keyword_min_relevance_after_limit(spark, sf_dir):
    return _keyword(spark, sf_dir, min_relevance=0.875).select("chunk_id", "bm25")


@query(f"{bm25_sql(TERMS)} {TOP}")
def keyword_postings_topk(spark, sf_dir):
    """After an update of the written index: a tenth of the rows replaced by themselves."""
    rows = A.whole_chunks(spark, sf_dir).where("chunk_id % 10 = 0")
    return S.top(postings.scores(postings.update(A.keyword_index(spark, sf_dir).tables(), rows, ["content"]), TERMS), F.col("bm25"), LIMIT)


REPLACED = "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 10 = 0 THEN replace(text, 'that', 'esat') ELSE text END AS c0 FROM documents"


@query(f"{bm25_sql(TERMS, REPLACED)} {TOP}")
def keyword_replaced_topk(spark, sf_dir):
    """After a tenth of the rows got other texts: the index has a second segment and deletions, its first segment is as it was."""
    old = A.whole_chunks(spark, sf_dir).where("chunk_id % 10 = 0").select("chunk_id", "content")
    new = old.withColumn("content", F.replace("content", F.lit("that"), F.lit("esat")))
    return S.indexed_search(A.keyword_index(spark, sf_dir).replace(old, new, ["content"]), TERMS, LIMIT).select("chunk_id", "bm25")


@query(f"{bm25_sql(['the', 'of'])} {TOP}")
def keyword_common_topk(spark, sf_dir):
    """Words that most rows have: blocks of rows that cannot be among the best are not read."""
    return _keyword(spark, sf_dir, ["the", "of"]).select("chunk_id", "bm25")


@query(f"{bm25_sql(TERMS)} {TOP}")
def keyword_scan_topk(spark, sf_dir):
    """Without an index: every text is tokenized."""
    return S.keyword_search(A.whole_chunks(spark, sf_dir), ["content"], TERMS, LIMIT).select("chunk_id", "bm25")


THREE = ["that", "the", "esat"]


@query(f"{bm25_sql(THREE)} SELECT chunk_id, bm25 FROM scored")
def keyword_multi_term_and(spark, sf_dir):
    return postings.scores(A.keyword_index(spark, sf_dir).tables(), THREE)


@query(f"{bm25_sql(['que'], where='package_name IN (' + chr(39) + 'es' + chr(39) + ')')} {TOP}")
def keyword_package_filter(spark, sf_dir):
    return _keyword(spark, sf_dir, ["que"], filters=SearchFilters(packages=["es"])).select("chunk_id", "bm25")


@query(f"{bm25_sql(['of the'])} SELECT chunk_id, bm25 FROM scored")
def phrase_match(spark, sf_dir):
    return postings.scores(A.keyword_index(spark, sf_dir).tables(), text.query_terms("of_the"))


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] * {b}[i])::DOUBLE))"


def _sim(v: str = "v", q: str = "q") -> str:
    return f"CASE WHEN len({v}) <> len({q}) OR {_dot(v, v)} = 0 OR {_dot(q, q)} = 0 THEN 0.0 ELSE {_dot(v, q)} / (sqrt({_dot(v, v)}) * sqrt({_dot(q, q)})) END"


Q_CTE = "qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
V_TOP = f"WITH {Q_CTE} SELECT vec_id AS chunk_id, round({_sim('embedding')}, 9) AS similarity FROM embeddings, qv WHERE {{where}} ORDER BY {_sim('embedding')} DESC, vec_id LIMIT {{limit}}"


def _nearest(spark, sf_dir, vectors=None, limit: int = LIMIT, **more) -> DataFrame:
    found = S.vector_search(A.vectors(spark, sf_dir) if vectors is None else vectors, A.query_vector(spark, sf_dir), limit, **more)
    return found.select("chunk_id", F.round("similarity", 9).alias("similarity"))


@query(V_TOP.format(where="true", limit=LIMIT))
def vector_cosine_topk(spark, sf_dir):
    return _nearest(spark, sf_dir)


@query(V_TOP.format(where="true", limit=LIMIT))
def vector_cells_topk(spark, sf_dir):
    """The same from vectors stored by cell: cells that cannot hold one of the nearest are not read."""
    q = A.query_vector(spark, sf_dir).first()["q"]
    return vector_cells.nearest(A.cells(spark, sf_dir), q, LIMIT).select("chunk_id", F.round("similarity", 9).alias("similarity"))


@query(V_TOP.format(where=f"{_sim('embedding')} >= 0.2", limit=LIMIT))
def vector_min_relevance(spark, sf_dir):
    return _nearest(spark, sf_dir, min_relevance=0.2)


@query(V_TOP.format(where="label IN (1, 3)", limit=LIMIT))
def vector_filtered_label(spark, sf_dir):
    return _nearest(spark, sf_dir, A.vectors(spark, sf_dir).where(F.col("label").isin(1, 3)))


@query(f"WITH {Q_CTE}, v AS (SELECT vec_id AS chunk_id, embedding AS v FROM embeddings UNION ALL SELECT vec_id + 1000000000, embedding[1:32] FROM embeddings) SELECT chunk_id, round({_sim()}, 9) AS similarity FROM v, qv WHERE len(v) = len(q) ORDER BY {_sim()} DESC, chunk_id LIMIT {LIMIT}")
def vector_dimension_mismatch(spark, sf_dir):
    v = A.vectors(spark, sf_dir).drop("label")
    short = v.select((F.col("chunk_id") + 1_000_000_000).alias("chunk_id"), F.slice("vector", 1, 32).alias("vector"))
    return _nearest(spark, sf_dir, v.unionByName(short))


@query(f"WITH {Q_CTE}, v AS (SELECT vec_id AS chunk_id, embedding AS v FROM embeddings UNION ALL SELECT vec_id + 1000000000, list_transform(embedding, lambda x: 0::FLOAT) FROM embeddings) SELECT chunk_id, round({_sim()}, 6) AS similarity FROM v, qv")
def vector_zero_norm(spark, sf_dir):
    v = A.vectors(spark, sf_dir).drop("label")
    zero = v.select((F.col("chunk_id") + 1_000_000_000).alias("chunk_id"), F.transform("vector", lambda x: F.lit(0.0).cast("float")).alias("vector"))
    both = v.unionByName(zero).crossJoin(F.broadcast(A.query_vector(spark, sf_dir)))
    return both.select("chunk_id", F.round(vector.cosine(F.col("vector"), F.col("q")), 6).alias("similarity"))


@query(f"SELECT vec_id AS chunk_id, round((embedding[1] / sqrt({_dot('embedding', 'embedding')})::FLOAT)::DOUBLE, 5) AS first, round((embedding[64] / sqrt({_dot('embedding', 'embedding')})::FLOAT)::DOUBLE, 5) AS last, len(embedding)::BIGINT AS dimension FROM embeddings")
def vector_l2_normalize(spark, sf_dir):
    v = A.vectors(spark, sf_dir).select("chunk_id", vector.normalize(F.col("vector")).alias("v"))
    at = lambda k: F.round(F.element_at("v", k).cast("double"), 5)
    return v.select("chunk_id", at(1).alias("first"), at(64).alias("last"), F.size("v").cast("long").alias("dimension"))


def _rrf_sql(k: int, limit: int, terms: list[str] = TERMS, cut: int | None = None) -> str:
    return f"""{bm25_sql(terms)}, {Q_CTE},
        v0 AS (SELECT vec_id AS chunk_id, {_sim('embedding')} AS s FROM embeddings, qv ORDER BY s DESC, chunk_id LIMIT {limit}),
        t0 AS (SELECT chunk_id, bm25 FROM scored ORDER BY bm25, chunk_id LIMIT {limit}),
        r AS (SELECT chunk_id, row_number() OVER (ORDER BY s DESC, chunk_id) AS k FROM v0 UNION ALL SELECT chunk_id, row_number() OVER (ORDER BY bm25, chunk_id) FROM t0),
        g AS (SELECT chunk_id, round(sum(1.0::DOUBLE / ({k} + k)), 12) AS x FROM r GROUP BY chunk_id),
        fused AS (SELECT chunk_id, x, row_number() OVER (ORDER BY x DESC, chunk_id) AS rank FROM g){f', cut AS (SELECT * FROM fused WHERE rank <= {cut})' if cut else ''}"""


def _arms(spark, sf_dir, limit: int, terms: list[str] = TERMS) -> tuple[DataFrame, DataFrame]:
    return S.vector_search(A.vectors(spark, sf_dir), A.query_vector(spark, sf_dir), limit), _keyword(spark, sf_dir, terms, limit)


def _fused(spark, sf_dir, k: int, limit: int, terms: list[str] = TERMS, cut: int | None = None) -> DataFrame:
    out = S.hybrid_search(*_arms(spark, sf_dir, limit, terms), cut or 2 * limit, k)
    return out.select("chunk_id", F.round("rrf_score", 9).alias("rrf_score"), "rank")


@query(f"{_rrf_sql(60, 20)} SELECT chunk_id, round(x, 9) AS rrf_score, rank FROM fused")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir, 60, 20)


@query(f"{_rrf_sql(30, 20)} SELECT chunk_id, round(x, 9) AS rrf_score, rank FROM fused")
def rrf_custom_k(spark, sf_dir):
    return _fused(spark, sf_dir, 30, 20)


@query(f"{_rrf_sql(60, 2 * LIMIT, cut=LIMIT)} SELECT chunk_id, rank, round(x, 9) AS relevance_score, file_path, package_name, c0 AS content FROM cut JOIN raw USING (chunk_id)")
def hybrid_search_topk(spark, sf_dir):
    hits = _fused(spark, sf_dir, 60, 2 * LIMIT, cut=LIMIT)
    chunks = A.whole_chunks(spark, sf_dir).select("chunk_id", "file_id", "content")
    files = A.files(spark, sf_dir).select("file_id", "file_path", "package_name")
    return S.hydrate(hits, chunks, files).select("chunk_id", "rank", F.col("rrf_score").alias("relevance_score"), "file_path", "package_name", "content")


@query(f"{_rrf_sql(60, 2 * LIMIT, ['zzznone'], LIMIT)} SELECT chunk_id, rank, round(x, 9) AS rrf_score FROM cut")
def hybrid_one_arm_empty(spark, sf_dir):
    return _fused(spark, sf_dir, 60, 2 * LIMIT, ["zzznone"], LIMIT).select("chunk_id", "rank", "rrf_score")


@query(f"{_rrf_sql(60, 2 * LIMIT, cut=LIMIT)} SELECT cut.chunk_id, rank, coalesce(quality, -1) AS symbol_quality, coalesce(toxic, -1) AS symbol_toxic, file_path, package_name || chr(10) || chr(10) || split_part(file_path, '/', 1) AS context FROM cut JOIN raw USING (chunk_id) LEFT JOIN labels ON doc_id = cut.chunk_id")
def hydrate_results(spark, sf_dir):
    hits = _fused(spark, sf_dir, 60, 2 * LIMIT, cut=LIMIT)
    chunks = A.whole_chunks(spark, sf_dir).select("chunk_id", "file_id", "symbol_id", "package_name", "project")
    symbols = A.symbols(spark, sf_dir).select(F.col("id").alias("symbol_id"), F.col("quality").alias("symbol_quality"), F.col("toxic").alias("symbol_toxic"))
    out = S.hydrate(hits, chunks, A.files(spark, sf_dir).select("file_id", "file_path"), symbols)
    missing = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return out.select("chunk_id", "rank", missing("symbol_quality"), missing("symbol_toxic"), "file_path", code.context_text(F.col("package_name"), F.col("project")).alias("context"))


def _flagged(spark, sf_dir) -> DataFrame:
    flags = A.symbols(spark, sf_dir).select("id", (F.col("quality") == 0).alias("is_service"), (F.col("toxic") == 1).alias("is_handler"))
    return flags


@query("SELECT doc_id AS chunk_id, lang AS package_name FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1)")
def ddd_filter_semi(spark, sf_dir):
    found = apply(A.whole_chunks(spark, sf_dir), SearchFilters(ddd_patterns=["service", "handler"]), _flagged(spark, sf_dir))
    return found.select("chunk_id", "package_name")


PATH = "source || '/' || lang || '/' || doc_id || '.txt'"


@query(f"SELECT doc_id AS chunk_id, {PATH} AS file_path FROM documents WHERE {PATH} GLOB 'src1*/[ed]*/?*5.txt'")
def glob_filter(spark, sf_dir):
    return apply(A.whole_chunks(spark, sf_dir), SearchFilters(file_pattern="src1*/[ed]*/?*5.txt")).select("chunk_id", "file_path")


@query(f"""WITH {Q_CTE}, c AS (SELECT doc_id FROM documents WHERE doc_id % 6 IN (0, 1, 3) AND lang IN ('en', 'de') AND {PATH} GLOB 'src*.txt' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1))
    SELECT vec_id AS chunk_id, round({_sim('embedding')}, 9) AS similarity FROM embeddings JOIN c ON doc_id = vec_id, qv WHERE {_sim('embedding')} >= 0.02 ORDER BY {_sim('embedding')} DESC, vec_id LIMIT {LIMIT}""")
def combined_filters(spark, sf_dir):
    filters = SearchFilters(symbol_types=["function", "struct", "package"], file_pattern="src*.txt", ddd_patterns=["service", "handler"], packages=["en", "de"], min_relevance=0.02, resolve_kinds=True)
    chunks = apply(A.whole_chunks(spark, sf_dir), filters, _flagged(spark, sf_dir)).select("chunk_id")
    return _nearest(spark, sf_dir, A.vectors(spark, sf_dir).join(chunks, "chunk_id", "left_semi"), min_relevance=filters.min_relevance)


PART = "SELECT p_partkey AS chunk_id, p_name AS c0, p_brand AS c1, p_type AS c2 FROM part"


@query(f"{bm25_sql(['economy', 'ring'], PART, 3)} {TOP}")
def symbol_search_bm25(spark, sf_dir):
    """From the postings of all three columns; the texts are not read."""
    return S.indexed_search(A.symbol_index(spark, sf_dir), ["economy", "ring"], LIMIT).select("chunk_id", "bm25")


@query(f"SELECT doc_id AS file_id, {PATH} AS file_path, sha256(text) AS content_hash, strlen(text)::BIGINT AS size_bytes FROM documents WHERE source = 'src0' ORDER BY file_path")
def list_files_ordered(spark, sf_dir):
    f = A.files(spark, sf_dir).select("project", "file_id", "file_path", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"))
    return T.listing(f, "project", "src0", "file_path").drop("project")


@query(f"SELECT doc_id AS file_id, {PATH} AS file_path FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id = 7)")
def point_lookup_hash(spark, sf_dir):
    f = A.files(spark, sf_dir).withColumn("content_hash", F.sha2("text", 256))
    wanted = T.rows_where(f, file_id=7).first()["content_hash"]
    return T.rows_where(f, content_hash=wanted).select("file_id", "file_path")


STATUS_SQL = """WITH f AS (SELECT source AS project, count(*) AS files FROM documents GROUP BY 1),
    s AS (SELECT source AS project, count(*) AS symbols FROM labels JOIN documents USING (doc_id) GROUP BY 1),
    c AS (SELECT source AS project, sum(len(string_split(text, chr(10))))::BIGINT AS chunks FROM documents GROUP BY 1),
    e AS (SELECT source AS project, count(*) AS embeddings FROM embeddings JOIN documents ON doc_id = vec_id GROUP BY 1),
    st AS (SELECT project, files, coalesce(symbols, 0) AS symbols, coalesce(chunks, 0) AS chunks, coalesce(embeddings, 0) AS embeddings FROM f LEFT JOIN s USING (project) LEFT JOIN c USING (project) LEFT JOIN e USING (project))"""


def _status(spark, sf_dir) -> DataFrame:
    files = A.files(spark, sf_dir)
    owner = files.select(F.col("file_id").alias("id"), "project")
    lines = files.groupBy("project").agg(F.sum(F.size(F.split("text", "\n", -1))).cast("long").alias("chunks"))
    counted = T.counts_by(files, "project", {"files": files, "symbols": A.symbols(spark, sf_dir).join(owner, "id"), "embeddings": A.vectors(spark, sf_dir).select(F.col("chunk_id").alias("id")).join(owner, "id")})
    return counted.join(lines, "project", "left").select("project", "files", "symbols", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), "embeddings")


@query(f"{STATUS_SQL} SELECT * FROM st")
def status_counts(spark, sf_dir):
    return _status(spark, sf_dir)


@query(f"{STATUS_SQL} SELECT project, true AS database_accessible, embeddings > 0 AS embeddings_available, true AS fts_indexes_built FROM st")
def status_health_flags(spark, sf_dir):
    owner = A.files(spark, sf_dir).select(F.col("file_id").alias("chunk_id"), "project")
    indexed = A.keyword_index(spark, sf_dir).live("lengths").join(owner, "chunk_id").groupBy("project").agg(F.count("*").alias("indexed"))
    whole = _status(spark, sf_dir).drop("chunks").withColumnRenamed("files", "chunks").join(indexed, "project", "left")
    return T.health(whole).select("project", "database_accessible", "embeddings_available", "fts_indexes_built")


@query(f"{STATUS_SQL} SELECT project, files AS total_files, chunks AS total_chunks FROM st")
def project_totals(spark, sf_dir):
    return _status(spark, sf_dir).select("project", F.col("files").alias("total_files"), F.col("chunks").alias("total_chunks"))


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Old: the documents. New: those with a label, with other text if toxic, and the pages."""
    docs = A.read(spark, sf_dir, "documents")
    old = docs.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"), F.lit(1).alias("created"))
    labelled = docs.join(A.read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    seen = labelled.select((F.col("doc_id") + 1_000_000_000).alias("file_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("file_path"), F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"), F.lit(2).alias("created"))
    fresh = A.read(spark, sf_dir, "pages").select((F.col("page_id") + 2_000_000_000).alias("file_id"), F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("file_path"), F.col("html").alias("content"), F.lit(2).alias("created"))
    return old, seen.unionByName(fresh)


SNAPSHOTS = """WITH old AS (SELECT doc_id AS file_id, 'd/' || doc_id AS file_path, text AS content, 1 AS created FROM documents),
    new AS (SELECT doc_id + 1000000000 AS file_id, 'd/' || doc_id AS file_path, CASE WHEN toxic = 1 THEN text || '!' ELSE text END AS content, 2 AS created FROM documents JOIN labels USING (doc_id)
        UNION ALL SELECT page_id + 2000000000, 'p/' || page_id, html, 2 FROM pages)"""


@query(f"{SNAPSHOTS} SELECT coalesce(old.file_id, new.file_id) AS file_id, file_path, md5(coalesce(new.content, old.content)) AS content, coalesce(old.created, new.created) AS created FROM old FULL JOIN new USING (file_path)")
def upsert_merge_files(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    merged = T.merge(old, new, ["file_path"], keep=["file_id", "created"])
    return merged.select("file_id", "file_path", F.md5("content").alias("content"), "created")


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, md5(arg_max(text, turn)) AS content FROM conversations GROUP BY conv_id")
def upsert_last_writer_wins(spark, sf_dir):
    last = T.last_writer(A.read(spark, sf_dir, "conversations"), ["conv_id"], "turn")
    return last.select("conv_id", "turn", "role", F.md5("text").alias("content"))


@query("""WITH new AS (SELECT vec_id AS chunk_id, label + 100 AS label, len(embedding)::BIGINT AS dimension FROM embeddings WHERE label = 3 UNION ALL SELECT doc_id + 1000000000, 200, 0 FROM labels)
    SELECT vec_id AS chunk_id, label, len(embedding)::BIGINT AS dimension FROM embeddings WHERE vec_id NOT IN (SELECT chunk_id FROM new) UNION ALL SELECT * FROM new""")
def upsert_embeddings(spark, sf_dir):
    old = A.vectors(spark, sf_dir).select("chunk_id", "label", F.size("vector").cast("long").alias("dimension"))
    more = A.symbols(spark, sf_dir).select((F.col("id") + 1_000_000_000).alias("chunk_id"), F.lit(200).alias("label"), F.lit(0).cast("long").alias("dimension"))
    new = old.where("label = 3").withColumn("label", F.col("label") + 100).unionByName(more)
    return T.replace(old, new, ["chunk_id"])


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS deleted, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS remaining")
def delete_batch_count(spark, sf_dir):
    chunks, ids = A.whole_chunks(spark, sf_dir).select("chunk_id"), A.symbols(spark, sf_dir).where("toxic = 1").select(F.col("id").alias("chunk_id"))
    left, deleted = T.delete_where_in(chunks, "chunk_id", ids)
    return left.agg(F.lit(deleted).cast("long").alias("deleted"), F.count("*").alias("remaining"))


@query("""WITH gone AS (SELECT doc_id FROM documents WHERE source = 'src0') SELECT 'files' AS table_name, (SELECT count(*) FROM documents WHERE doc_id NOT IN (FROM gone)) AS remaining
    UNION ALL SELECT 'symbols', (SELECT count(*) FROM labels WHERE doc_id NOT IN (FROM gone))
    UNION ALL SELECT 'chunks', (SELECT count(*) FROM documents WHERE doc_id NOT IN (FROM gone))
    UNION ALL SELECT 'embeddings', (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (FROM gone))""")
def cascade_delete_counts(spark, sf_dir):
    files = A.files(spark, sf_dir)
    tables = {
        "projects": files.select(F.col("project").alias("id")).distinct(),
        "files": files.select(F.col("file_id").alias("id"), F.col("project").alias("project_id")),
        "symbols": A.symbols(spark, sf_dir).select("id", F.col("id").alias("file_id")),
        "chunks": files.select(F.col("file_id").alias("id"), "file_id", F.lit(None).cast("long").alias("symbol_id")),
        "embeddings": A.vectors(spark, sf_dir).select(F.col("chunk_id").alias("id"), "chunk_id"),
    }
    left = T.cascade(tables, "projects", spark.createDataFrame([("src0",)], "id string"))
    counts = [left[t].agg(F.count("*").alias("remaining")).select(F.lit(t).alias("table_name"), "remaining") for t in ("files", "symbols", "chunks", "embeddings")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


STATUS = "CASE WHEN old.file_path IS NULL THEN 'new' WHEN new.file_path IS NULL THEN 'deleted' WHEN sha256(old.content) = sha256(new.content) THEN 'unchanged' ELSE 'changed' END"


@query(f"{SNAPSHOTS} SELECT coalesce(old.file_path, new.file_path) AS file_path, {STATUS} AS status FROM old FULL JOIN new ON old.file_path = new.file_path")
def incremental_diff(spark, sf_dir):
    return T.changes(*_snapshots(spark, sf_dir), "file_path", "content")


@query(f"""{SNAPSHOTS}, d AS (SELECT CASE WHEN length(new.content) > 9000 THEN 'failed' ELSE {STATUS} END AS status FROM old FULL JOIN new ON old.file_path = new.file_path)
    SELECT count(*) FILTER (status IN ('new', 'changed')) AS files_indexed, count(*) FILTER (status = 'unchanged') AS files_skipped, count(*) FILTER (status = 'deleted') AS files_deleted, count(*) FILTER (status = 'failed') AS files_failed FROM d""")
def index_statistics(spark, sf_dir):
    """Files over 9,000 characters stand for files that could not be read."""
    old, new = _snapshots(spark, sf_dir)
    d = T.changes(old, new.withColumn("error", F.when(F.length("content") > 9000, "too large")), "file_path", "content", "error")
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return d.agg(n("new", "changed").alias("files_indexed"), n("unchanged").alias("files_skipped"), n("deleted").alias("files_deleted"), n("failed").alias("files_failed"))


@query("SELECT doc_id AS file_id, md5(text) AS whole, CASE WHEN strlen(text) < 4004 THEN 1 END::INTEGER AS only_piece, 0::BIGINT AS over FROM documents")
def split_large_chunks(spark, sf_dir):
    """Chunks of over 1,000 tokens in pieces: joined they are the whole text again, and none of several lines is over the bound."""
    chunks = A.files(spark, sf_dir).select(F.col("file_id").alias("id"), F.col("text").alias("content"), F.lit(1).alias("start_line"))
    pieces = chunking.split_large(chunks)
    over = (F.floor(F.octet_length("content") / 4) > 1000) & F.contains("content", F.lit("\n"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "content"))), lambda x: x["content"]), "\n")
    own = pieces.groupBy("id").agg(F.md5(joined).alias("whole"), F.count("*").alias("n"), F.count_if(over).alias("over"), F.max(F.col("end_line").isNull()).alias("untouched"))
    return own.select(F.col("id").alias("file_id"), "whole", F.when(F.col("untouched"), F.col("n").cast("int")).alias("only_piece"), "over")


@query(f"SELECT {PATH} AS file_path, sha256(text) AS content_hash, strlen(text)::BIGINT AS size_bytes FROM documents WHERE source LIKE 'src1%'")
def source_tree_listing(spark, sf_dir):
    """Documents laid out as files, walked and read by executors; the filter on paths prunes folders."""
    tree = read_tree(spark, A.laid_out(spark, sf_dir), suffix=".txt", vendor=False)
    return tree.where(F.col("file_path").startswith("src1")).select("file_path", F.lower(F.hex("content_hash")).alias("content_hash"), "size_bytes")


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def orphan_chunks(spark, sf_dir):
    return T.without(A.whole_chunks(spark, sf_dir).select("chunk_id"), A.vectors(spark, sf_dir), "chunk_id")


@query("SELECT doc_id AS file_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS content FROM documents")
def chunk_by_line_range(spark, sf_dir):
    return A.files(spark, sf_dir).select("file_id", code.lines_between(F.col("text"), F.lit(2), F.lit(3)).alias("content"))


@query("""WITH l AS (SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS start_line FROM documents),
    s AS (SELECT * FROM l WHERE regexp_matches(content, '^[A-Z].*[.]$') AND strlen(content) <= 120)
    SELECT file_id, start_line, start_line AS end_line, 'function' AS chunk_type, md5(content) AS content FROM s
    UNION ALL SELECT doc_id, 1, len(string_split(text, chr(10)))::BIGINT, 'package', md5(text) FROM documents WHERE doc_id NOT IN (SELECT file_id FROM s)""")
def chunk_package_fallback(spark, sf_dir):
    """Documents as parsed files whose declarations are their short sentences."""
    line = lambda x, k: F.struct(
        x.alias("name"), F.lit("function").alias("kind"), F.lit("").alias("signature"), F.lit("").alias("doc_comment"), F.lit("").alias("receiver"),
        (k + 1).alias("start_line"), F.lit(1).alias("start_col"), (k + 1).alias("end_line"), F.lit(1).alias("end_col"),
    )
    lines = F.split("text", "\n", -1)
    own = F.filter(F.transform(lines, line), lambda s: s["name"].rlike("^[A-Z].*[.]$") & (F.octet_length(s["name"]) <= 120))
    parsed = A.files(spark, sf_dir).select("file_id", F.col("package_name").alias("package"), F.array().cast("array<struct<path:string,alias:string>>").alias("imports"), own.alias("symbols"), F.col("text").alias("content"), F.size(lines).alias("lines"))
    return chunking.chunks(parsed).select("file_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "chunk_type", F.md5("content").alias("content"))


@query("SELECT doc_id AS chunk_id, (strlen(text) + strlen(lang)) // 4 AS token_count FROM documents")
def token_count(spark, sf_dir):
    return A.whole_chunks(spark, sf_dir).select("chunk_id", code.token_count(F.col("content"), F.col("package_name")).cast("long").alias("token_count"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf_dir):
    hashed = A.whole_chunks(spark, sf_dir).select("chunk_id", F.lower(F.hex(code.content_hash(F.col("content")))).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("chunk_id").alias("first_id"))


@query("""SELECT r_name AS package_name, 'package ' || r_name || chr(10) || coalesce(chr(10) || 'import (' || chr(10) || string_agg(chr(9) || CASE WHEN n_nationkey < 10 THEN 'n' || n_nationkey || ' ' ELSE '' END || '"' || n_name || '"' || chr(10), '' ORDER BY n_name) || ')' || chr(10), '') AS context
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def package_context_text(spark, sf_dir):
    nation = A.read(spark, sf_dir, "nation")
    item = F.struct(F.col("n_name").alias("path"), F.when(F.col("n_nationkey") < 10, F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))).otherwise("").alias("alias"))
    imports = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list(item)).alias("imports"))
    out = A.read(spark, sf_dir, "region").join(imports, "r_regionkey", "left")
    return out.select(F.col("r_name").alias("package_name"), code.package_context(F.col("r_name"), F.coalesce("imports", F.array().cast("array<struct<path:string,alias:string>>"))).alias("context"))


@query("SELECT doc_id AS chunk_id, md5(concat_ws(chr(10) || chr(10), nullif(CASE WHEN lang = 'en' THEN '' ELSE source END, ''), text, nullif(CASE WHEN lang = 'de' THEN '' ELSE lang END, ''))) AS content FROM documents")
def full_content(spark, sf_dir):
    before = F.when(F.col("package_name") == "en", "").otherwise(F.col("project"))
    after = F.when(F.col("package_name") == "de", "").otherwise(F.col("package_name"))
    return A.whole_chunks(spark, sf_dir).select("chunk_id", F.md5(code.full_content(before, F.col("content"), after)).alias("content"))


@query("""SELECT doc_id AS chunk_id, 384::BIGINT AS dimension, round((('0x' || sha256(text)[1:2])::INT / 255)::FLOAT::DOUBLE, 6) AS first, round((('0x' || sha256(text)[63:64])::INT / 255)::FLOAT::DOUBLE, 6) AS last,
    round(list_sum(list_transform(range(0, 32), lambda i: (('0x' || sha256(text)[2 * i + 1:2 * i + 2])::INT / 255)::FLOAT::DOUBLE)), 6) AS total FROM documents""")
def local_embedding(spark, sf_dir):
    e = A.whole_chunks(spark, sf_dir).select("chunk_id", vector.local_embedding(F.col("content")).alias("v"))
    at = lambda k: F.round(F.element_at("v", k).cast("double"), 6)
    return e.select("chunk_id", F.size("v").cast("long").alias("dimension"), at(1).alias("first"), at(32).alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("SELECT conv_id AS batch_id, count(*) AS texts, bool_or(strlen(trim(text)) < 60) AS rejected FROM conversations GROUP BY conv_id")
def embedding_batch_validation(spark, sf_dir):
    short = F.octet_length(F.trim("text")) < 60  # stands for an empty text
    c = A.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch_id"), F.when(short, "").otherwise(F.col("text")).alias("content"))
    return embedding.validate(c)


@query("""SELECT conv_id, turn, sha256(text || '|' || CASE WHEN role = 'user' THEN 'hybrid' ELSE 'keyword' END || '|' || conv_id || CASE WHEN turn % 2 = 1 THEN '|filters:function,method|*.go||' || role || '|0.50' ELSE '' END || '|10|60') AS query_hash FROM conversations""")
def query_hash(spark, sf_dir):
    """Turns as requests: the key under which the engine keeps their results."""
    from fathom.plans.search import keys_of

    turns = A.read(spark, sf_dir, "conversations")
    filters = F.when(F.col("turn") % 2 == 1, F.struct(F.array(F.lit("function"), F.lit("method")).alias("symbol_types"), F.lit("*.go").alias("file_pattern"), F.array(F.col("role")).alias("packages"), F.lit(0.5).alias("min_relevance")))
    mode = F.when(F.col("role") == "user", "hybrid").otherwise("keyword")
    return turns.select("conv_id", "turn", keys_of(F.col("text"), mode, F.col("conv_id"), filters).alias("query_hash"))


@query(r"SELECT doc_id AS chunk_id, md5(trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_\s\-.]', ' ', 'g'), '\s+', ' ', 'g'))) AS sanitized FROM documents")
def sanitize_query(spark, sf_dir):
    return A.whole_chunks(spark, sf_dir).select("chunk_id", F.md5(text.sanitize(F.col("content"))).alias("sanitized"))


#: Endings that names of parts get in turn, so that each pattern has names that fit.
ENDINGS = ["Aggregate", "AggregateRoot", "ItemVO", "Command", "Query", "Repo", "Repository", "Service", "Handler", "ValueObject", "Cmd", "Entity", "", "List", "OrderX", "UserService"]
NAMED = f"SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '_' WHEN 2 THEN 'É' WHEN 3 THEN upper(p_name[1]) ELSE 'New' END || replace(replace(p_name, ' ', ''), '#', '') || ([{', '.join(f"'{e}'" for e in ENDINGS)}])[p_partkey % {len(ENDINGS)} + 1] AS name FROM part"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name) of parts: identifiers that begin in five ways and end in each of ENDINGS."""
    key, bare = F.col("p_partkey"), F.replace(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("#"), F.lit(""))
    head = F.element_at(F.array(F.lit(""), F.lit("_"), F.lit("É"), F.upper(F.substring("p_name", 1, 1)), F.lit("New")), (key % 5 + 1).cast("int"))
    return A.read(spark, sf_dir, "part").select(key.alias("id"), F.concat(head, bare, F.element_at(F.array(*map(F.lit, ENDINGS)), (key % len(ENDINGS) + 1).cast("int"))).alias("name"))


@query(f"""SELECT id, name, regexp_matches(name, '(Aggregate|AggregateRoot)$') AS is_aggregate_root,
    regexp_matches(name, '(Aggregate|AggregateRoot|Entity)$') OR regexp_matches(name, 'Order|User|Product|Account|Customer|Item') AND NOT regexp_matches(name, '(Service|Repository|Handler)$') AS is_entity,
    regexp_matches(name, '(VO|ValueObject)$') AS is_value_object, regexp_matches(name, '(Repository|Repo)$') AS is_repository, regexp_matches(name, 'Service$') AS is_service,
    regexp_matches(name, '(Command|Cmd)$') AS is_command, regexp_matches(name, 'Query$') AS is_query, regexp_matches(name, 'Handler$') AS is_handler FROM ({NAMED})""")
def ddd_classify_names(spark, sf_dir):
    return _names(spark, sf_dir).select("id", "name", *[c.alias(k) for k, c in code.patterns(F.col("name"), F.lit("struct")).items()])


KINDS = ["function", "method", "struct", "interface", "type", "const", "var", "field"]


@query("SELECT id, kind, CASE kind WHEN 'method' THEN 'method' WHEN 'struct' THEN 'type' WHEN 'interface' THEN 'type' WHEN 'type' THEN 'type' WHEN 'const' THEN 'const_group' WHEN 'var' THEN 'var_group' ELSE 'function' END AS chunk_type FROM (SELECT p_partkey AS id, ([" + ", ".join(f"'{k}'" for k in KINDS) + "])[p_size % 8 + 1] AS kind FROM part)")
def kind_to_chunk_type(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_size") % 8 + 1).cast("int"))
    return A.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind")).select("id", "kind", code.chunk_type(F.col("kind")).alias("chunk_type"))


@query(f"SELECT id, name, CASE WHEN regexp_matches(name, '^\\p{{Lu}}') THEN 'exported' ELSE 'unexported' END AS scope FROM ({NAMED})")
def scope_exported(spark, sf_dir):
    return _names(spark, sf_dir).select("id", "name", code.scope(F.col("name")).alias("scope"))


@query("""SELECT n_name AS name, string_agg('// Method: func ' || s_name, chr(10) ORDER BY s_suppkey) AS context FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name
    UNION ALL SELECT s_name, '// Receiver: type ' || n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def related_context(spark, sf_dir):
    nation, columns = A.read(spark, sf_dir, "nation"), ["file_id", "name", "kind", "signature", "receiver", "start_line"]
    named = lambda df, *c: df.select(*[x.alias(n) for x, n in zip((F.lit(1), *c), columns)])
    structs = named(nation, F.col("n_name"), F.lit("struct"), F.concat(F.lit("type "), "n_name"), F.lit(None).cast("string"), F.lit(0).cast("long"))
    supplier = A.read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    methods = named(supplier, F.col("s_name"), F.lit("method"), F.concat(F.lit("func "), "s_name"), F.col("n_name"), F.col("s_suppkey").cast("long"))
    return chunking.related(structs.unionByName(methods)).select("name", "context")


@query("SELECT 'r' || n_regionkey || '.go' AS file_path, 'lib/' || n_nationkey AS import_path, CASE WHEN n_nationkey % 2 = 0 THEN 'n' || n_nationkey ELSE '' END AS alias FROM nation")
def parse_imports(spark, sf_dir):
    return A.region_sources(spark, sf_dir).select("file_path", F.explode("imports").alias("i")).select("file_path", F.col("i.path").alias("import_path"), F.col("i.alias").alias("alias"))


@query("SELECT 'lib/' || n_nationkey AS import_path, CASE WHEN n_nationkey % 2 = 0 THEN 'n' || n_nationkey ELSE '' END AS alias FROM nation WHERE n_regionkey = 2 ORDER BY import_path")
def list_imports_by_file(spark, sf_dir):
    return T.listing(parse_imports(spark, sf_dir), "file_path", "r2.go", "import_path").select("import_path", "alias")


_DECLARED = """WITH s AS (SELECT 'n' || s_nationkey || '.go' AS file_path, s_suppkey AS k, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) * 6 AS off FROM supplier)"""


@query(f"""{_DECLARED} SELECT file_path, 'S' || k || 'Repository' AS name, 'struct' AS kind, '' AS receiver, 3 + off AS start_line, 5 + off AS end_line, true AS is_repository, 'exported' AS scope FROM s
    UNION ALL SELECT file_path, 'bal' || k, 'field', 'S' || k || 'Repository', 4 + off, 4 + off, false, 'unexported' FROM s
    UNION ALL SELECT file_path, 'Find' || k, 'method', 'S' || k || 'Repository', 7 + off, 7 + off, false, 'exported' FROM s""")
def parse_symbols(spark, sf_dir):
    parsed = A.supplier_sources(spark, sf_dir)
    out = chunking.symbols(parsed.withColumn("file_id", F.col("file_path")))
    line = lambda c: F.col(c).cast("long").alias(c)
    return out.select(F.col("file_id").alias("file_path"), "name", "kind", F.coalesce("receiver", F.lit("")).alias("receiver"), line("start_line"), line("end_line"), "is_repository", "scope")


@query(f"""{_DECLARED} SELECT name, start_line FROM (SELECT file_path, 'S' || k || 'Repository' AS name, 3 + off AS start_line FROM s UNION ALL SELECT file_path, 'bal' || k, 4 + off FROM s UNION ALL SELECT file_path, 'Find' || k, 7 + off FROM s)
    WHERE file_path = 'n3.go' ORDER BY start_line""")
def list_symbols_by_file(spark, sf_dir):
    return T.listing(parse_symbols(spark, sf_dir), "file_path", "n3.go", "start_line").select("name", "start_line")


@query(f"""{_DECLARED} SELECT file_path, 'type' AS chunk_type, 3 + off AS start_line, 5 + off AS end_line, md5('type S' || k || 'Repository struct {{' || chr(10) || chr(9) || 'bal' || k || ' float64' || chr(10) || '}}') AS content FROM s
    UNION ALL SELECT file_path, 'method', 7 + off, 7 + off, md5('func (s *S' || k || 'Repository) Find' || k || '(id int) error {{ return nil }}') FROM s""")
def chunk_declarations(spark, sf_dir):
    out = chunking.chunks(A.supplier_sources(spark, sf_dir).withColumn("file_id", F.col("file_path")))
    return out.select(F.col("file_id").alias("file_path"), "chunk_type", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("content").alias("content"))


@query("SELECT doc_id AS chunk_id, md5(text) AS content FROM documents WHERE doc_id = 42")
def get_chunk(spark, sf_dir):
    return T.rows_where(A.whole_chunks(spark, sf_dir), chunk_id=42).select("chunk_id", F.md5("content").alias("content"))


@query(f"SELECT doc_id AS file_id FROM documents WHERE source = 'src3' AND {PATH} = (SELECT min({PATH}) FROM documents WHERE source = 'src3')")
def get_file_by_path(spark, sf_dir):
    files = A.files(spark, sf_dir)
    first = files.where("project = 'src3'").agg(F.min("file_path").alias("file_path"))
    return T.rows_where(files.join(first, "file_path", "left_semi"), project="src3").select("file_id")


@query("SELECT doc_id AS id, quality, toxic FROM labels WHERE doc_id = (SELECT min(doc_id) FROM labels)")
def get_symbol(spark, sf_dir):
    s = A.symbols(spark, sf_dir)
    return T.rows_where(s, id=s.agg(F.min("id")).first()[0])


@query("SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS start_line, md5(unnest(string_split(text, chr(10)))) AS content FROM documents WHERE doc_id = 7")
def list_chunks_by_file(spark, sf_dir):
    return T.listing(A.line_chunks(spark, sf_dir), "file_id", 7, "start_line").select("start_line", F.md5("content").alias("content"))


@query("SELECT source AS project, sum(len(string_split(text, chr(10))))::BIGINT AS remaining FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source")
def delete_chunks_by_file(spark, sf_dir):
    files = A.symbols(spark, sf_dir).where("toxic = 1").select(F.col("id").alias("file_id"))
    return T.delete(A.line_chunks(spark, sf_dir), files, "file_id").groupBy("project").agg(F.count("*").alias("remaining"))


@query("""WITH gone AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT 'symbols' AS table_name, (SELECT count(*) FROM labels WHERE doc_id NOT IN (FROM gone)) AS remaining
    UNION ALL SELECT 'chunks', (SELECT count(*) FROM documents WHERE doc_id NOT IN (FROM gone)) UNION ALL SELECT 'embeddings', (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (FROM gone))""")
def delete_symbols_by_file(spark, sf_dir):
    """Symbols go, with them the chunks that are linked to them, and with those their vectors."""
    tables = {
        "symbols": A.symbols(spark, sf_dir).withColumn("file_id", F.col("id")), "chunks": A.whole_chunks(spark, sf_dir).withColumn("id", F.col("chunk_id")),
        "embeddings": A.vectors(spark, sf_dir).withColumn("id", F.col("chunk_id")),
    }
    left = T.cascade(tables, "symbols", tables["symbols"].where("toxic = 1").select("id"))
    rows = [df.agg(F.count("*").alias("remaining")).withColumn("table_name", F.lit(t)) for t, df in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT source AS root_path, count(*) AS total_files FROM documents GROUP BY source UNION ALL SELECT url, 0 FROM pages WHERE page_id < 3")
def insert_projects(spark, sf_dir):
    old = A.files(spark, sf_dir).groupBy(F.col("project").alias("root_path")).agg(F.count("*").alias("total_files"))
    new = A.read(spark, sf_dir, "pages").where("page_id < 3").select(F.col("url").alias("root_path"), F.lit(0).cast("long").alias("total_files"))
    return T.insert_new(old, new, ["root_path"])


@query("""SELECT page_id AS file_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS import_path FROM pages""")
def imports_explode(spark, sf_dir):
    pages = A.read(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("file_id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("import_path"))


VERSIONS = "SELECT DISTINCT p_size % 3 || '.' || p_partkey % 12 || '.' || p_partkey % 7 AS version FROM part"


@query(f"SELECT version, row_number() OVER (ORDER BY list_transform(string_split(version, '.'), lambda x: x::INT)) AS place FROM ({VERSIONS}) WHERE list_transform(string_split(version, '.'), lambda x: x::INT) > [1, 0, 1]")
def semver_pending_migrations(spark, sf_dir):
    """Versions made of parts that are over 1.0.1, in the order in which they are to be applied."""
    number = lambda c: c.cast("string")
    versions = A.read(spark, sf_dir, "part").select(F.concat_ws(".", number(F.col("p_size") % 3), number(F.col("p_partkey") % 12), number(F.col("p_partkey") % 7)).alias("version")).distinct()
    return migrations.pending_versions(versions, "1.0.1")


@query(r"""WITH l AS (SELECT p_partkey AS n, CASE p_partkey % 7 WHEN 0 THEN 'module ex.com/' || p_name WHEN 3 THEN '  go 1.' || p_size WHEN 5 THEN '// module none' WHEN 6 THEN 'gopher ' || p_name ELSE chr(9) || p_name || ' v1' END AS v FROM part)
    SELECT (SELECT trim(v[8:]) FROM l WHERE v LIKE 'module %' ORDER BY n DESC LIMIT 1) AS module_name, (SELECT trim(v[6:]) FROM l WHERE v LIKE '  go %' ORDER BY n DESC LIMIT 1) AS go_version""")
def go_mod_parse(spark, sf_dir):
    """A module file with a line for each part: the last line of each kind counts."""
    from fathom.sources.go_files import go_mod

    k = F.col("p_partkey") % 7
    line = F.when(k == 0, F.concat(F.lit("module ex.com/"), "p_name")).when(k == 3, F.concat(F.lit("  go 1."), F.col("p_size").cast("string"))).when(k == 5, "// module none").when(k == 6, F.concat(F.lit("gopher "), "p_name")).otherwise(F.concat(F.lit("\t"), "p_name", F.lit(" v1")))
    return go_mod(A.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), line.alias("value")))


@query()
def vector_codec_roundtrip(spark, sf_dir):
    v = A.vectors(spark, sf_dir).select("chunk_id", "vector", vector.from_bytes(vector.to_bytes("vector")).alias("back"))
    return v.select("chunk_id", (F.col("vector") == F.col("back")).alias("same"))


_TEXT = """WITH s AS (SELECT 'n' || s_nationkey || '/n' || s_nationkey || '.go' AS file_path, s_suppkey AS k, s_nationkey AS n, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INTEGER * 6 AS off FROM supplier),
    f AS (SELECT file_path, 'package n' || n || chr(10) || chr(10) || string_agg(format('type S{0}Repository struct {{' || chr(10) || chr(9) || 'bal{0} float64' || chr(10) || '}}' || chr(10) || chr(10) || 'func (s *S{0}Repository) Find{0}(id int) error {{ return nil }}' || chr(10) || chr(10), k), '' ORDER BY k) AS text FROM s GROUP BY file_path, n)"""


@query(f"""{_TEXT} SELECT file_path, 'S' || k || 'Repository' AS name, 'struct' AS kind, 'type S' || k || 'Repository struct {{ ... }} // 1 fields' AS signature, '' AS receiver, 3 + off AS start_line, 5 + off AS end_line FROM s
    UNION ALL SELECT file_path, 'bal' || k, 'field', 'bal' || k || ' float64', 'S' || k || 'Repository', 4 + off, 4 + off FROM s
    UNION ALL SELECT file_path, 'Find' || k, 'method', 'func (*S' || k || 'Repository) Find' || k || '(id int) error', 'S' || k || 'Repository', 7 + off, 7 + off FROM s""")
def go_symbols(spark, sf_dir):
    """Declarations of a source tree made of suppliers, read and parsed by executors."""
    from fathom.sources.go_files import discover, parse

    found = parse(discover(spark, A.supplier_tree(spark, sf_dir)))
    return found.select("file_path", F.explode("symbols").alias("s")).select("file_path", "s.name", "s.kind", "s.signature", F.coalesce("s.receiver", F.lit("")).alias("receiver"), "s.start_line", "s.end_line")


@query(f"{_TEXT} SELECT file_path, strlen(text)::BIGINT AS size_bytes, sha256(text) AS content_hash FROM f")
def file_discovery(spark, sf_dir):
    """Files of that tree with their sizes and hashes."""
    from fathom.sources.go_files import discover

    return discover(spark, A.supplier_tree(spark, sf_dir)).select("file_path", "size_bytes", F.lower(F.hex("content_hash")).alias("content_hash"))


@query("SELECT doc_id AS file_id, lang AS package_name, md5(text) AS content FROM documents WHERE doc_id = 11")
def get_file_by_id(spark, sf_dir):
    return T.rows_where(A.files(spark, sf_dir), file_id=11).select("file_id", "package_name", F.md5("text").alias("content"))


@query("SELECT source AS root_path, count(*) AS total_files FROM documents WHERE source = 'src1' GROUP BY source")
def get_project(spark, sf_dir):
    projects = A.files(spark, sf_dir).groupBy(F.col("project").alias("root_path")).agg(F.count("*").alias("total_files"))
    return T.rows_where(projects, root_path="src1")


@query("SELECT vec_id AS chunk_id, len(embedding)::BIGINT AS dimension, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id = 5")
def get_embedding(spark, sf_dir):
    found = T.rows_where(A.vectors(spark, sf_dir), chunk_id=5)
    return found.select("chunk_id", F.size("vector").cast("long").alias("dimension"), F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


@query("SELECT label, count(*) AS remaining FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY label")
def delete_embeddings(spark, sf_dir):
    gone = A.symbols(spark, sf_dir).where("quality = 1").select(F.col("id").alias("chunk_id"))
    return T.delete(A.vectors(spark, sf_dir), gone, "chunk_id").groupBy("label").agg(F.count("*").alias("remaining"))


LINKS = """SELECT page_id AS file_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS import_path FROM pages"""


@query(f"SELECT * FROM ({LINKS}) WHERE file_id NOT IN (SELECT page_id FROM pages WHERE url LIKE '%1%')")
def delete_imports_by_file(spark, sf_dir):
    gone = A.read(spark, sf_dir, "pages").where(F.col("url").contains("1")).select(F.col("page_id").alias("file_id"))
    return T.delete(imports_explode(spark, sf_dir), gone, "file_id")


@query(f"SELECT file_id, import_path, count(*) AS copies FROM (SELECT * FROM ({LINKS}) UNION ALL SELECT * FROM ({LINKS} WHERE page_id < 50)) GROUP BY ALL")
def insert_imports(spark, sf_dir):
    """Imports are appended, so what is stored twice stands there twice."""
    links = imports_explode(spark, sf_dir)
    return T.insert(links, links.where("file_id < 50")).groupBy("file_id", "import_path").agg(F.count("*").alias("copies"))


@query("""WITH l AS (SELECT doc_id AS file_id, source AS project, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS start_line, unnest(string_split(text, chr(10))) AS content FROM documents),
    new AS (SELECT file_id, start_line + CASE WHEN quality = 0 THEN 0 ELSE 100000 END AS start_line, content || '!' AS content FROM l JOIN labels ON doc_id = file_id WHERE toxic = 1 OR quality = 1)
    SELECT coalesce(l.file_id, new.file_id) AS file_id, coalesce(l.start_line, new.start_line) AS start_line, md5(coalesce(new.content, l.content)) AS content, CASE WHEN l.file_id IS NULL THEN 2 ELSE 1 END AS created, CASE WHEN new.file_id IS NULL THEN 1 ELSE 2 END AS updated
    FROM l FULL JOIN new ON l.file_id = new.file_id AND l.start_line = new.start_line""")
def upsert_chunks(spark, sf_dir):
    lines = A.line_chunks(spark, sf_dir)
    at = lambda df, n: df.select("file_id", "start_line", "content", F.lit(n).alias("created"), F.lit(n).alias("updated"))
    more = lines.join(A.symbols(spark, sf_dir).where("toxic = 1 OR quality = 1"), F.col("file_id") == F.col("id"))
    more = more.withColumn("start_line", F.col("start_line") + F.when(F.col("quality") == 0, 0).otherwise(100_000)).withColumn("content", F.concat("content", F.lit("!")))
    merged = T.merge(at(lines, 1), at(more, 2), schema.KEYS["chunks"][:2], keep=["created"])
    return merged.select("file_id", "start_line", F.md5("content").alias("content"), "created", "updated")


@query("""WITH new AS (SELECT conv_id, role, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE turn >= 1 GROUP BY conv_id, role), old AS (SELECT conv_id, role, text, turn FROM conversations WHERE turn < 2)
    SELECT coalesce(new.conv_id, old.conv_id) AS file_id, coalesce(new.role, old.role) AS name, md5(coalesce(new.text, old.text)) AS signature, coalesce(old.turn, new.turn) AS created FROM old FULL JOIN new ON old.conv_id = new.conv_id AND old.role = new.role""")
def upsert_symbols(spark, sf_dir):
    """Of a batch that names a symbol twice the later one counts; a symbol that exists keeps when it was created."""
    turns = A.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("role").alias("name"), F.col("text").alias("signature"), F.col("turn").alias("created"))
    new = T.last_writer(turns.where("created >= 1"), ["file_id", "name"], "created")
    merged = T.merge(turns.where("created < 2"), new, ["file_id", "name"], keep=["created"])
    return merged.select("file_id", "name", F.md5("signature").alias("signature"), "created")


@query("SELECT event_type AS version FROM events ORDER BY ts DESC, event_type DESC LIMIT 1")
def latest_migration(spark, sf_dir):
    return migrations.latest(A.read(spark, sf_dir, "events").select(F.col("event_type").alias("version"), F.col("ts").alias("applied_at")))


@query(f"""SELECT name, regexp_matches(name, '^\\p{{Lu}}') AS is_exported, regexp_matches(name, '(Aggregate|AggregateRoot|Entity|VO|ValueObject|Repository|Repo|Service|Command|Cmd|Query|Handler)$')
    OR regexp_matches(name, 'Order|User|Product|Account|Customer|Item') AS is_pattern FROM ({NAMED})""")
def symbol_predicates(spark, sf_dir):
    name = F.col("name")
    flags = list(code.patterns(name, F.lit("struct")).values())
    return _names(spark, sf_dir).select("name", code.is_exported(name, code.scope(name)).alias("is_exported"), code.is_pattern(flags).alias("is_pattern"))


KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in [*KINDS, "macro"]) + "]"
PARTS_SQL = f"SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS package_name, {KINDS_SQL}[p_partkey % 9 + 1] AS kind, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS receiver, p_size % 5 AS start_line, p_size % 7 AS end_line FROM part"


def _parts(spark, sf_dir) -> DataFrame:
    """Parts as declarations, many of them unsound."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return A.read(spark, sf_dir, "part").select(
        key.alias("id"), F.when(key % 7 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(key % 11 == 0, "").otherwise(F.col("p_brand")).alias("package_name"),
        F.element_at(F.array(*map(F.lit, [*KINDS, "macro"])), (key % 9 + 1).cast("int")).alias("kind"), F.when(size % 2 == 0, F.col("p_type")).otherwise("").alias("receiver"),
        (size % 5).alias("start_line"), (size % 7).alias("end_line"), F.lit("exported").alias("scope"),
    )


@query(f"SELECT id, name <> '' AND package_name <> '' AND kind <> 'macro' AND (kind = 'method') = (receiver <> '') AND start_line > 0 AND end_line >= start_line AS valid FROM ({PARTS_SQL})")
def validate_symbols(spark, sf_dir):
    return _parts(spark, sf_dir).select("id", schema.valid_symbol().alias("valid"))


@query(f"SELECT id, name <> '' AND kind IN ('function', 'method', 'type') AND start_line > 0 AND end_line >= start_line AS valid FROM ({PARTS_SQL})")
def validate_chunks(spark, sf_dir):
    chunks = _parts(spark, sf_dir).withColumnsRenamed({"name": "content", "kind": "chunk_type"})
    return chunks.select("id", schema.valid_chunk().alias("valid"))


@query("SELECT p_partkey AS id, p_size % 3 = 0 OR p_size % 3 = 1 AND p_partkey % 2 = 0 AS entity_like FROM part")
def entity_like_fields(spark, sf_dir):
    """Parts as structs of two fields: name, and ID, customerId or idle."""
    size, key = F.col("p_size"), F.col("p_partkey")
    second = F.when(size % 3 == 0, "ID").when((size % 3 == 1) & (key % 2 == 0), "customerId").otherwise("idle")
    fields = F.array(F.lit("name"), second)
    return A.read(spark, sf_dir, "part").select(key.alias("id"), code.entity_like(fields).alias("entity_like"))


@query(r"""SELECT doc_id AS chunk_id, md5(regexp_replace(regexp_replace(text || ' AND (x) "NOT* NEARBY', '(["*()])', '\\\1', 'g'), '\b(AND|OR|NOT|NEAR)\b', '\\\1', 'g')) AS escaped FROM documents""")
def escape_query(spark, sf_dir):
    return A.whole_chunks(spark, sf_dir).select("chunk_id", F.md5(text.escape(F.concat("content", F.lit(' AND (x) "NOT* NEARBY')))).alias("escaped"))


@query("""SELECT 'n' || s_nationkey || '.go' AS file_path, 'package' AS chunk_type, 1::BIGINT AS start_line, md5('package n' || s_nationkey || chr(10) || chr(10) || string_agg('type S' || s_suppkey || 'Repository struct {' || chr(10) || chr(9) || 'bal' || s_suppkey || ' float64' || chr(10) || '}' || chr(10) || chr(10)
    || 'func (s *S' || s_suppkey || 'Repository) Find' || s_suppkey || '(id int) error { return nil }' || chr(10) || chr(10), '' ORDER BY s_suppkey)) AS content FROM supplier GROUP BY s_nationkey""")
def chunk_package_strategy(spark, sf_dir):
    out = chunking.chunks(A.supplier_sources(spark, sf_dir).withColumn("file_id", F.col("file_path")), strategy="package")
    return out.select(F.col("file_id").alias("file_path"), "chunk_type", F.col("start_line").cast("long").alias("start_line"), F.md5("content").alias("content"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark, sf_dir):
    """The streaming aggregation over a table that is at rest."""
    events = A.read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return windowed_counts(events, window="1 hour").select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


def _engine(spark: SparkSession, sf_dir: str):
    """An engine over an index of the suppliers' source tree, made once for a session, and the tree."""
    from fathom.plans.api import Engine

    root = A.supplier_tree(spark, sf_dir)

    def make(_, path: str) -> Engine:
        engine = Engine(spark, path, keep_results=True)
        engine.index_codebase({"path": root})
        return engine

    return A._kept(spark, "engine", A.read(spark, sf_dir, "supplier"), make), root


@query("""SELECT count(DISTINCT s_nationkey) AS files, 3 * count(*) AS symbols, 2 * count(*) AS chunks, 2 * count(*) AS embeddings, 'example.com/suppliers' AS module, true AS fts_indexes_built FROM supplier""")
def engine_status(spark, sf_dir):
    """The status of a project that was indexed from a source tree: counts, module, health."""
    engine, root = _engine(spark, sf_dir)
    s = engine.get_status({"path": root})
    n, long = s["statistics"], lambda v: F.lit(v).cast("long")
    return spark.range(1).select(*[long(n[f"{c}_count"]).alias(c) for c in ("files", "symbols", "chunks", "embeddings")], F.lit(s["project"]["module"]).alias("module"), F.lit(s["health"]["fts_indexes_built"]).alias("fts_indexes_built"))


#: Requests of the engine's queries: the suppliers of the five lowest keys.
ASKED = "(SELECT * FROM supplier ORDER BY s_suppkey LIMIT 5)"


def _asked(spark: SparkSession, sf_dir: str, answer, kinds: str) -> DataFrame:
    keys = [r[0] for r in A.read(spark, sf_dir, "supplier").select("s_suppkey").orderBy("s_suppkey").limit(5).collect()]
    return spark.createDataFrame([(k, *row) for k in keys for row in answer(k)], f"request long, {kinds}")


@query(f"SELECT s_suppkey AS request, 1::BIGINT AS rank, 'Find' || s_suppkey AS name, 'n' || s_nationkey || '/n' || s_nationkey || '.go' AS path, 'func (s *S' || s_suppkey || 'Repository) Find' || s_suppkey || '(id int) error {{ return nil }}' AS content FROM {ASKED}")
def engine_search(spark, sf_dir):
    """Keyword requests answered by the engine from the index of the source tree."""
    engine, root = _engine(spark, sf_dir)
    ask = lambda k: engine.search_code({"path": root, "query": f"find{k} error", "search_mode": "keyword"})["results"]
    return _asked(spark, sf_dir, lambda k: [(r["rank"], r["symbol"]["name"], r["file"]["path"], r["content"]) for r in ask(k)], "rank long, name string, path string, content string")


@query(f"SELECT s_suppkey AS request, 'S' || s_suppkey || 'Repository' AS name, 'struct' AS kind, 'exported' AS scope FROM {ASKED}")
def engine_symbols(spark, sf_dir):
    """Symbol requests answered by the engine from the postings of the symbols' names, signatures and comments."""
    engine, root = _engine(spark, sf_dir)
    ask = lambda k: engine.search_symbols({"path": root, "query": f"S{k}Repository struct"})
    return _asked(spark, sf_dir, lambda k: [(r["name"], r["kind"], r["scope"]) for r in ask(k)], "name string, kind string, scope string")


@query("SELECT DISTINCT 'find' || (conv_id % 5) || ' error' AS query, 'keyword' AS mode, 1::BIGINT AS hits FROM conversations")
def stored_results(spark, sf_dir):
    """Requests made of conversations, asked of one engine and then of another on the same store: what is stored, and how often the second one found it there."""
    from fathom.plans.api import Engine

    engine, root = _engine(spark, sf_dir)
    other, version = Engine(spark, engine.store.base, keep_results=True), engine.store.versions()[-1]
    asked = [f"find{r[0]} error" for r in A.read(spark, sf_dir, "conversations").select(F.col("conv_id") % 5).distinct().collect()]
    before = {r["key"]: r["hits"] for r in engine.results.table(version).collect()}
    for e in (engine, other):
        for q in asked:
            e.search_code({"path": root, "query": q, "search_mode": "keyword"})
        e.results.flush()
    now = engine.results.table(version).where(F.col("query").isin(*asked))
    known = spark.createDataFrame(list(before.items()), "key string, before long")
    return now.join(known, "key", "left").select("query", "mode", (F.col("hits") - F.coalesce("before", F.lit(0))).alias("hits"))
