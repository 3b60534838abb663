"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontaminate, divergence, embedding_dedup, html_extract, packing, passage_dedup, pii, secrets, sharding, simhash, suffix_dedup, toxicity, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op3_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op5_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.near_duplicate_passages(table(spark, sf_dir, "documents"))


def op7_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op11_equal_average_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_min_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def shifted_vectors_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's operator over all vectors and a shifted copy of every third one, so that there are links to find: the tables hold none."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    factor = lambda i: F.element_at(F.array(F.lit(0.9), F.lit(1.0), F.lit(1.1)), (i % 3 + 1).cast("int"))
    moved = F.transform("embedding", lambda x, i: (x.cast("double") * factor(i)).cast("float"))
    copies = vectors.where("vec_id % 3 = 0").select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), moved.alias("embedding"))
    return embedding_dedup.near_duplicates(vectors.unionByName(copies))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"shifted_vectors_forest": shifted_vectors_forest, "pipeline": pipeline}


_WORDS = r"""CASE WHEN t IS NULL THEN [] ELSE regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END"""

_CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, text AS t FROM documents)),
    b AS (SELECT coalesce(item_id::VARCHAR, '') AS i, {_WORDS} AS w FROM (SELECT item_id, text AS t FROM benchmark)),
    bk AS (SELECT i, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k, least(len(w), 10) AS size FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT i, size, w[k:k + size - 1] AS win FROM bk),
    sizes AS (SELECT DISTINCT size FROM bw),
    dk AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size),
    dw AS (SELECT doc_id, k, size, w[k:k + size - 1] AS win FROM dk),
    hits AS (SELECT doc_id, k, dw.size AS size, i FROM dw JOIN bw ON dw.win = bw.win),
    places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

def _links(given: str) -> str:
    """All pairs of given vectors (vec_id, embedding) by their cosine, and what they reach."""
    return f"""
WITH RECURSIVE given AS ({given}), v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM given),
    n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.len > 0 AND b.len > 0 WHERE list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.9),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM given UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    low AS (SELECT a, min(b) AS m FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, m AS component_id, m = vec_id AS kept FROM given JOIN low ON low.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""


_LINKS = _links("SELECT vec_id, embedding FROM embeddings")

_SHIFTED = _links("""SELECT vec_id, embedding FROM embeddings UNION ALL
        SELECT vec_id + 1000000000, list_transform(embedding, lambda x, i: (x::DOUBLE * ([0.9, 1.0, 1.1]::DOUBLE[])[(i - 1) % 3 + 1])::FLOAT) FROM embeddings WHERE vec_id % 3 = 0""")


def _codes(rounds: int = 6) -> str:
    """Integer vectors, their first 16 as codebooks, `rounds` assignments and means, the last assignment."""
    sql = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT vec_id, label, k AS part, e[k * len(e) // 8 + 1:(k + 1) * len(e) // 8] AS x FROM v, range(8) t(k)),
    b0 AS MATERIALIZED (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1) AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)),
"""
    near = "    a{k} AS MATERIALIZED (SELECT vec_id, label, part, x, arg_min(entry, far * 16 + entry) AS entry, min(far) AS far FROM (SELECT p.*, entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS far FROM p JOIN b{k} ON b{k}.part = p.part) GROUP BY ALL)"
    mean = """    s{k} AS (SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, range(1, 257) r(i) WHERE i <= len(x) GROUP BY ALL),
    m{k} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{k} GROUP BY ALL),
    b{n} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry)),"""
    for k in range(rounds):
        sql += near.format(k=k) + ",\n" + mean.format(k=k, n=k + 1) + "\n"
    sql += near.format(k=rounds)
    return f"""{sql},
    out AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM out
"""


_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
    v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM d),
    own AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    sums AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN own USING (lang, source) GROUP BY ALL),
    shares AS MATERIALIZED (SELECT lang, source, term, coalesce(own.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(own.n, 0) + 2) // (sums.total + 2 * v) AS p, 1 + 1000000000::HUGEINT * (kept.n + 2) // (v.total + 2 * v) AS q FROM sums JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN own USING (lang, source, term)),
    apart AS (SELECT lang, a.source AS source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

#: The tables' pages have one article each, whose text is all of their main text.
_ARTICLES = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS h FROM pages),
    b AS (SELECT page_id, url, list_transform(regexp_split_to_array(h, '</?(?:p|h[1-6])(?:\s[^>]*)?>'), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?[A-Za-z][^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS bs FROM a),
    t AS (SELECT page_id, url, array_to_string(list_filter(bs, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the others are tested against brute-force versions."""
    return {"op7_projection_forest": _LINKS, "shifted_vectors_forest": _SHIFTED, "op9_prefix_decontamination": _CONTAMINATION, "op11_equal_average_codes": _codes(), "op12_source_divergence": _DIVERGENCE, "op13_min_cut_extraction": _ARTICLES}
