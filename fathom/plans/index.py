"""Indexing: discover, find changes, parse, chunk, embed, merge, commit a snapshot."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom import schema
from fathom.operators import chunking, embedding
from fathom.operators import tables as T
from fathom.plans.store import WORDS, Conflict, Project, Store
from fathom.sources import go_files

#: A small source tree for tests and queries.
FIXTURES = str(Path(__file__).resolve().parents[2] / "fixtures" / "shop")
@dataclass
class Statistics:
    files_indexed: int = 0
    files_skipped: int = 0
    files_failed: int = 0
    symbols_extracted: int = 0
    chunks_created: int = 0
    embeddings_created: int = 0
    errors: list[str] = field(default_factory=list)


def _id(*columns: str):
    """A deterministic id from the natural key."""
    return F.xxhash64(*columns)


def project_id(spark: SparkSession, root: str) -> int:
    return spark.range(1).select(F.xxhash64(F.lit(root))).first()[0]


def index_tree(spark: SparkSession, store: Store, root: str, force: bool = False, tests: bool = True, vendor: bool = False, prune: bool = False, provider=None, attempts: int = 3) -> Statistics:
    """Bring the store up to date with a source tree and commit; unchanged files are left alone unless forced.

    Only the buckets that changed files are in are read and written. Files that disappeared stay unless
    pruned. One run of a project at a time; a second one is refused. Runs of different projects do not wait
    for each other; if another run was first after all, this one starts over.
    """
    pid = project_id(spark, root)
    with store.run(pid):
        for k in range(attempts):
            try:
                return _index(spark, store, root, pid, force, tests, vendor, prune, provider)
            except Conflict:
                if k == attempts - 1:
                    raise
    raise AssertionError


def _bucketed(df: DataFrame, file_id: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(file_id), F.lit(buckets)).cast("int"))


def _index(spark, store, root, pid, force, tests, vendor, prune, provider) -> Statistics:
    seen, now = store.snapshot(), F.current_timestamp()
    stored = store.project(seen, pid)
    whole = store.read(snapshot=seen, project=pid)
    found = go_files.discover(spark, root, tests, vendor).cache()
    known = whole["files"].select("file_path", F.col("content_hash").alias("__old"), F.lit(True).alias("__known"))
    status = found.join(known, "file_path", "left")
    known_now = F.lit(False) if force else F.col("__known")  # a forced run takes all files for new ones
    status = status.withColumn("status", T.status_of(known_now, F.col("__old"), F.lit(True), F.col("content_hash"), F.col("error")))
    changed = status.where("status in ('new', 'changed')").withColumn("project_id", F.lit(pid)).withColumn("file_id", _id("project_id", "file_path"))
    parsed = changed.select("file_id", "project_id", "file_path", "content", "content_hash", "mod_time", "size_bytes").join(go_files.parse(changed), "file_path").cache()
    gone = whole["files"].select("file_path", "id").join(found.select("file_path"), "file_path", "left_anti").select("id") if prune else whole["files"].select("id").limit(0)

    # buckets: those of files that changed or went, or all of them where their number grows
    total = whole["files"].select("file_path").unionByName(found.select("file_path")).distinct().count()
    buckets = stored.buckets if stored.files and total <= 4 * store.bucket_files * stored.buckets else max(1, -(-total // store.bucket_files))
    touched_files = parsed.select(F.col("file_id").alias("id")).unionByName(gone)
    touched = [r[0] for r in _bucketed(touched_files, "id", buckets).select("bucket").distinct().collect()]
    old = whole if buckets != stored.buckets else store.read(snapshot=seen, project=pid, buckets=touched)

    files = parsed.select(F.col("file_id").alias("id"), "project_id", "file_path", F.col("package").alias("package_name"), "content_hash", "mod_time", "size_bytes", F.when(F.size("errors") > 0, F.element_at("errors", 1)).alias("parse_error"), now.alias("last_indexed_at"), now.alias("created_at"), now.alias("updated_at"))
    symbols = chunking.symbols(parsed).withColumn("id", _id("file_id", "name", "start_line", "start_col")).withColumn("created_at", now)
    symbols = T.last_writer(symbols, ["file_id", "name", "start_line", "start_col"], "seq").drop("seq")
    chunks = chunking.chunks(parsed).withColumn("id", _id("file_id", "start_line", "end_line"))
    chunks = chunks.withColumn("symbol_id", F.when(F.col("of").isNotNull(), _id("file_id", "of.name", "of.start_line", "of.start_col"))).withColumns({"created_at": now, "updated_at": now}).drop("of").cache()
    imports = parsed.select("file_id", F.posexplode("imports").alias("seq", "i")).select(_id("file_id", "seq").alias("id"), "file_id", F.col("i.path").alias("import_path"), F.col("i.alias").alias("alias"))

    # a text is embedded once: vectors are written before anything reads them, so that all tables see the same ones
    draft = f"{store.base}/drafts/{uuid.uuid4().hex}"
    embedding.embed(chunks.select(F.col("id").alias("chunk_id"), "content"), provider).write.parquet(draft)
    vectors = spark.read.parquet(draft).withColumns({"id": _id("chunk_id"), "created_at": now})
    kept = chunks.join(vectors.select(F.col("chunk_id").alias("id")), "id", "left_semi")  # a chunk without a vector goes

    base = T.cascade({t: old[t] for t in ("files", "symbols", "chunks", "embeddings", "imports")}, "files", touched_files)
    base["files"] = T.delete(old["files"], gone, "id")  # file rows are merged, so that they keep id and created_at
    fit = lambda t, df: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.TABLES[t]])
    out = {t: T.insert(base[t], df) for t, df in (("symbols", symbols), ("chunks", kept), ("embeddings", vectors), ("imports", imports))}
    out["files"] = T.merge(base["files"], fit("files", files), schema.KEYS["files"], keep=["id", "created_at"])

    changes = Project(buckets, {} if buckets != stored.buckets else {t: {b: f for b, f in by.items() if int(b) not in touched} for t, by in stored.files.items()})
    # writes that do not need each other run side by side
    with ThreadPoolExecutor(6) as pool:
        place = {"files": "id", "symbols": "file_id", "chunks": "file_id", "imports": "file_id"}
        writes = {t: pool.submit(store.write, t, _bucketed(out[t], column, buckets), pid) for t, column in place.items()}
        # the keyword indexes follow: rows of files that changed or went are taken out by their old texts, new ones are tokenized
        words = {}
        for name, table, new in (("chunk_words", "chunks", kept), ("symbol_words", "symbols", symbols)):
            before = old[table].join(touched_files.withColumnRenamed("id", "file_id"), "file_id", "left_semi")
            rows = [df.withColumnRenamed("id", "chunk_id") for df in (before, fit(table, new))]
            words[name] = pool.submit(store.index(seen, name).replace, *rows, list(WORDS[name]))
        changes.files.setdefault("chunks", {}).update(writes["chunks"].result())
        owner = store.table("chunks", [changes], touched if buckets == stored.buckets else None).select(F.col("id").alias("chunk_id"), "file_id")
        writes["embeddings"] = pool.submit(store.write, "embeddings", _bucketed(out["embeddings"].join(owner, "chunk_id"), "file_id", buckets), pid)
        counted = [pool.submit(df.count) for df in (symbols, chunks, vectors)]
        by = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
        problems = [r[0] for r in status.where("error is not null").select(F.concat_ws(": ", "file_path", "error")).limit(100).collect()]
        for t, written in writes.items():
            changes.files.setdefault(t, {}).update(written.result())
        words = {name: w.result() for name, w in words.items()}
        stats = Statistics(by.get("new", 0) + by.get("changed", 0), by.get("unchanged", 0), by.get("failed", 0), *[n.result() for n in counted], problems)

    listed = store.table("files", [changes]).agg(F.count("*").alias("total_files")).crossJoin(store.table("chunks", [changes]).agg(F.count("*").alias("total_chunks")))
    mod = Path(root) / "go.mod"
    lines = mod.read_text().splitlines() if mod.is_file() else []
    module = go_files.go_mod(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string"))
    row = listed.crossJoin(module).withColumns({"id": F.lit(pid), "root_path": F.lit(root), "index_version": F.lit(schema.VERSION), "last_indexed_at": now, "created_at": now, "updated_at": now})
    row = T.merge(whole["projects"], fit("projects", row), schema.KEYS["projects"], keep=["id", "created_at"])
    changes.files["projects"] = store.write("projects", row.withColumn("bucket", F.lit(0)), pid)

    store.commit(seen, pid, changes, words)
    store.tidy()
    store.fs.delete(store.jpath(draft), True)
    for df in (found, parsed, chunks):
        df.unpersist()
    return stats
