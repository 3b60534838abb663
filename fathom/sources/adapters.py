"""The engine's tables over the driver's: documents are files, their lines or wholes are chunks."""

from __future__ import annotations

import atexit
import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import vector_cells
from fathom.operators.segments import Index
from fathom.schema import CHUNK_TYPES
from fathom.sources import go_files

#: Indexes that this process has written, by application, kind and state of the table.
_MADE: dict[tuple[str, str, str], Index | vector_cells.Cells] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, project, package_name, file_path, text)"""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("project"), F.col("lang").alias("package_name"), path.alias("file_path"), "text")


def whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, file_id, symbol_id, chunk_type, package_name, file_path, content): a chunk for each document."""
    return files(spark, sf_dir).select(F.col("file_id").alias("chunk_id"), "file_id", F.col("file_id").alias("symbol_id"), F.element_at(F.array(*map(F.lit, CHUNK_TYPES)), (F.col("file_id") % len(CHUNK_TYPES) + 1).cast("int")).alias("chunk_type"), "package_name", "file_path", "project", F.col("text").alias("content"))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, project, start_line, content): a chunk for each line."""
    return files(spark, sf_dir).select("file_id", "project", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content")).withColumn("start_line", (F.col("pos") + 1).cast("long")).drop("pos")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, vector, label)"""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> DataFrame:
    """One row (q): a stored vector as the query."""
    return vectors(spark, sf_dir).where(F.col("chunk_id") == vec_id).select(F.col("vector").alias("q"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, quality, toxic): two flags of a symbol."""
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder's path where the driver and all executors write: below spark.checkpoint.dir or, where that is unset and Spark runs in one process, in the warehouse. It is deleted when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


def _kept(spark: SparkSession, kind: str, rows: DataFrame, make):
    """What make(rows, path) gives, made once for a session and a state of the files that rows come from."""
    key = (spark.sparkContext.applicationId, kind, _state(spark, rows.inputFiles()))
    if key not in _MADE:
        if len(rows.inputFiles()) < (tasks := spark.sparkContext.defaultParallelism):  # a small table in few files
            rows = rows.repartition(tasks)
        _MADE[key] = make(rows, _shared(spark, kind))
    return _MADE[key]


def keyword_index(spark: SparkSession, sf_dir: str) -> Index:
    """The keyword index over all documents, written once and read by the queries that follow."""
    return _kept(spark, "keyword-index", whole_chunks(spark, sf_dir).select("chunk_id", "content"), lambda rows, path: Index(spark, path).add(rows, ["content"]))


def symbol_index(spark: SparkSession, sf_dir: str) -> Index:
    """The keyword index over parts, which stand for symbols: name, brand and type."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), "p_name", "p_brand", "p_type")
    return _kept(spark, "symbol-index", part, lambda rows, path: Index(spark, path).add(rows, ["p_name", "p_brand", "p_type"]))


def cells(spark: SparkSession, sf_dir: str) -> vector_cells.Cells:
    """All vectors, stored by cell."""
    return _kept(spark, "vector-cells", vectors(spark, sf_dir).select("chunk_id", "vector"), vector_cells.write)


def laid_out(spark: SparkSession, sf_dir: str) -> str:
    """A folder in which each document is a file; executors write them, so the shared folder must be one that all see under one path."""
    return _kept(spark, "source-tree", files(spark, sf_dir).select("file_path", "text"), _lay_out)


def _lay_out(rows: DataFrame, path: str) -> str:
    root = path.removeprefix("file://")

    def write(batches):
        for batch in batches:
            for name, text in zip(batch["file_path"], batch["text"]):
                at = os.path.join(root, name)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "wb") as f:
                    f.write((text or "").encode())
            yield batch[["file_path"]]

    rows.mapInPandas(write, "file_path string").write.format("noop").mode("overwrite").save()
    return root


def _state(spark: SparkSession, files: list[str]) -> str:
    """A digest of names, sizes and times of files: another one once a table is written anew."""
    digest = hashlib.sha256()
    for f in sorted(files):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
        digest.update(f"{f}:{status.getLen()}:{status.getModificationTime()};".encode())
    return digest.hexdigest()


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:  # else the session ended before
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def _parsed(files: DataFrame) -> DataFrame:
    """Sources (file_path, content) with what the parser finds in them."""
    files = files.withColumn("content", F.encode("content", "UTF-8"))
    return go_files.parse(files).join(files, "file_path")


def supplier_tree(spark: SparkSession, sf_dir: str) -> str:
    """A source tree of supplier_sources(): a folder for each nation, written by executors, and a module file."""
    sources = supplier_texts(spark, sf_dir).select(F.concat(F.regexp_replace("file_path", r"\.go$", "/"), "file_path").alias("file_path"), F.col("content").alias("text"))
    root = _kept(spark, "supplier-tree", sources, _lay_out)
    with open(os.path.join(root, "go.mod"), "w") as f:
        f.write("module example.com/suppliers\n\ngo 1.25\n")
    return root


def region_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parsed source for each region that imports a package for each nation, those of even keys by an alias."""
    alias = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(" "))).otherwise("")
    line = F.concat(F.lit("\t"), alias, F.lit('"lib/'), F.col("n_nationkey").cast("string"), F.lit('"\n'))
    lines = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("l"))
    name = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    return _parsed(lines.select(F.concat(name, F.lit(".go")).alias("file_path"), F.concat(F.lit("package "), name, F.lit("\n\nimport (\n"), "l", F.lit(")\n")).alias("content")))


def supplier_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parsed source for each nation that declares a struct and a method for each supplier."""
    return _parsed(supplier_texts(spark, sf_dir))


def supplier_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, content) of these sources."""
    key = F.col("s_suppkey").cast("string")
    text = F.format_string("type S%sRepository struct {\n\tbal%s float64\n}\n\nfunc (s *S%sRepository) Find%s(id int) error { return nil }\n\n", key, key, key, key)
    texts = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", text.alias("t")))), lambda x: x["t"]), "").alias("l"))
    name = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    return texts.select(F.concat(name, F.lit(".go")).alias("file_path"), F.concat(F.lit("package "), name, F.lit("\n\n"), "l").alias("content"))
