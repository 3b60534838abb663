"""What the operators of this subpackage share: tables in the cluster's shared folder and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CREATED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset and Spark runs in one process, as in tests, a fresh temporary one; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="fathom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str, reclaim: bool = False, write=lambda df, path: df.write.parquet(path)) -> DataFrame:
    """Write df to the shared folder, as Parquet by default, and read it back.

    This cuts lineage: a lost executor costs the re-reading of files, not the recomputing of what made them.
    The folder goes when the driver ends. With reclaim the driver collects its garbage, upon which Spark
    deletes the shuffle files of plans that are over; else they stay until the driver's heap is full.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fathom-{name}-{uuid.uuid4().hex}"
    _CREATED.append((spark, path))
    write(df, path)
    if reclaim:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the shared folders behind materialized frames that no later plan reads."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            folder = f.rsplit("/", 1)[0]
            if "/fathom-" in folder:
                _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean_up() -> None:
    for spark, path in _CREATED:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have gone before
            return


#: A side of a join is broadcast up to this many rows, which are counted first.
BROADCAST_ROWS = 100_000
_SALTS = 64


def small_join(large: DataFrame, small: DataFrame, on, spread: str) -> DataFrame:
    """large joined with small, which has one row for each key; on takes both and gives the condition, an equality.

    small is written and counted. Up to BROADCAST_ROWS rows it is broadcast. Beyond, each of its rows is copied
    to _SALTS parts and large is dealt to these by its column `spread`, so that a key with a large share of
    the rows is read by as many tasks.
    """
    small = materialize(small, "small")
    if small.count() <= BROADCAST_ROWS:
        return large.join(F.broadcast(small), on(large, small))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    large = large.withColumn("_dealt", F.pmod(F.xxhash64(spread), F.lit(_SALTS)).cast("int"))
    return large.join(small, on(large, small) & (large["_dealt"] == small["_salt"])).drop("_salt", "_dealt")


def numbered(docs: DataFrame, *more: str) -> DataFrame:
    """(u, doc_id, t, more) of docs (doc_id, text): t the text's UTF-8 bytes and u 16 bytes of the SHA-256 of doc_id and text, the same for repeated rows."""
    doc_id = F.col("doc_id").cast("long")
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.when(F.col("text").isNull(), ";").otherwise(":"), F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.substring(F.unhex(F.sha2(named, 256)), 1, 16).alias("u"), doc_id.alias("doc_id"), F.encode("text", "UTF-8").alias("t"), *more)


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2^64, and those of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.insert(0, np.multiply.accumulate(p))
        del _POWERS[2:]
    return _POWERS[1][:n], _POWERS[0][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_edges(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of a text in which every other byte between words is a blank."""
    word = np.r_[False, np.frombuffer(plain, np.uint8) != 0x20, False]
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def word_hashes(plain: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes, the reverse is for callers to verify."""
    x = np.frombuffer(plain, np.uint8)
    up, down = powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge (a, b), of any type with an order; component is the smallest node reachable.

    Alternating large-star and small-star: each round is a few group-bys over the edges, whose
    number never grows, and rounds grow with the logarithm of the diameter. A node of a very large
    component is only ever minimum-aggregated (map-side first), never collected: the neighbours of
    a hub join the hub's minimum instead of being listed. Edges live in the shared folder only.
    No edge: no row. Null ends are dropped.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("x"), F.col("b").alias("y"))
        large = large.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        # small-star: every smaller neighbour, and the node itself, points at the smallest one
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.explode(F.array(F.struct("m", F.col("b").alias("n")), F.struct("m", F.col("a").alias("n")))).alias("s"))
        nxt = materialize(small.select(F.col("s.m").alias("a"), F.col("s.n").alias("b")).where("a <> b").distinct(), "edges")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(e)
        e = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy("b").agg(F.min("a").alias("component"))
    return stars.select(F.col("b").alias("node"), "component").unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
