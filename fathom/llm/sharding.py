"""Two-pass external shuffle of a table into shards.

Pass one scatters rows uniformly, by seeded hashes, into buckets that fit a task's memory; pass two
shuffles each bucket by Fisher-Yates and writes it. Buckets follow each other in one global order,
which is cut into shards of equal row counts; each shard is a folder of files, and slot gives a row's place in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from fathom.llm.common import materialize

#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 8 << 20
#: Rows that repeat doc_id and text more often than this are dealt to buckets one by one.
HOT_COPIES = 1000
_GROUP = 1024


def fisher_yates(n: int, seed: tuple[int, int]) -> np.ndarray:
    """A permutation of range(n): numpy's generator swaps each place with a random earlier one."""
    order = np.arange(n)
    np.random.default_rng([s & 0xFFFFFFFF for s in seed]).shuffle(order)
    return order


def _spread(docs: DataFrame, hot_copies: int) -> DataFrame:
    """(row, salt): docs as structs; salt tells apart the copies of rows that come more than hot_copies times, and is 0 for all others.

    Copies are counted before anything else moves; hot ones are grouped to one row with a number, and dealt out of that again.
    """
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("k"))
    hot = docs.groupBy(key.alias("k")).count().where(F.col("count") > hot_copies).select("k")
    if hot.isEmpty():
        return rows.select("row", F.lit(0).cast("long").alias("salt"))
    hot = materialize(hot, "hot")
    grouped = rows.join(F.broadcast(hot) if hot.count() < 10_000 else hot, "k", "left_semi").groupBy("row").agg(F.count("*").alias("n"))
    dealt = grouped.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i")).select("row", F.xxhash64("row", "i").alias("salt"))
    return rows.join(hot, "k", "left_anti").select("row", F.lit(0).cast("long").alias("salt")).unionByName(dealt)


def _scatter(docs: DataFrame, seed: int, bucket_bytes: int, hot_copies: int) -> tuple[DataFrame, DataFrame, int]:
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    rows, total = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes))
    spread = _spread(docs, hot_copies)
    own = (F.coalesce(F.octet_length("row.text"), F.lit(0)) + 1).cast("long")
    bucket = F.pmod(F.xxhash64("row.doc_id", own, "salt", F.lit(seed)), F.lit(buckets))
    counts = spread.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).withColumn("g", F.floor(F.col("bucket") / _GROUP))
    groups = counts.groupBy("g").agg(F.sum("n").alias("gn"))
    # one row for each thousand buckets, some gigabytes of text
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("g", F.coalesce(F.sum("gn").over(before), F.lit(0)).alias("gfirst"))
    within = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.join(groups, "g").select("bucket", (F.col("gfirst") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("first"))
    return spread.select(bucket.alias("bucket"), "row"), firsts, rows


def external_shuffle(docs: DataFrame, shards: int = 16, seed: int = 1, bucket_bytes: int = BUCKET_BYTES, hot_copies: int = HOT_COPIES) -> DataFrame:
    """(row, shard, slot): every row of docs as a struct with its shard and its place there, gapless from 0.

    docs has doc_id and text; all its columns stay, inside `row`, so names cannot clash. Row counts of
    shards are at most one apart. The order depends on rows, seed and bucket_bytes alone: before
    Fisher-Yates a bucket is put in the order of doc_id and text, so a lost task is done again alike.
    Rows that are equal throughout take any of their places; very many of them are spread over buckets. Nulls are hashed and ordered as such.
    Empty table: no rows. Only one bucket at a time is in a task's memory.
    """
    scattered, firsts, rows = _scatter(docs, seed, bucket_bytes, hot_copies)
    schema = StructType([scattered.schema["row"], StructField("shard", IntegerType()), StructField("slot", LongType())])

    def shuffle(key, table):
        table = table.combine_chunks()
        row = table.column("row").chunk(0) if table.num_rows else table.column("row").combine_chunks()
        keys = pa.table({"d": pc.struct_field(row, "doc_id"), "t": pc.struct_field(row, "text")})
        order = pc.sort_indices(keys, [("d", "ascending"), ("t", "ascending")]).to_numpy()
        order = order[fisher_yates(len(order), (seed, key[0].as_py()))]
        place = table.column("first")[0].as_py() + np.arange(len(order), dtype=np.int64)
        shard = place * shards // rows
        slot = place - (shard * rows + shards - 1) // shards
        return pa.table({"row": row.take(pa.array(order)), "shard": pa.array(shard.astype(np.int32)), "slot": pa.array(slot)})

    return scattered.join(firsts, "bucket").groupBy("bucket").applyInArrow(shuffle, schema)


def _by_shard(shuffled: DataFrame, path: str) -> None:
    shuffled.write.partitionBy("shard").parquet(path)


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 1, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write external_shuffle(docs) to path as Parquet, one folder a shard; slot gives the order in it."""
    _by_shard(external_shuffle(docs, shards, seed, bucket_bytes), path)


def digest(docs: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """Per row (doc_id, size, text_crc32, law, shard, slot, grown_shard), read back from the written shards.

    The law is `rows`; size is the UTF-8 bytes of the text, none for null, plus 1. See external_shuffle().
    """
    written = materialize(external_shuffle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), shards, seed), "shards", write=_by_shard)
    text = F.coalesce(F.encode("row.text", "UTF-8"), F.lit(b""))
    return written.select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
