"""SimHash near-duplicates: fingerprints embedded as per-segment popcounts, joined on a grid under Manhattan distance.

A fingerprint's 64 bits form 32 segments of two bits; its embedding is the popcount of each segment.
A bit that differs moves one coordinate by at most one, so the Manhattan distance of two embeddings is
a lower bound of the Hamming distance. The coordinates form BLOCKS blocks; under distance 4 at least
BLOCKS - 4 blocks are equal, so a grid over each choice of BLOCKS - 4 blocks, with cells of width one,
brings every pair within reach together. Manhattan distance then rejects, the exact distance confirms.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import connected_components, materialize, numbered

SEED = 42
BLOCKS = 7
SEGMENTS = 32
#: A cell with more distinct fingerprints is compared by pairs of chunks of at most half as many, in tasks of their own.
CELL_LIMIT = 8192
_ODD = np.uint64(0x5555555555555555)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes | None, width: int = 4, block: int = 1 << 18) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text: XXH64 of `width`-word shingles, repeats included.

    ASCII letters are lower-cased, words are runs without ASCII white space. Fewer words: the whole
    sequence is one shingle. No word, or null: 0. Shingles are hashed block by block.
    """
    ws = text.lower().split() if text else []
    if not ws:
        return 0
    joined, n = b" ".join(ws), max(1, len(ws) - width + 1)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[:n], ends[min(width, len(ws)) - 1 :]
    del ws
    ones = np.zeros(64, np.int64)
    for k in range(0, n, block):
        hashed = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k : k + block].tolist(), ends[k : k + block].tolist())]
        bits = np.unpackbits(np.array(hashed, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(u, doc_id, fp): fp is the fingerprint's 64 bits as a signed long, u a digest of doc_id and text. One row per document, one pass, no shuffle."""

    def scan(batches):
        for batch in batches:
            fps = [fingerprint(t, width) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(fps, np.uint64).view(np.int64))], ["u", "doc_id", "fp"])

    return numbered(docs).mapInArrow(scan, "u binary, doc_id long, fp long")


def embed(fps: np.ndarray) -> np.ndarray:
    """The 32 segment popcounts of each fingerprint, packed in two bits each."""
    return fps - ((fps >> np.uint64(1)) & _ODD)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings: a coordinate is 0, 1 or 2, so its unary form has as many ones."""
    unary = lambda x: ((x | (x >> np.uint64(1))) & _ODD) | (x & ~_ODD)  # noqa: E731  0, 01, 10 -> 00, 01, 11
    return np.bitwise_count(unary(a) ^ unary(b))


def _masks(blocks: int, distance: int) -> list[np.uint64]:
    edges = [round(k * SEGMENTS / blocks) for k in range(blocks + 1)]
    block = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [np.uint64(sum(chosen)) for chosen in combinations(block, blocks - distance)]


def _cells(distance: int, blocks: int):
    masks = _masks(blocks, distance)

    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                e = embed(fps.view(np.uint64))
                keys = []
                for k, mask in enumerate(masks):
                    x = (e & mask) * _MIX
                    x = (x ^ (x >> np.uint64(29))) * _MIX + np.uint64(k)
                    keys.append((x ^ (x >> np.uint64(32))).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(fps, len(masks)))], ["cell", "fp"])

    return deal


def _forest(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of one cell, at most one for each fingerprint."""
    e = embed(fps)
    left = np.arange(len(fps))
    while len(left) > 1:
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            reached, parents, rest = [], [], left
            for seed in wave:
                if not len(rest):
                    break
                near = manhattan(e[seed], e[rest]) <= distance
                if near.any():
                    near[near] = np.bitwise_count(fps[seed] ^ fps[rest[near]]) <= distance
                    reached.append(rest[near])
                    parents.append(np.full(int(near.sum()), seed))
                    rest = rest[~near]
            left = rest
            wave = np.concatenate(reached) if reached else left[:0]
            if len(wave):
                yield fps[np.concatenate(parents)], fps[wave]


def _within(distance: int, limit: int | None):
    """Rows (a, b, over) of sorted (cell, fp): links, or with over the members of a cell beyond limit, by cell."""

    def pairs(keys: np.ndarray, fps: np.ndarray, out: list) -> None:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        for lag in (1, 2, 3):
            at = np.concatenate([starts[(sizes == s)] + k for s in (2, 3, 4) if s > lag for k in range(s - lag)] or [starts[:0]])
            if len(at):
                a, b = fps[at], fps[at + lag]
                near = manhattan(embed(a), embed(b)) <= distance
                near[near] = np.bitwise_count(a[near] ^ b[near]) <= distance
                out.append((a[near], b[near]))
        for s, n in zip(starts[sizes > 4].tolist(), sizes[sizes > 4].tolist()):
            out += _forest(fps[s : s + n], distance)

    def batch_of(links: list, over: bool) -> pa.RecordBatch:
        a = np.concatenate([x[0].view(np.int64) for x in links]) if links else np.zeros(0, np.int64)
        b = np.concatenate([x[1].view(np.int64) for x in links]) if links else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), over))], ["a", "b", "over"])

    def run(batches):
        keys, fps, spill = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if spill is not None:  # the rest of a cell beyond the limit
                same = int(np.searchsorted(k, spill, "right"))
                if same:
                    yield batch_of([(f[:same], k[:same])], True)
                k, f = k[same:], f[same:]
                if not len(k):
                    continue
                spill = None
            keys, fps = np.r_[keys, k], np.r_[fps, f]
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            out: list = []
            if cut:
                pairs(keys[:cut], fps[:cut], out)
            keys, fps = keys[cut:], fps[cut:]
            if limit and len(keys) > limit:
                yield batch_of([(fps, keys)], True)
                spill, keys, fps = keys[-1], keys[:0], fps[:0]
            yield batch_of(out, False)
        if len(keys):
            out = []
            pairs(keys, fps, out)
            yield batch_of(out, False)

    return run


def links(distinct: DataFrame, distance: int = 4, blocks: int = BLOCKS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp), enough to connect all that lie within `distance` bits.

    Every pair within reach shares a cell; of a cell's links a spanning forest is kept, so that a large
    group of near copies gives as many links as members, not their square. A cell beyond cell_limit is
    dealt anew to all pairs of its chunks, which gives each pair of members once: exact at any size.
    """
    cells = distinct.select("fp").mapInArrow(_cells(distance, blocks), "cell long, fp long")
    n = max(distinct.sparkSession.sparkContext.defaultParallelism, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_cells = cells.repartition(n, "cell").sortWithinPartitions("cell", "fp")
    found = materialize(sorted_cells.mapInArrow(_within(distance, cell_limit), "a long, b long, over boolean"), "cells")
    near = found.where("not over").select("a", "b")
    most = found.where("over").groupBy("b").count().agg(F.max("count")).first()[0]
    if most:
        chunks = -(-most * 4 // cell_limit)  # twice as many as needed on average: no group comes near the limit
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(chunks))
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda x: F.struct(F.least(x.cast("long"), own).alias("i"), F.greatest(x.cast("long"), own).alias("j"))))
        big = found.where("over").select(F.col("b").alias("cell"), F.col("a").alias("fp")).select("cell", "fp", pair.alias("p"))
        big = big.select(F.xxhash64("cell", "p.i", "p.j").alias("cell"), "fp").repartition(n, "cell").sortWithinPartitions("cell", "fp")
        near = near.unionByName(big.mapInArrow(_within(distance, None), "a long, b long, over boolean").select("a", "b"))
    return near


def _components(docs: DataFrame, distance: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of all rows, (fp, c) of each distinct fingerprint with its component)."""
    fps = materialize(fingerprints(docs, width), "fingerprints")
    nodes = materialize(fps.select("fp").distinct(), "nodes")
    comps = materialize(connected_components(links(nodes, distance)), "components")
    return fps, nodes.join(comps, nodes.fp == comps.node, "left").select("fp", F.coalesce("component", "fp").alias("c"))


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """Per document (doc_id, fingerprint, component_id), linking fingerprints at most `distance` bits apart.

    fingerprint is 16 lower-case hex digits, component_id the smallest doc_id reachable by links, itself
    included. Equal fingerprints are one node, however many documents have it. Null and empty texts have
    fingerprint zero and link like any other. Repeated rows each return; a null doc_id never names a
    component. Empty table: no rows. Other columns are ignored.
    """
    fps, named = _components(docs, distance, width)
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = named.join(first, "fp")
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    by_fp = named.join(least, "c").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """docs, all columns, with one row of each component: of the smallest doc_id, of rows that share it of the smallest digest of the text.

    Rows without a doc_id come last. Of rows that repeat doc_id and text throughout one stays, any of
    them if other columns differ. Links and other cases as in near_duplicates().
    """
    fps, named = _components(docs, distance, width)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "u")
    own = fps.groupBy("fp").agg(F.min(rank).alias("best"))
    best = own.join(named, "fp").groupBy("c").agg(F.min("best").alias("best"))
    winners = materialize(best.select(F.col("best.u").alias("u")), "winners")
    again = fps.join(winners, "u", "left_semi").groupBy("u").count().where("count > 1").select("u")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    rows = numbered(whole.select("__row", F.col("__row.doc_id").alias("doc_id"), F.col("__row.text").alias("text")), "__row").select("u", "__row")
    kept = rows.join(winners, "u", "left_semi")
    if not again.isEmpty():
        again = materialize(again, "again")
        kept = kept.join(again, "u", "left_anti").unionByName(kept.join(again, "u", "left_semi").groupBy("u").agg(F.first("__row").alias("__row")))
    return kept.select("__row.*")
