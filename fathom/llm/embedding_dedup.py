"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

Each level of each tree projects on a random direction and splits at a node's median; vectors near the
split go both ways, as near as the data's spread in that direction says, and no more of them than keeps
a tree's copies of all vectors below COPIES. Trees are added until pairs at the threshold, planted beside
sampled vectors, meet in some leaf but for MISSED of them. Vectors are compared within leaves, by exact cosine. A pair may meet in many leaves;
it counts in the smallest leaf the two share, which each can tell from the leaves of both, so that
neither pairs nor links are ever gathered to be made distinct.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import connected_components, materialize

#: Trees are added beyond the least number until planted pairs meet; if the most of them miss over twice MISSED, trees
#: become less deep and leaves larger.
TREES, MOST_TREES = 6, 20
MISSED = 0.005
LEAF = 512
#: Copies of a vector in one tree, on average, at most.
COPIES = 4.0
#: Vectors that directions' spreads and splits are learned from; they are taken by order of a hash.
SAMPLE = 20_000
#: Levels whose nodes have splits of their own; below, where the sample is thin, one split holds for a level.
_LEARNED = 11
#: A leaf beyond this is compared by pairs of chunks, in tasks of their own.
LEAF_LIMIT = 4096
_BLOCK = 1024


class Forest:
    """Random directions by (tree, level), medians by node; depth follows the number of vectors."""

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, trees: int = TREES, leaf: int = LEAF, seed: int = 5):
        rng = np.random.default_rng(seed)
        # in the middle a level keeps a little over half of the vectors on either side
        self.depth = max(0, math.ceil(math.log(max(rows, 1) / leaf) / math.log(1 / 0.57))) if rows > 2 * leaf else 0
        while True:
            self.directions, self.splits, self.margins, self.missed = [], [], [], 0.0
            if not self.depth:
                self._grow(rng, sample, threshold)
                return
            pairs = self._planted(rng, sample, threshold)
            apart = np.ones(len(pairs[0]), bool)
            while len(self.splits) < trees or (apart.mean() > MISSED and len(self.splits) < MOST_TREES):
                self._grow(rng, sample, threshold)
                apart &= ~self._meet(len(self.splits) - 1, *pairs)
            self.missed = float(apart.mean())
            if self.missed <= 2 * MISSED:
                return
            self.depth = max(0, self.depth - 2)

    @staticmethod
    def _planted(rng: np.random.Generator, sample: np.ndarray, threshold: float, n: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """Sampled vectors and for each one of cosine `threshold` to it: half in random directions, half in those of other vectors."""
        x = sample[rng.integers(0, len(sample), n)]
        off = rng.standard_normal(x.shape)
        off[n // 2 :] = sample[rng.integers(0, len(sample), n - n // 2)]
        off -= (off * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(off, axis=1, keepdims=True)
        on = size[:, 0] > 1e-6
        x, off = x[on], off[on] / size[on]
        return x, threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * off

    def _grow(self, rng: np.random.Generator, sample: np.ndarray, threshold: float) -> None:
        """One more tree; where every vector has the same part, as a common mean, the spread and the splits leave it out."""
        directions = rng.standard_normal((self.depth, sample.shape[1]))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        total = math.sqrt(sample.var(axis=0).sum()) if len(sample) else 1.0
        share = COPIES ** (1 / max(1, self.depth)) - 1
        splits, margins, node = [], [], np.zeros(len(sample), np.int64)
        for level, d in enumerate(directions):
            p = sample @ d
            split = np.full(1 << level if level <= _LEARNED else 1, np.median(p) if len(p) else 0.0)
            if level <= _LEARNED:
                order = np.lexsort((p, node))
                starts = np.searchsorted(node[order], np.arange(1 << level))
                sizes = np.diff(np.r_[starts, len(order)])
                full = sizes >= 8
                split[full] = p[order[starts[full] + sizes[full] // 2]]
            off = p - split[node if level <= _LEARNED else 0]
            wanted = 0.36 * math.sqrt(max(0.0, 2 - 2 * threshold)) / max(total, 1e-9) * (p.std() if len(p) else 0.0)
            margins.append(min(wanted, float(np.quantile(np.abs(off), share))) if len(p) else wanted)
            splits.append(split)
            node = 2 * node + (off >= 0)
        self.directions.append(directions)
        self.splits.append(splits)
        self.margins.append(margins)

    def _route(self, tree: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level, (d, split, margin) in enumerate(zip(self.directions[tree], self.splits[tree], self.margins[tree])):
            off = (x @ d)[row] - split[node if level <= _LEARNED else 0]
            right, left = off >= -margin, off < margin
            row, node = np.r_[row[left], row[right]], np.r_[2 * node[left], 2 * node[right] + 1]
        return row, node

    def _meet(self, tree: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of rows shares a leaf of a tree."""
        (i, u), (j, v) = self._route(tree, a), self._route(tree, b)
        both = np.intersect1d((i.astype(np.int64) << self.depth) + u, (j.astype(np.int64) << self.depth) + v)
        out = np.zeros(len(a), bool)
        out[both >> self.depth] = True
        return out

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs, by row and leaf; leaf numbers go through all trees."""
        routed = [self._route(t, x) for t in range(len(self.splits))]
        row, leaf = np.concatenate([r for r, _ in routed]), np.concatenate([n + (t << self.depth) for t, (_, n) in enumerate(routed)])
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    top = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(top > 0, top, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(leaf: int, x: np.ndarray, weight: np.ndarray, chunk: np.ndarray, cross: bool, lists: list[np.ndarray], threshold: float):
    """(linked weight of each vector, label of each vector) of one leaf; only pairs whose smallest common leaf it is."""
    n = len(x)
    earlier = [a[a < leaf] for a in lists]
    flat, width = np.concatenate(earlier), 0
    if len(flat):
        names, at = np.unique(flat, return_inverse=True)
        width = -(-len(names) // 64)
        seen = np.zeros((n, width), np.uint64)
        np.bitwise_or.at(seen, (np.repeat(np.arange(n), [len(a) for a in earlier]), at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    total, links_i, links_j = np.zeros(n, np.int64), [], []
    for k in range(0, n, _BLOCK):
        i, j = np.nonzero(x[k : k + _BLOCK] @ x[k:].T >= threshold)
        i, j = i + k, j + k
        on = i < j
        if cross:
            on &= chunk[i] != chunk[j]
        i, j = i[on], j[on]
        fresh = np.ones(len(i), bool)
        for w in range(width):
            fresh &= (seen[i, w] & seen[j, w]) == 0
        i, j = i[fresh], j[fresh]
        total += np.bincount(i, weight[j], n).astype(np.int64) + np.bincount(j, weight[i], n).astype(np.int64)
        label = _components(n, i, j)
        own = np.flatnonzero(label != np.arange(n))
        links_i.append(own)
        links_j.append(label[own])
    return total, _components(n, np.concatenate(links_i), np.concatenate(links_j))


def _in_leaves(dim: int, threshold: float):
    def one(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        col = lambda name: table.column(name).chunk(0)
        node, a, b = col("node"), *(col(c).to_numpy(zero_copy_only=False) for c in ("i", "j"))
        lists = col("leaves")
        offsets, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        total, label = _compare(
            col("leaf")[0].as_py(), unit(col("embedding"), dim), col("n").to_numpy(zero_copy_only=False), col("chunk").to_numpy(zero_copy_only=False),
            bool(a[0] != b[0]), [flat[s:e] for s, e in zip(offsets, offsets[1:])], threshold,
        )
        on = np.flatnonzero(total > 0)
        return pa.RecordBatch.from_arrays([node.take(pa.array(on)), pa.array(total[on]), node.take(pa.array(label[on]))], ["node", "links", "other"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            g = held.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist()]
            for s, e in zip(cuts, cuts[1:]):
                if e - s > 1:
                    yield one(held.slice(s, e - s))
            held = held.slice(cuts[-1])
        if held is not None and held.num_rows > 1:
            yield one(held)

    return run


def _links(classes: DataFrame, dim: int, threshold: float, trees: int, leaf: int, leaf_limit: int) -> DataFrame:
    """(node, links, other) of classes (node, embedding, n) of one dimension."""
    spark, rows = classes.sparkSession, classes.count()
    taken = classes.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(SAMPLE).select("embedding").toArrow()
    forest = spark.sparkContext.broadcast(Forest(unit(taken.column(0).combine_chunks(), dim) if rows else np.zeros((0, dim)), rows, threshold, trees, leaf))

    def route(batches):
        for batch in batches:
            row, found = forest.value.leaves(unit(batch.column(1), dim))
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))], ["node", "embedding", "n", "leaves"])

    kind = classes.schema["embedding"].dataType.simpleString()
    routed = materialize(classes.select("node", "embedding", "n").mapInArrow(route, f"node binary, embedding {kind}, n long, leaves array<long>"), "routed")
    # how many chunks a leaf needs is joined to (node, leaf) rows, which are few bytes each; vectors are dealt once
    large = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().where(F.col("count") > leaf_limit)
    chunked = routed.select("node", F.explode("leaves").alias("leaf")).join(large, "leaf").groupBy("node").agg(
        # twice the chunks that are needed on average: two of them stay below the limit
        F.map_from_entries(F.collect_list(F.struct("leaf", F.ceil(F.col("count") * 4 / leaf_limit).cast("int")))).alias("in_large")
    )
    has_large = not large.isEmpty()
    dealt = routed.join(chunked, "node", "left") if has_large else routed.withColumn("in_large", F.lit(None).cast("map<bigint,int>"))
    dealt = dealt.withColumn("leaf", F.explode("leaves")).withColumn("chunks", F.coalesce(F.element_at("in_large", F.col("leaf")), F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(9)), F.col("chunks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, "chunk").alias("i"), F.greatest(c, "chunk").alias("j")))
    dealt = dealt.withColumn("p", F.explode(pair)).select("leaf", "node", "embedding", "n", "leaves", "chunk", "p.i", "p.j")
    dealt = dealt.withColumn("group", F.xxhash64("leaf", "i", "j"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_in_leaves(dim, threshold), "node binary, links long, other binary")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, trees: int = TREES, leaf: int = LEAF, leaf_limit: int = LEAF_LIMIT) -> DataFrame:
    """Per vector (vec_id, n_links, component_id, kept), linking those found with cosine >= threshold in double precision.

    vectors (vec_id, embedding). Equal vectors are one class, linked among each other and compared once.
    Null, empty and zero vectors and those with null or non-finite components link with nothing, nor do
    vectors of different lengths. Links are between rows: a vec_id that comes again, with the same vector
    or another, is another vector each time. A null vec_id names no component: component_id is the smallest
    one that is not null, else null, and such a row is kept if there is none. Empty table: no rows. Other
    columns are ignored. Recall depends on trees, not on group sizes: all of a leaf is compared.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    ok = F.coalesce(F.col("embedding").isNotNull() & finite, F.lit(False))
    # equal vectors have one node: 16 bytes of the SHA-256 of their numbers in full
    node = F.substring(F.unhex(F.sha2(F.array_join(F.col("embedding").cast("array<string>"), ","), 256)), 1, 16)
    sound = v.where(ok).withColumn("node", node)
    classes = materialize(sound.groupBy("node").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("low"), F.count("*").alias("n")), "classes")
    alone = v.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = None
    for dim in [r[0] for r in classes.groupBy(F.size("embedding")).count().where("count > 1").collect()]:
        some = _links(classes.where(F.size("embedding") == dim), dim, threshold, trees, leaf, leaf_limit)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = classes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("other")).limit(0)
    found = materialize(found, "links")
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "low", "n").join(sums, "node", "left").join(comps, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = named.groupBy("c").agg(F.min("low").alias("component_id"))
    named = named.join(least, "c").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    kept = F.when(F.col("vec_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("vec_id") == F.col("component_id"))
    return sound.select("vec_id", "node").join(named, "node").select("vec_id", "n_links", "component_id", kept.alias("kept")).unionByName(alone)
