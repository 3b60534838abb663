"""Vector code compression: product codes whose nearest entries are found by equal-average search.

Each vector is cut into equal parts, each part position has a codebook of a few entries, and a vector is
kept as the indexes of its parts' nearest entries. The entries of a codebook are sorted by the sum of
their components. A part starts at its own sum and expands outward, nearer sums first, until the squared
gap of the sums over the dimension strictly exceeds the best squared distance: by Cauchy-Schwarz no entry
further out can be as near, not even equally near. All arithmetic is on integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import small_join

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: A vector that holds a component of this size or more is passed over, as non-finite ones are: a long could not hold it.
LARGEST = 2.0**50


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance, entries compared) of the nearest of entries (k, d) for each row of x (n, d); ties go to the lower index."""
    n, d = x.shape
    sums = entries.sum(1)
    order = np.argsort(sums, kind="stable")
    sums, own, last, compared = sums[order], x.sum(1), len(entries) - 1, 0
    right = np.searchsorted(sums, own)
    left = right - 1
    best, index, active = np.zeros(n, x.dtype), np.full(n, -1), np.arange(n)
    while len(active):
        lo, hi, s = left[active], right[active], own[active]
        below, above = lo >= 0, hi <= last
        gap_lo, gap_hi = s - sums[np.maximum(lo, 0)], sums[np.minimum(hi, last)] - s
        down = below & (~above | (gap_lo <= gap_hi))
        gap = np.where(down, gap_lo, gap_hi)
        go = (below | above) & ((index[active] < 0) | (gap * gap <= best[active] * d))
        active, down, at = active[go], down[go], np.where(down, lo, hi)[go]
        left[active[down]] -= 1
        right[active[~down]] += 1
        entry = order[at]
        far = x[active] - entries[entry]
        far = (far * far).sum(1)
        better = (index[active] < 0) | (far < best[active]) | ((far == best[active]) & (entry < index[active]))
        best[active[better]], index[active[better]] = far[better], entry[better]
        compared += len(active)
    return index, best, compared


def integers(values: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) of finite vectors as rows; of Python integers where 64 bits could not hold what nearest() computes."""
    x = np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    whole = np.floor(x * SCALE).astype(np.int64)
    return whole if not whole.size or max(int(whole.max()), -int(whole.min())) < _bound(dim) else whole.astype(object)


def _bound(dim: int) -> int:
    return (1 << 30) // max(1, dim)  # (2 * d * bound)^2 is below 2^63


def _ready(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """x and the codebooks with one type of number."""
    fits = x.dtype != object and all(max(map(abs, b.ravel().tolist()), default=0) < _bound(x.shape[1]) for b in books)
    return (x, [b.astype(np.int64) for b in books]) if fits else (x.astype(object), [b.astype(object) for b in books])


def _edges(dim: int, parts: int) -> list[int]:
    return [k * (dim // parts) + min(k, dim % parts) for k in range(parts + 1)]


def _sums(dim: int, edges: list[int], books: list[np.ndarray]):
    """Rows (part, entry, place, n, total) of a task: counts and componentwise sums of the parts that each entry is nearest to."""

    def run(batches):
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            x, own = _ready(integers(batch.column(0), dim), books)
            for p, (a, b) in enumerate(zip(edges, edges[1:])):
                index = nearest(x[:, a:b], own[p])[0]
                counts[p] += np.bincount(index, minlength=len(own[p]))
                for e in range(len(own[p])):
                    totals[p][e] += x[index == e, a:b].sum(0)
        out = [(p, e, k, int(counts[p][e]), str(totals[p][e, k])) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist() for k in range(books[p].shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["part", "entry", "place", "n", "total"])

    return run


def _coded(dim: int, edges: list[int], books: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            x, own = _ready(integers(batch.column(2), dim), books)
            codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), object)
            for p, (a, b) in enumerate(zip(edges, edges[1:])):
                index, far, _ = nearest(x[:, a:b], own[p])
                codes[:, p] = index
                error += far.astype(object)
            out = [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(list(map(str, error)), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], ["vec_id", "label", "code", "error"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): the vectors without null and non-finite components."""
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)))
    return vectors.select("vec_id", "label", F.col("embedding").alias("v")).where(F.col("v").isNotNull()).where(finite)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, list[int], list[np.ndarray]]:
    """(dimension, edges of the parts, a codebook for each part) after `rounds` passes over rows, as usable() gives them.

    Of each pass the driver gets a count and sums for every entry: as many numbers as the codebooks have.
    """
    # rows that share a vec_id are told apart by their vectors
    first = rows.where(F.size("v") > 0).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return 0, [0] * (parts + 1), []
    dim = len(first[0]["v"])
    rows = rows.where(F.size("v") == dim)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = integers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), dim).astype(object)
    edges = _edges(dim, parts)
    books = [start[:, a:b].copy() for a, b in zip(edges, edges[1:])]
    for _ in range(rounds):
        found = rows.select("v").mapInArrow(_sums(dim, edges, books), "part int, entry int, place int, n long, total string")
        found = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        for r in found.collect():
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return dim, edges, books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for b in books for e in b for c in e).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per vector (vec_id, code, error, label_error, codebooks_sha256) of vectors (vec_id, embedding, label).

    A component x becomes floor(4096 * x). The codebook of a part position starts as that part of the
    vectors with the `entries` smallest vec_ids (at most 256); fewer vectors give fewer entries. Each of
    `rounds` rounds deals every part to its nearest entry, ties to the lower index, and replaces each entry
    that has parts by their componentwise floor of the mean. code is the final indexes in part order, two
    hex digits each, error the squared distances summed over the parts, label_error the errors summed over
    rows with the same label, null ones together.

    Vectors that are null or hold null, non-finite or larger components than a long can hold (2^50 in size)
    are dropped. Rows that repeat count each; of equal vec_ids the lesser vector comes first, null ids come
    last. The dimension is that of the first vector that is not empty; vectors of another one return with
    code and error null. If the dimension is no multiple of `parts`, the first parts are one longer. Errors
    beyond a long are null. Empty table: no rows. Other columns are ignored. The table is read once for each
    round and twice besides; what it is made from should be written first if it is dear.
    """
    rows = usable(vectors)
    dim, edges, books = train(rows, parts, entries, rounds)
    sha = digest(books)
    kept = rows.where(F.size("v") == dim) if dim else rows.limit(0)
    label = dict(rows.dtypes)["label"]
    vec_id = dict(rows.dtypes)["vec_id"]
    coded = kept.select("vec_id", "label", "v").mapInArrow(_coded(dim, edges, books), f"vec_id {vec_id}, label {label}, code string, error string")
    if rows.where(F.size("v") != dim).isEmpty():
        coded = coded.select("vec_id", "label", "code", F.col("error").cast("decimal(38,0)").alias("e"))
    else:
        other = rows.where(F.size("v") != dim).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("decimal(38,0)").alias("e"))
        coded = coded.select("vec_id", "label", "code", F.col("error").cast("decimal(38,0)").alias("e")).unionByName(other)
    by_label = coded.groupBy("label").agg(F.sum("e").alias("sum")).select(F.col("label").alias("own"), "sum")
    out = small_join(coded, by_label, lambda a, b: a["label"].eqNullSafe(b["own"]), "vec_id")
    return out.select("vec_id", "code", F.col("e").try_cast("long").alias("error"), F.col("sum").try_cast("long").alias("label_error"), F.lit(sha).alias("codebooks_sha256"))
