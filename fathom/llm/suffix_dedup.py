"""Repeated byte strings by a run-length index: run-compressed Burrows-Wheeler transforms with sampled run ends.

A string of LENGTH bytes is found wherever it starts more than once. To build indexes of bounded size
over any corpus, each window of LENGTH bytes is sent to the place that its own content names: the anchor,
the smallest of the hashes of its ANCHORS[0]-byte strings. Runs of windows with one anchor form a segment;
equal segments are one, with a count. Segments that share an anchor go into one index, where matching
statistics, streamed from the run ends, tell how far the text at each position matches elsewhere. An
anchor that too many different segments share is split by content: its segments are cut anew by a longer
anchor, up to LENGTH bytes, where a segment is one window. Windows that are equal have equal anchors, so
none is missed. Anchors only bring windows together; within an index bytes are compared, and segments
and documents are told apart by 128-bit digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import materialize, numbered, powers, release

LENGTH = 400
#: Bytes of an anchor, and of those by which the segments of an anchor with more than GROUP_LIMIT of them are cut anew.
ANCHORS = (100, 250, LENGTH)
#: Bytes of segments in one index.
INDEX_BYTES = 2 << 20
GROUP_LIMIT = 3000
_STRETCH = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)


def _hashes(x: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every `width` bytes."""
    up, down = powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=sums[1:])
    h = (sums[width:] - sums[:-width]) * down[: len(x) - width + 1]
    for mult in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F):
        h ^= h >> np.uint64(32)
        h *= np.uint64(mult)
    return h ^ (h >> np.uint64(29))


def segments(text: bytes, length: int = LENGTH, anchor: int = ANCHORS[0]):
    """(first window, bytes, anchor hash) of the segments of a text: all its windows of `length` bytes, by runs of one anchor."""
    w = length - anchor + 1
    for base in range(0, len(text) - length + 1, _STRETCH):
        part = text[base : base + _STRETCH + length - 1]
        h = _hashes(np.frombuffer(part, np.uint8), anchor)
        n = len(part) - length + 1
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
        rows = np.r_[key, np.full(-len(key) % w, ~np.uint64(0))].reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        names = h[(low[first] & _PLACE).astype(np.int64)]
        sizes = np.diff(np.r_[first, n]) + length - 1
        yield (first + base), sizes, names


class RunLengthIndex:
    """The Burrows-Wheeler transform of a text as runs, with the suffix array sampled where runs start and end."""

    def __init__(self, text: bytes):
        n = len(text)
        x = np.frombuffer(text + bytes(8), np.uint8).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | x[k : k + n]
        self.levels, h = [], 8
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]]).astype(np.int32)
            if rank[order[-1]] == n - 1:  # the whole order: runs of one that is cut off at some depth do not carry longer matches
                break
            self.levels.append((h, rank))
            key = (rank.astype(np.uint64) + np.uint64(1)) << np.uint64(32)
            key[: max(0, n - h)] |= rank[h:].astype(np.uint64) + np.uint64(1)
            h *= 2
        self.text = x
        bwt = x[order - 1]  # of the first suffix, the padding
        heads = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        self.runs, self.size = bwt[heads], n
        self.starts, self.ends = order[heads[1:]], order[heads[1:] - 1]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of different suffixes, in steps by the ranks of ..., 16, 8 bytes and then bytes; all ranks above differ."""
        a, b = a.copy(), b.copy()
        first, n = a.copy(), self.size
        for h, rank in reversed(self.levels):
            inside = (a + h <= n) & (b + h <= n)
            same = inside.copy()
            same[inside] = rank[a[inside]] == rank[b[inside]]
            a[same] += h
            b[same] += h
        for _ in range(8):
            same = (a < n) & (b < n) & (self.text[np.minimum(a, n)] == self.text[np.minimum(b, n)])
            a[same] += 1
            b[same] += 1
        return a - first

    def matching_statistics(self) -> np.ndarray:
        """For each position, how many bytes from there on also start somewhere else.

        Within a run the match of a position is that of the one before, less one, so only the ends of
        runs are compared: with the suffix above for starts, with the one below for ends.
        """
        reach = self._common(self.starts, self.ends)
        best = np.zeros(self.size, np.int64)
        at = np.arange(self.size)
        for p in (self.starts, self.ends):
            far = np.zeros(self.size, np.int64)
            np.maximum.at(far, p, p + reach)
            best = np.maximum(best, np.maximum.accumulate(far) - at)
        return np.maximum(best, 0)


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text the starts of its windows that also start elsewhere in these texts."""
    hit = RunLengthIndex(b"\xff".join(texts) + b"\xff").matching_statistics() >= length
    out, at = [], 0
    for t in texts:
        out.append(np.flatnonzero(hit[at : at + max(0, len(t) - length + 1)]))
        at += len(t) + 1
    return out


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs (first, last) of consecutive numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist()))


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _scan(length: int, anchor: int):
    """(u, start, size, a, q): the segments of texts (u, t), with their anchor and the digest of their bytes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, cols, q = [], [[], [], []], []
                for u, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if text is None or len(text) < length:
                        continue
                    for first, sizes, names in segments(text, length, anchor):
                        ids += [u] * len(first)
                        for c, x in zip(cols, (first, sizes.astype(np.int32), names.view(np.int64))):
                            c.append(x)
                        q += [_digest(text[s : s + n]) for s, n in zip(first.tolist(), sizes.tolist())]
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), *[pa.array(np.concatenate(c)) for c in cols], pa.array(q, pa.binary())], ["u", "start", "size", "a", "q"])

    return run


def _cut_out(batches):
    """(a, q, b): the bytes of wanted segments, given by text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 32):
            part = batch.slice(at, 32)
            a, q, b = [], [], []
            for text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for w in wanted:
                    a.append(w["a"])
                    q.append(w["q"])
                    b.append(text[w["start"] : w["start"] + w["size"]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(q, pa.binary()), pa.array(b, pa.binary())], ["a", "q", "b"])


def _index_groups(length: int, index_bytes: int):
    """(q, lo, hi): repeated windows of segments (a, q, b) sorted by anchor; whole groups fill an index until it is large enough."""

    def find(rows: list) -> pa.RecordBatch:
        out = [(q, lo, hi) for (_, q, _), w in zip(rows, repeated_windows([r[2] for r in rows], length)) for lo, hi in _spans(w)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 3, (pa.binary(), pa.int64(), pa.int64()))], ["q", "lo", "hi"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= index_bytes and row[0] != rows[-1][0]:
                    yield find(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield find(rows)

    return run


def _remove(batches):
    for batch in batches:
        out = []
        for doc, text, marks in zip(*(c.to_pylist() for c in batch.columns)):
            text, kept, last, removed, spans = text or b"", hashlib.sha256(), 0, 0, 0
            runs: list = []
            for s, e in sorted((m["s"], m["e"]) for m in marks or ()):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            for s, e in runs:
                kept.update(text[last:s])
                last, removed, spans = e, removed + e - s, spans + 1
            kept.update(text[last:])
            out.append((doc, len(text), removed, spans, kept.hexdigest()))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _repeated(texts: DataFrame, length: int, anchors: tuple[int, ...], group_limit: int, index_bytes: int) -> DataFrame:
    """(u, s, e): ranges of texts (u, t) whose windows start from s to e - length and also start elsewhere; u may come again with the same t."""
    spark = texts.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    segs = materialize(texts.mapInArrow(_scan(length, anchors[0]), "u binary, start long, size int, a long, q binary"), "segments")
    # the bytes of a segment decide its anchor, so q alone names a kind of segment
    kinds = segs.groupBy("a", "q").agg(F.count("*").alias("n"), F.min(F.struct("u", "start", "size")).alias("one"))
    kinds = materialize(kinds, "kinds")
    shared = kinds.groupBy("a").agg(F.sum("n").alias("total"), F.count("*").alias("m")).where("total > 1").select("a", "m")
    known = materialize(kinds.join(shared, "a"), "shared")
    release(kinds)
    spans = known.where("n > 1").select("q", F.lit(0).cast("long").alias("lo"), (F.col("one.size") - length).cast("long").alias("hi"))
    wanted = known.where("m > 1").groupBy("one.u").agg(F.collect_list(F.struct("a", "q", "one.start", "one.size")).alias("wanted"))
    # of a text that comes again any row gives the bytes
    pieces = materialize(texts.join(wanted, "u").select("t", "wanted").mapInArrow(_cut_out, "a long, q binary, b binary").dropDuplicates(["q"]), "pieces")
    large = materialize(known.where(F.col("m") > group_limit).select("a").distinct(), "large") if len(anchors) > 1 else None
    small = pieces if large is None else pieces.join(large, "a", "left_anti")
    small = small.repartition(parts, "a").sortWithinPartitions("a")
    spans = spans.unionByName(small.mapInArrow(_index_groups(length, index_bytes), "q binary, lo long, hi long"))
    if large is not None and not large.isEmpty():
        again = _repeated(pieces.join(large, "a", "left_semi").select(F.col("q").alias("u"), F.col("b").alias("t")), length, anchors[1:], group_limit, index_bytes)
        spans = spans.unionByName(again.select(F.col("u").alias("q"), F.col("s").alias("lo"), (F.col("e") - length).alias("hi")))
    by_kind = materialize(spans.groupBy("q").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    marks = segs.join(by_kind, "q").select("u", "start", F.explode("spans").alias("x"))
    return marks.select("u", (F.col("start") + F.col("x.lo")).alias("s"), (F.col("start") + F.col("x.hi") + length).alias("e")).distinct()


def repeats(docs: DataFrame, length: int = LENGTH, anchors: tuple[int, ...] = ANCHORS, group_limit: int = GROUP_LIMIT, index_bytes: int = INDEX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, marks): documents (u, doc_id, t) with t the UTF-8 bytes and u a digest of doc_id and t, and per u its repeated byte ranges (s, e), which may overlap."""
    raw = numbered(docs)
    marks = _repeated(raw.select("u", "t"), length, anchors, group_limit, index_bytes)
    return raw, marks.groupBy("u").agg(F.collect_list(F.struct("s", "e")).alias("marks"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, **limits) -> DataFrame:
    """Per document (doc_id, n_bytes, n_removed, n_spans, kept_sha256) without the bytes of repeated strings.

    A byte goes if some string of `length` bytes over it also starts elsewhere in docs, the same text
    included, judged on the texts as given. Strings never cross documents. Null, empty and shorter texts
    keep all. Repeated rows are copies of each other, so both lose what is long enough. Empty table: no
    rows. Other columns are ignored. Equal segments are counted before they move, and groups that share an
    anchor are split by longer ones while they are too large, so no task meets a hot group.
    """
    raw, marks = repeats(docs, length, **limits)
    return raw.join(marks, "u", "left").select("doc_id", "t", "marks").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
