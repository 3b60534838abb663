"""Packing token sequences: non-negative least squares over shallow length combinations, then greedy residuals.

Only a histogram of piece lengths, never the pieces, reaches the driver: its size depends on the window.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import materialize

#: Where str.split() and a tokenizer's own notion of white space may part.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Chunks kept by each worker with their ids; more are encoded anew each time.
CACHE = 700_000
_MARK = "\x01"
#: A letter or digit, then ASCII punctuation to the end.
_TAIL = re.compile(r"(.*[^\W_])([!-/:-@\[-`{-~]+)", re.DOTALL)


class ChunkEncoder:
    """Ids of whole texts by a tokenizers file whose pre-tokenizer never crosses white space.

    A text is split at white space and each chunk's ids are looked up, so that the tokenizer sees each
    different chunk once per worker; the ids are those of encoding the whole text. Chunks that are not
    known yet are encoded together, parted by a control character whose own ids show the borders.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task is all there is
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.room, self.known = cache, {}
        self.mark = self._encode(_MARK)
        if len(self.mark) != 1:
            raise ValueError("the tokenizer has no single id for the parting character")

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks not known yet; punctuation at an end is looked up apart, as no token crosses into it."""
        found, parts, alone = {}, {}, set()
        for c in chunks:
            m = None if "<|" in c else _TAIL.fullmatch(c)
            parts[c] = m.groups() if m else (c,)
            alone.update(parts[c])
        new = [p for p in alone if p not in self.known]
        for p in [p for p in new if _MARK in p]:
            found[p] = np.array(self._encode(p), "<u4").tobytes()
        plain = [p for p in new if p not in found]
        lines = [plain[k : k + 256] for k in range(0, len(plain), 256)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([f" {_MARK} ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) != len(line) - 1:
                found |= {p: np.array(self._encode(p), "<u4").tobytes() for p in line}
                continue
            raw, at = ids.tobytes(), 0
            for p, cut in zip(line, [*(4 * cuts).tolist(), len(raw)]):
                found[p] = raw[at:cut]
                at = cut + 4
        get = lambda p: found[p] if p in found else self.known[p]
        return found | {c: b"".join(map(get, p)) for c, p in parts.items() if len(p) > 1}

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; none for null."""
        out: list = []
        get, miss = self.known.get, set()
        for t in texts:
            if t and _ODD_SPACE.search(t):
                out.append((None, [np.array(self._encode(t), "<u4").tobytes()]))
                continue
            t = t or ""
            try:
                t.encode("latin-1")
                t = t.lower()  # the tokenizer does so too; in Latin-1 every letter has one lower case
            except UnicodeEncodeError:
                pass
            chunks = t.split()
            ids = list(map(get, chunks))
            if None in ids:
                miss.update(c for c, x in zip(chunks, ids) if x is None)
                out.append((chunks, ids))
            else:
                out.append((None, ids))
        more = self._learn(miss) if miss else {}
        if len(self.known) + len(more) <= self.room:
            self.known.update(more)
        return [b"".join(ids if chunks is None else [more[c] if x is None else x for c, x in zip(chunks, ids)]) for chunks, ids in out]


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): documents cut into whole windows and a rest.

    Null text: as empty, which is the end id alone. One pass, no shuffle.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encode = _encoder(tokenizer).encode_batch
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    raw = memoryview(ids + end)
                    n = len(raw) // 4
                    out += ((doc, s, min(window, n - s), zlib.crc32(raw[4 * s : 4 * (s + window)]), n) for s in range(0, n, window))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """min |ax - b| over x >= 0, by the active-set method: a variable enters by its gradient, and leaves where it would turn negative."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    bar = tol * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[0] + 10):
        slope = a.T @ (b - a @ x)
        slope[passive] = -np.inf
        enter = int(np.argmax(slope)) if len(slope) else 0
        if not len(slope) or slope[enter] <= bar:
            break
        passive[enter] = True
        while True:
            on = np.flatnonzero(passive)
            chosen = a[:, on]
            z = np.linalg.solve(chosen.T @ chosen + 1e-12 * np.eye(len(on)), chosen.T @ b)
            if (z > 0).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - z[low], 1e-300))
            x[on] += step * (z - x[on])
            gone = on[(x[on] <= 1e-12) & low]
            if not len(gone):
                gone = on[low][:1]
            x[gone], passive[gone] = 0, False
            if not passive.any():
                break
    return x


def combinations_of(bins: int) -> list[tuple[int, ...]]:
    """All ways to fill `bins` exactly with one, two or three lengths, each with its longest first."""
    two = [(a, bins - a) for a in range(bins - 1, (bins - 1) // 2, -1)]
    three = [(a, b, bins - a - b) for a in range(bins - 2, 0, -1) for b in range(min(a, bins - a - 1), 0, -1) if b >= bins - a - b]
    return [(bins,), *two, *three]


def plan(counts: dict[int, int], bins: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in bins, repeats) that use every piece of the histogram once.

    Least squares weighs a length's misfit by its share of a window, as short pieces fit anywhere;
    repeats are rounded and held to what is there; what is left is packed greedily, longest first,
    each time repeating one filled window as often as its lengths allow.
    """
    left = {k: int(v) for k, v in counts.items() if v > 0}
    total, out = sum(left.values()), []
    if not total:
        return []
    fits = [c for c in combinations_of(bins) if all(k in left for k in c)]
    if fits:
        rows = sorted(left)
        at = {k: i for i, k in enumerate(rows)}
        weight = np.sqrt(np.array(rows) / bins)
        a = np.zeros((len(rows), len(fits)))
        for j, c in enumerate(fits):
            for k in c:
                a[at[k], j] += 1
        x = nnls(a * weight[:, None], np.array([left[k] for k in rows]) * weight / total) * total
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            c = fits[j]
            if n := min(int(x[j] + 0.5), *(left[k] // c.count(k) for k in c)):
                out.append((c, n))
                for k in c:
                    left[k] -= n
    left = {k: v for k, v in left.items() if v}
    while left:
        room, take = bins, {}
        for k in sorted(left, reverse=True):
            if n := min(room // k, left[k]):
                take[k] = n
                room -= n * k
            if not room:
                break
        n = min(left[k] // m for k, m in take.items())
        out.append((tuple(k for k, m in take.items() for _ in range(m)), n))
        for k, m in take.items():
            left[k] -= n * m
        left = {k: v for k, v in left.items() if v}
    return out


def _slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(bin, first rank, end rank, first sequence, slot) for every slot of every combination."""
    used: dict[int, int] = {}
    base, out = 0, []
    for combo, n in planned:
        for slot, k in enumerate(combo):
            lo = used.get(k, 0)
            out.append((k, lo, lo + n, base, slot))
            used[k] = lo + n
        base += n
    return out


def pack(cut: DataFrame, window: int = 4096, bin_width: int = 16, rows_per_bucket: int = 20_000) -> DataFrame:
    """Pieces (doc_id, start, length, ...) with the sequence and the offset in it that each gets.

    Lengths are rounded up to bins of bin_width for planning only; offsets are by true lengths, gapless
    from 0. A piece's rank among those of its bin is its bucket's offset plus its place in the bucket;
    buckets are seeded hashes, so a bin that holds most pieces is spread over many tasks; a column salt,
    which numbers rows as they were written, spreads pieces that are equal throughout. Ties (equal doc_id,
    start, checksum and salt) take any of their places. Nothing to pack: no rows.
    """
    spark, bins = cut.sparkSession, -(-window // bin_width)
    cut = cut if "salt" in cut.columns else cut.withColumn("salt", F.lit(0))
    cut = cut.withColumn("bin", F.ceil(F.col("length") / bin_width).cast("int"))
    counts = {r["bin"]: r["n"] for r in cut.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan(counts, bins))
    buckets = max(1, -(-sum(counts.values()) // rows_per_bucket))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt", F.lit(1)), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("bin", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bin").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bin", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("bin", "bucket").orderBy("doc_id", "start", "ids_crc32", "salt"))
    ranked = dealt.withColumn("place", place).join(sizes, ["bin", "bucket"]).withColumn("rank", F.col("first") + F.col("place") - 1)
    # as many slots as the plan has, which the number of bins bounds whatever the rows
    table = spark.createDataFrame(slots, "bin int, lo long, hi long, base long, slot int")
    put = ranked.join(F.broadcast(table), "bin").where("rank >= lo and rank < hi").withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("lo"))
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return put.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")).drop("bin", "bucket", "place", "first", "rank", "lo", "hi", "base", "slot", "salt")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, cut: Callable[..., DataFrame] = pieces) -> DataFrame:
    """Pack all docs (doc_id, text): (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    Each id lies in one piece; a document longer than the window gives whole windows and a rest. Null
    and empty texts hold the end id alone. Repeated rows are packed as often as they come. Empty table:
    no rows. Other columns are ignored. The tokenizer runs once: pieces are kept in the shared folder.
    """
    numbered = cut(docs, tokenizer, window, end_id).withColumn("salt", (F.monotonically_increasing_id() % 65536).cast("int"))
    return pack(materialize(numbered, "pieces"), window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
