"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

The tokens of the join are shingles of SHINGLE words, ordered by rarity in the whole document table. A
window must be contained whole, so its necessary prefix is one shingle, the rarest; documents are joined
on that one only. Its position in the window gives where the window would start, which must leave room
before and behind (length and positional bounds), and the candidate is then compared word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import materialize, numbered, word_hashes, word_edges

SHINGLE = 3
#: The most shingles (of 8 bytes) that are broadcast for documents to be filtered by; beyond that they are joined by a shuffle.
KEYS = 4_000_000
#: Lower-cases A-Z, turns every ASCII character that is no letter or digit into a blank.
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_NONE = np.zeros(0, np.int64)


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; none for null."""
    return text.translate(_WORD_BYTES).split() if text else []


def _shingles(text: bytes, widths: list[int]) -> tuple[bytes, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(the text in lower case and blanks, starts and ends of its words, and by width the hashes of the shingles at each word)."""
    plain = text.translate(_WORD_BYTES)
    starts, ends = word_edges(plain)
    own, out = word_hashes(plain, starts, ends), []
    for width in widths:
        n = len(own) - width + 1
        h = np.full(max(n, 0), width, np.uint64)
        for k in range(width if n > 0 else 0):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
        out.append(h.view(np.int64))
    return plain, starts, ends, out


class _Keys:
    """A set of hashes; nearly all others are told by one look into a table of bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.low = np.zeros(1 << max(16, int(len(self.keys)).bit_length() + 4), bool)
        self.low[self.keys & (len(self.low) - 1)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of h that hold a key."""
        at = np.flatnonzero(self.low[h & (len(self.low) - 1)])
        if len(at):
            where = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            at = at[self.keys[where] == h[at]]
        return at


def _item_windows(window: int):
    """(item, win): each distinct window of an item, as an array of words."""

    def run(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                out += [(item, x) for x in {tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1) if w else 0)}]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([list(x[1]) for x in out], pa.list_(pa.binary()))], ["item", "win"])

    return run


def _parts(batches):
    """(win, size, h, off): the shingles of windows (win); of windows that are shorter than a shingle the whole."""
    for batch in batches:
        wins, hashes, offs = batch.column(0).to_pylist(), [], []
        for w in wins:
            h = _shingles(b" ".join(w), [min(SHINGLE, len(w))])[3][0]
            hashes.append(h.tolist())
            offs.append(list(range(len(h))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in wins], pa.int32()), pa.array(hashes, pa.list_(pa.int64())), pa.array(offs, pa.list_(pa.int32()))], ["win", "size", "hs", "offs"])


def _count(widths: list[int], keys):
    """(h, n): how often shingles stand in each batch of texts (t); with keys only those."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = []
                for text in batch.column(0).slice(at, 256).to_pylist():
                    for h in _shingles(text, widths)[3] if text else ():
                        found.append(h[keys.value.find(h)] if keys else h)
                h, n = np.unique(np.concatenate(found) if found else _NONE, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

    return run


_SCAN = "u binary, doc_id long, n_words long, at int, h long, near array<binary>"


def _scan(widths: list[int], window: int, keys, context: bool, whole: bool):
    """Of texts (u, doc_id, t, ats): with whole a row for each; and one for each shingle among keys (or all, or those at ats), with context the words around it.

    near has the window - 1 words before, empty ones past the start, the word itself, and up to window - 1 words after.
    """

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out = []
                for u, doc, text, ats in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                    plain, starts, ends, hashes = _shingles(text or b"", widths)
                    n = len(starts)
                    if whole:
                        out.append((u, doc, n, None, None, None))
                    for h in hashes:
                        places = keys.value.find(h) if keys else np.arange(len(h)) if ats is None else np.array([x for x in ats if x < len(h)], np.int64)
                        for i in places.tolist():
                            near = [plain[starts[j] : ends[j]] if j >= 0 else b"" for j in range(i - window + 1, min(n, i + window))] if context else None
                            out.append((u, doc, n, i, int(h[i]), near))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)], ["u", "doc_id", "n_words", "at", "h", "near"])

    return run


def _join(docs: DataFrame, benchmark: DataFrame, window: int, most_keys: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, windows): a row (u, doc_id, n_words) per document, its verified (u, s, size, win), and the (item, win) of the benchmark."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.encode("text", "UTF-8").alias("t"))
    windows = materialize(items.mapInArrow(_item_windows(window), "item string, win array<binary>"), "windows")
    parts = windows.select("win").distinct().mapInArrow(_parts, "win array<binary>, size int, hs array<long>, offs array<int>")
    parts = materialize(parts.select("win", "size", F.explode(F.arrays_zip("hs", "offs")).alias("x")).select("win", "size", F.col("x.hs").alias("h"), F.col("x.offs").alias("off")), "parts")
    widths = sorted(r[0] for r in parts.select(F.least("size", F.lit(SHINGLE))).distinct().collect())  # three at most

    def known(rows: DataFrame):
        """The hashes of rows as a broadcast if they are few enough."""
        held = rows.select("h").distinct().limit(most_keys + 1).toArrow().column(0).combine_chunks().to_numpy()
        return spark.sparkContext.broadcast(_Keys(held)) if len(held) <= most_keys else None

    raw = numbered(docs)
    n = raw.select("t").mapInArrow(_count(widths, known(parts)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rare = parts.join(n, "h", "left").groupBy("win", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")).alias("x"))
    prefixes = materialize(rare.select("win", "size", "x.h", "x.off"), "prefixes")

    keys, plain = known(prefixes), raw.withColumn("ats", F.lit(None).cast("array<int>"))
    if keys:
        scanned = materialize(plain.mapInArrow(_scan(widths, window, keys, True, True), _SCAN), "scanned")
        rows, found = scanned.where("at is null"), scanned.where("at is not null")
    else:
        rows = materialize(plain.mapInArrow(_scan([], window, None, False, True), _SCAN), "scanned")
        places = plain.mapInArrow(_scan(widths, window, None, False, False), _SCAN).join(prefixes.select("h").distinct(), "h", "left_semi")
        found = raw.join(places.groupBy("u").agg(F.collect_set("at").alias("ats")), "u").select("u", "doc_id", "t", "ats").mapInArrow(_scan(widths, window, None, True, False), _SCAN)
    start = F.col("at") - F.col("off")
    room = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    hits = found.select("u", "n_words", "at", "h", "near").join(prefixes, "h").where(room).where(F.slice("near", F.lit(window) - F.col("off"), F.col("size")) == F.col("win"))
    return rows.select("u", "doc_id", "n_words"), materialize(hits.select("u", start.alias("s"), "size", "win").distinct(), "hits"), windows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_keys: int = KEYS) -> DataFrame:
    """One row per document: which of its words lie in a window of a benchmark item.

    docs (doc_id, text), benchmark (item_id, text). A window is `window` consecutive item words; an
    item of fewer words is one window, one of none has none. Documents are not shuffled as long as the
    benchmark has at most most_keys different shingles, which are then broadcast; beyond that the
    shingles of documents are joined with them by a shuffle, with the same result.

    Null or empty texts: no words, no hits. Items that share a window all count; rows that repeat an
    item_id count as one item, a null item_id as ''. Repeated documents each give a row. Empty
    benchmark: nothing is hit. Other columns are ignored.
    """
    rows, hits, windows = _join(docs, benchmark, window, most_keys)
    places = hits.select("u", F.explode(F.sequence("s", F.col("s") + F.col("size") - 1)).alias("p")).distinct().groupBy("u").agg(F.count("*").alias("n_hit"))
    items = hits.select("u", "win").distinct().join(windows, "win").select("u", "item").distinct()
    items = items.groupBy("u").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("ids"))
    full = rows.join(places.join(items, "u"), "u", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return full.select("doc_id", "n_words", n("n_hit"), n("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_keys: int = KEYS) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of a benchmark item. Edge cases as in contamination()."""
    hits = _join(docs, benchmark, window, most_keys)[1]
    lost, whole = hits.select(F.col("u").alias("__u")).distinct(), docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    named = numbered(whole.select("__row", F.col("__row.doc_id").alias("doc_id"), F.col("__row.text").alias("text")), "__row")
    return named.join(lost, named["u"] == lost["__u"], "left_anti").select("__row.*")
