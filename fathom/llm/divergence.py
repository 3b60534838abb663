"""Source divergence audit: how far the sources of a language are apart in their use of terms, with late string materialization.

A scan counts terms within tasks and writes, for each language, source and term, a 64-bit digest with its
counts. Shuffles, joins and rankings carry digests only. The least and the greatest string of every digest
tell whether several terms share it; such terms are told apart by their strings from then on. Text is
joined back to the terms that the result names, and to no others.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import BROADCAST_ROWS, materialize, release, small_join

MIN_DOCUMENTS = 10
UNIT = 1_000_000_000
TOP = 10
#: Sources are compared in blocks of this many, terms in chunks.
BLOCK = 64
CHUNK = 4096
#: A task's counts are written out once they hold so many terms, or so many bytes of terms.
HELD = 500_000
HELD_BYTES = 64 << 20
#: ASCII letters as lower case, all other ASCII as blanks; the bytes of other characters stay.
FOLD = bytes(c if c > 0x7F else c | 0x20 if chr(c).isalpha() else 0x20 for c in range(256))
_COUNTED = "lang string, source string, h long, n long, df long, term string, split string"


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8: runs of ASCII letters, folded to lower case, and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def _scan(bits: int, shared: frozenset[int] | bool = False):
    """Counts (lang, source, digest, occurrences, documents) of the terms of a task's documents.

    term is on one row for each term and batch written, split on the rows of all terms whose digest is in shared, or on all rows if that is True.
    """
    mask = (1 << bits) - 1

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]):
        seen: set[bytes] = set()
        for (lang, source), (n, df) in held.items():
            names = list(n)
            h = np.fromiter((xxhash.xxh3_64_intdigest(t) & mask for t in names), np.uint64, len(names)).view(np.int64)
            term = [t if t not in seen else None for t in names]
            split = names if shared is True else [t if x in shared else None for t, x in zip(names, h.tolist())] if shared else [None] * len(names)
            seen.update(names)
            k = len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(h), pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in names], pa.int64()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(split, pa.binary()).cast(pa.string())],
                ["lang", "source", "h", "n", "df", "term", "split"],
            )

    def run(batches):
        held, size, length = {}, 0, 0
        for batch in batches:
            langs, sources, texts = (batch.column(i) for i in range(3))
            for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts):
                found = terms(text.as_py())
                if not found:
                    continue
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                own, before = set(found), len(n)
                length += sum(len(t) for t in own if t not in n)
                n.update(found)
                df.update(own)
                size += len(n) - before
                if size >= HELD or length >= HELD_BYTES:
                    yield from rows(held)
                    held, size, length = {}, 0, 0
        yield from rows(held)

    return run


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept)), exact: the product may be longer than a long."""
    below = total + 2 * kept
    exact = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), below.cast("decimal(20,0)"))
    return 1 + F.when(n < 1 << 33, F.call_function("div", F.lit(UNIT) * (n + 2).cast("long"), below)).otherwise(exact)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pairs(batches):
    """Rows (lang, a, b, seen, value): for each pair of sources of two blocks, `_apart` summed over the terms of the batch, and the number of these terms.

    A row is a term that some source of the blocks has: used holds (place << 32 | share) of those sources,
    absent by place the share that a source has of a term that it lacks.
    """
    for batch in batches:
        by_key: dict[tuple, list[int]] = {}
        for k, own in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            by_key.setdefault(own, []).append(k)
        for (lang, one, two), rows in by_key.items():
            used, absent = batch.column(3).take(pa.array(rows)), np.array(batch.column(4)[rows[0]].as_py(), np.int64)
            flat, sizes = used.flatten().to_numpy(), pc.list_value_length(used).to_numpy()
            share = np.tile(absent, (len(rows), 1))
            share[np.repeat(np.arange(len(rows)), sizes), flat >> 32] = flat & 0xFFFFFFFF
            out = []
            for i in range(min(BLOCK, len(absent))):
                start = i + 1 if one == two else BLOCK
                gap, both = share[:, start:] - share[:, i : i + 1], share[:, start:] + share[:, i : i + 1]
                out.append((gap * gap // both).sum(0))
            a = np.repeat(np.arange(len(out)), [len(v) for v in out])
            b = np.concatenate([np.arange(i + 1 if one == two else 0, len(absent) - (0 if one == two else BLOCK)) for i in range(len(out))])
            n = len(a)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array(a + one * BLOCK, pa.int32()), pa.array(b + two * BLOCK, pa.int32()), pa.array(np.full(n, len(rows))), pa.array(np.concatenate(out))],
                ["lang", "a", "b", "seen", "value"],
            )


def _block_pairs(df: DataFrame) -> DataFrame:
    """df with a copy for each pair (one, two) of blocks of the language that its source s is in, and its place there."""
    own = F.floor(F.col("s") / BLOCK).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, own).alias("one"), F.greatest(x, own).alias("two")))
    df = df.withColumn("pair", F.explode(pairs)).withColumns({"one": F.col("pair.one"), "two": F.col("pair.two")})
    return df.withColumn("place", F.when(own == F.col("one"), F.col("s") - BLOCK * F.col("one")).otherwise(BLOCK + F.col("s") - BLOCK * F.col("two")))


def _counts(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(counts (lang, source, h, split, n, df), names (h, lo, hi)); split is a term's string where others share its digest, else null."""
    compact = lambda df, path: df.write.option("compression", "zstd").parquet(path)
    counted = materialize(docs.mapInArrow(_scan(bits), _COUNTED), "counted", write=compact)
    names = materialize(counted.where("term is not null").groupBy("h").agg(F.min("term").alias("lo"), F.max("term").alias("hi")), "names")
    shared = [r["h"] for r in names.where("lo <> hi").select("h").limit(BROADCAST_ROWS + 1).collect()]
    if shared:  # texts are read again; beyond the bound every term is told apart by its string
        release(counted)
        counted = materialize(docs.mapInArrow(_scan(bits, frozenset(shared) if len(shared) <= BROADCAST_ROWS else True), _COUNTED), "counted", write=compact)
    return counted.groupBy("lang", "source", "h", "split").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), names


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, bits: int = 64) -> DataFrame:
    """How far sources are apart: rows (lang, source, part, item, value, rank) of docs (text, lang, source).

    Each language keeps the V terms that occur in at least min_documents of its documents. A group (lang,
    source), and a language as a whole, has the share p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)) of each
    kept term, N being its counts' sum. Two shares p, q are f = floor((p - q)^2 / (p + q)) apart. Part `pair`
    has a row for each other source of the language, value the sum of f over all kept terms. Part `term` has
    those of the group's own terms whose share is over the language's, with f against that, to rank `top`.
    Ranks are by value, descending, then by item in the order of UTF-8. All arithmetic is exact.

    Null text, lang and source are ''. Repeated documents count each. A group without terms has its pairs; a
    language of one source has none, one without kept terms has pairs of value 0. Empty table: no rows.
    Other columns are ignored. bits is the length of a digest; fewer make digests meet, which changes no row.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts, names = _counts(docs, bits)
    by_term = Window.partitionBy("lang", "h", "split")
    counts = counts.withColumns({"all_n": F.sum("n").over(by_term), "all_df": F.sum("df").over(by_term), "first": F.min("source").over(by_term) == F.col("source")})
    kept = materialize(counts.where(F.col("all_df") >= min_documents).select("lang", "source", "h", "split", "n", "all_n", "first"), "kept")

    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts"))
    groups = docs.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").fillna(0, ["total", "firsts"])
    whole = Window.partitionBy("lang")
    groups = groups.withColumns({"lang_total": F.sum("total").over(whole), "V": F.sum("firsts").over(whole), "s": F.row_number().over(whole.orderBy("source")) - 1, "blocks": F.ceil(F.count("*").over(whole) / BLOCK).cast("int")})
    groups = materialize(groups.withColumn("absent", F.when(F.col("V") > 0, _share(F.lit(0), F.col("total"), F.col("V"))).otherwise(0)).drop("firsts"), "groups")
    own = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "total", "lang_total", "V", "s", "blocks")
    scored = small_join(kept, own, lambda a, b: (a["lang"] == b["g_lang"]) & (a["source"] == b["g_source"]), "h")
    scored = scored.withColumn("p", _share(F.col("n"), F.col("total"), F.col("V"))).withColumn("q", _share(F.col("all_n"), F.col("lang_total"), F.col("V")))

    # part term: first each group's value at rank `top`, then all terms that come to it, then their text
    over = scored.where("p > q").select("lang", "source", "h", "split", _apart(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    least = over.withColumn("at", F.row_number().over(best)).where(F.col("at") <= top).groupBy("lang", "source").agg(F.min("value").alias("least"))
    least = least.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "least")
    found = small_join(over, least, lambda a, b: (a["lang"] == b["g_lang"]) & (a["source"] == b["g_source"]), "h").where("value >= least")
    found = materialize(found.select("lang", "source", "h", "split", "value"), "found")
    texts = small_join(names, found.where("split is null").select(F.col("h").alias("wanted")).distinct(), lambda a, b: a["h"] == b["wanted"], "h").select("h", "lo")
    found = found.join(texts, "h", "left").select("lang", "source", F.coalesce("split", "lo").alias("item"), "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_terms = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    # part pair: terms that neither source of a pair has are equal for it, so that they are counted, not visited
    used = _block_pairs(scored.select("lang", "s", "blocks", "h", "split", "p"))
    used = used.groupBy("lang", "one", "two", "h", "split").agg(F.collect_list(F.shiftleft(F.col("place").cast("long"), 32) + F.col("p")).alias("used"))
    absent = _block_pairs(groups.select("lang", "s", "blocks", "absent")).groupBy("lang", "one", "two").agg(F.sort_array(F.collect_list(F.struct("place", "absent"))).alias("x"))
    absent = absent.select(F.col("lang").alias("g_lang"), F.col("one").alias("g_one"), F.col("two").alias("g_two"), F.col("x.absent").alias("absent"))
    used = small_join(used, absent, lambda a, b: (a["lang"] == b["g_lang"]) & (a["one"] == b["g_one"]) & (a["two"] == b["g_two"]), "h")
    sums = used.select("lang", "one", "two", "used", "absent").mapInArrow(_pairs, "lang string, a int, b int, seen long, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("seen").alias("seen"), F.sum("value").alias("value"))
    left = groups.select("lang", "source", "V", "s", "absent", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = groups.select("lang", F.floor(F.col("s") / BLOCK).cast("int").alias("block"), F.col("s").alias("t"), F.col("source").alias("item"), F.col("absent").alias("other"))
    pairs = left.join(right, ["lang", "block"]).where("s <> t").withColumns({"a": F.least("s", "t"), "b": F.greatest("s", "t")}).join(sums, ["lang", "a", "b"], "left")
    rest = (F.col("V") - F.coalesce("seen", F.lit(0))) * F.coalesce(_apart(F.col("absent"), F.nullif(F.col("other"), F.lit(0))), F.lit(0))
    pairs = pairs.select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + rest).cast("long").alias("value"))
    by_pairs = pairs.withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return by_pairs.select(columns).unionByName(by_terms.select(columns))
