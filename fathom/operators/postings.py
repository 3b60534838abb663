"""A stored inverted index: postings with positions, clustered by term; lengths by row; corpus statistics in one row."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import add, and_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as T

#: Tables of an index and how they are laid out.
TABLES = {
    "postings": "term string, chunk_id long, col int, f int, positions array<int>, dl int",
    "lengths": "chunk_id long, dl int",
    "corpus": "rows long, tokens long",
}


def _inverted(marked: bool):
    """Postings of tokenized rows (chunk_id, cols, dl); a row's terms are all in one place, so nothing is shuffled. Marked: and one of the empty term for each row.

    f is how often the row has the term in all of its columns, on the first of the term's postings; on others it is 0.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[list] = [[], [], [], [], [], []]
                for chunk, cols, dl in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    often = Counter(t for x in cols for t in x["toks"] or ())
                    for x in cols + [{"col": -1, "toks": None}] * marked:
                        found: dict[str, list[int]] = {} if x["toks"] is not None else {"": []}
                        for k, term in enumerate(x["toks"] or ()):
                            found.setdefault(term, []).append(k)
                        out[0] += found
                        out[3] += [often.pop(t, 0) for t in found]
                        out[4] += found.values()
                        for col, value in zip((out[1], out[2], out[5]), (chunk, x["col"], dl)):
                            col += [value] * len(found)
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["term", "chunk_id", "col", "f", "positions", "dl"])

    return run


def _tokenized(rows: DataFrame, columns: list[str]) -> DataFrame:
    toks = [F.struct(F.lit(c).alias("col"), T.tokens(F.coalesce(F.col(name).cast("string"), F.lit(""))).alias("toks")) for c, name in enumerate(columns)]
    each = rows.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.array(*toks).alias("cols"))
    return each.withColumn("dl", F.aggregate("cols", F.lit(0), lambda n, x: n + F.size(x["toks"])))


def postings_of(rows: DataFrame, columns: list[str], marked: bool = False) -> DataFrame:
    """(term, chunk_id, col, f, positions, dl) of rows (chunk_id, columns)."""
    return _tokenized(rows, columns).mapInArrow(_inverted(marked), TABLES["postings"])


def build(rows: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """The index of rows (chunk_id, columns): a posting for each term, row and column, with the row's length in tokens."""
    lengths = _tokenized(rows, columns).select("chunk_id", "dl")
    return {"postings": postings_of(rows, columns), "lengths": lengths, "corpus": corpus(lengths)}


def corpus(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("rows"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("tokens"))


def clustered(postings: DataFrame) -> DataFrame:
    """By terms and sorted, so that a term's rows are few row groups, which their statistics single out; the adaptive plan splits very common terms."""
    return postings.hint("rebalance", "term").sortWithinPartitions("term", "chunk_id")


def write(rows: DataFrame, columns: list[str], path: str) -> None:
    """Write the index of rows; each text is tokenized once."""
    spark = rows.sparkSession
    clustered(postings_of(rows, columns, True)).write.parquet(f"{path}/postings")
    marks = spark.read.schema(TABLES["postings"]).parquet(f"{path}/postings").where(F.col("term") == "")
    marks.select("chunk_id", "dl").write.parquet(f"{path}/lengths")
    corpus(spark.read.schema(TABLES["lengths"]).parquet(f"{path}/lengths")).write.parquet(f"{path}/corpus")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: spark.read.schema(ddl).parquet(f"{path}/{t}") for t, ddl in TABLES.items()}


def update(index: dict[str, DataFrame], rows: DataFrame, columns: list[str], gone: DataFrame | None = None) -> dict[str, DataFrame]:
    """The index with the rows of these ids replaced, and those of `gone` (chunk_id) removed; only new texts are read."""
    new, ids = build(rows, columns), rows.select("chunk_id")
    ids = ids if gone is None else ids.unionByName(gone.select("chunk_id"))
    out = {t: index[t].join(ids, "chunk_id", "left_anti").unionByName(new[t]) for t in ("postings", "lengths")}
    return out | {"corpus": corpus(out["lengths"])}


def _less(k: int):
    return lambda x: x - k


def counts(index: dict[str, DataFrame], terms: list[str]) -> DataFrame:
    """(chunk_id, dl, f0, f1, ...): how often each term stands in rows that have any of their words.

    A term with blanks is a phrase: its words stand next to each other in one column. The filter on words
    reaches the scan of the postings; texts are not read.
    """
    words = list(dict.fromkeys(w for t in terms for w in t.split(" ")))
    found = index["postings"].where(F.col("term").isin(*words))
    own = found.groupBy("chunk_id", "col").agg(F.max("dl").alias("dl"), *[F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{k}") for k, w in enumerate(words)])

    def count(term: str):
        places = [F.col(f"p{words.index(w)}") for w in term.split(" ")]
        # where the phrase starts: each word's positions, less its own place in the phrase
        shifted = [F.transform(p, _less(k)) for k, p in enumerate(places)]
        return F.coalesce(F.size(reduce(F.array_intersect, shifted)), F.lit(0)) if len(places) > 1 else F.coalesce(F.size(places[0]), F.lit(0))

    has = lambda t: reduce(and_, [F.col(f"p{words.index(w)}").isNotNull() for w in t.split(" ")])
    each = own.select("chunk_id", "dl", *[F.when(has(t), count(t)).otherwise(0).alias(f"f{k}") for k, t in enumerate(terms)])
    return each.groupBy("chunk_id").agg(F.max("dl").alias("dl"), *[F.sum(f"f{k}").alias(f"f{k}") for k in range(len(terms))])


def scores(index: dict[str, DataFrame], terms: list[str], candidates: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """(chunk_id, bm25) of rows that hold every term: lower is better. Statistics are over all rows; candidates (chunk_id) then narrow."""
    if not terms:
        raise ValueError("a query needs a term")
    counted = counts(index, terms)
    having = counted.agg(*[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(terms))])
    totals = index["corpus"].select(F.col("rows"), (F.col("tokens") / F.col("rows")).alias("mean"))
    found = counted.where(reduce(and_, [F.col(f"f{k}") > 0 for k in range(len(terms))]))
    found = found if candidates is None else found.join(candidates.select("chunk_id"), "chunk_id", "left_semi")
    found = found.crossJoin(F.broadcast(having)).crossJoin(F.broadcast(totals))  # one row each
    part = lambda k: F.round(T.term_score(T.idf(F.col("rows"), F.col(f"n{k}")), F.col(f"f{k}"), F.col("dl"), F.col("mean")), 12)
    return found.select("chunk_id", F.round(-reduce(add, map(part, range(len(terms)))), digits).alias("bm25"))
