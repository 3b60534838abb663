"""A keyword index of immutable segments: new texts make a segment, texts that go are listed as deletions, and segments of one size are merged.

A segment has its rows' postings, clustered by term and by block of rows, for each term and block how
many rows have it, how often at most, and in which shortest row, and the rows' lengths. Deletions name
the segment that a row is in and list the terms that it had, so that what a query subtracts is read by
its terms alone. Numbers of rows and tokens are kept with each part and added up. What is written is
never changed, and an Index is a small value that says which parts count: a snapshot of it stays whole
while later ones are made.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass
from functools import cached_property, reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import postings as P

#: Rows of a block, on average.
BLOCK_ROWS = 256
#: So many segments whose postings are within a power of TIER are merged into one.
TIER = 4
#: Blocks that are looked at first for the score to beat; bounds and ids that the driver may hold.
FIRST_BLOCKS, HELD = 32, 4096
#: Scores are rounded to nine digits; a bound is raised by more than that can make up.
SLACK = 2e-9

SCHEMAS = {
    "postings": "term string, block int, chunk_id long, col int, f int, positions array<int>, dl int",
    "blocks": "term string, block int, n long, most int, shortest int",
    "lengths": "chunk_id long, block int, dl int",
}
DELETED = "term string, segment string, block int, chunk_id long"


@dataclass(frozen=True)
class Segment:
    id: str
    rows: int
    tokens: int
    postings: int
    blocks: int


@dataclass(frozen=True)
class Deletion:
    """by: for each segment how many rows and tokens of it are deleted here."""

    id: str
    by: dict[str, list[int]]


@dataclass(frozen=True)
class Manifest:
    segments: tuple[Segment, ...] = ()
    deletions: tuple[Deletion, ...] = ()

    def to_dict(self) -> dict:
        return {"segments": [asdict(s) for s in self.segments], "deletions": [asdict(d) for d in self.deletions]}

    @staticmethod
    def of(x: dict | None) -> Manifest:
        x = x or {}
        return Manifest(tuple(Segment(**s) for s in x.get("segments", ())), tuple(Deletion(**d) for d in x.get("deletions", ())))

    def totals(self) -> tuple[int, int]:
        """(rows, tokens) that count."""
        live = {s.id for s in self.segments}
        gone = [x for d in self.deletions for s, x in d.by.items() if s in live]
        return sum(s.rows for s in self.segments) - sum(x[0] for x in gone), sum(s.tokens for s in self.segments) - sum(x[1] for x in gone)


class Index:
    """The parts of a keyword index below a folder that a manifest names."""

    def __init__(self, spark: SparkSession, base: str, manifest: Manifest = Manifest()):
        self.spark, self.base, self.manifest = spark, base.rstrip("/"), manifest

    def with_manifest(self, manifest: Manifest) -> Index:
        return Index(self.spark, self.base, manifest)

    def _read(self, table: str, segments: list[str]) -> DataFrame:
        schema = SCHEMAS[table] + ", segment string"
        if not segments:
            return self.spark.createDataFrame([], schema)
        at = f"{self.base}/{table}"
        return self.spark.read.schema(schema).option("basePath", at).parquet(*[f"{at}/segment={s}" for s in segments])

    @cached_property
    def ids(self) -> list[str]:
        return [s.id for s in self.manifest.segments]

    @cached_property
    def deleted(self) -> DataFrame:
        """(term, segment, block, chunk_id): each term that a deleted row had, and the empty one."""
        paths = [f"{self.base}/deleted/{d.id}" for d in self.manifest.deletions]
        if not paths:
            return self.spark.createDataFrame([], DELETED)
        return self.spark.read.schema(DELETED).parquet(*paths).where(F.col("segment").isin(*self.ids))

    @cached_property
    def rows_deleted(self) -> int:
        return sum(x[0] for d in self.manifest.deletions for s, x in d.by.items() if s in self.ids)

    @cached_property
    def corpus(self) -> DataFrame:
        """One row (rows, tokens)."""
        return self.spark.createDataFrame([self.manifest.totals()], "rows long, tokens long")

    def live(self, table: str, words: list[str] | None = None, segments: list[str] | None = None) -> DataFrame:
        """Rows of postings, of these words if any are given, or of lengths, without those that are deleted."""
        rows = self._read(table, self.ids if segments is None else segments)
        if words is not None:
            rows = rows.where(F.col("term").isin(*words))
        if not self.rows_deleted:
            return rows
        gone = self.deleted.where(F.col("term") == "").select("segment", "chunk_id")
        if words is not None:
            gone = self.deleted.where(F.col("term").isin(*words)).select("segment", "chunk_id").distinct()
        return rows.join(F.broadcast(gone) if self.rows_deleted <= 100_000 else gone, ["segment", "chunk_id"], "left_anti")

    def tables(self) -> dict[str, DataFrame]:
        """postings, lengths and corpus as operators.postings takes them."""
        live = {t: self.live(t).select(*[c.split(" ")[0] for c in P.TABLES[t].split(", ")]) for t in ("postings", "lengths")}
        return live | {"corpus": self.corpus}

    # writing

    def add(self, rows: DataFrame, columns: list[str]) -> Index:
        """The index with a segment of rows (chunk_id, columns); rows is read twice."""
        n = rows.count()
        if not n:
            return self
        blocks = math.ceil(n / BLOCK_ROWS)
        found = P.postings_of(rows, columns, marked=True)
        return self._segment(found.withColumn("block", _block(blocks)), blocks)

    def _segment(self, found: DataFrame, blocks: int, drop: tuple[str, ...] = ()) -> Index:
        name, at = uuid.uuid4().hex, lambda t: f"{self.base}/{t}/segment={name}"
        columns = [c.split(" ")[0] for c in SCHEMAS["postings"].split(", ")]
        found.select(columns).hint("rebalance", "term").sortWithinPartitions("term", "block", "chunk_id").write.parquet(at("postings"))
        written = self.spark.read.schema(SCHEMAS["postings"]).parquet(at("postings"))
        lengths = written.where(F.col("term") == "").select("chunk_id", "block", "dl")
        lengths.hint("rebalance", "block").sortWithinPartitions("block", "chunk_id").write.parquet(at("lengths"))
        by_block = written.where((F.col("term") != "") & (F.col("f") > 0)).groupBy("term", "block")
        summary = by_block.agg(F.count("*").alias("n"), F.max("f").alias("most"), F.min("dl").alias("shortest"))
        summary.hint("rebalance", "term").sortWithinPartitions("term", "block").write.parquet(at("blocks"))
        rows, tokens, n = written.agg(F.count_if(F.col("term") == ""), F.coalesce(F.sum(F.when(F.col("term") == "", F.col("dl"))), F.lit(0)), F.count("*")).first()
        kept = tuple(s for s in self.manifest.segments if s.id not in drop)
        deletions = tuple(d for d in (Deletion(d.id, {s: x for s, x in d.by.items() if s not in drop}) for d in self.manifest.deletions) if d.by)
        return self.with_manifest(Manifest((*kept, Segment(name, rows, tokens, n, blocks)), deletions))

    def delete(self, rows: DataFrame, columns: list[str]) -> Index:
        """The index without rows (chunk_id, columns as they were indexed): their terms are read from the texts, not looked for in the postings. Rows that are not in the index are passed over."""
        if not self.manifest.segments:
            return self
        name = uuid.uuid4().hex
        at = f"{self.base}/deleted/{name}"
        sizes = F.create_map(*[F.lit(x) for s in self.manifest.segments for x in (s.id, s.blocks)])
        terms = P.postings_of(rows, columns, marked=True).select("term", "chunk_id").distinct()
        # a row's place is found in the lengths of its block of each segment
        places = rows.select(F.col("chunk_id").cast("long").alias("chunk_id")).distinct().withColumn("segment", F.explode(F.array(*map(F.lit, self.ids))))
        places = places.withColumn("block", F.pmod(F.xxhash64("chunk_id"), sizes[F.col("segment")]).cast("int"))
        lengths = self.live("lengths")
        few = places.select("block").distinct().limit(HELD + 1).collect()
        if len(few) <= HELD:  # the filter on blocks reaches the scan
            lengths = lengths.where(F.col("block").isin(*[r[0] for r in few]))
        found = lengths.join(places, ["segment", "block", "chunk_id"]).select("segment", "block", "chunk_id", "dl")
        out = terms.join(found, "chunk_id").select("term", "segment", "block", "chunk_id", "dl")
        out.hint("rebalance", "term").sortWithinPartitions("term", "segment", "block").write.parquet(at)
        written = self.spark.read.schema(DELETED + ", dl int").parquet(at).where(F.col("term") == "")
        by = {r["segment"]: [r["n"], r["tokens"]] for r in written.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens")).collect()}
        return self.with_manifest(Manifest(self.manifest.segments, (*self.manifest.deletions, Deletion(name, by)))) if by else self

    def replace(self, old: DataFrame, new: DataFrame, columns: list[str]) -> Index:
        """The index with rows old taken out and rows new put in, by their texts."""
        return self.delete(old, columns).add(new, columns)

    def merged(self) -> Index:
        """The index with TIER or more segments of one size merged into one, as long as there are such; rows deleted from them are gone for good."""
        index = self
        while True:
            tiers: dict[int, list[str]] = {}
            for s in index.manifest.segments:
                tiers.setdefault(int(math.log(max(1, s.postings), TIER)), []).append(s.id)
            full = next((ids for ids in tiers.values() if len(ids) >= TIER), None)
            if full is None:
                return index
            live = Manifest(tuple(s for s in index.manifest.segments if s.id in full), index.manifest.deletions).totals()[0]
            blocks = max(1, math.ceil(live / BLOCK_ROWS))
            found = index.live("postings", segments=full).withColumn("block", _block(blocks))
            index = index._segment(found, blocks, tuple(full))

    # searching

    def deleted_having(self, words: list[str]) -> dict[str, int]:
        """How many deleted rows have each word."""
        if not self.rows_deleted:
            return {}
        return {r["term"]: r["n"] for r in self.deleted.where(F.col("term").isin(*words)).groupBy("term").agg(F.count("*").alias("n")).collect()}

    def by_block(self, words: list[str]) -> DataFrame:
        """(segment, block, n0, most0, shortest0, n1, ...) of blocks that have any of the words; null where they lack one."""
        own = self._read("blocks", self.ids).where(F.col("term").isin(*words))
        is_word = lambda w, c: F.max(F.when(F.col("term") == w, F.col(c)))
        return own.groupBy("segment", "block").agg(*[is_word(w, c).alias(f"{c}{k}") for k, w in enumerate(words) for c in ("n", "most", "shortest")])

    def scores(self, words: list[str], weights: list[Column], mean: float, where: Column | None = None, blocks: DataFrame | None = None, digits: int = 9) -> DataFrame:
        """(chunk_id, bm25) of rows that have all words, in some blocks or in all; positions are not read."""
        rows = self.live("postings", words)
        if where is not None:
            rows = rows.where(where)
        if blocks is not None:
            rows = rows.join(blocks.select("segment", "block"), ["segment", "block"], "left_semi")
        own = rows.where(F.col("f") > 0).groupBy("chunk_id").agg(F.max("dl").alias("dl"), *[F.max(F.when(F.col("term") == w, F.col("f"))).alias(f"f{k}") for k, w in enumerate(words)])
        own = own.where(reduce(and_, [F.col(f"f{k}").isNotNull() for k in range(len(words))]))
        part = lambda k: F.round(T.term_score(weights[k], F.col(f"f{k}"), F.col("dl"), F.lit(mean)), 12)
        return own.select("chunk_id", F.round(-reduce(add, map(part, range(len(words)))), digits).alias("bm25"))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int")


def _in_blocks(chosen: list[Row]) -> Column:
    """A filter on blocks that reaches the scan."""
    by: dict[str, list[int]] = {}
    for r in chosen:
        by.setdefault(r["segment"], []).append(r["block"])
    return reduce(or_, [(F.col("segment") == s) & F.col("block").isin(*blocks) for s, blocks in by.items()], F.lit(False))


@dataclass
class Plan:
    """Rows that may be among the best, and how many blocks of those that have all words were read for them."""

    scored: DataFrame
    read: int | None
    blocks: int | None


def plan_top(index: Index, terms: list[str], limit: int, candidates: DataFrame | None = None) -> Plan:
    """What is to be scored for the `limit` best rows, candidates (chunk_id) alone if given: exactly these are among it, ties included.

    The blocks with the highest bounds are scored first; the last of the best rows there is the score to
    beat, and blocks whose bound is below it are not read. Where the driver may not hold all bounds, the
    blocks to read are found by a join. A phrase has no bound: its rows are all scored.
    """
    if not terms:
        raise ValueError("a query needs a term")
    if any(" " in t for t in terms):
        return Plan(P.scores(index.tables(), terms, candidates), None, None)
    rows, tokens = index.manifest.totals()
    mean, count = tokens / rows if rows else 1.0, range(len(terms))
    narrowed = lambda df: df if candidates is None else df.join(candidates.select("chunk_id"), "chunk_id", "left_semi")
    by_block, gone = index.by_block(terms), index.deleted_having(terms)
    held = by_block.limit(HELD + 1).collect()
    if whole := len(held) <= HELD:
        having = [sum(r[f"n{k}"] or 0 for r in held) for k in count]
    else:
        having = by_block.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in count]).first()
    having = [n - gone.get(t, 0) for n, t in zip(having, terms)]
    weights = [T.idf(F.lit(rows), F.lit(n)) for n in having]
    if not all(having):
        return Plan(index.scores(terms, weights, mean, F.lit(False)), 0, 0)
    # the score of a row that has each word as often as any of the block and is as short as its shortest
    best = reduce(add, [T.term_score(weights[k], F.col(f"most{k}"), F.col(f"shortest{k}"), F.lit(mean)) for k in count]) + SLACK
    every = reduce(and_, [F.col(f"most{k}").isNotNull() for k in count])
    bounds = by_block.where(every).select("segment", "block", best.alias("bound"))
    having_all = len([r for r in held if all(r[f"most{k}"] is not None for k in count)]) if whole else None
    found: list[Row] = []
    if limit > 0 and (having_all is None or having_all >= 4 * FIRST_BLOCKS):  # else all of them are read as fast
        held = bounds.orderBy(F.desc("bound"), "segment", "block").limit(HELD + 1).collect()
        first = narrowed(index.scores(terms, weights, mean, _in_blocks(held[:FIRST_BLOCKS])))
        found = first.orderBy("bm25", "chunk_id").limit(limit).collect()
    if len(found) < limit or limit <= 0:  # there is no score to beat
        return Plan(narrowed(index.scores(terms, weights, mean)), having_all, having_all)
    beat = -found[-1]["bm25"]
    chosen = [r for r in held if r["bound"] >= beat]
    if len(chosen) <= HELD:
        return Plan(narrowed(index.scores(terms, weights, mean, _in_blocks(chosen))), len(chosen), having_all)
    return Plan(narrowed(index.scores(terms, weights, mean, blocks=bounds.where(F.col("bound") >= beat))), None, None)
