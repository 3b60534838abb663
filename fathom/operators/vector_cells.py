"""Exact nearest vectors without a full scan: vectors stored by cell, and bounds on what a cell can hold.

Vectors are dealt to the nearest of a set of directions; a cell knows the widest angle between its
direction and its vectors. By the triangle inequality of angles no vector of a cell is nearer to a query
than the angle to the cell's direction less that width. The nearest cells are read first; the last of the
best vectors found there is the similarity to beat, and cells that cannot reach it are not opened.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fathom.functions import vector as V

#: The directions are fitted to at most this many vectors; there are at most MOST_CELLS of them.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 4096, 10
#: Similarities are computed from 32-bit products; bounds are raised by more than that can make up.
SLACK = 1e-5
#: The cell of vectors without a direction: of another length than the most common one, without length, or not finite. It is always read.
ODD = -1


@dataclass
class Cell:
    number: int
    direction: np.ndarray | None
    width: float
    rows: int


class Cells:
    """Stored vectors (chunk_id, vector) by cell below a folder."""

    def __init__(self, spark: SparkSession, path: str, cells: list[Cell]):
        self.spark, self.path, self.cells = spark, path, cells

    def rows(self, cells: list[Cell]) -> DataFrame:
        """(chunk_id, vector) of these cells: other cells' files are not opened."""
        if not cells:
            return self.spark.createDataFrame([], "chunk_id long, vector array<float>")
        return self.spark.read.schema("chunk_id long, vector array<float>").parquet(*[f"{self.path}/cell={c.number}" for c in cells])

    def bounds(self, query: np.ndarray) -> list[tuple[float, Cell]]:
        """Each cell with the highest similarity that one of its vectors may have, best first."""
        out, length = [], float(np.linalg.norm(query))
        for c in self.cells:
            if c.direction is None or not length or not math.isfinite(length):
                out.append((math.inf, c))
            elif len(c.direction) != len(query):
                out.append((-math.inf, c))  # of another length: none of them is compared
            else:
                angle = math.acos(float(np.clip(c.direction @ query / length, -1, 1)))
                out.append((math.cos(max(0.0, angle - c.width)) + SLACK, c))
        return sorted(out, key=lambda x: (-x[0], x[1].number))


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Directions for rows of length one: means of the rows that are nearest to them, from rows that are far apart."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(cells, len(sample)):
        chosen.append(int(nearest.argmin()))
        np.maximum(nearest, sample @ sample[chosen[-1]], out=nearest)
    at = sample[chosen]
    for _ in range(ROUNDS):
        own = (sample @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(lengths > 1e-9, sums / np.maximum(lengths, 1e-9), at)
    return at


def _dealt(directions: np.ndarray):
    dim = directions.shape[1]

    def run(batches):
        for batch in batches:
            cell, angle = np.full(batch.num_rows, ODD, np.int32), np.zeros(batch.num_rows)
            rows = batch.column(1).to_pylist()
            fit_ = [k for k, v in enumerate(rows) if v is not None and len(v) == dim and None not in v]
            x = np.array([rows[k] for k in fit_], np.float64).reshape(-1, dim)
            length = np.linalg.norm(x, axis=1)
            sound = np.isfinite(length) & (length > 0)
            x, at = x[sound] / length[sound, None], np.array(fit_, int)[sound]
            near = x @ directions.T
            cell[at] = near.argmax(1) if len(at) else ODD
            angle[at] = np.arccos(np.clip(near.max(1), -1, 1)) if len(at) else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(angle)], ["chunk_id", "vector", "cell", "angle"])

    return run


def write(vectors: DataFrame, path: str, cells: int | None = None) -> Cells:
    """Write vectors (chunk_id, vector) by cell; without a number of cells there are as many as a quarter of the root of the rows.

    The directions are fitted on the driver to at most SAMPLE vectors, those of the least hashes; every vector is stored.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("vector").cast("array<float>").alias("vector"))
    sizes = vectors.where(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not sizes:
        directions = np.zeros((1, 1))
    else:
        size, n = sizes[0]
        sound = vectors.where(F.size("vector") == size).where(F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
        taken = sound.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).collect()
        x = np.array([r["vector"] for r in taken], np.float64).reshape(-1, size)
        x = x[np.linalg.norm(x, axis=1) > 0]
        directions = fit(x / np.linalg.norm(x, axis=1, keepdims=True), max(1, min(MOST_CELLS, cells or round(math.sqrt(n) / 4)))) if len(x) else np.zeros((1, size))
    dealt = vectors.mapInArrow(_dealt(directions), "chunk_id long, vector array<float>, cell int, angle double")
    dealt.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    found = spark.read.schema("cell int, angle double").parquet(path).groupBy("cell").agg(F.max("angle").alias("width"), F.count("*").alias("n")).collect()  # a row for each cell
    return Cells(spark, path, [Cell(r["cell"], directions[r["cell"]] if r["cell"] != ODD else None, r["width"] or 0.0, r["n"]) for r in sorted(found, key=lambda r: r["cell"])])


@dataclass
class Plan:
    scored: DataFrame
    read: list[Cell]


def plan_nearest(index: Cells, query: list[float], limit: int, candidates: DataFrame | None = None, min_relevance: float = 0.0) -> Plan:
    """(chunk_id, similarity) of the rows of all cells that may hold one of the `limit` nearest vectors, of candidates (chunk_id) alone if given; and these cells."""

    def scored(cells: list[Cell]) -> DataFrame:
        rows = index.rows(cells)
        rows = rows if candidates is None else rows.join(candidates.select("chunk_id"), "chunk_id", "left_semi")
        q = F.array(*[F.lit(float(x)) for x in query]).cast("array<float>")
        out = rows.where(F.size("vector") == len(query)).select("chunk_id", V.cosine(F.col("vector"), q).alias("similarity"))
        return out.where(F.col("similarity") >= min_relevance) if min_relevance > 0 else out

    bounds = [(b, c) for b, c in index.bounds(np.array(query, np.float64)) if b > -math.inf and (min_relevance <= 0 or b >= min_relevance)]
    first, rows = [], 0
    for _, c in bounds:
        if rows >= 4 * limit:
            break
        first.append(c)
        rows += c.rows
    best: list[Row] = []
    if len(first) < len(bounds):
        best = scored(first).orderBy(F.desc("similarity"), "chunk_id").limit(limit).collect()
    beat = best[-1]["similarity"] if len(best) >= limit > 0 else -math.inf
    read = [c for b, c in bounds if not b < beat]
    return Plan(scored(read), read)


def nearest(index: Cells, query: list[float], limit: int, candidates: DataFrame | None = None, min_relevance: float = 0.0) -> DataFrame:
    """(chunk_id, similarity) of the `limit` vectors nearest to query, nearest first, ties by chunk_id: the same rows as search.vector_search() gives."""
    return plan_nearest(index, query, limit, candidates, min_relevance).scored.orderBy(F.desc("similarity"), "chunk_id").limit(max(limit, 0))
