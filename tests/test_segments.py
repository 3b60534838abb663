"""The segmented keyword index, top rows by blocks, and nearest vectors by cells."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import search as S
from fathom.operators import segments, vector_cells
from fathom.operators.segments import Index, Manifest

COLUMNS = ["content", "title"]
SCHEMA = "chunk_id long, content string, title string"


def texts(rng, ids):
    words = ["the", "of", "cat", "dog", "É", "user_name", "x1", "rare", "tree", "sea"]
    weights = [30, 20, 9, 7, 4, 3, 2, 0.3, 5, 5]
    return [(k, " ".join(rng.choices(words, weights, k=rng.randint(0, 60))), rng.choice([None, "", "the cat", "dog of sea"])) for k in ids]


def expected(spark, rows, terms):
    return {r["chunk_id"]: r["bm25"] for r in S.keyword_scores(spark.createDataFrame(rows, SCHEMA), COLUMNS, terms).collect()}


def found(index, terms, limit=10_000, candidates=None):
    return [(r["chunk_id"], r["bm25"]) for r in S.indexed_search(index, terms, limit, candidates).collect()]


def files(base):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(base) for n in names if n.endswith(".parquet")}


def test_replaced_rows_score_as_in_a_rebuilt_index(spark, tmp_path):
    rng = random.Random(1)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    rows = texts(rng, range(400))
    index = Index(spark, str(tmp_path)).add(frame(rows).repartition(3), COLUMNS)
    before = files(tmp_path)
    first = index
    for step in range(2):  # the second step replaces rows that the first one has put in, too
        old = [r for r in rows if r[0] % (10 - step) == 0]
        new = texts(rng, [r[0] for r in old[1:]] + [1000 + step])
        index = index.replace(frame(old), frame(new), COLUMNS)
        gone = {r[0] for r in old}
        rows = [r for r in rows if r[0] not in gone] + new
        assert index.manifest.totals()[0] == len(rows) and index.live("lengths").count() == len(rows)
        for terms in (["the", "of"], ["rare"]) if step else (["cat", "dog"], ["user name", "the"]):
            assert dict(found(index, terms)) == expected(spark, rows, terms), terms
    assert before.items() <= files(tmp_path).items()
    assert dict(found(first, ["rare"])) == expected(spark, texts(random.Random(1), range(400)), ["rare"])  # an earlier manifest still reads as it did
    assert index.delete(frame([(99_999, "the", None)]), COLUMNS).manifest == index.manifest  # not in the index


def test_segments_of_one_size_are_merged(spark, tmp_path):
    rng, rows = random.Random(2), []
    index = Index(spark, str(tmp_path))
    for k in range(segments.TIER):
        some = texts(rng, range(40 * k, 40 * k + 40))
        rows += some
        index = index.add(spark.createDataFrame(some, SCHEMA), COLUMNS)
    gone = [r for r in rows if r[0] % 7 == 0]
    index = index.delete(spark.createDataFrame(gone, SCHEMA), COLUMNS)
    merged = index.merged()
    assert len(index.manifest.segments) == segments.TIER and len(merged.manifest.segments) == 1 and not merged.manifest.deletions
    assert Manifest.of(merged.manifest.to_dict()) == merged.manifest
    rows = [r for r in rows if r[0] % 7]
    for terms in (["the"], ["dog", "of"], ["user name"]):
        assert dict(found(merged, terms)) == dict(found(index, terms)) == expected(spark, rows, terms)


def test_empty_indexes(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    assert found(index, ["the"]) == [] and index.manifest.totals() == (0, 0)
    none = spark.createDataFrame([], SCHEMA)
    assert index.add(none, COLUMNS).manifest == index.manifest and index.merged() is index
    only = index.add(spark.createDataFrame([(1, None, None), (1, "", "")], SCHEMA), COLUMNS)
    assert found(only, ["the"]) == [] and only.manifest.totals() == (2, 0)
    with pytest.raises(ValueError):
        segments.plan_top(index, [], 3)


def test_blocks_that_cannot_be_among_the_best_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK_ROWS", 4)
    monkeypatch.setattr(segments, "FIRST_BLOCKS", 8)
    rng = random.Random(3)
    rows = [(k, " ".join(["the", "of"] * (40 if k % 97 == 0 else 1) + ["other"] * rng.randint(5, 200)), None) for k in range(1500)]
    index = Index(spark, str(tmp_path)).add(spark.createDataFrame(rows, SCHEMA).repartition(4), COLUMNS)
    best = sorted(expected(spark, rows, ["the", "of"]).items(), key=lambda x: (x[1], x[0]))
    plan = segments.plan_top(index, ["the", "of"], 10)
    assert plan.blocks > 300 and plan.read < plan.blocks / 4
    assert found(index, ["the", "of"], 10) == best[:10]
    some = spark.createDataFrame([(k,) for k in range(0, 1500, 3)], "chunk_id long")
    assert found(index, ["the", "of"], 10, some) == [b for b in best if b[0] % 3 == 0][:10]
    few = spark.createDataFrame([(5,), (6,)], "chunk_id long")
    assert found(index, ["the", "of"], 10, few) == [b for b in best if b[0] in (5, 6)]  # less than asked for: all blocks are read
    monkeypatch.setattr(segments, "HELD", 16)  # more bounds than the driver may hold
    assert found(index, ["the", "of"], 40) == best[:40] and found(index, ["the"], 3) == sorted(expected(spark, rows, ["the"]).items(), key=lambda x: (x[1], x[0]))[:3]


def test_only_postings_of_the_words_are_read(spark, tmp_path):
    index = Index(spark, str(tmp_path)).add(spark.createDataFrame([(k, f"word{k} common", None) for k in range(50)], SCHEMA), COLUMNS)
    plan = segments.plan_top(index, ["word7", "common"], 3).scored._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [common,word7])" in plan or "In(term, [word7,common])" in plan
    assert "positions" not in plan


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 12)) * 4
    x = np.concatenate([c + rng.normal(size=(60, 12)) * 0.3 for c in centers])
    rows = [(k, v) for k, v in enumerate(x.astype(np.float32).tolist())]
    rows += [(5000, [0.0] * 12), (5001, None), (5002, [1.0] * 5), (5003, []), (5004, [1.0] * 11 + [None])] + [(7, rows[7][1]), (6000, rows[7][1])]
    df = spark.createDataFrame(rows, "chunk_id long, vector array<float>").repartition(3)
    return df, vector_cells.write(df, str(tmp_path_factory.mktemp("cells") / "v"), 20), rows


@pytest.mark.parametrize("limit, least", [(1, 0.0), (10, 0.0), (10, 0.995), (70, 0.0), (5000, 0.0), (0, 0.0)])
def test_nearest_by_cells_equals_the_full_scan(spark, clustered, limit, least):
    df, index, rows = clustered
    for q in (rows[7][1], rows[300][1], [0.0] * 12, [1.0] * 12, [1.0] * 5):
        full = S.vector_search(df.where(F.forall("vector", lambda x: x.isNotNull())), spark.createDataFrame([(q,)], "q array<float>"), limit, least)
        got = vector_cells.nearest(index, q, limit, None, least).where("chunk_id <> 5004")
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in full.collect()]


def test_cells_that_cannot_hold_a_neighbour_are_not_opened(spark, clustered):
    df, index, rows = clustered
    plan = vector_cells.plan_nearest(index, rows[7][1], 10)
    assert len(plan.read) <= 4 < len(index.cells)
    assert len(plan.scored.inputFiles()) < len(index.rows(index.cells).inputFiles()) / 3
    some = spark.createDataFrame([(k,) for k in range(0, 1200, 100)], "chunk_id long")
    full = S.vector_search(df.join(some, "chunk_id", "left_semi"), spark.createDataFrame([(rows[7][1],)], "q array<float>"), 5)
    assert [tuple(r) for r in vector_cells.nearest(index, rows[7][1], 5, some).collect()] == [tuple(r) for r in full.collect()]


def test_cells_of_an_empty_table(spark, tmp_path):
    index = vector_cells.write(spark.createDataFrame([], "chunk_id long, vector array<float>"), str(tmp_path / "v"))
    assert vector_cells.nearest(index, [1.0, 2.0], 3).collect() == []
