import shutil

import pytest
from pyspark.sql import functions as F

from fathom.operators import tables as T
from fathom.plans.api import EMPTY_QUERY, INVALID_PARAMS, NOT_INDEXED, ApiError, Engine, flag, number, string
from fathom.plans.index import FIXTURES
from fathom.plans.search import ResultCache
from fathom.streaming.watch import watch


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("src") / "shop"
    shutil.copytree(FIXTURES, root)
    e = Engine(spark, str(tmp_path_factory.mktemp("store") / "s"))
    e.root = str(root)
    assert e.get_status({"path": e.root})["indexed"] is False
    with pytest.raises(ApiError) as error:
        e.search_code({"path": e.root, "query": "order"})
    assert error.value.code == NOT_INDEXED
    first = e.index_codebase({"path": e.root})
    assert (first["files_indexed"], first["files_skipped"], first["symbols_extracted"]) == (6, 0, 31)
    return e


def test_status_counts(engine):
    s = engine.get_status({"path": engine.root})
    assert s["statistics"]["files_count"] == 6 and s["project"]["module"] == "example.com/shop" and s["health"]["embeddings_available"]
    assert s["statistics"]["chunks_count"] == s["statistics"]["embeddings_count"] == 21  # the empty file's chunk has no vector


def test_search_modes_filters_and_cache(engine):
    hit = engine.search_code({"path": engine.root, "query": "Save", "search_mode": "keyword"})["results"]
    assert hit and hit[0]["symbol"]["name"] in ("OrderRepository", "SaveHandler", "SaveCommand")
    found = engine.search_code({"path": engine.root, "query": "id", "filters": {"ddd_patterns": ["repository", "handler"]}})["results"]
    assert {r["symbol"]["name"] for r in found} == {"OrderRepository", "SaveHandler"}
    assert engine.search_code({"path": engine.root, "query": "Save", "search_mode": "keyword"})["statistics"]["cache_hit"]
    only = engine.search_code({"path": engine.root, "query": "order", "filters": {"file_pattern": "internal/*"}})["results"]
    assert all(r["file"]["path"].startswith("internal/") for r in only) and only


@pytest.mark.parametrize("args, code", [({"query": " "}, EMPTY_QUERY), ({"query": "a", "limit": 0}, INVALID_PARAMS), ({"query": "a", "search_mode": "x"}, INVALID_PARAMS), ({"query": "a", "filters": {"ddd_patterns": ["x"]}}, INVALID_PARAMS)])
def test_errors(engine, args, code):
    with pytest.raises(ApiError) as error:
        engine.search_code({"path": engine.root} | args)
    assert error.value.code == code


def test_only_changed_files_are_indexed_again(engine):
    with open(f"{engine.root}/broken.go", "w") as f:
        f.write("package shop\n\nfunc Fixed() {}\n")
    again = engine.index_codebase({"path": engine.root})
    assert (again["files_indexed"], again["files_skipped"]) == (1, 5)
    names = {r["name"] for r in engine.store.read()["symbols"].select("name").collect()}
    assert "Fixed" in names and "Kept" not in names and "OrderAggregate" in names


def test_the_keyword_index_follows_the_chunks(engine):
    found = lambda q: engine.search_code({"path": engine.root, "query": q, "search_mode": "keyword"})["results"]
    assert found("Fixed") and not found("Kept")
    t = engine.store.read()
    ids = {r["id"] for r in t["chunks"].select("id").collect()}
    assert {r["chunk_id"] for r in t["lengths"].collect()} == ids and t["corpus"].first()["rows"] == len(ids)
    assert engine.get_status({"path": engine.root})["health"] == {"database_accessible": True, "embeddings_available": True, "fts_indexes_built": True}
    # a path is a term of its context: the index covers the text before a chunk too
    assert found("context")


def test_symbols_are_searched(engine):
    assert {r["name"] for r in engine.search_symbols({"path": engine.root, "query": "handle"})} >= {"Handle"}
    assert engine.search_symbols({"path": engine.root, "query": "nothinglikethis"}) == []


def test_queries_are_embedded_by_the_provider_of_the_vectors(spark, engine, tmp_path):
    class Lengths:  # tasks get a class of a function by value
        name, model = "lengths", "m"

        def embed(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    own = Engine(spark, str(tmp_path / "s"), Lengths())
    own.index_codebase({"path": engine.root})
    assert {r["provider"] for r in own.store.read()["embeddings"].select("provider").collect()} == {"lengths"}
    assert own.search_code({"path": engine.root, "query": "anything", "search_mode": "vector"})["results"]
    assert not Engine(spark, str(tmp_path / "s")).search_code({"path": engine.root, "query": "anything", "search_mode": "vector"})["results"]


def test_merge_keeps_and_overwrites(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, k string, v string")
    new = spark.createDataFrame([(9, "b", "z"), (3, "c", None)], "id int, k string, v string")
    got = {tuple(r) for r in T.merge(old, new, ["k"], keep=["id"]).collect()}
    assert got == {(1, "a", "x"), (2, "b", "z"), (3, "c", None)}


def test_cascade_removes_all_below(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    tables = {
        "files": frame([(1,), (2,)], "id int"), "symbols": frame([(5, 1), (6, 2)], "id int, file_id int"),
        "chunks": frame([(7, 1, 5), (8, 2, 6), (9, 2, 5)], "id int, file_id int, symbol_id int"), "embeddings": frame([(1, 7), (2, 8), (3, 9)], "id int, chunk_id int"),
    }
    left = T.cascade(tables, "files", frame([(1,)], "id int"))
    assert {t: sorted(r["id"] for r in df.collect()) for t, df in left.items()} == {"files": [2], "symbols": [6], "chunks": [8], "embeddings": [2]}


def test_cache_forgets_the_oldest():
    c = ResultCache(2)
    for k in "abc":
        c.put(k, [1], 60)
    c.put("empty", [], 60)
    assert c.get("a") is None and c.get("c") == [1] and c.get("empty") is None
    c.put("late", [1], -1)
    assert c.get("late") is None


def test_watch_merges_micro_batches(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for n, rows in enumerate([[("a", 1), ("a", 2), ("b", 1)], [("b", 5)]]):
        spark.createDataFrame(rows, "k string, n int").coalesce(1).write.mode("append").parquet(str(source))
        watch(spark.readStream.schema("k string, n int").parquet(str(source)), target, str(tmp_path / "check"), ["k"], "n").awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(f"{target}/b1").collect())) == [("a", 2), ("b", 5)]
    assert spark.read.parquet(f"{target}/b0").agg(F.sum("n")).first()[0] == 3


def test_a_smaller_cache_drops_the_oldest():
    c = ResultCache(3)
    for k in "abc":
        c.put(k, [k], 60)
    c.get("a")
    c.resize(2)
    assert c.get("b") is None and c.get("a") == ["a"] and c.get("c") == ["c"]
    with pytest.raises(ValueError):
        c.resize(0)


def test_arguments_of_another_type_count_as_missing():
    args = {"a": "false", "b": True, "c": 3, "d": None}
    assert [flag(args, k, False) for k in "abce"] == [False, True, False, False]
    assert [number(args, k, 7) for k in "abcd"] == [7, 7, 3, 7]
    assert [string(args, k, "x") for k in "abcd"] == ["false", "x", "x", "x"]
