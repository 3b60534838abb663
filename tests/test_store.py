"""The snapshot store: what a run writes and a reader opens, and writers that do not wait for each other."""

import os
import subprocess
import sys
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathom import schema
from fathom.plans import store as store_module
from fathom.plans.api import Engine
from fathom.plans.index import index_tree, project_id
from fathom.plans.store import Conflict, IndexingInProgress, Store


def tree(root, n, start=0):
    for k in range(start, start + n):
        folder = root / f"p{k % 7}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{k}.go").write_text(f"package p{k % 7}\n\n// Thing{k} is number {k}.\ntype Thing{k} struct {{\n\tID int\n}}\n\nfunc Make{k}() {{}}\n")
    return str(root)


def data_files(base):
    return {os.path.join(d, n) for d, _, names in os.walk(os.path.join(base, "data")) for n in names if n.endswith(".parquet")}


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root, base = tmp_path_factory.mktemp("src"), str(tmp_path_factory.mktemp("store") / "s")
    store = Store(spark, base, bucket_files=10)
    path = tree(root / "a", 200)
    index_tree(spark, store, path)
    index_tree(spark, store, tree(root / "b", 3, 1000))
    return store, path, str(root / "b")


def test_a_changed_file_rewrites_its_bucket_alone(spark, indexed):
    store, path, _ = indexed
    pid = project_id(spark, path)
    before, snapshot = data_files(store.base), store.snapshot()
    listed = store.project(snapshot, pid)
    assert listed.buckets == 20 and all(len(listed.files[t]) == 20 for t in ("files", "symbols", "chunks", "embeddings"))
    with open(f"{path}/p3/f3.go", "a") as f:
        f.write("\nfunc Added() {}\n")
    stats = index_tree(spark, store, path)
    assert (stats.files_indexed, stats.files_skipped) == (1, 199)
    written = {f.rsplit("/data/", 1)[1] for f in data_files(store.base) - before}
    assert Counter(f.split("/")[0] for f in written) == {"files": 1, "symbols": 1, "chunks": 1, "embeddings": 1, "projects": 1}
    assert len({f.split("/bucket=")[1].split("/")[0] for f in written if not f.startswith("projects")}) == 1
    after = store.project(store.snapshot(), pid)
    assert sum(after.files["chunks"][b] != listed.files["chunks"][b] for b in listed.files["chunks"]) == 1
    t = store.read(project=pid)
    names = {r[0] for r in t["symbols"].select("name").collect()}
    assert "Added" in names and len(names) == 402 and t["files"].count() == 200
    assert t["files"].agg(F.count_distinct("id")).first()[0] == 200
    assert store.index(store.snapshot(), "chunk_words").manifest.totals()[0] == store.read()["chunks"].count()


def test_readers_open_the_files_of_their_project_and_buckets(spark, indexed):
    store, path, other = indexed
    pid, whole = project_id(spark, other), store.read()["chunks"]
    own = store.read(project=pid)["chunks"]
    assert len(own.inputFiles()) == 1 and len(whole.inputFiles()) == 21
    assert all(f"project={pid}/" in f for f in own.inputFiles())
    assert {r[0] for r in store.read(project=pid)["files"].select("project_id").collect()} == {pid}
    first = store.read(project=project_id(spark, path), buckets=[0, 1])["files"]
    assert len(first.inputFiles()) == 2 and 0 < first.count() < 60
    assert store.read(project=12345)["files"].count() == 0


def test_symbols_are_found_without_reading_all_their_texts(spark, indexed):
    store, path, _ = indexed
    engine = Engine(spark, store.base)
    assert [r["name"] for r in engine.search_symbols({"path": path, "query": "thing5"})] == ["Thing5"]
    plan = store_module.Index(spark, f"{store.base}/symbol_words", store.index(store.snapshot(), "symbol_words").manifest).live("postings", ["thing5"])._jdf.queryExecution().executedPlan().toString()
    assert "doc_comment" not in plan and "EqualTo(term,thing5)" in plan


def test_pruned_and_grown_projects(spark, tmp_path):
    store, path = Store(spark, str(tmp_path / "s"), bucket_files=10), tree(tmp_path / "a", 20)
    index_tree(spark, store, path)
    pid = project_id(spark, path)
    os.remove(f"{path}/p1/f1.go")
    index_tree(spark, store, path)
    assert store.read()["files"].count() == 20
    index_tree(spark, store, path, prune=True)
    t = store.read()
    assert t["files"].count() == 19 and not t["symbols"].where("name = 'Thing1'").count() and t["chunks"].count() == t["embeddings"].count()
    assert store.index(store.snapshot(), "symbol_words").manifest.totals()[0] == t["symbols"].count()
    tree(tmp_path / "a", 100, 100)
    index_tree(spark, store, path)
    assert store.project(store.snapshot(), pid).buckets == 12
    t = store.read()
    assert t["files"].count() == 119 == t["files"].agg(F.count_distinct("id")).first()[0] and t["projects"].first()["total_files"] == 119
    assert Engine(spark, store.base).get_status({"path": path})["health"]["fts_indexes_built"]


def test_each_text_is_embedded_once(spark, tmp_path):
    log = str(tmp_path / "log")

    class Counting:  # tasks get a class of a function by value
        name, model = "counting", "m"

        def embed(self, texts):
            with open(log, "a") as f:
                f.write("".join(f"{t!r}\n" for t in texts))
            return [[float(len(t)), 1.0] for t in texts]

    store, path = Store(spark, str(tmp_path / "s")), tree(tmp_path / "a", 12)
    stats = index_tree(spark, store, path, provider=Counting())
    sent = (tmp_path / "log").read_text().splitlines()
    assert len(sent) == len(set(sent)) == store.read()["chunks"].select("content").distinct().count()
    assert stats.embeddings_created == store.read()["embeddings"].count()


def test_two_writers_of_two_projects_lose_nothing(spark, indexed, tmp_path):
    base, a, b = str(tmp_path / "s"), tree(tmp_path / "a", 8), tree(tmp_path / "b", 9, 50)
    run = f"""
import sys
from pyspark.sql import SparkSession
from fathom.plans.index import index_tree
from fathom.plans.store import Store
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "1g").getOrCreate()
index_tree(spark, Store(spark, {base!r}), sys.argv[1])
"""
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    other = subprocess.Popen([sys.executable, "-c", run, b], env=env, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE)
    store = Store(spark, base)
    index_tree(spark, store, a)
    with open(f"{a}/p0/more.go", "w") as f:
        f.write("package p0\n\nfunc More() {}\n")
    index_tree(spark, store, a)
    _, error = other.communicate(timeout=300)
    assert other.returncode == 0, error[-2000:]
    t = store.read()
    assert Counter(r[0] for r in t["files"].select("project_id").collect()) == {project_id(spark, a): 9, project_id(spark, b): 9}
    assert store.index(store.snapshot(), "chunk_words").manifest.totals()[0] == t["chunks"].count()
    found = Engine(spark, base).search_code({"path": b, "query": "thing51", "search_mode": "keyword"})["results"]
    assert found and found[0]["symbol"]["name"] == "Thing51"


def test_commits_are_rebased_or_refused(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    rows = lambda n: spark.createDataFrame([(n, n, f"f{n}")], "id long, project_id long, file_path string")
    whole = lambda n: rows(n).select(*[F.col(f.name) if f.name in rows(n).columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.TABLES["files"]], F.lit(0).alias("bucket"))
    part = lambda n: store_module.Project(1, {"files": store.write("files", whole(n), n)})
    word = lambda s, seen, n: {"chunk_words": s.index(seen, "chunk_words").add(spark.createDataFrame([(n, f"w{n}")], "chunk_id long, content string"), ["content"])}
    seen = store.snapshot()
    assert store.commit(seen, 1, part(1), word(store, seen, 1)) == 1
    assert other.commit(seen, 2, part(2), word(other, seen, 2)) == 2  # made from the same snapshot
    assert sorted(r[0] for r in store.read()["files"].select("id").collect()) == [1, 2]
    assert store.index(store.snapshot(), "chunk_words").manifest.totals() == (2, 2)
    with pytest.raises(Conflict):
        other.commit(seen, 1, part(1), {})
    lost = part(7)
    store.tidy(grace=-5.0)
    with pytest.raises(Conflict):
        store.commit(store.snapshot(), 7, lost, {})
    now = store.snapshot()
    outdated = {"chunk_words": store.index(now, "chunk_words").delete(spark.createDataFrame([(1, "w1")], "chunk_id long, content string"), ["content"])}
    later = store.index(now, "chunk_words")
    for k in range(3, 6):
        later = later.add(spark.createDataFrame([(k, f"w{k}")], "chunk_id long, content string"), ["content"])
    other.commit(now, 3, part(3), {"chunk_words": later})
    other.tidy()
    assert len(other.snapshot().words["chunk_words"]["segments"]) < 5
    with pytest.raises(Conflict):
        store.commit(now, 1, part(1), outdated)  # rows were to go from a segment that has been merged


def test_one_of_many_publishers_wins(spark, tmp_path):
    store, won = Store(spark, str(tmp_path / "s")), []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if store._publish("snapshots/v1.json", {"version": 1, "projects": {}, "words": {}}) else None) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and store.versions() == [1] and not store._names("drafts")


def test_runs_of_a_project_are_refused_until_their_mark_expires(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    with store.run(1):
        with pytest.raises(IndexingInProgress), store.run(1):
            pass
        with store.run(2):
            pass
    with store.run(1):
        pass
    monkeypatch.setattr(store_module, "RUN_TTL", -1.0)
    with store.run(1), store.run(1):
        pass
    assert store._names("runs") == []


def test_old_data_goes_and_other_engines_see_new_snapshots(spark, tmp_path):
    store, path = Store(spark, str(tmp_path / "s"), bucket_files=2), tree(tmp_path / "a", 4)
    index_tree(spark, store, path)
    reader = Engine(spark, store.base)
    assert reader.get_status({"path": path})["statistics"]["files_count"] == 4
    earlier = store.read()
    for k in range(2):
        tree(tmp_path / "a", 1, 10 + k)
        index_tree(spark, store, path)
    assert reader.get_status({"path": path})["statistics"]["files_count"] == 6
    assert earlier["chunks"].count() == 8 and len(store.versions()) >= 3  # within the time of grace nothing goes
    named = len(data_files(store.base))
    store.tidy(keep=1, grace=-5.0)
    assert len(store.versions()) == 1 and len(data_files(store.base)) < named
    assert store.read()["files"].count() == 6 and store.index(store.snapshot(), "chunk_words").manifest.totals()[0] == 12
    assert reader.search_code({"path": path, "query": "thing11", "search_mode": "keyword"})["results"]
    assert store.bytes() > 0 and time.time() > 0


def test_results_are_kept_for_other_engines_until_the_next_snapshot(spark, tmp_path):
    path, base = tree(tmp_path / "a", 5), str(tmp_path / "s")
    first, second = (Engine(spark, base, keep_results=True) for _ in range(2))
    first.index_codebase({"path": path})
    ask = lambda e, q: e.search_code({"path": path, "query": q, "search_mode": "keyword"})
    made = ask(first, "thing2")
    again = ask(second, "thing2")
    assert not made["statistics"]["cache_hit"] and again["statistics"]["cache_hit"] and again["results"] == made["results"]
    assert not ask(second, "nothing")["results"] and not ask(first, "nothing")["statistics"]["cache_hit"]
    version = first.store.versions()[-1]
    kept = second.results.table(version).collect()
    assert [(r["query"], r["mode"], r["hits"]) for r in kept] == [("thing2", "keyword", 1)] and kept[0]["until"] > kept[0]["made"]
    (tmp_path / "a" / "p2" / "f2.go").write_text("package p2\n\ntype Other struct {\n\tID int\n}\n")
    first.index_codebase({"path": path})
    assert not ask(second, "thing2")["results"] and not ask(first, "thing2")["results"]
    now = first.store.versions()[-1]
    keeper = first.results
    keeper.put(now, "k", "q", "keyword", [store_module_row()], -1.0)
    assert keeper.get(now, "k") is None
    keeper.put(now, "k", "q", "keyword", [store_module_row()], 60.0)
    assert keeper.get(now, "k") == [store_module_row()] and keeper.get(now + 1, "k") is None
    first.store.tidy(keep=1, grace=-5.0)
    assert first.store._names("cache") == [f"v{now}"]


def store_module_row():
    from pyspark.sql import Row

    return Row(rank=1, symbol=Row(name="a"), context=None)
