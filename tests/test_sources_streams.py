"""Source trees read by executors, change detection by state, and cuts of large chunks."""

import itertools
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fathom.operators import chunking
from fathom.sources.go_files import discover, list_files
from fathom.sources.trees import DEPTH, TreeReader, read_tree
from fathom.streaming import changes


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "root"
    for name in ("a.go", "a_test.go", "b.txt", "x/one.go", "x/y/two.go", "x/y/z/w/three.go", "x/y/z/w/three_test.go", "vendor/v.go", "x/vendor/v.go", ".git/g.go", "x/.h/g.go", "_u/u.go", "x2/four.go", "empty/deep/none.txt", "dir.go/inner.go"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"package {name!r}\n")
    os.symlink(root / "x" / "one.go", root / "link.go")
    os.symlink(root / "gone.go", root / "broken.go")
    os.symlink(root / "x", root / "linked")
    return str(root)


@pytest.mark.parametrize("tests, vendor, depth", list(itertools.product([True, False], [True, False], [0, 1, DEPTH, 9])))
def test_trees_list_what_a_walk_lists(spark, tree, tests, vendor, depth):
    rows = read_tree(spark, tree, tests=tests, vendor=vendor, depth=depth).collect()
    assert sorted(r["full_path"] for r in rows) == list_files(tree, tests, vendor)
    by = {r["file_path"]: r for r in rows}
    assert by["broken.go"]["error"] and by["broken.go"]["content"] is None
    assert bytes(by["x/y/two.go"]["content"]) == b"package 'x/y/two.go'\n" and by["x/y/two.go"]["size_bytes"] == 21
    assert {r["is_test"] for r in rows if r["file_path"].endswith("_test.go")} <= {True}


def test_filters_on_paths_and_tests_are_pushed(spark, tree):
    df = read_tree(spark, tree).where("not is_test and file_path like 'x/y%'")
    assert sorted(r["file_path"] for r in df.collect()) == ["x/y/two.go", "x/y/z/w/three.go"]
    assert sorted(r["file_path"] for r in read_tree(spark, tree).where(F.col("file_path").startswith("x") & (F.length("file_path") < 9)).collect()) == ["x/one.go", "x/y/two.go"][:1] + ["x2/four.go"][:0]
    reader = TreeReader({"path": tree})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    left = GreaterThan(("size_bytes",), 3)
    assert list(reader.pushFilters([StringStartsWith(("file_path",), "x/y"), EqualTo(("is_test",), False), left])) == [left]
    folders = [os.path.relpath(p.path, tree) for p in reader.partitions()]
    assert folders == [".", "x", "x/y"]  # the folders above hold files of their own, which the prefix rules out one by one


def test_odd_trees(spark, tree, tmp_path):
    assert read_tree(spark, str(tmp_path)).count() == 0
    assert read_tree(spark, str(tmp_path / "none")).count() == 0
    assert read_tree(spark, f"{tree}/vendor").count() == 0 and read_tree(spark, f"{tree}/vendor", vendor=True).count() == 1
    bare = read_tree(spark, tree, content=False).where("file_path = 'a.go'").first()
    assert bare["content"] is None and bare["content_hash"] is None and bare["size_bytes"] == 15
    assert sorted(r["full_path"] for r in discover(spark, tree).collect()) == list_files(tree)


def listing(spark, folder, n, rows, at):
    os.makedirs(folder, exist_ok=True)
    df = spark.createDataFrame([(p, h, at) for p, h in rows], "file_path string, content_hash string, seen timestamp")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{n}.parquet")
    os.rename(next(f.path for f in os.scandir(f"{folder}/{n}.parquet") if f.name.endswith(".parquet")), f"{folder}/l{n}.parquet")


@pytest.fixture
def states(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    changes.configure(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_changes_of_listings_and_after_a_restart(spark, states, tmp_path):
    folder, start = str(tmp_path / "in"), datetime(2024, 1, 1, tzinfo=timezone.utc)
    hours = lambda k: start + timedelta(hours=k)

    def run():
        stream = spark.readStream.schema("file_path string, content_hash string, seen timestamp").parquet(f"{folder}/l*.parquet")
        q = changes.detect(stream, "90 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r["file_path"], r["seen_ms"], r["status"]) for r in rows)

    at = lambda k: int(hours(k).timestamp() * 1000)
    listing(spark, folder, 0, [("a", "1"), ("b", "1"), ("c", "1")], hours(0))
    assert run() == [("a", at(0), "new"), ("b", at(0), "new"), ("c", at(0), "new")]
    listing(spark, folder, 1, [("a", "1"), ("b", "2"), ("d", "1")], hours(1))
    second = run()  # another query on the same checkpoint
    assert [r for r in second if r[1] == at(1)] == [("a", at(1), "unchanged"), ("b", at(1), "changed"), ("d", at(1), "new")]
    listing(spark, folder, 2, [("a", "3"), ("b", "2"), ("d", "1")], hours(2))
    run()
    listing(spark, folder, 3, [("a", "3"), ("b", "2"), ("c", "9"), ("d", "1")], hours(3))
    last = run()
    assert ("c", at(1.5), "deleted") in last and ("c", at(3), "new") in last and ("a", at(2), "changed") in last
    assert [r[2] for r in last].count("deleted") == 1


def test_a_stream_of_two_snapshots_tells_what_a_join_tells(spark, states, tmp_path):
    from fathom.operators import tables as T
    from fathom.plans import catalogue

    old, new = catalogue._snapshots(spark, "/root/testdata/sf0.001")
    expected = {r["file_path"]: r["status"] for r in T.changes(old, new, "file_path", "content").collect()}
    folder, start = str(tmp_path / "in"), datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = lambda df: [(r[0], r[1]) for r in df.select("file_path", F.sha2("content", 256)).collect()]
    listing(spark, folder, 0, rows(old), start)
    listing(spark, folder, 1, rows(new), start + timedelta(hours=1))
    listing(spark, folder, 2, [("clock", "0")], start + timedelta(hours=1, minutes=30))
    stream = spark.readStream.schema("file_path string, content_hash string, seen timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/l*.parquet")
    q = changes.detect(stream, "1 hour").writeStream.format("memory").queryName("two_snapshots").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    second = int((start + timedelta(hours=1)).timestamp() * 1000)
    found = {r["file_path"]: r["status"] for r in spark.table("two_snapshots").where(F.col("seen_ms") == second).collect()}
    assert found == expected


def cost(lines, starts, most):
    depth, out = 0, chunking.PIECE * len(starts)
    depths = [0]
    for line in lines:
        depth = max(0, depth + line.count("{") - line.count("}"))
        depths.append(depth)
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        if b - a > 1 and len("\n".join(lines[a:b]).encode()) // 4 > most:
            return None
        if a:
            out += chunking.IN_BRACE * depths[a] + chunking.NO_BLANK * bool(lines[a - 1].strip())
    return out


def test_cuts_cost_the_least():
    rng = random.Random(11)
    for _ in range(200):
        lines = [rng.choice(["", "", "x = 1", "func f() {", "}", "é" * rng.randint(1, 60), "{ }", "long " * 20]) for _ in range(rng.randint(1, 11))]
        most = rng.choice([0, 3, 8, 20, 1000])
        starts = chunking.cuts(lines, most)
        every = [cost(lines, [0, *s], most) for r in range(len(lines)) for s in itertools.combinations(range(1, len(lines)), r)]
        assert starts[0] == 0 and cost(lines, starts, most) == min(c for c in every if c is not None)


def test_large_chunks_are_split_and_others_left(spark):
    body = "\n".join(["func a() {"] + [f"\tcall({k})" for k in range(300)] + ["}", ""] + ["func b() {"] + ["\tx()"] * 600 + ["}"])
    rows = [(1, "small", 5, 5, "t"), (2, body, 10, 900, "t"), (3, None, 1, 1, "t"), (4, "", 1, 1, "t"), (5, "y" * 9000, 3, 3, "t"), (6, "z\n" * 100_000, 1, 100_001, "t")]
    df = spark.createDataFrame(rows, "id long, content string, start_line int, end_line int, piece_of string")
    found = {}
    for r in chunking.split_large(df, 500).orderBy("id", "piece").collect():
        found.setdefault(r["id"], []).append(r)
    assert [len(found[k]) for k in (1, 3, 4, 5)] == [1, 1, 1, 1] and found[1][0]["end_line"] == 5
    for k, text in ((2, body), (6, "z\n" * 100_000)):
        assert "\n".join(r["content"] for r in found[k]) == text
        assert all(len(r["content"].encode()) // 4 <= 500 for r in found[k])
        assert all(a["end_line"] + 1 == b["start_line"] for a, b in itertools.pairwise(found[k])) and found[k][-1]["end_line"] == found[k][0]["start_line"] + text.count("\n")
    assert any(r["content"].startswith("func b() {") for r in found[2])
    assert chunking.split_large(df.limit(0)).count() == 0


def test_late_events_are_counted_up_to_the_watermark(spark, tmp_path):
    from fathom.streaming.watch import windowed_counts

    folder, start = str(tmp_path / "in"), datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
    os.makedirs(folder)
    minutes = [[1, 2, 31], [26, 3], [4, 60], [61]]  # 26 and 3 come late, 4 too late
    for n, batch in enumerate(minutes):
        df = spark.createDataFrame([(start + timedelta(minutes=m), "click") for m in batch], "ts timestamp, event_type string")
        df.coalesce(1).write.parquet(f"{folder}/{n}.tmp")
        os.rename(next(f.path for f in os.scandir(f"{folder}/{n}.tmp") if f.name.endswith(".parquet")), f"{folder}/l{n}.parquet")
    stream = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/l*.parquet")
    q = windowed_counts(stream).writeStream.format("memory").queryName("late_events").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    found = {r["at"]: r["n"] for r in spark.table("late_events").select(F.date_format("window.start", "HH:mm").alias("at"), "n").collect()}
    # the mark is at 12:21 after the first batch; what is late by it goes from the batch after the next one on
    assert found == {"12:00": 3, "12:25": 1, "12:30": 1}
