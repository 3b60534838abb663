import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from fathom.operators import chunking, embedding, postings
from fathom.operators import search as S
from fathom.plans.index import FIXTURES
from fathom.sources.go_files import discover, parse
from pyspark.sql import functions as F


@pytest.fixture()
def service():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            seen.append(asked)
            fail = "poison" in asked
            self.send_response(500 if fail else 200)
            self.end_headers()
            self.wfile.write(b"" if fail else json.dumps({"data": [{"embedding": [float(len(t)), 1.0]} for t in asked]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", seen
    server.shutdown()


def test_service_embeds_each_text_once_and_a_bad_batch_fails_alone(spark, service):
    url, seen = service
    rows = [(1, "aa"), (2, "aa"), (3, "bbb"), (4, ""), (5, "poison")]
    out = embedding.embed(spark.createDataFrame(rows, "chunk_id long, content string").coalesce(1), embedding.HttpProvider("p", "m", url), batch=1)
    assert {r["chunk_id"]: list(r["vector"]) for r in out.collect()} == {1: [2.0, 1.0], 2: [2.0, 1.0], 3: [3.0, 1.0]}
    assert sum(x == ["aa"] for x in seen) == 1 and sum(x == ["poison"] for x in seen) == 3


def test_retry_waits_and_gives_up():
    calls = []

    def fail():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        embedding.retry(fail, 3, 0.001)
    assert len(calls) == 3


@pytest.mark.parametrize("env, name", [({}, "local"), ({"OPENAI_API_KEY": "x"}, "openai"), ({"JINA_API_KEY": "x", "OPENAI_API_KEY": "x"}, "jina"), ({"FATHOM_EMBEDDING_PROVIDER": "Local", "JINA_API_KEY": "x"}, "local")])
def test_provider_by_environment(env, name):
    assert embedding.provider_name(env) == name


def test_chunks_of_declarations_and_whole_files(spark):
    parsed = parse(discover(spark, FIXTURES)).join(discover(spark, FIXTURES).select("file_path", "content"), "file_path").withColumn("file_id", F.xxhash64("file_path"))
    rows = {(r["chunk_type"], r["start_line"]): r for r in chunking.chunks(parsed.where("file_path = 'order.go'")).collect()}
    method = rows["method", 34]
    assert method["content"].startswith("func (o *OrderAggregate) Total") and method["content"].endswith("}")
    assert method["context_before"].startswith('package shop\n\nimport (\n\t"context"\n\tstr "strings"\n')
    assert method["token_count"] == (len(method["content"].encode()) + len(method["context_before"].encode())) // 4
    assert rows["var_group", 36]["of"]["name"] == "y"  # of declarations on the same lines the last
    whole = chunking.chunks(parsed.where("file_path = 'empty_decls.go'")).collect()
    assert [(r["chunk_type"], r["start_line"], r["end_line"]) for r in whole] == [("package", 1, 2)]
    related = {r["name"]: r["context"] for r in chunking.related(chunking.symbols(parsed)).collect()}
    assert related["SaveHandler"].startswith("// Method: func (SaveHandler) Handle") and related["Handle"].startswith("// Receiver: type SaveHandler")


def test_stored_postings_score_as_the_text_does(spark, tmp_path):
    rows = spark.createDataFrame([(1, "quick brown fox"), (2, "quick quick fox jumps"), (3, "lazy"), (4, "fox"), (5, "a b c"), (6, "d e")], "chunk_id long, content string")
    postings.write(rows, ["content"], str(tmp_path / "i"))
    expected = {r["chunk_id"]: r["bm25"] for r in S.keyword_scores(rows, ["content"], ["quick", "fox"]).collect()}
    index = postings.read(spark, str(tmp_path / "i"))
    assert {r["chunk_id"]: r["bm25"] for r in postings.scores(index, ["quick", "fox"]).collect()} == expected
    changed = postings.update(index, spark.createDataFrame([(1, "nothing")], "chunk_id long, content string"), ["content"])
    assert {r["chunk_id"] for r in postings.scores(changed, ["quick", "fox"]).collect()} == {2}


def test_postings_find_phrases_within_a_column(spark):
    rows = spark.createDataFrame([(1, "user name of the user name", "x"), (2, "name user", "name"), (3, "user", "name"), (4, "a user name", "user name user"), (5, None, ""), (6, "user of name", "")], "chunk_id long, content string, context_before string")
    columns, terms = ["content", "context_before"], ["user name"]
    index = postings.build(rows, columns)
    expected = {r["chunk_id"]: r["bm25"] for r in S.keyword_scores(rows, columns, terms).collect()}
    assert expected.keys() == {1, 4} and {r["chunk_id"]: r["bm25"] for r in postings.scores(index, terms).collect()} == expected
    only = spark.createDataFrame([(4,)], "chunk_id long")
    assert {r["chunk_id"]: r["bm25"] for r in postings.scores(index, terms, only).collect()} == {4: expected[4]}


def test_only_postings_of_the_terms_are_read(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"word{k} common") for k in range(50)], "chunk_id long, content string")
    postings.write(rows, ["content"], str(tmp_path / "i"))
    plan = postings.scores(postings.read(spark, str(tmp_path / "i")), ["word7", "common"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [common,word7])]" in plan or "PushedFilters: [In(term, [word7,common])]" in plan


@pytest.mark.parametrize("env, name", [({}, None), ({"OPENAI_API_KEY": "x"}, "openai"), ({"FATHOM_EMBEDDING_PROVIDER": "jina", "JINA_API_KEY": "y"}, "jina")])
def test_remote_provider_from_environment(env, name):
    p = embedding.from_env(env)
    assert (p.name if p else None) == name
    with pytest.raises(ValueError):
        embedding.from_env({"FATHOM_EMBEDDING_PROVIDER": "jina"})
