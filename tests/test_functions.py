import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom import schema
from fathom.functions import code, text, vector
from fathom.operators import migrations
from fathom.operators import search as S


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab*?[]^/.", max_size=8), st.text(alphabet="ab/.]^[", max_size=8))
def test_path_patterns_match_as_sqlite_does(pattern, path):
    import re

    expected = sqlite3.connect(":memory:").execute("SELECT ? GLOB ?", (path, pattern)).fetchone()[0]
    assert bool(re.search(text.glob_regex(pattern), path)) == bool(expected)


def test_keyword_score_equals_fts5(spark):
    docs = ["the quick brown fox", "quick quick brown", "lazy dog the end of the day", "École of brown foxes", "fox fox fox quick the", "nothing here", "plain words again", "one two three"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(content)")
    con.executemany("INSERT INTO f(rowid, content) VALUES (?, ?)", list(enumerate(docs, 1)))
    expected = dict(con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH 'quick fox'").fetchall())
    rows = spark.createDataFrame(list(enumerate(docs, 1)), "chunk_id int, content string")
    got = {r["chunk_id"]: r["bm25"] for r in S.keyword_scores(rows, ["content"], ["quick", "fox"]).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-6) for k in got)


def test_letters_fold_as_in_fts5(spark):
    import unicodedata

    letters = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if unicodedata.category(c).startswith("L")]
    words = [f"x{c}x" for c in letters] + ["Ångström", "Škoda", "žluťoučký", "e\u0301a", "b\u0327c\u030c", "\u0301", "ß", "Ǻ"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(c)")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    con.executemany("INSERT INTO f(rowid, c) VALUES (?, ?)", list(enumerate(words, 1)))
    expected = {}
    for term, doc in con.execute("SELECT term, doc FROM v"):
        expected.setdefault(doc, []).append(term)
    rows = spark.createDataFrame(list(enumerate(words, 1)), "id int, w string").select("id", text.tokens(F.col("w")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in rows if r["t"]} == expected
    assert all(text.query_terms(words[k - 1]) == t for k, t in expected.items())


def test_query_terms_make_phrases_of_underscores():
    assert text.query_terms("User_Name École, (a*)") == ["user name", "ecole", "a"]
    assert text.query_terms("!!") == []


@pytest.mark.parametrize("query", ["a*", '"a b"', "(a)", "a AND b", "user-name", "a.b", "content:a"])
def test_strict_queries_are_refused(query):
    with pytest.raises(text.QuerySyntaxError):
        text.query_terms(query, strict=True)
    assert text.query_terms(query)


def test_strict_takes_plain_words():
    assert text.query_terms("and User_Name École", strict=True) == ["and", "user name", "ecole"]


def test_escape(spark):
    row = spark.createDataFrame([('a* "b" (NOT c) NOTE AND',)], "q string").select(text.escape(F.col("q"))).first()
    assert row[0] == 'a\\* \\"b\\" \\(\\NOT c\\) NOTE \\AND'


def test_sanitizer():
    assert text.sanitize_text('  a"b*(c)  é  d-e_f.g ') == "a b c d-e_f.g"


@pytest.mark.parametrize(
    "a, b, expected",
    [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0)],
)
def test_cosine(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert df.select(vector.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(expected)


def test_fusion_sums_reciprocal_ranks(spark):
    v = spark.createDataFrame([(1, 1), (2, 2)], "chunk_id long, rank long")
    t = spark.createDataFrame([(2, 1), (1, 2), (3, 3)], "chunk_id long, rank long")
    got = {r["chunk_id"]: (r["rrf_score"], r["rank"]) for r in S.fuse(v, t, 0).collect()}
    both = 1 / 61 + 1 / 62
    assert got == {1: (pytest.approx(both), 1), 2: (pytest.approx(both), 2), 3: (pytest.approx(1 / 63), 3)}


@pytest.mark.parametrize("a, b", [("1.0.0", "1.0.1"), ("1.0.9", "1.0.10"), ("0.9", "1.0.0"), ("1.2.3", "2.0.0")])
def test_versions(a, b):
    assert schema.parse_version(a) < schema.parse_version(b)
    assert schema.pending(a, [b, a]) == [b]


def test_migrations_go_up_in_order_and_down_one_at_a_time(spark):
    step = lambda v: migrations.Migration(v, lambda t: t | {"a": t["a"].withColumn(f"c{v}", F.lit(1))}, lambda t: t | {"a": t["a"].drop(f"c{v}")})
    known = [step(v) for v in ("1.0.10", "1.0.2", "0.9.0")]
    log = spark.createDataFrame([], migrations.LOG)
    assert migrations.latest(log).first()[0] is None
    tables, log = migrations.apply({"a": spark.range(1)}, log, known)
    assert tables["a"].columns == ["id", "c0.9.0", "c1.0.2", "c1.0.10"]
    assert migrations.apply(tables, spark.createDataFrame([("1.0.2", None)], migrations.LOG), known)[0]["a"].columns == ["id", "c0.9.0", "c1.0.2", "c1.0.10"]
    tables, log = migrations.rollback(tables, log, known)
    assert tables["a"].columns == ["id", "c0.9.0", "c1.0.2"] and sorted(r[0] for r in log.select("version").collect()) == ["0.9.0", "1.0.2"]
    with pytest.raises(ValueError):
        migrations.rollback(tables, log, known[:1])
    with pytest.raises(ValueError):
        migrations.rollback(tables, spark.createDataFrame([], migrations.LOG), known)


def test_lines_and_contexts(spark):
    df = spark.createDataFrame([("a\nb\nc", "", "x")], "t string, before string, content string")
    row = df.select(
        code.lines_between(F.col("t"), F.lit(2), F.lit(9)).alias("lines"), code.full_content(F.col("before"), F.col("content"), F.lit("z")).alias("full"), code.token_count(F.col("t")).alias("n")
    ).first()
    assert tuple(row) == ("b\nc", "x\n\nz", 1)


def test_full_content_keeps_an_empty_text_between_its_contexts(spark):
    df = spark.createDataFrame([("a", "", "z"), ("a", "", ""), ("", "", "z"), ("", "", ""), ("a", None, "z"), (None, "x", None)], "before string, content string, after string")
    full = [r[0] for r in df.select(code.full_content(F.col("before"), F.col("content"), F.col("after"))).collect()]
    assert full == ["a\n\n\n\nz", "a\n\n", "\n\nz", "", "a\n\nz", "x"]
