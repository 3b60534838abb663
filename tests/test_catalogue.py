"""Every query of the catalogue against its DuckDB counterpart on the smallest tables."""

import math

import duckdb
import pytest

from fathom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 8) if isinstance(x, float) else x


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_oracle(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    result = con.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(result.columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_vectors_survive_their_byte_form(spark):
    assert catalogue.queries()["vector_codec_roundtrip"](spark, SF).where("not same").count() == 0


def test_full_content_of_odd_documents_equals_oracle(spark, tmp_path):
    """Texts, languages and sources that are null, empty or blank, in every combination."""
    path = f"{tmp_path}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT row_number() OVER () AS doc_id, t.text, l.lang, s.source, len(t.text)::BIGINT AS n_chars
        FROM (VALUES (NULL), (''), (' '), (chr(10)), ('x')) t(text), (VALUES (NULL), (''), ('en'), ('de'), ('fr')) l(lang), (VALUES (NULL), (''), ('src1')) s(source)) TO '{path}' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    df = catalogue.queries()["full_content"](spark, str(tmp_path))
    result = con.sql(catalogue.oracle_sql()["full_content"])
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == 75 and got == canonical(result.columns, result.fetchall())
