"""Requests, their keys, and how results are cut."""

import pytest

from fathom.operators.filters import SearchFilters
from fathom.plans.search import DEFAULT_LIMIT, MAX_LIMIT, TTL, SearchRequest, keys_of


@pytest.mark.parametrize("given, limit", [(0, DEFAULT_LIMIT), (-5, DEFAULT_LIMIT), (7, 7), (MAX_LIMIT, MAX_LIMIT), (5000, MAX_LIMIT)])
def test_limits_are_held_to_their_range(given, limit):
    assert SearchRequest("a", limit=given).limit == limit


def test_defaults_and_errors():
    r = SearchRequest("a", mode="", rrf_k=0, ttl=0)
    assert (r.mode, r.rrf_k, r.ttl) == ("hybrid", 60, TTL)
    for bad in ({"query": ""}, {"query": "a", "mode": "fuzzy"}):
        with pytest.raises(ValueError):
            SearchRequest(**bad)


def test_all_that_decides_a_result_is_in_its_key():
    base = dict(query="a", project_id=1, limit=10, mode="hybrid", rrf_k=60)
    others = [{"query": "b"}, {"project_id": 2}, {"limit": 11}, {"mode": "vector"}, {"rrf_k": 61}, {"strict": True}, {"filters": SearchFilters(packages=["p"])}, {"filters": SearchFilters(ddd_patterns=["entity"])}, {"filters": SearchFilters(min_relevance=0.25)}, {"filters": SearchFilters(file_pattern="*.go")}]
    keys = [SearchRequest(**base | o).key() for o in others]
    assert len({*keys, SearchRequest(**base).key()}) == len(others) + 1
    assert SearchRequest(**base).key() == SearchRequest(**base, use_cache=True, ttl=5).key()


def test_keys_of_rows_are_those_of_requests(spark):
    schema = "q string, m string, p long, f struct<symbol_types:array<string>,file_pattern:string,packages:array<string>>"
    df = spark.createDataFrame([("a b", "vector", 3, None), ("ü", "hybrid", 4, (["function"], "x/*", ["p", "q"]))], schema)
    from pyspark.sql import functions as F

    found = {r["q"]: r["k"] for r in df.select("q", keys_of(F.col("q"), F.col("m"), F.col("p"), F.col("f")).alias("k")).collect()}
    assert found == {"a b": SearchRequest("a b", 3, mode="vector").key(), "ü": SearchRequest("ü", 4, filters=SearchFilters(["function"], "x/*", packages=["p", "q"])).key()}
