"""Embedding of texts: providers, checks, and what becomes of failures."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.vector import local_embedding
from fathom.schema import DIMENSIONS

BATCH, MAX_BATCH = 30, 100


class Provider(Protocol):
    """Something that embeds texts by batch, as a remote service does; it must be picklable."""

    name: str
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class HttpProvider:
    """A service that takes {"model", "input": [...]} and answers {"data": [{"embedding": [...]}, ...]}; the key goes in a bearer header."""

    name: str
    model: str
    url: str
    key: str = ""
    timeout: float = 30.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            found = [x["embedding"] for x in json.load(answer)["data"]]
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return found


def provider_name(env: dict[str, str] | None = None) -> str:
    """The provider that the environment asks for: by name, else by the first key that is set, else the local one."""
    env = os.environ if env is None else env
    named = env.get("FATHOM_EMBEDDING_PROVIDER", "").lower()
    if named:
        if named not in DIMENSIONS:
            raise ValueError(f"unknown provider {named}")
        return named
    return next((p for p, key in (("jina", "JINA_API_KEY"), ("openai", "OPENAI_API_KEY")) if env.get(key)), "local")


# Model and address of the remote services.
SERVICES = {
    "jina": ("jina-embeddings-v3", "https://api.jina.ai/v1/embeddings", "JINA_API_KEY"),
    "openai": ("text-embedding-3-small", "https://api.openai.com/v1/embeddings", "OPENAI_API_KEY"),
}


def from_env(env: dict[str, str] | None = None) -> HttpProvider | None:
    """The provider that the environment asks for, None for the local one; a remote one needs its key."""
    env = os.environ if env is None else env
    name = provider_name(env)
    if name == "local":
        return None
    model, url, key = SERVICES[name]
    if not env.get(key):
        raise ValueError(f"{name} needs {key}")
    return HttpProvider(name, model, url, env[key])


def validate(texts: DataFrame) -> DataFrame:
    """(batch_id, texts, rejected) of texts (batch_id, content): a batch with an empty text is rejected whole."""
    return texts.groupBy("batch_id").agg(F.count("*").alias("texts"), F.bool_or(F.coalesce(F.length("content") == 0, F.lit(True))).alias("rejected"))


def retry(call: Callable[[], list], attempts: int = 3, first: float = 0.1, most: float = 5.0) -> list:
    """The call's result; after a failure again, each time after twice the wait."""
    wait = first
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(wait)
            wait = min(2 * wait, most)
    return []


def embed(chunks: DataFrame, provider: Provider | None = None, batch: int = BATCH) -> DataFrame:
    """(chunk_id, vector, dimension, provider, model) of chunks (chunk_id, content); a failed text gives no row.

    Texts are embedded once each: equal ones share their vector. Empty texts fail alone. Without a
    provider the local embedding is computed as an expression.
    """
    texts = chunks.where(F.length("content") > 0).select("chunk_id", "content", F.sha2("content", 256).alias("__h"))
    if provider is None:
        out = texts.select("chunk_id", local_embedding(F.col("content")).alias("vector"), F.lit("local").alias("provider"), F.lit("sha256").alias("model"))
        return out.withColumn("dimension", F.size("vector"))
    size = min(batch, MAX_BATCH)

    def run(frames):
        for frame in frames:
            for k in range(0, len(frame), size):
                part = frame.iloc[k : k + size]
                try:
                    found = retry(lambda: provider.embed(part["content"].tolist()))
                except Exception:  # this batch has no vectors
                    continue
                yield pd.DataFrame({"__h": part["__h"], "vector": found, "provider": provider.name, "model": provider.model})

    once = texts.groupBy("__h").agg(F.first("content").alias("content"))
    vectors = once.select("__h", "content").mapInPandas(run, "__h string, vector array<float>, provider string, model string")
    return texts.select("chunk_id", "__h").join(vectors, "__h").select("chunk_id", "vector", "provider", "model", F.size("vector").alias("dimension"))
