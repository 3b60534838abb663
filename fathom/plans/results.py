"""Search results kept in the store, for other processes too: by request and snapshot, with an expiry and a count of hits.

A result is a small file in the folder of its snapshot's number; a new snapshot makes it unreachable, and
tidy() of the store deletes it with the snapshot. Hits are counted in memory and written in batches.
"""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
from collections import Counter

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from fathom.plans.store import Store

#: Hits that may wait to be written.
WAITING = 100
_ENTRY = "key string, query string, mode string, version long, made double, until double, rows string"


class StoredResults:
    def __init__(self, store: Store, wait: int = WAITING):
        self.store, self.wait, self.lock, self.waiting = store, wait, threading.Lock(), Counter()

    def _name(self, version: int, key: str) -> str:
        return f"cache/v{version}/results/{key}.json"

    def get(self, version: int, key: str) -> list[Row] | None:
        """The rows of a request, if some process has them for this snapshot and they have not expired."""
        try:
            entry = self.store._load(self._name(version, key))
        except (Py4JJavaError, PySparkException, ValueError):
            return None
        if entry["until"] < time.time():
            return None
        with self.lock:
            self.waiting[version, key] += 1
        if sum(self.waiting.values()) >= self.wait:
            self.flush()
        return [_row(r) for r in json.loads(entry["rows"])]

    def put(self, version: int, key: str, query: str, mode: str, rows: list[Row], ttl: float) -> None:
        """Keep rows, at most 100, until ttl seconds from now; empty results are not kept, and what another process has put stays until it expires."""
        if not rows:
            return
        name, now = self._name(version, key), time.time()
        entry = {"key": key, "query": query, "mode": mode, "version": version, "made": now, "until": now + ttl, "rows": json.dumps([r.asDict(recursive=True) for r in rows])}
        if not self.store._publish(name, entry):
            with contextlib.suppress(Py4JJavaError, PySparkException, ValueError):
                if self.store._load(name)["until"] < now:
                    self.store.fs.delete(self.store.jpath(f"{self.store.base}/{name}"), False)
                    self.store._publish(name, entry)

    def flush(self) -> None:
        """Write the hits that wait."""
        with self.lock:
            waiting, self.waiting = self.waiting, Counter()
        by_version: dict[int, dict[str, int]] = {}
        for (version, key), n in waiting.items():
            by_version.setdefault(version, {})[key] = n
        for version, hits in by_version.items():
            self.store._save(f"cache/v{version}/hits/{uuid.uuid4().hex}.json", {"hits": [{"key": k, "n": n} for k, n in hits.items()]})

    def table(self, version: int) -> DataFrame:
        """(key, query, mode, version, made, until, hits) of the results kept for a snapshot; hits that wait are written first."""
        self.flush()
        spark, at = self.store.spark, f"{self.store.base}/cache/v{version}"
        there = lambda kind: bool(self.store._names(f"cache/v{version}/{kind}"))
        kept = spark.read.schema(_ENTRY).json(f"{at}/results") if there("results") else spark.createDataFrame([], _ENTRY)
        hits = spark.read.schema("hits array<struct<key:string,n:long>>").json(f"{at}/hits") if there("hits") else spark.createDataFrame([], "hits array<struct<key:string,n:long>>")
        hits = hits.select(F.inline("hits")).groupBy("key").agg(F.sum("n").alias("hits"))
        moment = lambda c: F.timestamp_seconds(c).alias(c)
        return kept.join(hits, "key", "left").select("key", "query", "mode", "version", moment("made"), moment("until"), F.coalesce("hits", F.lit(0)).alias("hits"))


def _row(values: dict) -> Row:
    return Row(**{k: Row(**v) if isinstance(v, dict) else v for k, v in values.items()})
