"""Change detection on a stream of listings: each path's last hash is state, and paths that are seen no more are told by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

OUTPUT = StructType([StructField("file_path", StringType()), StructField("status", StringType()), StructField("seen_ms", LongType())])
_STATE = StructType([StructField("content_hash", StringType()), StructField("seen_ms", LongType()), StructField("timer_ms", LongType())])


class Changes(StatefulProcessor):
    """State by path: hash, when it was seen last, and the timer that tells that it is gone."""

    def __init__(self, gone_after_ms: int):
        self.gone_after_ms = gone_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = sorted((int(at), h) for batch in rows for at, h in zip(batch["at"], batch["content_hash"]))
        known = self.last.get() if self.last.exists() else None
        content_hash, last, timer = known if known else (None, None, None)
        out = []
        for at, h in seen:
            if last is not None and at < last:  # a listing that is older than what is known says nothing
                continue
            status = "new" if last is None else "unchanged" if h == content_hash else "changed"
            out.append((key[0], status, at))
            content_hash, last = h, at
        if out:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = last + self.gone_after_ms
            self.handle.registerTimer(timer)
            self.last.update((content_hash, last, timer))
            yield pd.DataFrame(out, columns=["file_path", "status", "seen_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.last.clear()
        yield pd.DataFrame([(key[0], "deleted", at)], columns=["file_path", "status", "seen_ms"])

    def close(self) -> None:
        pass


def detect(listings: DataFrame, gone_after: str = "1 hour") -> DataFrame:
    """(file_path, status, seen_ms) of a stream of listings (file_path, content_hash, seen): new, changed, unchanged or deleted.

    A listing is the rows of one time `seen`. A path that has not been seen for gone_after of event time is
    deleted; if it comes back it is new. Listings may come late, up to that time; one that is older than what
    is known of a path says nothing of it. Only the stream's own state is read, so a run costs what changed
    paths cost; after a restart it goes on from the checkpoint. The session needs the RocksDB state store, see configure().
    """
    amount, unit = gone_after.split()
    ms = int(amount) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
    watched = listings.select("file_path", "content_hash", "seen", F.unix_millis("seen").alias("at")).withWatermark("seen", "0 seconds")
    return watched.groupBy("file_path").transformWithStateInPandas(Changes(ms), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")


def configure(spark: SparkSession) -> None:
    """The state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
