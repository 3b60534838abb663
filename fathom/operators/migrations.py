"""Versions of the dataset: a log of what was applied, and the steps up and down between versions.

The log (version, applied_at) is a small table; a step turns the tables of one version into those of the next.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.schema import parse_version, pending

Tables = dict[str, DataFrame]
LOG = "version string, applied_at timestamp"


@dataclass(frozen=True)
class Migration:
    version: str
    up: Callable[[Tables], Tables]
    down: Callable[[Tables], Tables]


def latest(log: DataFrame) -> DataFrame:
    """One row (version): the version applied last, of equal times the one that sorts last as text; null if there is none."""
    return log.agg(F.max_by("version", F.struct("applied_at", "version")).alias("version"))


def pending_versions(versions: DataFrame, current: str) -> DataFrame:
    """(version, place) of versions above the current one, place from 1 in the order in which they are to be applied; numbers that are missing are 0."""
    number = lambda k: F.coalesce(F.try_element_at(F.split(F.ltrim(F.trim("version"), F.lit("v")), r"\."), F.lit(k)).cast("int"), F.lit(0))
    numbers = F.array(number(1), number(2), number(3))
    over = versions.select("version").where(numbers > F.array(*map(F.lit, parse_version(current))))
    return over.withColumn("place", F.row_number().over(Window.orderBy(numbers, "version")).cast("long"))  # a list of versions is short


def apply(tables: Tables, log: DataFrame, known: list[Migration]) -> tuple[Tables, DataFrame]:
    """tables and log after all known migrations above the latest version, lowest first."""
    current = latest(log).first()[0] or "0.0.0"
    by_version = {m.version: m for m in known}
    for version in pending(current, list(by_version)):
        tables = by_version[version].up(tables)
        log = log.unionByName(log.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("applied_at")))
    return tables, log


def rollback(tables: Tables, log: DataFrame, known: list[Migration]) -> tuple[Tables, DataFrame]:
    """tables and log before the highest applied migration; none applied or an unknown one is an error."""
    applied = sorted((r[0] for r in log.select("version").distinct().collect()), key=parse_version)
    if not applied:
        raise ValueError("no migration is applied")
    step = next((m for m in known if m.version == applied[-1]), None)
    if step is None:
        raise ValueError(f"migration {applied[-1]} is unknown")
    return step.down(tables), log.where(F.col("version") != step.version)
