"""Search filters as predicates; what is empty adds nothing."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import glob_match
from fathom.schema import FLAGS

#: Kinds that callers may name though no chunk has them, and the chunk types that hold them.
KIND_ALIASES = {"struct": "type", "interface": "type", "const": "const_group", "var": "var_group"}


@dataclass(frozen=True)
class SearchFilters:
    symbol_types: list[str] = field(default_factory=list)
    file_pattern: str = ""
    ddd_patterns: list[str] = field(default_factory=list)
    packages: list[str] = field(default_factory=list)
    min_relevance: float = 0.0
    resolve_kinds: bool = False


def apply(chunks: DataFrame, filters: SearchFilters | None, symbols: DataFrame | None = None) -> DataFrame:
    """chunks (chunk_type, file_path, package_name, symbol_id) that pass all filters but the relevance.

    An empty list, or types that begin with an empty one, filter nothing. Patterns are a semi-join with
    the symbols that have any of them; only unknown patterns are an error.
    """
    if filters is None:
        return chunks
    if filters.packages:
        chunks = chunks.where(F.col("package_name").isin(*filters.packages))
    if filters.symbol_types and filters.symbol_types[0]:
        kinds = [KIND_ALIASES.get(k, k) for k in filters.symbol_types] if filters.resolve_kinds else filters.symbol_types
        chunks = chunks.where(F.col("chunk_type").isin(*kinds))
    if filters.file_pattern:
        chunks = chunks.where(glob_match(F.col("file_path"), filters.file_pattern))
    if filters.ddd_patterns:
        flags = [F.col(FLAGS[p]) for p in filters.ddd_patterns if p in FLAGS]
        if not flags or symbols is None:
            raise ValueError(f"no known pattern among {filters.ddd_patterns}")
        ids = symbols.where(reduce(or_, flags)).select(F.col("id").alias("__symbol"))
        chunks = chunks.join(ids, chunks["symbol_id"] == ids["__symbol"], "left_semi")
    return chunks
