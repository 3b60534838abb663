"""Tables of the index: types, keys, value sets and the dataset version."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

VERSION = "1.0.1"
#: Columns of a chunk that keyword search covers.
INDEXED = ("content", "context_before", "context_after")

_DDL = {
    "projects": "id long, root_path string, module_name string, go_version string, total_files int, total_chunks int, index_version string, last_indexed_at timestamp, created_at timestamp, updated_at timestamp",
    "files": "id long, project_id long, file_path string, package_name string, content_hash binary, mod_time timestamp, size_bytes long, parse_error string, last_indexed_at timestamp, created_at timestamp, updated_at timestamp",
    "symbols": "id long, file_id long, name string, kind string, package_name string, signature string, doc_comment string, scope string, receiver string, start_line int, start_col int, end_line int, end_col int, is_aggregate_root boolean, is_entity boolean, is_value_object boolean, is_repository boolean, is_service boolean, is_command boolean, is_query boolean, is_handler boolean, created_at timestamp",
    "chunks": "id long, file_id long, symbol_id long, content string, content_hash binary, token_count int, start_line int, end_line int, context_before string, context_after string, chunk_type string, created_at timestamp, updated_at timestamp",
    "embeddings": "id long, chunk_id long, vector array<float>, dimension int, provider string, model string, created_at timestamp",
    "imports": "id long, file_id long, import_path string, alias string",
}
_TYPES = {"array<int>": ArrayType(IntegerType()), "long": LongType(), "int": IntegerType(), "string": StringType(), "binary": BinaryType(), "boolean": BooleanType(), "timestamp": TimestampType(), "array<float>": ArrayType(FloatType())}
TABLES = {name: StructType([StructField(c, _TYPES[t]) for c, t in (x.split(" ") for x in ddl.split(", "))]) for name, ddl in _DDL.items()}

#: What an upsert matches on.
KEYS = {
    "projects": ["root_path"],
    "files": ["project_id", "file_path"],
    "symbols": ["file_id", "name", "start_line", "start_col"],
    "chunks": ["file_id", "start_line", "end_line"],
    "embeddings": ["chunk_id"],
}
#: child table -> (its column, parent table): rows whose parent goes go too.
PARENTS = {
    "files": [("project_id", "projects")],
    "symbols": [("file_id", "files")],
    "chunks": [("file_id", "files"), ("symbol_id", "symbols")],
    "embeddings": [("chunk_id", "chunks")],
    "imports": [("file_id", "files")],
}

# The names that stored rows and search requests use.
CHUNK_TYPES = ("function", "type", "method", "package", "const_group", "var_group")
SYMBOL_KINDS = ("function", "method", "struct", "interface", "type", "const", "var", "field")
SCOPES = ("exported", "unexported", "package_local")
MODES = ("hybrid", "vector", "keyword")
PATTERNS = ("aggregate", "entity", "value_object", "repository", "service", "command", "query", "handler")
FLAGS = dict(zip(PATTERNS, ("is_aggregate_root", "is_entity", "is_value_object", "is_repository", "is_service", "is_command", "is_query", "is_handler")))
DIMENSIONS = {"jina": 1024, "openai": 1536, "local": 384}


def valid_chunk() -> Column:
    """Whether a row of chunks is sound: content, lines in order, a known type."""
    return reduce(and_, [F.length("content") > 0, F.col("start_line") > 0, F.col("end_line") >= F.col("start_line"), F.col("chunk_type").isin(*CHUNK_TYPES)])


def valid_symbol() -> Column:
    """Whether a row of symbols is sound: a name, a package, a known kind and scope, a receiver for methods alone, lines in order."""
    receiver = (F.col("kind") == "method") == (F.coalesce("receiver", F.lit("")) != "")
    return reduce(and_, [F.length("name") > 0, F.length("package_name") > 0, F.col("kind").isin(*SYMBOL_KINDS), F.col("scope").isin(*SCOPES), receiver, F.col("start_line") > 0, F.col("end_line") >= F.col("start_line")])


def parse_version(version: str) -> tuple[int, int, int]:
    """Numbers of a version like 1.0.1; missing ones are 0."""
    parts = [int(x) for x in version.strip().lstrip("v").split(".")]
    return tuple((parts + [0, 0, 0])[:3])


def pending(current: str, known: list[str]) -> list[str]:
    """Versions above the current one, lowest first."""
    return sorted((v for v in known if parse_version(v) > parse_version(current)), key=parse_version)
