"""Chunks of parsed files: one for each declaration, or one for a file without any."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import code


def symbols(parsed: DataFrame) -> DataFrame:
    """Rows of the symbol table (without ids) of parsed files (file_id, package, symbols), in the order of the source (seq)."""
    s = parsed.select("file_id", F.col("package").alias("package_name"), F.posexplode("symbols").alias("seq", "s")).select("file_id", "package_name", "seq", "s.*")
    return s.withColumns({"scope": code.scope(F.col("name"))} | code.patterns(F.col("name"), F.col("kind")))


def chunks(parsed: DataFrame, strategy: str = "function") -> DataFrame:
    """Rows of the chunk table (without ids) of parsed files (file_id, package, imports, symbols, content, lines).

    Fields make no chunk, nor do declarations outside the file's lines. A file that gives no chunk, or
    each file with strategy "package", is one chunk of its whole text. Chunks of the same lines are one,
    the last declaration's.
    """
    text = F.decode("content", "UTF-8") if dict(parsed.dtypes)["content"] == "binary" else F.col("content")
    files = parsed.withColumn("__text", text)
    usable = F.filter("symbols", lambda s: (s["kind"] != "field") & (s["start_line"] > 0) & (s["end_line"] > 0) & (s["start_line"] <= F.col("lines")))
    files = files.withColumn("__usable", F.array().cast(parsed.schema["symbols"].dataType) if strategy == "package" else usable)
    context = code.package_context(F.col("package"), F.col("imports"))
    rows = files.where(F.size("__usable") > 0).select("file_id", context.alias("context_before"), F.posexplode(code.cut_lines(F.col("__text"), F.col("__usable"))).alias("seq", "x"))
    rows = rows.select("file_id", "context_before", "seq", "x.s", "x.content")
    own = rows.select(
        "file_id", "content", "context_before",
        F.col("s.start_line").alias("start_line"), F.col("s.end_line").alias("end_line"), code.chunk_type(F.col("s.kind")).alias("chunk_type"),
        F.struct("s.name", F.col("s.start_line").alias("start_line"), F.col("s.start_col").alias("start_col")).alias("of"), "seq",
    )
    last = own.groupBy("file_id", "start_line", "end_line").agg(F.max_by(F.struct("content", "context_before", "chunk_type", "of"), "seq").alias("x")).select("file_id", "start_line", "end_line", "x.*")
    whole = files.where(F.size("__usable") == 0).select(
        "file_id", F.lit(1).alias("start_line"), F.col("lines").alias("end_line"), F.col("__text").alias("content"), F.lit("").alias("context_before"),
        F.lit("package").alias("chunk_type"), F.lit(None).cast(last.schema["of"].dataType).alias("of"),
    )
    out = last.unionByName(whole).withColumn("context_after", F.lit(""))
    return out.withColumns({"content_hash": code.content_hash(F.col("content")), "token_count": code.token_count(F.col("content"), F.col("context_before"), F.col("context_after"))})


def related(symbols: DataFrame) -> DataFrame:
    """(file_id, name, context): for a struct its methods, for a method its receiver, each as a comment line."""
    structs = symbols.where("kind = 'struct'").select("file_id", "name", "signature")
    methods = symbols.where("kind = 'method'").select("file_id", F.col("receiver"), F.col("name").alias("method"), F.col("signature").alias("method_signature"), "start_line")
    joined = structs.join(methods, (structs["file_id"] == methods["file_id"]) & (structs["name"] == methods["receiver"])).drop(methods["file_id"])
    line = F.concat(F.lit("// Method: "), "method_signature")
    of_struct = joined.groupBy("file_id", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_line", line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))
    return of_struct.unionByName(joined.select("file_id", F.col("method").alias("name"), F.concat(F.lit("// Receiver: "), "signature").alias("context")))


#: Bytes of a token, and the costs of a cut: for each open brace, if no blank line is before it, and for each piece.
TOKEN_BYTES, IN_BRACE, NO_BLANK, PIECE = 4, 10, 3, 5


def cuts(lines: list[str], most: int) -> list[int]:
    """Where each piece of lines begins, so that no piece is over `most` tokens unless it is one line, at the least cost.

    Before every line the least cost of what came before is the least over the places where the last piece
    may begin; these form a window that only moves on, so that its least is kept in a queue: linear in the lines.
    """
    n, bytes_before, depth = len(lines), [0], [0]
    for line in lines:
        bytes_before.append(bytes_before[-1] + len(line.encode()) + 1)
        depth.append(max(0, depth[-1] + line.count("{") - line.count("}")))
    fits = lambda i, j: (bytes_before[j] - bytes_before[i] - 1) // TOKEN_BYTES <= most  # noqa: E731  lines i to j - 1
    # best[i] is the cost of pieces for the lines before i, with a cut there
    best, back, window, low = [0] * (n + 1), [0] * (n + 1), deque([0]), 0
    for j in range(1, n + 1):
        while low < j - 1 and not fits(low, j):
            low += 1
        while window[0] < low:
            window.popleft()
        back[j] = window[0]
        best[j] = best[back[j]] + PIECE
        if j < n:
            best[j] += IN_BRACE * depth[j] + NO_BLANK * bool(lines[j - 1].strip())
            while window and best[window[-1]] > best[j]:
                window.pop()
            window.append(j)
    out, j = [], n
    while j > 0:
        j = back[j]
        out.append(j)
    return out[::-1]


def split_large(chunks: DataFrame, most: int = 1000) -> DataFrame:
    """chunks (id, content, start_line, other columns) with those of over `most` tokens cut into pieces at lines; piece numbers them from 0.

    The cuts are where they cost least: at blank lines rather than between others, outside of braces rather
    than inside. Joined by line feeds the pieces are the whole chunk; a piece is over the bound only if it is
    one line. start_line and end_line are the piece's own. Chunks within the bound and null contents stay as
    they are. Optional: an indexing run leaves chunks whole.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for key, content, start in zip(batch["__id"], batch["content"], batch["start_line"]):
                lines = content.split("\n")
                at = cuts(lines, most)
                rows += [(key, k, "\n".join(lines[a:b]), start + a, start + b - 1) for k, (a, b) in enumerate(zip(at, [*at[1:], len(lines)]))]
            yield pd.DataFrame(rows, columns=["__id", "piece", "content", "start_line", "end_line"])

    large = F.octet_length("content") >= TOKEN_BYTES * (most + 1)
    whole = chunks.where(~F.coalesce(large, F.lit(False))).withColumn("piece", F.lit(0))
    over = chunks.where(large)
    kind = dict(chunks.dtypes)["id"]
    lines = dict(chunks.dtypes)["start_line"]
    found = over.select(F.col("id").alias("__id"), "content", "start_line").mapInPandas(run, f"__id {kind}, piece int, content string, start_line {lines}, end_line {lines}")
    rest = over.drop("content", "start_line", "end_line").join(found, F.col("id") == F.col("__id")).drop("__id")
    if "token_count" in rest.columns:
        rest = rest.withColumn("token_count", code.token_count(F.col("content"), F.coalesce("context_before", F.lit("")), F.coalesce("context_after", F.lit(""))))
    if "content_hash" in rest.columns:
        rest = rest.withColumn("content_hash", code.content_hash(F.col("content")))
    return whole.unionByName(rest, allowMissingColumns=True)
