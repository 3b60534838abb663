"""Secret scans with DataFrame expressions only: no Python runs on the executors.

Three base patterns give spans; beside them, candidate strings are slid over by a window whose
Shannon entropy is kept up from incremental counts, per character class, and those that are random
enough for their class become spans too unless an allow-list pattern explains them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base scan; a match is kept if its value has the least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # of runs under 24 none counts, so runs from 24 on are the same matches
KINDS = ("assign", "access", "hex", "entropy")

#: The base64 and URL-safe alphabets; candidates for entropy are runs of 20 or more of these characters.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes with the entropy, in bits a character, that some window of WINDOW must come to. Of random strings of 24
#: characters 95 % of digits, 99 % of hexadecimal, 92 % of letters, 99 % of letters and digits and 93 % of all reach it.
CLASSES = ((r"^[0-9]+$", 2.8), (r"^[0-9a-fA-F-]+$", 3.0), (r"^[A-Za-z]+$", 3.85), (r"^[A-Za-z0-9]+$", 3.7), (r".", 3.9))
#: Strings that are no secrets: words or numbers joined by dashes and the like, paths, UUIDs, placeholders.
ALLOW = (
    r"^[A-Za-z]{1,15}(?:[-_/=+]+[A-Za-z]{1,15})++[-_/=+]*$",
    r"^[0-9]{1,8}(?:[-_/=+]+[0-9]{1,8})++[-_/=+]*$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|(?:^|[-_])your[-_]",
)
#: Running sums are taken over this many matches at a time, so that a text's matches are not copied again for each.
_BLOCK = 256
_SPANS = "array<struct<s:int,e:int,v:string>>"


def _bound(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often use names it, also within lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, v): code-point start, end and value of every leftmost non-overlapping match.

    The pieces between matches and the matches themselves alternate, so starts are running sums of lengths:
    first within blocks of matches, then over blocks.
    """

    def step(acc: Column, x: Column) -> Column:
        s = (acc["p"] + F.length(x["a"])).cast("int")
        e = (s + F.length(x["v"])).cast("int")
        return F.struct(e.alias("p"), F.array_append(acc["o"], F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"))).alias("o"))

    def over(acc: Column, b: Column) -> Column:
        moved = F.transform(b["o"], lambda x: F.struct((x["s"] + acc["p"]).cast("int").alias("s"), (x["e"] + acc["p"]).cast("int").alias("e"), x["v"].alias("v")))
        return F.struct((acc["p"] + b["p"]).cast("int").alias("p"), F.array_append(acc["o"], moved).alias("o"))

    def start(kind: str) -> Column:
        return F.struct(F.lit(0).alias("p"), F.array().cast(kind).alias("o"))

    def listed(pairs: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(_BLOCK))
        blocks = F.transform(firsts, lambda k: F.aggregate(F.slice(pairs, k, F.lit(_BLOCK)), start(_SPANS), step))
        return F.flatten(F.aggregate(blocks, start(f"array<{_SPANS}>"), over, lambda acc: acc["o"]))

    def zipped(found: Column) -> Column:
        return F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda a, v: F.struct(a.alias("a"), v.alias("v")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), _bound(_bound(found, zipped), listed)).otherwise(F.array().cast(_SPANS))


def window_entropy(value: Column, window: int = WINDOW, enough: Column | None = None) -> Column:
    """The highest Shannon entropy, in bits a character, of any run of `window` characters of value.

    With c the count of each character, entropy is log2(w) - sum(c log2 c) / w. Each step takes one
    character in and one out: two numbers of a fixed array of counts change, and the sum moves by their
    terms only. One pass over value; once a window has `enough`, the rest costs next to nothing and the
    result is that window's. Characters outside ALPHABET count as one. Shorter values: the entropy of
    the whole. Empty: 0. Null: null.
    """
    w = F.least(F.lit(window), F.length(value))
    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def codes() -> Column:  # 1 to len(ALPHABET), or one more
        return F.transform(F.split(value, ""), lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(len(ALPHABET) + 1)))

    def step(acc: Column, x: Column) -> Column:
        into, out = x["into"], x["out"]  # out is 0 until the window is full
        had, left = F.element_at(acc["counts"], into), F.element_at(acc["counts"], F.greatest(out, F.lit(1)))
        counts = F.transform(acc["counts"], lambda n, i: n + F.when(i + 1 == into, 1).when(i + 1 == out, -1).otherwise(0))
        moved = acc["s"] + term(had + 1) - term(had) + F.when(out > 0, term(left - 1) - term(left)).otherwise(0.0)
        same = into == out
        s, n = F.when(same, acc["s"]).otherwise(moved), acc["n"] + 1
        h = F.log2(w.cast("double")) - s / w
        new = F.struct(
            F.when(same, acc["counts"]).otherwise(counts).alias("counts"), s.alias("s"), n.alias("n"),
            F.when(n >= w, F.greatest(acc["best"], h)).otherwise(acc["best"]).alias("best"),
        )
        return new if enough is None else F.when(acc["best"] >= enough, acc).otherwise(new)

    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))
    late = lambda c: F.concat(F.array_repeat(F.lit(0), w), F.slice(c, 1, F.size(c) - w))
    pairs = _bound(codes(), lambda c: F.zip_with(c, late(c), lambda a, b: F.struct(a.alias("into"), b.alias("out"))))
    run = F.aggregate(pairs, zero, step, lambda acc: acc["best"])
    return F.when(F.length(value) == 0, F.lit(0.0)).when(value.isNotNull(), run)


def _random(v: Column) -> Column:
    """Whether a candidate is no allowed string and random enough for the first class that it fits."""
    bar = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        bar = F.when(v.rlike(pattern), F.lit(bits)).otherwise(bar)
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | v.rlike(pattern)
    reached = _bound(bar, lambda b: window_entropy(v, enough=b) >= b)
    return F.when(allowed, F.lit(False)).otherwise(reached)


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with one more column: array<struct<s:int,e:int,v:string,k:int>>, spans by start, then kind.

    k indexes KINDS. One projection: no shuffle, no state between rows, so group sizes do not matter.
    Null or empty text: no spans. Repeated rows each get theirs. A column already named `out` is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    tagged = lambda spans, k: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), F.lit(k).alias("k")))
    assign = F.filter(_matches(t, ASSIGN), lambda x: F.length(F.regexp_replace(x["v"], ASSIGN_HEAD, "")) >= 6)
    access = F.filter(_matches(t, ACCESS), lambda x: F.length(x["v"]) >= 20)
    entropy = F.filter(_matches(t, CANDIDATE), lambda x: _random(x["v"]))
    spans = F.concat(tagged(assign, 0), tagged(access, 1), tagged(_matches(t, HEX), 2), tagged(entropy, 3))
    by = lambda a, b: F.when(a["s"] != b["s"], F.when(a["s"] < b["s"], -1).otherwise(1)).when(a["k"] != b["k"], F.when(a["k"] < b["k"], -1).otherwise(1)).otherwise(0)
    return docs.withColumn(out, F.array_sort(spans, by))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of spans as find_secrets() gives them."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, n_assign, n_access, n_hex, base_sha256, spans); see find_secrets() for edge cases."""
    found = find_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), out="f")
    base = F.filter("f", lambda x: x["k"] < 3)
    n = lambda k: F.size(F.filter("f", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("f")).alias("spans")
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span of text replaced by mask, overlapping spans by one mask; same columns.

    Rows without a find keep their text unchanged, null included. n_chars, if there is one, follows the text.
    """
    name = "__secrets"
    found = find_secrets(docs, out=name)
    # spans are sorted by start: each gives the text since the one before, if it starts beyond that, and a mask
    step = lambda acc, x: F.when(x["e"] <= acc["p"], acc).otherwise(
        F.struct(
            x["e"].alias("p"),
            F.when(x["s"] < acc["p"], acc["t"]).otherwise(F.array_append(acc["t"], F.struct(acc["p"].alias("s"), x["s"].alias("e")))).alias("t"),
        )
    )
    zero = F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<s:int,e:int>>").alias("t"))
    gaps = F.aggregate(name, zero, step, lambda acc: F.array_append(acc["t"], F.struct(acc["p"].alias("s"), F.length("text").alias("e"))))
    pieces = F.transform(gaps, lambda g: F.substring(F.col("text"), g["s"] + 1, g["e"] - g["s"]))
    out = found.withColumn("text", F.when(F.size(name) > 0, F.array_join(pieces, mask)).otherwise(F.col("text"))).drop(name)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
