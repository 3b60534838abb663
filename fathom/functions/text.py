"""Text expressions: tokens, keyword scores, query clean-up and path patterns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of the keyword score.
K1, B = 1.2, 0.75


def _folding() -> dict[str, str]:
    """Lower-case Latin letters that are an ASCII letter with one mark, by that letter; the long s, dotted or not, is an s. Letters with two marks stay."""
    table = {"ſ": "s", "ẛ": "s"}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        parts = unicodedata.normalize("NFD", c.lower())
        if len(c.lower()) == 1 and len(parts) == 2 and parts[0].isascii() and unicodedata.category(parts[1]) == "Mn":
            table[c.lower()] = parts[0]
    return table


_FOLDING = _folding()
#: Marks that stand by themselves are dropped.
_MARKS = "[\u0300-\u036f]"


def folded(text: Column) -> Column:
    """Lower case, Latin diacritics removed."""
    return F.regexp_replace(F.translate(F.lower(text), "".join(_FOLDING), "".join(_FOLDING.values())), _MARKS, "")


def folded_text(text: str) -> str:
    return re.sub(_MARKS, "", text.lower().translate(str.maketrans(_FOLDING)))


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased, diacritics removed."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _is(word: str):
    return lambda x: x == word


def term_count(toks: Column, term: str) -> Column:
    """How often a term stands in an array of tokens; a term with blanks is a phrase of adjacent tokens."""
    words = term.split(" ")
    if len(words) == 1:
        return F.size(F.filter(toks, lambda x: x == term))
    found = F.transform(toks, _is(words[0]))
    for k, word in enumerate(words[1:], 1):  # each place holds whether the phrase so far starts there
        after = F.slice(F.transform(toks, _is(word)), k + 1, F.greatest(F.size(toks), F.lit(1)))
        found = F.zip_with(found, after, lambda a, b: a & F.coalesce(b, F.lit(False)))
    return F.size(F.filter(found, lambda x: x))


def idf(rows: Column, having: Column) -> Column:
    """Inverse frequency; a small positive number for terms that half of all rows have."""
    raw = F.log((rows - having + 0.5) / (having + 0.5))
    return F.when(raw > 0, raw).otherwise(1e-6)


def term_score(weight: Column, count: Column, length: Column, mean: Column) -> Column:
    """One term's share of the keyword score."""
    return weight * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))


def relevance(bm25: Column) -> Column:
    """The keyword score's normal form, which falls as the match gets better."""
    return 1 / (1 + F.abs(bm25) / 50)


class QuerySyntaxError(ValueError):
    """A query that a strict full-text parser does not take."""


def escape(query: Column) -> Column:
    """A backslash before quotes, asterisks, parentheses and the operators in capitals."""
    return F.regexp_replace(F.regexp_replace(query, r'(["*()])', r"\\$1"), r"\b(AND|OR|NOT|NEAR)\b", r"\\$1")


def query_terms(query: str, strict: bool = False) -> list[str]:
    """Terms of a query; words joined by underscores are a phrase. All must match.

    Punctuation parts words. With strict, anything but letters, digits, underscores and blanks is an error,
    and so are the operators in capitals.
    """
    if strict and (bad := re.search(r"[^\w\s]|\b(?:AND|OR|NOT|NEAR)\b", query)):
        raise QuerySyntaxError(f"{bad.group()!r} at {bad.start()} is no plain term")
    out = []
    for bare in re.findall(r"[^\W]+", folded_text(query)):
        if words := re.findall(r"[^\W_]+", bare):
            out.append(" ".join(words))
    return list(dict.fromkeys(out))


def sanitize(query: Column) -> Column:
    """Everything but ASCII word characters, white space, dash, underscore and dot becomes a blank; blanks collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(query, r"[^A-Za-z0-9_\s\-.]", " "), r"\s+", " "))


def sanitize_text(query: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9_\s\-.]", " ", query)).strip()


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a path pattern: * crosses folders, ? is one character, [..] a set, [^..] its complement."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            while k + 1 < len(pattern) and pattern[k + 1] == "*":
                k += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", k + (3 if pattern[k + 1 : k + 2] == "^" else 2))
            if end < 0:
                return "(?!)"
            body = pattern[k + 1 : end]
            no, body = ("^", body[1:]) if body.startswith("^") else ("", body)
            out.append(f"[{no}{re.sub(r'([\\\[\]^&])', r'\\\1', body)}]")
            k = end
        else:
            out.append(re.escape(c))
        k += 1
    return "(?s)^" + "".join(out) + "$"


def glob_match(path: Column, pattern: str) -> Column:
    """Whether a path matches; the literal beginning becomes a prefix test, which reaches the scan."""
    head = re.match(r"[^*?\[]*", pattern).group()
    match = path.rlike(glob_regex(pattern))
    return path.startswith(head) & match if head else match
