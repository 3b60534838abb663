"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Words that make a kind likelier if they stand within CONTEXT characters before a span.
WORDS = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security"),
}
CONTEXT = 40
#: What a pattern alone, a passed checksum and a word nearby are worth; added kinds count from ACCEPT on.
SCORES = {"email": 0.7, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "ssn": 0.3}
CHECKED, NEARBY, ACCEPT = 0.5, 0.3, 0.6

# A match can start only where a run of its characters starts, so each is tried once there: time stays linear.
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn checksum."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48 << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an IBAN without blanks leaves 1 modulo 97."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    last = 0
    for m in _HOST.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_pii(text: str | None) -> list[Span]:
    """All spans of one whole text by kind, then start. Null and empty texts have none."""
    if not text:
        return []
    found = []

    def add(kind: str, start: int, end: int, checked: bool, least: float = 0.0) -> None:
        before = text[max(0, start - CONTEXT) : start].lower()
        near = any(w in before for w in WORDS[kind])
        score = min(1.0, SCORES[kind] + CHECKED * checked + NEARBY * near)
        if score >= least:
            found.append(Span(kind, start, end, round(score, 2)))

    if "@" in text:
        for s, e in _emails(text):
            add("email", s, e, False)
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            add("ip", *m.span(), False)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            add("card", *m.span(), True)
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_digits(m.group())) <= 15:
            add("phone", *m.span(), False)
    for m in _IBAN.finditer(text):
        if 15 <= len(a := m.group().replace(" ", "")) <= 34:
            add("iban", *m.span(), mod97(a), ACCEPT if mod97(a) else 2.0)
    for m in _SSN.finditer(text):
        add("ssn", *m.span(), False, ACCEPT)
    return found


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"


def joined(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


def pii_spans(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text) the counts of the base kinds, a digest of base spans, all spans and their scores.

    The base kinds (email, ip, card, phone) always count when their own check passes; iban (mod-97)
    and ssn (context) are added when their score reaches ACCEPT. Positions are code points. One pass
    without shuffle: each row stands alone, so repeated rows and hot sources cost nothing more.
    Null or empty text: no spans, the digest of the empty string. Other columns are ignored.
    """

    def scan(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = find_pii(text)
                base = [x for x in spans if x.kind in KINDS[:4]]
                counts = [sum(x.kind == k for x in base) for k in KINDS[:4]]
                out.append((doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), ",".join(f"{x.score:g}" for x in spans)))
            columns = list(zip(*out)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, _FOUND)
