"""Toxicity: a support vector machine over gapped subsequences of words, with Nyström landmarks.

The kernel of two words is the inner product of their subsequences of three to five characters, borders
of the word included, each weighed by LAMBDA for every character that it skips, over a norm. An inserted
character costs a gap, not the match. Landmarks are words of the training texts; the machine is trained
on their kernel values (K to the power of -1/2 whitens them), and as the kernel has an explicit feature
map its decision folds into one weight per hashed subsequence, which scores a word in one pass.

Labels are on texts, not on words: each toxic text lends the words that look most toxic so far, clean
texts lend all of theirs, and the hardest of those return in the next round. A text is then judged by
its highest words through a logistic curve.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
LAMBDA = 0.6
#: Offsets of a subsequence's characters after its first: three to five characters with up to two skipped.
OFFSETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4), (1, 2, 3, 4), (1, 2, 3, 5), (1, 2, 4, 5), (1, 3, 4, 5), (2, 3, 4, 5))
#: Documents of each label that the machine is fitted on, by order of a hash; bounds what the driver gets.
SAMPLE = 1500
LANDMARKS = 256
NEGATIVES = 12_000
#: Weighed log-odds that a subsequence must reach to make a word suspect.
SIGNAL = 11.0
THRESHOLD = 0.7
CACHE = 300_000
LONGEST = 64

_INNER = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<!\S)\w(?:\s\w){3,19}(?!\S)")
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def tokens(text: str) -> list[str]:
    """Lower-cased runs without white space; single characters spelled out one by one add the word they make."""
    text = text.lower()
    return text.split() + ["".join(m.group().split()) for m in _SPELLED.finditer(text)]


def core(token: str) -> str:
    """A token without what is no letter or digit, so that marks put between letters do not hide a word."""
    return _INNER.sub("", token)


def subsequences(words: list[str]):
    """(word number, hashed subsequence, weight) arrays, pattern by pattern; words are cut to LONGEST for hashing by overlapping pieces."""
    marked = [f"^{w}$" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(words)), sizes)
    for offsets in OFFSETS:
        span = offsets[-1]
        if len(chars) <= span:
            continue
        at = np.flatnonzero(owner[span:] == owner[: len(owner) - span])
        h = chars[at] * _MULT[0]
        for k, o in enumerate(offsets, 1):
            h = (h ^ (h >> np.uint64(31))) * _MULT[k] + chars[at + o]
        h = (h ^ (h >> np.uint64(29))) * _MULT[0] + np.uint64(len(offsets))
        yield owner[at], ((h * _MULT[1]) >> np.uint64(64 - BITS)).astype(np.int64), LAMBDA ** (span - len(offsets))


def _norms(words: list[str]) -> np.ndarray:
    n = np.fromiter(map(len, words), np.float64, len(words)) + 2
    return np.sqrt(np.maximum(sum(np.maximum(n - o[-1], 0) * LAMBDA ** (2 * (o[-1] - len(o))) for o in OFFSETS), 1.0))


def word_scores(words: list[str], weights: np.ndarray, bias: float, batch: int = 20_000) -> np.ndarray:
    """The machine's decision for each word, taken in batches that bound what is held at once."""
    out = np.empty(len(words))
    for k in range(0, len(words), batch):
        part = words[k : k + batch]
        total = np.zeros(len(part))
        for owner, at, value in subsequences(part):
            total += value * np.bincount(owner, weights[at], len(part))
        out[k : k + batch] = total / _norms(part) + bias
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    curve: np.ndarray


def _pieces(word: str) -> list[str]:
    return [word[k : k + LONGEST] for k in range(0, max(1, len(word) - LONGEST // 4), LONGEST - LONGEST // 4)]


class Scorer:
    """Scores whole texts; keeps the decisions of CACHE tokens, which changes speed only."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _learn(self, miss: list[str]) -> dict[str, float]:
        parts = [_pieces(core(t)) for t in miss]
        flat = sorted({p for x in parts for p in x})
        found = dict(zip(flat, word_scores(flat, self.model.weights, self.model.bias).tolist()))
        return {t: max(found[p] for p in x) for t, x in zip(miss, parts)}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: 1, the three highest decisions, log of how many are positive, and of how many tokens there are. Empty: 1, -2, -2, -2, 0, 0."""
        get, miss, listed = self.known.get, set(), []
        for t in texts:
            ts = tokens(t) if t else []
            got = list(map(get, ts))
            if None in got:
                miss.update(c for c, x in zip(ts, got) if x is None)
                listed.append((ts, got))
            else:
                listed.append((None, got))
        more = self._learn(list(miss)) if miss else {}
        if len(self.known) + len(more) <= CACHE:
            self.known.update(more)
        out = np.tile(np.array([1.0, -2.0, -2.0, -2.0, 0.0, 0.0]), (len(texts), 1))
        for row, (ts, got) in zip(out, listed):
            f = np.array(got if ts is None else [more[c] if x is None else x for c, x in zip(ts, got)])
            if len(f):
                top = np.sort(np.partition(f, len(f) - min(3, len(f)))[-3:])[::-1]
                row[1 : 1 + len(top)] = np.clip(top, -2, 1)
                row[4:] = np.log1p((f > 0.3).sum()), np.log1p(len(f))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.model.curve, -30, 30)))


def _kernel(words: list[str], columns: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of words with landmarks given by their features over `columns` (hash -> column or -1)."""
    out = []
    for k in range(0, len(words), 512):
        part = words[k : k + 512]
        x = np.zeros((len(part), landmarks.shape[1]), np.float32)
        for owner, at, value in subsequences(part):
            c = columns[at]
            on = c >= 0
            np.add.at(x, (owner[on], c[on]), np.float32(value))
        out.append((x @ landmarks.T) / _norms(part)[:, None])
    return np.concatenate(out).astype(np.float64)


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 2.0) -> np.ndarray:
    """Squared-hinge linear support vector machine by Newton steps; the last column of x is the constant."""
    w, reg = np.zeros(x.shape[1]), np.ones(x.shape[1])
    reg[-1] = 1e-3
    for _ in range(30):
        on = y * (x @ w) < 1
        z = x[on] * (c * weight[on])[:, None]
        new = np.linalg.solve(np.diag(reg) + z.T @ x[on], z.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new if _ < 8 else (w + new) / 2
    return w


def _fit_words(positive: dict[str, int], negative: dict[str, int]) -> tuple[np.ndarray, float]:
    """Hashed weights and bias of the machine; words come with the number of texts that have them, landmarks are drawn from both sides."""
    plus, minus = sorted(positive, key=lambda w: (-positive[w], w)), sorted(negative, key=lambda w: (-negative[w], w))
    marks = list(dict.fromkeys([*plus[: LANDMARKS // 2], *minus[: LANDMARKS // 4], *minus[:: max(1, len(minus) // (LANDMARKS // 4))]]))[:LANDMARKS]
    triples = [(o, a, np.full(len(a), v)) for o, a, v in subsequences(marks)]
    owner, at, value = (np.concatenate(x) for x in zip(*triples))
    used, col = np.unique(at, return_inverse=True)
    phi = np.zeros((len(marks), len(used)), np.float32)
    np.add.at(phi, (owner, col), value)
    phi /= _norms(marks)[:, None]
    columns = np.full(1 << BITS, -1, np.int32)
    columns[used] = np.arange(len(used))
    values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    keep = values > 1e-4
    white = vectors[:, keep] / np.sqrt(values[keep])
    words = plus + minus
    x = np.c_[_kernel(words, columns, phi) @ white, np.ones(len(words))]
    y = np.r_[np.ones(len(plus)), -np.ones(len(minus))]
    share = lambda side, ws, of: side * np.sqrt([of[w] for w in ws]) / np.sqrt([of[w] for w in ws]).sum()
    w = _machine(x, y, np.r_[share(600, plus, positive), share(1800, minus, negative)])
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = phi.T @ (white @ w[:-1])
    return weights, float(w[-1])


def _suspects(toxic: list[set[str]], clean: list[set[str]]) -> list[set[str]]:
    """Of each toxic text the words with the subsequences that part the two labels best, by weighed log-odds of text counts.

    Where nothing stands out of what chance would give (SIGNAL), the text lends no word: its label may be wrong.
    """
    count = [np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)]
    for side, texts in enumerate((clean, toxic)):
        for ws in texts:
            if ws:
                count[side][np.unique(np.concatenate([a for _, a, _ in subsequences(sorted(ws))]))] += 1
    odds = (np.log((count[1] + 0.5) / (len(toxic) + 1)) - np.log((count[0] + 0.5) / (len(clean) + 1))) * np.sqrt(count[1])
    floor = min(SIGNAL, 0.6 * float(odds.max()))
    out = []
    for ws in toxic:
        ws = sorted(ws)
        best = np.zeros(len(ws))
        for owner, at, _ in subsequences(ws):
            np.maximum.at(best, owner, odds[at])
        top = np.argsort(-best, kind="stable")[:4]
        out.append({ws[k] for k in top if best[k] >= max(floor, 0.4 * best[top[0]])})
    return out


def fit(texts: list[str], labels: list[int], rounds: int = 3) -> Model:
    """Fit on labelled texts. With one label only, or none, every text gets that label's share as its score."""
    y = np.array(labels, dtype=int)
    if len(set(labels)) < 2:
        share = 0.95 if len(y) and y[0] else 0.02
        return Model(np.zeros(1 << BITS, np.float32), 0.0, np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0]))
    one: dict[str, str] = {}  # texts share the objects of their words
    bags = [{one.setdefault(p, p) for t in tokens(x) for p in _pieces(core(t)) if p} for x in texts]
    del one
    toxic, clean = [b for b, v in zip(bags, y) if v], [b for b, v in zip(bags, y) if not v]
    in_toxic, in_clean = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    innocent = sorted(in_clean)
    odd = lambda w: (in_toxic[w] + 0.5) * (len(clean) + 1) >= 4 * (in_clean[w] + 0.5) * (len(toxic) + 1)
    common = [w for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0]))[: NEGATIVES // 2]]
    rest = np.random.default_rng(7).permutation(len(innocent))[: NEGATIVES // 2]
    negative = dict.fromkeys([*common, *(innocent[k] for k in rest)])
    chosen, weights, bias = _suspects(toxic, clean), np.zeros(1 << BITS, np.float32), -1.0
    for _ in range(rounds):
        seen = Counter(w for ws in chosen for w in ws if odd(w))
        if not seen or not negative:
            break
        weights, bias = _fit_words(seen, {w: in_clean[w] for w in negative if w not in seen})
        f = word_scores(innocent, weights, bias)
        negative |= dict.fromkeys(innocent[k] for k in np.argsort(-f, kind="stable")[: NEGATIVES // 4] if f[k] > -1)
        chosen = []
        for ws in toxic:
            ws = sorted(w for w in ws if odd(w))
            f = word_scores(ws, weights, bias) if ws else np.zeros(0)
            chosen.append({ws[k] for k in np.argsort(-f, kind="stable")[:4] if f[k] > 0})
    model = Model(weights, bias, np.zeros(6))
    z = Scorer(model).features(texts)
    curve = np.zeros(6)
    for _ in range(50):  # logistic regression with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.3 * np.eye(6)
        step = np.linalg.solve(h, z.T @ (y - p) - 0.3 * curve)
        curve += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(weights, bias, curve)


def held_out(doc_id) -> F.Column:
    return (F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3) == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents of each label, by order of a hash of doc_id; held-out ids never.

    labels (doc_id, toxic): rows with a null are passed over, repeated ids count once and as toxic if any row does.
    Of a document that repeats a doc_id the text that comes first in order is learned from.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = [known.where(c).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample) for c in ("toxic > 0", "toxic <= 0")]
    rows = taken[0].unionByName(taken[1]).withColumnRenamed("doc_id", "__id")
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("__id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))

    def words(batches):
        for batch in batches:
            found = [" ".join(sorted({c for t in tokens(x or "") if (c := core(t))})) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["doc_id", "toxic", "words"])

    def learn(batches):  # a task, not the driver, holds the sample
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        got = sorted((doc, words, int(toxic > 0)) for doc, toxic, words in rows)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in got], [r[2] for r in got]))], pa.binary())], ["model"])

    bags = texts.mapInArrow(words, "doc_id long, toxic int, words string")
    row = bags.repartition(1).mapInArrow(learn, "model binary").first()  # of 2 * sample rows at most
    return pickle.loads(bytes(row.model)) if row else fit([], [])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Per document (doc_id, held_out, score, predicted), one pass without shuffle.

    A score depends on the whole text alone. Null and empty texts get the score of a text without words.
    Repeated rows each return; a null doc_id is not held out. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scorer.score(part.column(2).to_pylist()))], ["doc_id", "held_out", "score"])

    doc_id = F.col("doc_id").cast("long")
    scored = docs.select(doc_id.alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold; cases as in toxicity()."""
    model, at = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample)), docs.columns.index("text")

    def keep(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield part.filter(pa.array(scorer.score(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(keep, docs.schema)
