"""Near-duplicate passages by compact windows.

A passage is a run of five-word shingles. For each of a few hash functions the Cartesian tree over a
text's shingle hashes has, for each node, the compact window (left, root, right) in which the root is the
smallest: every passage inside it that holds the root has the root's hash as its signature. Windows that
hold a passage of WORDS words or more are kept. Equal texts are one text. Windows are joined on (function,
smallest hash), and two texts whose windows meet are compared inside both windows' intervals, around the
shared root. Equal views that end or start on it, and windows that are equal throughout, are seen by their
hashes alone; of other texts that also share the shingles on one side, the shingles around it are fetched, and
every equal run of a passage's length and every pair of views that hold the root and have a Jaccard similarity
of SIMILARITY or more is listed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import connected_components, materialize, word_edges, word_hashes
from fathom.llm.common import mix as _mix
from fathom.llm.common import powers as _powers

SHINGLE = 5
WORDS = 50
HASHES = 3
SIMILARITY = 0.8
#: Two texts are compared around a shared shingle if they also share this many before or after it: of the 46 shingles
#: of an equal passage at least 22 stand on one side, and a single changed word spoils five in a row on one side only.
SIDE = 8
#: Members of one group in one task; larger groups are compared by pairs of chunks, in tasks of their own.
GROUP_LIMIT = 16_384
#: Groups up to SMALL members are compared pair by pair; in larger ones views that are not listed yet are held against all rows.
SMALL = 64

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if 9 <= c <= 13 else c for c in range(256))
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingles(text: bytes) -> tuple[np.ndarray, int]:
    """(hashes of the five-word shingles, number of words); words are lower-cased runs without ASCII white space."""
    plain = text.translate(_LOWER)
    starts, ends = word_edges(plain)
    n = len(starts)
    if n < SHINGLE:
        return np.zeros(0, np.uint64), n
    w = word_hashes(plain, starts, ends)
    h = np.zeros(n - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(h)]
    return _mix(h), n


def _roots(h: np.ndarray, least: int) -> np.ndarray:
    """Places whose hash is the smallest of some run of `least` places, of equal ones the first of the run."""
    n = len(h) - least + 1
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    key = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    rows = np.r_[key, np.full(-len(key) % least, ~np.uint64(0))].reshape(-1, least)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:n], ahead[least - 1 : least - 1 + n])
    return (low[np.r_[True, low[1:] != low[:-1]]] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def compact_windows(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, root, right), by root, of the compact windows of `least` places or more: the root's hash is the smallest from left to right.

    The nodes of the Cartesian tree that have such windows are the minima of runs of `least` places, and so
    are their ancestors, so the tree is built over those alone. Of one hash that fills places in a row the
    first, the last and every `least`-th are roots, so that a run of one word gives few windows: a passage
    in it holds one of them, and two equal passages that reach beyond the run hold its first or last both.
    """
    roots, step = _roots(h, least), 1 + np.flatnonzero(h[1:] != h[:-1])
    if len(step) + 1 < len(h):
        first, last = np.r_[0, step], np.r_[step, len(h)] - 1
        run = np.unique(np.searchsorted(first, roots, "right") - 1)
        first, last = first[run], last[run]
        n = (last - first) // least + 1
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        roots = np.unique(np.r_[np.repeat(first, n) + least * nth, last])
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    value, place = (h[roots] >> bits).tolist(), roots.tolist()
    left, right, stack = [0] * len(place), [len(h) - 1] * len(place), []
    for k, x in enumerate(value):
        while stack and value[stack[-1]] > x:
            right[stack.pop()] = place[k] - 1
        # a node on the stack with an equal hash has the same ancestor on its left
        left[k] = (left[stack[-1]] if value[stack[-1]] == x else place[stack[-1]] + 1) if stack else 0
        stack.append(k)
    return np.array(left, np.int64), roots, np.array(right, np.int64)


def _windows(least: int):
    """(key, u, c, lo, hi, gl, gr, side, more): root c of each compact window of a text u, how far the window reaches to either side of it, with hashes of all that is there up to the root and from it on.

    lo and hi are least - 1 at most; where they are, gl and gr are hashes of views. side holds 32-bit hashes of the SIDE shingles before the root and of those after it.
    Where lines repeat within a text, roots with equal surroundings that follow each other closely are one row: the last
    of them is at c + more, and a span around c that is found holds on to the same place around that one.
    """

    def run(batches):
        for batch in batches:
            cols: list = [[] for _ in range(9)]
            for u, n, t in zip(*(x.to_pylist() for x in batch.columns)):
                text = _unpacked(n, t)
                h, _ = shingles(text) if text else (np.zeros(0, np.uint64), 0)
                if len(h) < least:
                    continue
                sums, places = _sums(h), np.arange(len(h) - SIDE + 1)
                near = (_stretches(sums, places, places + SIDE).view(np.uint64) >> np.uint64(32)) | np.uint64(1)
                near = np.r_[np.zeros(SIDE, np.uint64), near, np.zeros(SIDE, np.uint64)]  # the side before c is at c, that after it at c + SIDE + 1
                owns = [_mix(h ^ seed) for seed in _SEEDS[:HASHES]]
                found = [compact_windows(own, least) for own in owns]
                left, c, right = (np.concatenate(x) for x in zip(*found))
                lo, hi = np.minimum(c - left, least - 1), np.minimum(right - c, least - 1)
                gl, gr = _stretches(sums, c - lo, c + 1), _stretches(sums, c, c + hi + 1)
                side = ((near[c] << np.uint64(32)) | near[c + SIDE + 1]).view(np.int64)
                key = np.concatenate([own[roots] for own, (_, roots, _) in zip(owns, found)]).view(np.int64)
                for col, x in zip(cols, _repeated([key, np.full(len(c), u), c, lo, hi, gl, gr, side], least)):
                    col.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["key", "u", "c", "lo", "hi", "gl", "gr", "side", "more"])

    return run


def _repeated(rows: list[np.ndarray], least: int) -> list[np.ndarray]:
    """rows of one text, by root, with one more column: how far the roots that are one with it go on."""
    key, _, c, lo, hi, gl, gr, _ = rows
    if len(np.unique(key)) == len(key):
        return [*rows, np.zeros(len(key), np.int64)]
    order = np.lexsort((c, gr, gl, key))
    key, c, gl, gr, whole = (x[order] for x in (key, c, gl, gr, (lo == least - 1) & (hi == least - 1)))
    same = (key[1:] == key[:-1]) & (gl[1:] == gl[:-1]) & (gr[1:] == gr[:-1]) & whole[1:] & whole[:-1] & (c[1:] - c[:-1] <= least)
    first = np.flatnonzero(np.r_[True, ~same])
    last = np.r_[first[1:], len(key)] - 1
    return [*[x[order[first]] for x in rows], c[last] - c[first]]


def _sums(h: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(len(h) + 1)[0][: len(h)], out=sums[1:])
    return sums


def _stretches(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes, never 0, of the shingles from each start to its end, exclusive, by the sums of their text."""
    _, down = _powers(len(sums))
    length = (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (_mix((sums[end] - sums[start]) * down[start] + length) | np.uint64(1)).view(np.int64)


def _classes(key: np.ndarray, g: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the smallest and largest u of those with its key and g; rows with g = 0 stay alone."""
    lo, hi = u.copy(), u.copy()
    at = np.flatnonzero(g)
    if len(at):
        order = at[np.lexsort((u[at], g[at], key[at]))]
        start = np.flatnonzero(np.r_[True, (key[order[1:]] != key[order[:-1]]) | (g[order[1:]] != g[order[:-1]])])
        end = np.r_[start[1:], len(order)]
        size = end - start
        lo[order], hi[order] = np.repeat(u[order[start]], size), np.repeat(u[order[end - 1]], size)
    return lo, hi


def _join(least: int):
    """Over rows sorted by key: (u, s, e, other, key, c, more) with spans of words that equal views verify (key null), and members to compare (key not null): s and e are then how far their windows reach, other is their number in the group.

    Rows whose windows are equal throughout are of one kind. Of a kind that several texts have each row is listed whole
    here, and the first and the last stand for it in what follows; of a kind that one text alone has, all rows go on.
    """
    names = ["u", "s", "e", "other", "key", "c", "more"]

    def batch_of(u, s, e, other, key, c, more) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) if x is not None else pa.nulls(len(u), pa.int64()) for x in (u, s, e, other, key, c, more)], names)

    def groups(key, u, c, lo, hi, gl, gr, side, more):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.repeat(np.diff(np.r_[start, len(key)]) > 1, np.diff(np.r_[start, len(key)]))
        key, u, c, lo, hi, gl, gr, side, more = (x[many] for x in (key, u, c, lo, hi, gl, gr, side, more))
        if not len(key):
            return
        order = np.lexsort((u, gr, gl, key))
        new = np.r_[True, np.any([x[order[1:]] != x[order[:-1]] for x in (key, gl, gr)], axis=0)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(order)] - 1
        head, shared, stands = np.zeros(len(key), bool), np.zeros(len(key), bool), np.zeros(len(key), bool)
        other = np.empty_like(u)
        low, high = (np.repeat(u[order[x]], last - first + 1) for x in (first, last))
        head[order], shared[order], other[order] = new, low != high, np.where(u[order] == low, high, low)
        stands[order] = new | np.r_[new[1:], True] | (low == high)
        yield batch_of(u[shared], (c - lo)[shared], (c + hi + SHINGLE + more)[shared], other[shared], None, None, None)
        for g, reach, shift in ((gl, lo, least - 1), (gr, hi, 0)):
            low, high = _classes(key, np.where(reach == least - 1, g, 0), u)
            # a passage that only one text has is no passage across documents; of a kind that is listed one row links it to others
            on = (low != high) & (head | ~shared)
            other = np.where(u == low, high, low)
            s = c - shift
            yield batch_of(u[on], s[on], s[on] + least + SHINGLE - 1 + more[on], other[on], None, None, None)
        # texts that share one side too, or that others so connect: members of each kind of view are compared
        i, j = [], []
        for g in (side.view(np.uint64) >> np.uint64(32), side.view(np.uint64) & np.uint64(0xFFFFFFFF)):
            order = np.flatnonzero(g)
            order = order[np.lexsort((g[order], key[order]))]
            on = (key[order[1:]] == key[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
            i.append(order[1:][on])
            j.append(order[:-1][on])
        label = _union(len(key), np.concatenate(i), np.concatenate(j))
        order = np.lexsort((u, gr, gl, label))
        start = np.flatnonzero(np.r_[True, label[order[1:]] != label[order[:-1]]])
        size = np.diff(np.r_[start, len(order)])
        differ = np.minimum.reduceat(u[order], start) != np.maximum.reduceat(u[order], start)
        new = np.r_[True, np.any([x[order[1:]] != x[order[:-1]] for x in (label, gl, gr)], axis=0)]
        # a group of one kind is listed whole; else two texts of each kind stand for it
        differ &= np.add.reduceat(new.astype(np.int64), start) > 1
        on = np.repeat(differ, size) & stands[order]
        members = np.repeat(np.add.reduceat(on.astype(np.int64), start), size)[on]
        pick = order[on]
        first = label[pick]
        named = _mix(key[pick].view(np.uint64) + _mix(u[first].view(np.uint64) + c[first].astype(np.uint64)))
        yield batch_of(u[pick], lo[pick], hi[pick], members, named.view(np.int64), c[pick], more[pick])

    def run(batches):
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows < 200_000 or held[0][0][0] == held[-1][0][-1]:  # rows of one key are put together once
                continue
            whole = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))
            yield from groups(*(x[:cut] for x in whole))
            held, rows = [[x[cut:] for x in whole]], len(whole[0]) - cut
        if held:
            yield from groups(*(np.concatenate(c) for c in zip(*held)))

    return run


def _fetch(least: int):
    """(group, u, c, h, chunk, i, j, more): shingles around wanted roots, from least - 1 before to least - 1 after; 0 past the window's ends.

    h has the upper half of each hash: members of a group are few enough to be told apart by runs of those.
    A member of a group that is compared in chunks goes to the group of each pair that its chunk is in.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), None, pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                cols: list = [[] for _ in kinds]
                for u, n, t, wanted in zip(*(x.to_pylist() for x in part.columns)):
                    h = ((shingles(_unpacked(n, t))[0] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)).view(np.int32)
                    h = np.r_[np.zeros(least - 1, np.int32), h, np.zeros(least - 1, np.int32)]
                    for w in wanted:
                        n, c, around = w["chunks"], w["c"], h[w["c"] : w["c"] + 2 * least - 1].copy()
                        around[: least - 1 - w["lo"]] = 0
                        around[least + w["hi"] :] = 0
                        chunk = xxhash.xxh3_64_intdigest(f"{u}:{c}", 9) % n
                        for other in range(n):
                            i, j = min(chunk, other), max(chunk, other)
                            group = w["key"] if n == 1 else xxhash.xxh3_64_intdigest(f"{w['key']}:{i}:{j}") - (1 << 63)
                            for col, x in zip(cols, (group, u, c, around, chunk, i, j, w["more"])):
                                col.append(x)
                flat = pa.array(np.concatenate(cols[3]) if cols[3] else np.zeros(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cols[3])]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([lists if k is None else pa.array(c, k) for c, k in zip(cols, kinds)], ["group", "u", "c", "h", "chunk", "i", "j", "more"])

    return run


def _equal_runs(group: np.ndarray, u: np.ndarray, h: np.ndarray, least: int):
    """(row, first place, other row) for each run of `least` shingles that holds the shared one and that two texts of a group have at the same places."""
    n = len(u)
    up, down = _powers(h.shape[1] + 1)
    sums = np.zeros((n, h.shape[1] + 1), np.uint64)
    np.cumsum(_mix(h.astype(np.uint64)) * up[: h.shape[1]], axis=1, out=sums[:, 1:])
    view = _mix((sums[:, least:] - sums[:, :-least]) * down[:least])
    out = np.cumsum(np.c_[np.zeros(n, np.int64), h == 0], axis=1)
    whole = (out[:, least:] - out[:, :-least]) == 0
    row, first = np.nonzero(whole)
    key, who = view[row, first], u[row]
    order = np.lexsort((who, key, first, group[row]))
    row, first, key, who = row[order], first[order], key[order], who[order]
    if not len(row):
        return row, first, row
    g = group[row]
    start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (first[1:] != first[:-1]) | (key[1:] != key[:-1])])
    end = np.r_[start[1:], len(row)]
    lo, hi = np.repeat(row[start], end - start), np.repeat(row[end - 1], end - start)
    on = u[lo] != u[hi]
    other = np.where(u[row] == u[lo], hi, lo)
    return row[on], first[on], other[on]


def _union(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


@lru_cache(maxsize=None)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _before(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place of each row where its value last stood before, -1 for nowhere, and whether a row has any value twice."""
    last = np.full(h.shape, -1, np.int16)
    ranked = np.sort(h, axis=1)
    twice = ((ranked[:, 1:] == ranked[:, :-1]) & (ranked[:, 1:] != 0)).any(1)
    rows = np.flatnonzero(twice)
    if len(rows):
        order = np.argsort(h[rows], axis=1, kind="stable")
        ranked = np.take_along_axis(h[rows], order, 1)
        some = np.full((len(rows), h.shape[1]), -1, np.int16)
        np.put_along_axis(some, order[:, 1:], np.where(ranked[:, 1:] == ranked[:, :-1], order[:, :-1], -1).astype(np.int16), 1)
        last[rows] = some
    return last, twice


def _similar_views(a: np.ndarray, b: np.ndarray, first: np.ndarray, joins: np.ndarray, stays: np.ndarray, sizes: tuple, whole: tuple, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(view, pair) of the views of a that are similar to any view of b, and of those of b that are to any of a; each pair is a column.

    first, joins and stays tell of each place of a whether its value is new in the row, new in the view that ends with
    it, and also stands in the view that begins after it; sizes and whole are of both sides' views.
    """
    width, n = a.shape
    there, b = np.empty((width, least, n), bool), np.where(b == 0, 2, b)  # values are odd
    for x in range(width):
        same, size = b == a[x], 1
        while 2 * size <= least:
            same = same[:-size] | same[size:]
            size *= 2
        np.logical_or(same[:least], same[least - size : 2 * least - size], out=there[x])  # whether the value is in each view of b
    kind = np.uint8 if least < 256 else np.int32
    there, joins, leaves = there.view(np.uint8), joins.astype(np.uint8), (~stays).astype(np.uint8)
    needs = np.ceil(similarity / (1 + similarity) * np.arange(2 * least + 1) - 1e-3).astype(kind)
    plain = bool((sizes[0] == least).all() and (sizes[1] == least).all())
    masked = bool((stays[:least].any()) or not joins[least:].all())
    count = (there[:least] & first[:least, None].astype(np.uint8)).sum(axis=0, dtype=kind)
    out = np.zeros((least, n), bool), np.zeros((least, n), bool)
    for i in range(least):
        near = count >= (needs[2 * least] if plain else needs[sizes[1] + sizes[0][i]])
        if near.any():
            near &= whole[1] & whole[0][i]
            np.logical_or.reduce(near, axis=0, out=out[0][i])
            np.logical_or(out[1], near, out=out[1])
        if i + 1 < least:
            count += there[i + least] & joins[i + least] if masked else there[i + least]
            count -= there[i] & leaves[i] if masked else there[i]
    return out


def _may_be_similar(h: np.ndarray, first: np.ndarray, cols: np.ndarray, at: np.ndarray, bar: np.ndarray):
    """(column, row) where the values of a column, marks of places of the row `at` of h, and all of a row share `bar`[column, row] or more."""
    own = h[at]
    on = cols & (own != 0)
    values = np.unique(own[on])
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marks = np.zeros((len(values), len(at)), np.uint8)
    col, place = np.nonzero(on)
    marks[np.searchsorted(values, own[col, place]), col] = 1
    pos = np.minimum(np.searchsorted(values, h), len(values) - 1)
    hit = (values[pos] == h) & first
    out = []
    step = max(1, 400_000 // (len(at) + 1))
    for k in range(0, len(h), step):
        row, place = np.nonzero(hit[k : k + step])
        if not len(row):
            continue
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        count = np.add.reduceat(marks[pos[k + row, place]], start, axis=0, dtype=np.uint8)
        r, c = np.nonzero(count >= bar[:, k + row[start]].T - 1e-3)
        out.append((c, k + row[start][r]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class _Rare:
    """The values of a group's rows by rarity, and the rows that have each: two sets that share many values share one of the rarest of either."""

    def __init__(self, h: np.ndarray, first: np.ndarray):
        values, at = np.unique(h, return_inverse=True)
        at = at.reshape(h.shape)
        often = np.bincount(at[first], minlength=len(values))
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, often))] = np.arange(len(values))
        self.rank = rank[at]  # by place
        row, place = np.nonzero(first)
        by = self.rank[row, place]
        order = np.lexsort((row, by))
        self.rows, self.start = row[order], np.searchsorted(by[order], np.arange(len(values) + 1))
        self.first, self.none = first, len(values)

    def similar(self, cols: np.ndarray, at: np.ndarray, need: np.ndarray, size: np.ndarray, low: np.ndarray, bar: float, most: int):
        """(column, row) where the values of a column, marks of places of the row `at`, and all of a row share bar * (size + low) or more; None if over `most` rows would have to be looked at.

        need is the least that a column must share with any row.
        """
        found = self.candidates(cols, at, need, most)
        if found is None:
            return None
        col, row, own = *found, np.sort(np.where(cols, self.rank[at], self.none), axis=1)
        keep = []
        for k in range(0, len(col), 20_000):
            c, r = col[k : k + 20_000], row[k : k + 20_000]
            theirs = np.where(self.first[r], self.rank[r], -1)
            both = np.sort(np.c_[own[c], theirs], axis=1)
            shared = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0) & (both[:, 1:] < self.none)).sum(1)
            keep.append(shared >= bar * (size[c] + low[r]) - 1e-3)
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        return col[keep], row[keep]

    def candidates(self, cols: np.ndarray, at: np.ndarray, need: np.ndarray, most: int):
        """(column, row) of all rows that have one of a column's rarest values, all but need - 1 of them: one of these a column shares with each row that it shares `need` values with; None for over `most`."""
        own = np.sort(np.where(cols, self.rank[at], self.none), axis=1)
        prefix = np.clip(cols.sum(1) - np.ceil(need - 1e-3).astype(np.int64) + 1, 0, cols.sum(1))
        col, k = np.nonzero(np.arange(own.shape[1])[None, :] < prefix[:, None])
        value = own[col, k]
        n = self.start[value + 1] - self.start[value]
        if n.sum() > most:
            return None
        ends = np.cumsum(n)
        where = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.start[value], n)
        return np.divmod(np.unique(np.repeat(col, n) * len(self.first) + self.rows[where]), len(self.first))


class _Compared:
    """Rows of groups whose pairs are compared whole: which of their views are listed, and which rows are one."""

    def __init__(self, h, u, listed, label, apart, least, similarity):
        self.h, self.u, self.label, self.apart, self.least, self.similarity = h, u, label, apart, least, similarity
        self.last, twice = _before(h)
        self.first = (h != 0) & (self.last < 0)
        out = np.cumsum(np.c_[np.zeros(len(h), np.int64), h == 0], axis=1)
        self.whole = (out[:, least:] - out[:, :-least]) == 0
        self.listed = listed | ~self.whole
        starts, place = np.arange(least)[:, None], np.arange(h.shape[1])[None, :]
        self.inside, self.starts = (place >= starts) & (place < starts + least), starts.astype(np.int16)
        self.sizes = np.full((len(h), least), least, np.int16)
        for k in np.array_split(np.flatnonzero(twice), 1 + int(twice.sum()) // 1024):
            self.sizes[k] = self.fresh(k).sum(2)
        self.low, self.high = np.where(self.whole, self.sizes, least).min(1), np.where(self.whole, self.sizes, 0).max(1)
        self.bar = similarity / (1 + similarity)
        gap = np.arange(h.shape[1]) - self.last
        self.joins, self.stays = gap >= least, np.zeros(h.shape, bool)
        row, place = np.nonzero((self.last >= 0) & (gap < least))
        self.stays[row, self.last[row, place]] = True

    def fresh(self, rows):
        """Per view of each row, the places where a value stands for the first time in it."""
        return self.inside & (self.last[rows][:, None, :] < self.starts)

    def verify(self, i, j):
        """(row, first start, last start, other row) of runs of similar views that are news, for pairs of rows."""
        for k in range(0, len(i), 512):
            a, b = i[k : k + 512], j[k : k + 512]
            on = (self.label[a] != self.label[b]) | ~(self.listed[a].all(1) & self.listed[b].all(1))
            a, b = a[on], b[on]
            if not len(a):
                continue
            columns = [np.ascontiguousarray(x[a].T) for x in (self.h, self.first, self.joins, self.stays, self.sizes, self.whole)]
            other = [np.ascontiguousarray(x[b].T) for x in (self.h, self.sizes, self.whole)]
            views = _similar_views(columns[0], other[0], *columns[1:4], (columns[4], other[1]), (columns[5], other[2]), self.least, self.similarity)
            views = [np.ascontiguousarray(x.T) for x in views]
            hit = views[0].any(1)
            a, b, views = a[hit], b[hit], [v[hit] for v in views]
            if not len(a):
                continue
            link = self.label[a] != self.label[b]
            for x, y, view in ((a, b, views[0]), (b, a, views[1])):
                news = link | (view & ~self.listed[x]).any(1)
                x, y, view = x[news], y[news], view[news]
                if not len(x):
                    continue
                edge = np.diff(np.c_[np.zeros(len(x), np.int8), view.astype(np.int8), np.zeros(len(x), np.int8)], axis=1)
                (row, start), end = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
                yield x[row], start, end - 1, y[row]
                np.logical_or.at(self.listed, x, view)
            if link.any():
                rows, where = np.unique(self.label[np.r_[a, b]], return_inverse=True)
                low = rows[_union(len(rows), where[: len(a)], where[len(a) :])]
                at = np.minimum(np.searchsorted(rows, self.label), len(rows) - 1)
                self.label = np.where(rows[at] == self.label, low[at], self.label)

    def small(self, i, j):
        """All given pairs, of small groups."""
        # each row's nearest partner first, in all groups: what one lists or connects, the others need not
        order = np.argsort(j - i, kind="stable")
        i, j = i[order], j[order]
        for k in range(0, len(i), 2048):
            a, b = i[k : k + 2048], j[k : k + 2048]
            on = (self.label[a] != self.label[b]) | ~(self.listed[a].all(1) & self.listed[b].all(1))
            yield from self.verify(a[on], b[on])

    def large(self, begin, end):
        """All pairs of the rows begin..end of one large group: views not listed yet, and rows not connected yet, are held against every row.

        A view that is to be listed shares one of its rarest values with the row that it is similar to, so
        that a passage that all rows have asks for no comparison; where rare values do not tell rows apart
        they are compared row by row. Of rows that are connected already the most numerous need no search of
        partners: the others look for them.
        """
        h, first, low = self.h[begin:end], self.first[begin:end], self.low[begin:end]
        rare, at = _Rare(h, first), begin
        while at < end:
            stop, n = at, 0
            while stop < end and (n == 0 or n < 512) and stop - at < max(1, (at - begin) // 2):
                n += 1 + int((~self.listed[stop]).sum())
                stop += 1
            stop = max(stop, at + 1)
            labels, often = np.unique(self.label[begin:end], return_counts=True)
            alone = at + np.flatnonzero(self.label[at:stop] != labels[often.argmax()])
            row, view = np.nonzero(~self.listed[at:stop])
            own = np.r_[alone, at + row]
            cols = np.r_[self.first[alone], self.inside[view] & (self.last[at + row] < self.starts[view])] & (self.h[own] != 0)
            size = np.r_[self.low[alone], self.sizes[at + row, view]]
            most = np.r_[self.high[alone], self.sizes[at + row, view]]
            # a similar view has at least `similarity` times as many values, all of them shared
            need = np.maximum(self.bar * (size + low.min()), self.similarity * size)
            near = rare.candidates(cols, own - begin, need, max(100_000, len(h) * len(own) // 8))
            if near is None:
                near = _may_be_similar(h, first, cols, own - begin, self.bar * (size[:, None] + low[None, :]))
            col, other = near
            i, j = own[col], begin + other
            on = (self.u[i] != self.u[j]) & self.apart(i, j)
            # similar views do not differ much in size
            on &= (self.low[j] * self.similarity <= most[col] + 1e-3) & (size[col] * self.similarity <= self.high[j] + 1e-3)
            # a row as a whole counts for what it may connect, a view for what it may list
            on &= (col >= len(alone)) | (self.label[i] != self.label[j])
            pairs = np.unique(np.c_[i[on], j[on]], axis=0)
            # each row's next partner in turn: what one lists or connects, the others need not
            turn = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
            pairs = pairs[np.argsort(turn, kind="stable")]
            for k in range(0, len(pairs), 512):
                i, j = pairs[k : k + 512].T
                on = (self.label[i] != self.label[j]) | ~self.listed[i].all(1)
                yield from self.verify(i[on], j[on])
            at = stop


def _verify(least: int, similarity: float):
    """(u, s, e, other): verified spans of sorted groups; many small groups are told apart in one go."""

    def some(group, u, c, h, chunk, i, j, more):
        cross = i != j
        group = np.cumsum(np.r_[0, group[1:] != group[:-1]])
        row, first, other = _equal_runs(group, u, h, least)
        order = np.lexsort((first, other, row))
        row, first, other = row[order], first[order], other[order]
        if len(row):  # runs one place apart with one partner are one longer run
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (other[1:] != other[:-1]) | (first[1:] != first[:-1] + 1)])
            last = np.r_[new[1:], len(row)] - 1
            s = c[row[new]] - least + 1 + first[new]
            yield u[row[new]], s, c[row[last]] + first[last] + SHINGLE + more[row[last]], u[other[new]]
        label = _union(len(u), row, other)
        listed = np.zeros((len(u), least), bool)
        listed[row, first] = True
        # rows of several texts that are equal throughout are listed by now: two texts of them are enough for the others
        up, _ = _powers(h.shape[1] + 1)
        same = (_mix(h.astype(np.uint64)) * up[: h.shape[1]]).sum(axis=1, dtype=np.uint64)
        order = np.lexsort((u, same, chunk, group))
        ends = np.any([x[order[1:]] != x[order[:-1]] for x in (same, chunk, group)], axis=0)
        first, last = np.r_[True, ends], np.r_[ends, True]
        size = np.diff(np.r_[np.flatnonzero(first), len(order)])
        keep = np.sort(order[first | last | np.repeat(u[order[first]] == u[order[last]], size)])
        group, u, c, h, chunk, cross, listed, label, more = (x[keep] for x in (group, u, c, h, chunk, cross, listed, label, more))

        def apart(i, j):
            return ~(cross[i] & (chunk[i] == chunk[j]))

        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        end = np.r_[start[1:], len(u)]
        work = _Compared(h, u, listed, label, apart, least, similarity)
        left, right, wide = [], [], []
        for a, b in zip(start.tolist(), end.tolist()):
            if (u[a:b] == u[a]).all() or ((label[a:b] == label[a]).all() and work.listed[a:b].all()):
                continue
            if b - a > SMALL:
                wide.append((a, b))
                continue
            i, j = _pairs(b - a)
            left.append(a + i)
            right.append(a + j)
        steps = [work.large(a, b) for a, b in wide]
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            on = (u[i] != u[j]) & apart(i, j)
            steps.append(work.small(i[on], j[on]))
        for step in steps:
            for x, low, high, y in step:
                yield u[x], c[x] - least + 1 + low, c[x] + high + SHINGLE + more[x], u[y]

    def found(held: list):
        """What the groups in held give, about 4096 rows at a time."""
        start = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]])
        at = 0
        while at < len(held[0]):
            k = int(np.searchsorted(start, at + 4096))
            end = int(start[k]) if k < len(start) else len(held[0])
            for x in some(*(a[at:end] for a in held)):
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()) for y in x], ["u", "s", "e", "other"])
            at = end

    def run(batches):
        width, held = 2 * least - 1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            more = [x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if pa.types.is_list(x.type) else x.to_numpy(zero_copy_only=False) for x in batch.columns]
            held = more if held is None else [np.concatenate(x) for x in zip(held, more)]
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))
            if cut >= 4096:
                yield from found([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield from found(held)

    return run


def _packed(batches):
    """Texts (q, t, low, n) with their number of words and of bytes, compressed."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        cols = [[pa.compress(t, "zstd", asbytes=True) for t in texts], [len(t.split()) for t in texts], [len(t) for t in texts]]
        q, _, low, n = batch.columns
        yield pa.RecordBatch.from_arrays([q, pa.array(cols[0], pa.binary()), low, n, *(pa.array(x, pa.int64()) for x in cols[1:])], [*batch.schema.names, "words", "bytes"])


def _unpacked(n: int, t: bytes) -> bytes:
    return pa.decompress(t, n, "zstd", asbytes=True)


def _report(batches):
    """(q, words, n_passages, n_dup_words, passages) of texts (q, words, whole, spans)."""
    for batch in batches:
        out = []
        for q, words, whole, spans in zip(*(x.to_pylist() for x in batch.columns)):
            runs: list = [[0, words]] if whole else []
            for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            out.append((q, words, len(runs), sum(e - s for s, e in runs), ",".join(f"{s}:{e}" for s, e in runs)))
        cols, kinds = list(zip(*out)) or [()] * 5, [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["q", "words", "n_passages", "n_dup_words", "passages"])


def near_duplicate_passages(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Per document (doc_id, component_id, n_words, n_passages, n_dup_words, passages).

    passages lists maximal runs start:end of words, end exclusive, in passages of `words` words or more
    that another document has too, equal or with a similarity of `similarity` or more over five-word
    shingles; component_id is the smallest doc_id that such passages connect, itself included. Equal passages
    are all listed; similar ones where their texts share a min-hash. Equal texts are one text for all
    comparing; if one of `words` words or more comes twice, all of it counts. Null, empty and shorter texts
    have no passage. Repeated rows are copies. A null doc_id never names a component. Empty table: no rows.
    Other columns are ignored. Rows of a group that are equal throughout are compared once; groups over
    group_limit are dealt to tasks by pairs of chunks.
    """
    spark, least = docs.sparkSession, words - SHINGLE + 1
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    q = F.substring(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)), 1, 16).alias("q")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), q, F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("t"))
    # equal texts are one from here on, with an id of its own
    once = raw.groupBy("q").agg(F.first("t").alias("t"), F.min("doc_id").alias("low"), F.count("*").alias("n"))
    once = once.select("q", "t", "low", "n").mapInArrow(_packed, "q binary, t binary, low long, n long, words long, bytes long")
    texts = materialize(once.withColumn("u", F.monotonically_increasing_id()), "texts", reclaim=True)
    long = texts.where(F.col("words") >= words).select("u", "bytes", "t")
    windows = long.mapInArrow(_windows(least), "key long, u long, c long, lo long, hi long, gl long, gr long, side long, more long")
    joined = windows.repartition(parts, "key").sortWithinPartitions("key")
    found = materialize(joined.mapInArrow(_join(least), "u long, s long, e long, other long, key long, c long, more long"), "joined", reclaim=True)
    equal = found.where("key is null").select("u", "s", "e", "other")

    # every text of a group is compared, for its runs count even where others connect it already
    asked = found.where("key is not null").select("key", "u", "c", F.col("s").cast("int").alias("lo"), F.col("e").cast("int").alias("hi"), "more", F.col("other").alias("members"))
    chunks = F.when(F.col("members") > group_limit, F.ceil(F.col("members") * 4 / group_limit)).otherwise(1).cast("int").alias("chunks")
    wanted = asked.groupBy("u").agg(F.collect_set(F.struct("key", "c", "lo", "hi", "more", chunks)).alias("wanted"))
    around = long.join(wanted, "u").select("u", "bytes", "t", "wanted").mapInArrow(_fetch(least), "group long, u long, c long, h array<int>, chunk int, i int, j int, more int")
    near = around.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_verify(least, similarity), "u long, s long, e long, other long")

    spans = materialize(equal.unionByName(near), "passages", reclaim=True)
    comps = connected_components(spans.select(F.col("u").alias("a"), F.col("other").alias("b")))
    merged = spans.groupBy("u").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    named = texts.select("u", "q", "low", "n", "words").join(comps, F.col("u") == comps["node"], "left").withColumn("comp", F.coalesce("component", "u"))
    least_doc = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    told = named.join(merged, "u", "left").select("q", "words", ((F.col("n") > 1) & (F.col("words") >= words)).alias("whole"), "spans")
    told = told.mapInArrow(_report, "q binary, words long, n_passages long, n_dup_words long, passages string")
    info = named.join(least_doc, "comp").select("q", "component_id").join(told, "q")
    # texts too short for a passage stay alone even if they are equal
    component = F.when(F.col("words") >= words, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return raw.select("doc_id", "q").join(info, "q").select("doc_id", component, F.col("words").alias("n_words"), "n_passages", "n_dup_words", "passages")
