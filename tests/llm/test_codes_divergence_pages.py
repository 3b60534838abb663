"""Vector codes, divergence of sources and main text of pages against brute force and planted pages."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import common, divergence, html_extract, packing, passage_dedup, queries, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, part int"


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """The contract in Python integers: rows are (vec_id, embedding, label) of one dimension."""
    kept = [(i, [math.floor(4096 * x) for x in e], g) for i, e, g in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return [], ""
    size = len(kept[0][1]) // parts
    cut = lambda e: [tuple(e[p * size : (p + 1) * size]) for p in range(parts)]
    first = [cut(e) for _, e, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books = [[f[p] for f in first] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x, book: min((far(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, e, _ in kept:
                groups[near(cut(e)[p], books[p])[1]].append(cut(e)[p])
            for k, xs in groups.items():
                books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out, total = [], Counter()
    for i, e, g in kept:
        found = [near(x, b) for x, b in zip(cut(e), books)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), g))
        total[g] += out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((repr(i), code, error, total[g]) for i, code, error, g in out), sha


def coded(df):
    rows = df.collect()
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in rows), {r["codebooks_sha256"] for r in rows}


def vector_rows(n, seed, dim=16):
    rng = random.Random(seed)
    some = [[rng.choice([-0.5, 0.0, 0.25, 1.0]) if rng.random() < 0.3 else float(np.float32(rng.gauss(0, 1))) for _ in range(dim)] for _ in range(n)]
    return [(k, v, rng.choice([None, 0, 0, 0, 1]), "x", 3) for k, v in enumerate(some)]


def test_codes_equal_brute_force(spark):
    rows = vector_rows(300, 1) + [(7, [0.5] * 16, 1, "x", 3)] * 3 + [(None, [0.25] * 16, None, "x", 3)]
    odd = [(900, None, 1, "x", 3), (901, [None] + [0.0] * 15, 1, "x", 3), (-5, [float("nan")] * 16, 1, "x", 3), (-6, [float("inf")] * 16, 0, "x", 3)]
    found, sha = coded(vector_codes.compress(spark.createDataFrame(rows + odd, VECTORS).repartition(5)))
    expected, expected_sha = brute_codes([r[:3] for r in rows])
    assert found == expected
    assert sha == {expected_sha}


@pytest.mark.parametrize("rows", [vector_rows(5, 2), [(3, [0.5] * 16, None, "x", 3)] * 40, [(k, [40000.0 * k, -3e9] + [0.5] * 14, 1, "x", 3) for k in range(30)]])
def test_codes_of_few_equal_and_large_vectors(spark, rows):
    found, sha = coded(vector_codes.compress(spark.createDataFrame(rows, VECTORS)))
    expected, expected_sha = brute_codes([r[:3] for r in rows])
    assert [(i, c) for i, c, _, _ in found] == [(i, c) for i, c, _, _ in expected]
    assert [e if e is not None else "over" for _, _, e, _ in found] == [e if e < 1 << 63 else "over" for _, _, e, _ in expected]
    assert sha == {expected_sha}


def test_codes_of_odd_tables(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1, "x", 3)], VECTORS)).collect() == []
    rows = [(1, [1.0] * 10, 1, "x", 3), (2, [2.0] * 9, 1, "x", 3), (3, [], None, "x", 3), (4, [0.5] * 10, 1, "x", 3)]
    found = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in vector_codes.compress(spark.createDataFrame(rows, VECTORS)).collect()}
    assert found == {1: ("00" * 8, 0, 0), 4: ("01" * 8, 0, 0), 2: (None, None, 0), 3: (None, None, None)}


def test_equal_average_search_skips_and_is_exact():
    rng = np.random.default_rng(4)
    entries = rng.integers(-5000, 5000, (16, 8))
    entries[5] = entries[9]
    x = np.concatenate([rng.integers(-6000, 6000, (2000, 8)), entries, entries + 1])
    index, far, compared = vector_codes.nearest(x, entries)
    every = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (far == every.min(1)).all()
    assert compared < every.size
    apart = 3000 * np.arange(16)[:, None] + rng.integers(-500, 500, (16, 8))
    assert vector_codes.nearest(np.repeat(apart, 100, 0) + 5, apart)[2] < 0.3 * 1600 * 16
    big, own, _ = vector_codes.nearest(x.astype(object) * (1 << 40), entries.astype(object) * (1 << 40))
    assert (big == index).all() and all(a == int(b) << 80 for a, b in zip(own, far))


def test_small_join_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    large = spark.range(1000).select("id", (F.col("id") % 5).alias("k"))
    small = spark.range(5).select(F.col("id").alias("own"), (F.col("id") * 10).alias("v"))
    out = common.small_join(large, small, lambda a, b: a["k"] == b["own"], "id").select("id", "v").collect()
    assert sorted((r["id"], r["v"]) for r in out) == [(k, k % 5 * 10) for k in range(1000)]


def brute_audit(docs, least=10, top=10):
    counts, df, groups = Counter(), Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts.update((lang, source, t) for t in found)
        df.update({(lang, t) for t in found})
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= least]
        own = sorted(s for x, s in groups if x == lang)
        share = lambda n, total: 1 + 10**9 * (n + 2) // (total + 2 * len(kept))
        whole = {t: sum(counts[lang, s, t] for s in own) for t in kept}
        q = {t: share(n, sum(whole.values())) for t, n in whole.items()}
        p = {s: {t: share(counts[lang, s, t], sum(counts[lang, s, u] for u in kept)) for t in kept} for s in own}
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted(((sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((apart(p[s][t], q[t]), t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, kind, item, v, k) for kind, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def audited(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgÉéß中") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    docs = [(" ".join(rng.choice([w, w.upper(), w + ",", w + "_1"]) for w in rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "de"]), f"s{rng.choice([0, 0, 0, rng.randint(0, 70)])}") for _ in range(900)]
    docs += [docs[0]] * 15 + [(None, None, None), ("", "en", None), ("alone", "xx", "s1"), (None, "yy", "a"), ("x " * 50_000, "yy", "b"), ("w" * 100_000, "yy", "c")]
    return docs


@pytest.mark.parametrize("bits", [64, 4])
def test_audit_equals_brute_force(spark, audited, bits):
    df = spark.createDataFrame([(*d, 1, "x", 0.5) for d in audited], "text string, lang string, source string, h long, term string, value double").repartition(7)
    found = divergence.audit(df, bits=bits)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == brute_audit(audited)


def test_audit_of_ties_and_an_empty_table(spark):
    docs = [("a b c d e f g h i j k l m n", "en", s) for s in "pq" for _ in range(10)] + [("a", "en", "r")]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == brute_audit(docs)
    assert divergence.audit(df.limit(0)).collect() == []


def test_large_counts_are_exact(spark):
    rows = [(3 * 10**14, 9 * 10**15, 7), (0, 5, 1), (1 << 33, 1 << 40, 1 << 20)]
    df = spark.createDataFrame(rows, "n long, total long, kept long")
    found = [r[0] for r in df.select(divergence._share(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert sorted(found) == sorted(1 + 10**9 * (n + 2) // (t + 2 * k) for n, t, k in rows)


PAGES = "page_id long, url string, html string, text string, n_chars long"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t='</p>';</script>{head}</head><body>{body}</body></html>"


LONG = "The committee met on Tuesday and agreed that the bridge, which was closed in March, will open again before the end of the year. Work on the second lane goes on."
MENU = "<nav><ul>" + "".join(f'<li><a href="/{k}">Topic {k}</a></li>' for k in range(6)) + "</ul></nav>"
PLANTED = {
    "article": (MENU + f"<div class='ad'>Buy now and save a lot of money today.</div><article><h1>A title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></article><footer>&copy; us &middot; {LONG}</footer>", f"A title\n\n{LONG}\n\nShort.\n\n{LONG}"),
    "unclosed": (f"<article><h1>A title<p><b>{LONG}<br><p>Two &amp; three &lt;b&gt;<p>  End\n\tof it.</article><footer>About", f"A title\n\n{LONG}\n\nTwo & three <b>\n\nEnd of it."),
    "plain divisions": (f"<div id='top'><a href='/'>Home</a> <a href='/n'>News</a> <a href='/s'>Sport</a></div><div><h1>A title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class='site-footer'>Copyright 2020 Us. All rights reserved.</div>", f"A title\n\n{LONG}\n\n{LONG}\n\n{LONG}"),
    "comments": (f"<main><h1>A title</h1><p>{LONG}</p><section id='comments'><h2>Two comments</h2><div class='comment'><p>{LONG}</p></div><article class='comment'><p>I agree with all of this, it was time.</p></article></section></main>", f"A title\n\n{LONG}"),
    "side matter": (
        f"<header><h2>The Site</h2><p>{LONG}</p></header><div class='cookie-notice'>We use cookies to make this better. <button>OK</button></div><div class='content'><article><header><h1>A title</h1></header><p>{LONG}</p>"
        f"<aside><p>{LONG}</p></aside><form><label>Your mail</label><input><p>Write to us.</p></form><p>{LONG}</p><div class='advert'><p>{LONG}</p></div><p>End.</p></article></div><div id='sidebar'><h3>More</h3><p>{LONG}</p></div>",
        f"A title\n\n{LONG}\n\n{LONG}\n\nEnd.",
    ),
    "hidden": (f"<article><p>{LONG}</p><p style='display: none'>Not seen.</p><noscript>Turn it on.</noscript><template><p>No.</p></template><p>&#72;i&nbsp;there &eacute;</p><!-- <p>not this</p> --></article>", f"{LONG}\n\nHi there é"),
    "inline": (f"<article><p>One <em>two</em><strong>three</strong> <a href='x'>four</a>, a < b &&amp; c<br/>five {LONG}</p></article>", f"One twothree four, a < b && c five {LONG}"),
}


@pytest.mark.parametrize("name", PLANTED)
@pytest.mark.parametrize("trained", [False, True])
def test_planted_pages(spark, name, trained):
    weights = html_extract.PRIOR
    if trained:
        weights = html_extract.train(spark.createDataFrame([(k, "u", page(b), "x", 1) for k, (b, _) in enumerate(PLANTED.values())], PAGES))
    body, expected = PLANTED[name]
    assert html_extract.main_text(page(body), weights) == expected


def test_extract_odd_rows(spark):
    rows = [(1, "u", None, "x", 1), (2, None, "", "x", 1), (None, "u", "<p>", "x", 1), (3, "u", page(PLANTED["article"][0]), "x", 1), (3, "u", page(PLANTED["article"][0]), "x", 1)]
    rows += [(4, "u", "<a href=\"x" + "<p>" * 1000, "x", 1), (5, "u", "<article>" + f"<p>{LONG}</p>" * 3000 + "</article>", "x", 1), (6, "u", "<div>" * 5000 + LONG, "x", 1), (7, "u", "<" * 20000 + "&" * 20000, "x", 1), (8, "u", MENU * 400, "x", 1), (9, "u", "<div>" * 30_000 + "</section>" * 30_000 + "<b>" * 30_000 + "<p>x" * 10, "x", 1)]
    found = html_extract.extract(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    by_id = {r["page_id"]: r for r in found}
    assert len(found) == len(rows) and found[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    assert by_id[1]["text"] == by_id[2]["text"] == by_id[None]["text"] == by_id[8]["text"] == ""
    assert by_id[3]["text"] == PLANTED["article"][1]
    assert by_id[5]["text"] == "\n\n".join([LONG] * 3000)
    assert by_id[6]["text"] == LONG
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_extract.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_labels_cost_the_least():
    rng = random.Random(8)
    for _ in range(60):
        pieces = [rng.choice(["<p>Short</p>", f"<p>{LONG}</p>", "<li><a href=x>Link</a></li>", "<h2>Head</h2>", "<div>", "</div>", "<nav>", "</nav>", "<article>", "</article>"]) for _ in range(14)]
        parsed = html_extract.Page("".join(pieces))
        n = len(parsed.blocks)
        if not 1 <= n <= 8:
            continue
        content, value = html_extract.label(parsed, html_extract.PRIOR)
        own, edges = html_extract.costs(parsed.blocks, html_extract.PRIOR), html_extract.smoothness(parsed)
        nodes = sorted({x for e in edges for x in e[:2]} | set(range(n)))

        def cost(side):
            return sum(max(0, c) if not side[k] else max(0, -c) for k, c in enumerate(own)) + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost(dict(zip(nodes, s))) for s in itertools.product([False, True], repeat=len(nodes))) if len(nodes) <= 14 else value
        rest = [x for x in nodes if x >= n]
        mine = min(cost(dict(enumerate(content)) | dict(zip(rest, s))) for s in itertools.product([False, True], repeat=len(rest))) if len(rest) <= 12 else value
        assert value == best == mine


def test_flow_equals_the_least_cut():
    rng = random.Random(9)
    for _ in range(40):
        n = rng.randint(3, 7)
        net, edges = html_extract.Network(n), []
        for _ in range(rng.randint(2, 12)):
            a, b = rng.sample(range(n), 2)
            edges.append((a, b, rng.randint(0, 9), rng.randint(0, 9)))
            net.join(*edges[-1])
        cuts = [sum(f * (a in s and b not in s) + g * (b in s and a not in s) for a, b, f, g in edges) for r in range(n - 1) for s in ({0, *x} for x in itertools.combinations(range(1, n - 1), r))]
        assert net.flow(0, n - 1)[0] == min(cuts)


def test_many_equal_rows_are_packed_in_many_buckets(spark, monkeypatch):
    rows = [(None, None)] * 3000 + [(7, "the same words in each of these rows " * 20)] * 2000 + [(k, f"row {k}") for k in range(1000, 1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = []

    def watched(cut, window):
        seen.append(cut)
        return plain(cut, window, rows_per_bucket=200)

    plain = packing.pack
    monkeypatch.setattr(packing, "pack", watched)
    out = packing.pack_documents(docs, queries.tokenizer()).collect()
    tokens = [sum(r["length"] for r in out if r["doc_id"] == k) for k in (None, 7)]
    assert len(out) == 5500 and tokens[0] == 3000 and tokens[1] % 2000 == 0
    by_sequence = defaultdict(list)
    for r in out:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 4096
    buckets = seen[0].groupBy(F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt", F.lit(1)), F.lit(28)).alias("b")).count().collect()
    assert max(r["count"] for r in buckets) < 600


@pytest.mark.parametrize("seed", range(6))
def test_rare_values_find_the_rows_that_all_values_find(seed):
    rng = np.random.default_rng(seed)
    h = rng.integers(1, 8 if seed % 2 else 60, (40, 19)).astype(np.int32)
    h[rng.random(h.shape) < 0.1] = 0
    h[5:12, 3:16] = h[4, 3:16]
    last, _ = passage_dedup._before(h)
    first = (h != 0) & (last < 0)
    at = rng.integers(0, 40, 30)
    cols = (rng.random((30, 19)) < 0.7) & (h[at] != 0)
    for k in range(30):  # a column marks each of its values once
        seen = set()
        for p in np.flatnonzero(cols[k]):
            cols[k, p] = h[at[k], p] not in seen
            seen.add(h[at[k], p])
    size, low, bar = cols.sum(1), rng.integers(3, 8, 40), 0.8 / 1.8
    found = passage_dedup._Rare(h, first).similar(cols, at, bar * (size + low.min()), size, low, bar, 1 << 40)
    plain = passage_dedup._may_be_similar(h, first, cols, at, bar * (size[:, None] + low[None, :]))
    sets = [set(v[c].tolist()) for v, c in zip(h[at], cols)]
    brute = {(k, r) for k in range(30) for r in range(40) if len(sets[k] & set(h[r][h[r] != 0].tolist())) >= bar * (size[k] + low[r]) - 1e-3}
    assert set(zip(*(x.tolist() for x in found))) == brute == set(zip(*(x.tolist() for x in plain))) | {(k, r) for k, r in brute if not sets[k] & set(h[r].tolist())}
    assert passage_dedup._Rare(h, first).similar(cols, at, bar * (size + low.min()), size, low, bar, 1) is None


def test_texts_that_share_one_passage_are_hardly_compared():
    rng = np.random.default_rng(7)
    n, least = 3000, passage_dedup.WORDS - passage_dedup.SHINGLE + 1
    h = rng.integers(1, 1 << 31, (n, 2 * least - 1)).astype(np.int32)
    h[:, 25:80] = h[0, 25:80]
    first = np.ones(h.shape, bool)
    views = np.zeros((n, h.shape[1]), bool)
    views[:, 15 : 15 + least] = True  # ten places before the passage, so that no other row has enough of them
    size = np.full(n, least)
    col, row = passage_dedup._Rare(h, first).similar(views, np.arange(n), 0.8 / 1.8 * 2 * size, size, size, 0.8 / 1.8, 10 * n)
    assert (col == row).all() and len(col) == n
