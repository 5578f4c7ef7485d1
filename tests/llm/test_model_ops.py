"""Extraction, embeddings, MinHash, toxicity, LM scores, shards and components on small fixtures."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomline.llm import common, embed, extract, lm, minhash, shards, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, digest string"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "x", "y", 1, "k", "i", "d") for i, t in enumerate(texts)], SCHEMA)


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    df = spark.createDataFrame([*edges, (None, 3), (5, 5)], "src long, dst long")
    got = {r.node: r.component for r in common.connected_components(df).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    want = roots({x for e in edges for x in e}, edges)
    assert got == want
    assert common.connected_components(df.limit(0)).count() == 0


def page(article, extra=""):
    return f"""<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{{}}</style></head><body>
    <nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now</div>
    <article>{article}</article>{extra}<footer>&copy; site</footer></body></html>"""


@pytest.fixture(scope="module")
def net():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    para = lambda: " ".join(word() for _ in range(rng.randint(3, 60))).capitalize() + "."
    pages = []
    for _ in range(200):
        extra = rng.choice(["", f'<section class="comments"><p>{para()}</p></section>', f"<aside><p>{para()}</p></aside>", f"<form><p>{para()}</p></form>"])
        pages.append(page(f"<h1>{para()}</h1>" + "".join(f"<p>{para()}</p>" for _ in range(rng.randint(1, 8))), extra))
    return extract.fit(pages)


def test_extraction_of_blocks(spark, net):
    html = page(
        "<h1>A &amp; B</h1><p><b>One<br>two  three</b><p>caf&eacute; &lt;x&gt;&nbsp;y</p><script>no()</script><!-- no --><p>last",
        '<section class="comments"><p>first! great read.</p></section><aside><p>See also.</p></aside>',
    )
    rows = spark.createDataFrame([(1, "u", html, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, "u", "<nav>x</nav>", "x"), (1, "u", html, "x")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in extract.extract(rows, net).orderBy("page_id").collect()]
    want = "A & B\nOne two three\ncafé <x> y\nlast"
    assert got == [(1, want), (1, want), (2, ""), (3, ""), (4, "")]
    assert extract.digest(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    "change",
    [
        lambda h, c: h.replace("</article>", f'</article><section class="comments"><p>{c}</p><p>{c}</p></section>'),
        lambda h, c: h.replace("</article>", f'<div class="comments"><div class="comment"><p>{c}</p></div></div></article>'),
        lambda h, c: h.replace("<article>", f'<header><h2>{c}</h2></header><aside class="sidebar"><p>{c}</p></aside><article>'),
        lambda h, c: h.replace("<article>", "<main><div class='post'>").replace("</article>", f"</div></main><form><label>{c}</label><button>Send</button></form>"),
        lambda h, c: h.replace("<article>", f'<div class="notice">{c}</div><article>').replace("</article>", f'<div class="share-buttons"><a>{c}</a></div></article><div id="cookie-banner"><p>{c}</p></div>'),
        lambda h, c: h.replace("<article>", "<article><header>").replace("</h1>", "</h1></header>"),
    ],
)
def test_extraction_of_varied_layouts(net, change):
    words = "some plain sentence about a thing that goes on for a while."
    html = page(f"<h1>Heading of it</h1><p>First {words}</p><p>Second {words}</p><p>Third {words}</p>")
    _, blocks, q = next(iter(extract.label_pages(net, [change(html, f"Other {words}")], extract.Features())))
    assert extract.main_text(blocks, q) == f"Heading of it\nFirst {words}\nSecond {words}\nThird {words}"


WORDS = "some plain sentence about a thing that goes on for a while."
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = "<footer><p>© 2024 The site. All rights reserved.</p></footer>"


@pytest.mark.parametrize(
    "html, want",
    [
        (f"{MENU}<article><h1>Head of it</h1><p>Intro {WORDS}</p><ul><li>First {WORDS}</li><li>Second {WORDS}</li></ul><p>End {WORDS}</p></article>{FOOT}", f"Head of it\nIntro {WORDS}\nFirst {WORDS}\nSecond {WORDS}\nEnd {WORDS}"),
        (f"{MENU}<article><h1>Head of it</h1><p>Intro {WORDS}</p><ol><li>First</li><li>Second</li></ol><p>End {WORDS}</p></article>{FOOT}", f"Head of it\nIntro {WORDS}\nFirst\nSecond\nEnd {WORDS}"),
        (f"<body class='with-sidebar'><div class='content'><h1>Head of it</h1><p>One {WORDS}</p><p>Two {WORDS}</p></div>", f"Head of it\nOne {WORDS}\nTwo {WORDS}"),
    ],
)
def test_extraction_of_lists_and_framed_pages(net, html, want):
    _, blocks, q = next(iter(extract.label_pages(net, [html], extract.Features())))
    assert extract.main_text(blocks, q) == want


def test_sample_is_bounded_by_size(spark, monkeypatch):
    pages = [(i, page(f"<h1>Head</h1><p>Text number {i} goes on.</p>" + "<p>More of it.</p>" * (200 * i))) for i in range(4)]
    rows = spark.createDataFrame(pages, "page_id long, html string")
    monkeypatch.setattr(extract, "SAMPLE_CHARS", 10)
    net = extract.train(rows)  # the shortest alone
    assert extract.train(rows.where("page_id = 0")).p["o"].tolist() == net.p["o"].tolist()
    monkeypatch.setattr(extract, "SAMPLE_BLOCKS", 0)
    assert len(extract._windows([(None, "x", True)] * 1000, 240, np.random.default_rng(1))) == 240


@pytest.mark.parametrize("tag", ["<svg width='1'/>", "<math/>", "<svg><title/><path d='M0'/></svg>", "<svg><path>", "<math><mi>", "<video src='v'>", "<audio>", "<canvas>", "<object data='o'>", "<select>", "<noscript></noscript>"])
def test_extraction_behind_embedded_elements(net, tag):
    words = "some plain sentence about a thing that goes on for a while."
    html = page(f"<h1>Heading of it</h1><p>First {words}</p>{tag}<p>Second {words}</p><p>Third {words}</p>")
    _, blocks, q = next(iter(extract.label_pages(net, [html], extract.Features())))
    got = extract.main_text(blocks, q).replace("Fig\n", "")
    assert got == f"Heading of it\nFirst {words}\nSecond {words}\nThird {words}"


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>so <math><mi>y</mi><mo>=</mo><mn>2</mn></math> holds</p>", [("p", "so y=2 holds")]),
        ("<p>a<svg><title>t</title><text>fig</text></svg>b</p>", [("p", "a"), ("svg", "fig"), ("p", "b")]),
        ("<p>a<object>in<object>side</object></object>b</p>", [("p", "a"), ("object", "in"), ("object", "side"), ("p", "b")]),
        ("<p>a <video></video> b</p><noscript>c</noscript>", [("p", "a b"), ("noscript", "c")]),
        ("<svg><foreignObject><p>a</p></foreignObject></svg><p>b", [("p", "a"), ("p", "b")]),
        ("<svg><g><text>a<div>b</div>", [("text", "a"), ("div", "b")]),
        ("<select><option>a<option>b</select>c<template><p>d</p></template>", [("option", "a"), ("option", "b"), (None, "c"), ("p", "d")]),
        ("<p>a</p><script>b", [("p", "a")]),
    ],
)
def test_blocks_of_embedded_elements(html, want):
    assert [(p.element.tag if p.element else None, t) for p, t in extract.blocks_of(html)] == want


def test_blocks_of_deep_pages():
    import time

    began = time.time()
    assert len(extract.Features().vectors(extract.blocks_of("<div>a" * 30_000))) == 30_000
    assert len(extract.blocks_of("<div>" * 20_000 + "x</b>" * 20_000)) == 1
    assert time.time() - began < 20


def test_extraction_of_a_long_page(net):
    html = page("".join(f"<p>Paragraph number {i} says something plain.</p>" for i in range(3000)))
    _, blocks, q = next(iter(extract.label_pages(net, [html], extract.Features())))
    assert extract.main_text(blocks, q).count("\n") == 2999


def test_lstm_gradients():
    net = extract.BiLstm(3, 2)
    rng = np.random.default_rng(0)
    x, mask = rng.normal(size=(4, 2, 3)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)
    y = (rng.random((4, 2)) > 0.5).astype(float)

    def loss():
        q = net.forward(x, mask)[0]
        return -(mask * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum() / mask.sum()

    for k, g in net.gradients(x, mask, y).items():
        at = tuple(0 for _ in g.shape)
        net.p[k][at] += 1e-5
        up = loss()
        net.p[k][at] -= 2e-5
        down = loss()
        net.p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6, k


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows = [base[i % 60] + rng.normal(size=16) * rng.choice([0.02, 0.05, 0.1]) for i in range(300)]
    rows = [r.astype(np.float32).tolist() for r in rows] + [rows[0].astype(np.float32).tolist()] * 5
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, float("inf")] + [0.0] * 14]
    data = [(i, v, 1, "x") for i, v in enumerate(rows + bad)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, rep string")
    u = np.array(rows)
    u /= np.linalg.norm(u, axis=1)[:, None]
    i, j = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    want = roots(range(len(data)), zip(i.tolist(), j.tolist(), strict=True))
    n = Counter([*i.tolist(), *j.tolist()])
    # sixteen dimensions: with four standard deviations the margin is the whole distance
    for block in (2048, 16):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embed.classes(df, block_rows=block, probe_sigmas=4).collect()}
        assert got == {k: (n[k], want[k]) for k in want}
    found = sum(r.n_links for r in embed.classes(df).collect())
    assert found >= 0.98 * sum(n.values())
    assert embed.digest(df.limit(0)).count() == 0


def test_embeddings_of_several_lengths(spark):
    rng = np.random.default_rng(7)
    rows = []
    for dims, n in ((16, 60), (3, 20), (24, 2), (5, 1)):
        base = rng.normal(size=(n, dims))
        rows += [v.astype(np.float32).tolist() for v in (*base, *(base[: n // 2] + rng.normal(size=(n // 2, dims)) * 0.05), base[0])]
    u = [np.array(r) / np.linalg.norm(r) for r in rows]
    pairs = [(i, j) for i in range(len(u)) for j in range(i) if len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.95]
    want, n = roots(range(len(u)), pairs), Counter(x for p in pairs for x in p)
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.classes(df).collect()}
    assert got == {k: (n[k], want[k]) for k in want}


def test_embeddings_keep_double_precision(spark):
    # alike as floats, at 0.95 only as doubles
    b = math.sqrt(1 - 0.95**2)
    rows = [[1.0, 0.0], [0.95 + 1e-12, b], [0.95 - 1e-9, b]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    u = np.array(rows) / np.linalg.norm(np.array(rows), axis=1)[:, None]
    want = ((u @ u.T >= 0.95).sum(1) - 1).tolist()
    assert [r.n_links for r in embed.classes(df).orderBy("vec_id").collect()] == want


def test_embeddings_of_any_size_and_repeated_ids(spark):
    large = [(1, [1.0, 0.0, 0.0]), (2, [1e200, 0.0, 0.0]), (3, [2e200, 1e190, 0.0]), (4, [1e-200, 0.0, 0.0]), (5, [5e-324, 0.0, 0.0]), (6, [0.0, 1.7e308, 0.0])]
    got = {r[0]: tuple(r[1:]) for r in embed.classes(spark.createDataFrame(large, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (4, 1) for i in range(1, 6)} | {6: (0, 6)}
    shared = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (9, [0.0, -1.0]), (9, [0.0, -3.0])]
    got = sorted(map(tuple, embed.classes(spark.createDataFrame(shared, "vec_id long, embedding array<double>")).collect()))
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (9, 1, 9), (9, 1, 9)]


def test_embeddings_of_low_rank_lose_no_link(spark):
    rng = np.random.default_rng(5)
    low = rng.normal(size=(1500, 8))
    low = low / np.linalg.norm(low, axis=1)[:, None]
    near = low[:500] + rng.normal(size=(500, 8)) * 0.1
    u = (np.concatenate([low, near]) @ np.linalg.qr(rng.normal(size=(256, 8)))[0].T).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)] + [(9000 + i, u[i].tolist()) for i in range(100)], "vec_id long, embedding array<float>")
    v = np.concatenate([u, u[:100]]).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = (v @ v.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embed.classes(df).collect()}
    assert [got[i] for i in [*range(2000), *range(9000, 9100)]] == want.tolist()


def test_probability_jaccard_estimate():
    rng = np.random.default_rng(2)
    e = minhash._mix(np.arange(1, 121, dtype=np.uint64))
    a, b = e[:100], e[20:]
    x, y = rng.integers(1, 6, 100).astype(float), rng.integers(1, 6, 100).astype(float)
    sa, sb = np.argsort(a), np.argsort(b)
    exact = minhash.probability_jaccard(a[sa], x[sa], b[sb], y[sb])
    w = minhash.prob_minhash(np.repeat([0, 1], 100), np.concatenate([a, b]), np.concatenate([x, y]), 2, 20_000)
    assert abs((w[0] == w[1]).mean() - exact) < 0.02
    u, v = np.zeros(120), np.zeros(120)
    u[:100], v[20:] = x, y
    slow = sum(1 / np.maximum(u / u[i], v / v[i]).sum() for i in range(20, 100))
    assert abs(slow - exact) < 1e-9
    one = np.ones(100)
    assert minhash.probability_jaccard(a[sa], one, b[sb], one) == 80 / 120


def test_minhash_matches_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [None, "", "!!", "one two", "one two", "One, two!", "three", "r s t u v " * 50, "r s t u v " * 5]
    for _ in range(12):
        origin = [word() for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(origin))
        for _ in range(rng.randint(0, 8)):
            copy = list(origin)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    shingler = minhash.Shingler()
    found = [shingler((t or "").encode()) for t in texts]
    pairs = []
    for i, (a, x, d) in enumerate(found):
        for j, (b, y, _) in enumerate(found[:i]):
            if d and len(b) and minhash.probability_jaccard(a, x.astype(float), b, y.astype(float)) >= 0.8:
                pairs.append((i, j))
    want = roots(range(len(texts)), pairs)
    rows = docs(spark, texts)
    got = {r.doc_id: r.class_id for r in minhash.digest(rows).collect()}
    assert got == want
    kept = minhash.drop_near_copies(rows.unionByName(rows))
    # rows without words stay, repeated ones too
    bare = [i for i, t in enumerate(texts) if not found[i][2]]
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*{*want.values()} - {*bare}, *bare, *bare])
    assert kept.columns == rows.columns
    assert minhash.digest(rows.limit(0)).count() == 0


def test_minhash_of_ids_with_several_texts(spark):
    rng = random.Random(4)
    some = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(60)) for _ in range(4)]
    rows = [(1, some[0]), (1, some[1]), (2, some[0]), (3, some[1]), (1, some[2]), (4, some[3]), (4, some[3]), (None, some[0]), (None, some[0])]
    table = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = sorted((r.doc_id or 0, r.text) for r in minhash.drop_near_copies(table).collect())
    assert kept == sorted([(0, some[0]), (0, some[0]), (1, some[0]), (1, some[1]), (1, some[2]), (4, some[3])])
    assert {(r.doc_id, r.class_id) for r in minhash.classes(table).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)}


def test_minhash_across_blocks(spark, monkeypatch):
    """A bucket of several blocks, of one large class and outsiders alike to some of its members only."""
    shape = "key long, rep long, comp long, n long"
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    texts, sets = [], []
    for i in range(700):
        own = base.copy()
        own[: i * 7 % 16] = rng.integers(0, 2**63, i * 7 % 16, dtype=np.uint64)
        own.sort()
        sets.append(own)
        texts.append((i, bytes(minhash.REGISTERS), own.tobytes(), None))
    big = [0 if i < 600 else i for i in range(700)]
    open_ = spark.createDataFrame([(7, i, big[i], 700) for i in range(700)], shape)
    held = spark.createDataFrame(texts, "rep long, sketch binary, shingles binary, counts binary")
    comps = spark.createDataFrame([(i, big[i]) for i in range(600)], "node long, component long")
    got = {tuple(r) for r in minhash._block_pairs(open_, held, comps, 0.8, True).collect()}
    alike = lambda a, b: minhash.probability_jaccard(sets[a], np.ones(100), sets[b], np.ones(100)) >= 0.8
    assert got and all(alike(a, b) and big[a] != big[b] for a, b in got)
    want = roots(range(700), [(a, b) for a in range(700) for b in range(max(600, a + 1), 700) if big[a] != big[b] and alike(a, b)] + [(0, i) for i in range(600)])
    assert roots(range(700), [*got, *((0, i) for i in range(600))]) == want


def test_toxicity_of_a_text_without_blanks():
    import time

    began = time.time()
    found = [toxicity.features(t, toxicity.Lexicon()) for t in ("a1" * 250_000, "x.y." * 100_000, "QUJD" * 100_000)]
    assert time.time() - began < 20 and all(len(f) == len(toxicity.FEATURES) for f in found)


def test_toxicity_learns(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(400)]
    bad = ["zorkel", "zorkelen", "idiot"]
    texts, labels = [], []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append(int(toxic))
    rows = docs(spark, [*texts, None, "", "!" * 50_000], 0)
    lab = spark.createDataFrame([(i, 1, t) for i, t in enumerate(labels)] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(rows, lab).collect()}
    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held)
    assert sum(got[i].predicted == labels[i] for i in held) / len(held) > 0.97
    kept = toxicity.drop_toxic(rows, lab)
    assert kept.columns == rows.columns and kept.count() == sum(1 - r.predicted for r in got.values())
    assert toxicity.digest(rows.limit(0), lab).count() == 0
    assert toxicity.train(rows, lab, sample_rows=0).trees is None
    assert {r.score for r in toxicity.digest(rows.limit(3), lab.limit(0)).collect()} == {0.0}
    without = spark.createDataFrame([(None, "zorkel")], "doc_id long, text string")
    assert [r.held_out for r in toxicity.digest(without, lab).collect()] == [True]


def brute_score(model, text):
    """One text's score, step by step: every tree by itself, then the calibration."""
    x = toxicity.features(text, model.lexicon)
    margin = model.trees.base
    for f, t, v in zip(model.trees.feature, model.trees.threshold, model.trees.value, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if x[f[node]] > t[node] else 1)
        margin += v[node - len(f)]
    at, value = model.at, model.value
    k = next((i for i, a in enumerate(at) if a >= margin), len(at))
    step = value[0] if k == 0 else value[-1] if k == len(at) else value[k - 1] + (value[k] - value[k - 1]) * (margin - at[k - 1]) / (at[k] - at[k - 1])
    return min(1.0, max(0.0, step + 1e-6 * math.tanh(margin / 20)))


def test_toxicity_scores_match_brute_force(spark):
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [" ".join([*(word() for _ in range(rng.randint(1, 40))), *(["zorkel", "You"] if i % 5 == 0 else [])]) for i in range(300)]
    model = toxicity.fit(texts, np.array([i % 5 == 0 for i in range(300)], dtype=float))
    asked = [*texts[:40], "", "YOU zorkel!!", "z0rkel", "x" * 3000]
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, [*asked, None]), model).collect()}
    for i, t in enumerate([*asked, ""]):
        assert abs(got[i] - brute_score(model, t)) < 1e-9, t
    assert got[41] > 0.5 > got[40]


def test_helper_names_never_clash(spark):
    """Every operator that gives rows back, over columns of all its own names."""
    from loomline.llm import bpe, decontaminate, secrets

    names = "row h id text found n spans items at score key ids bytes rep comp path merge n_words class_id _kept _n _toxicity _hits0 _merge _path".split()
    schema = "doc_id long, " + ", ".join(f"{n} string" for n in names)
    rows = spark.createDataFrame([(i, *[f"value {i} {n} of a b c d e {i * 7}" for n in names]) for i in range(12)], schema)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of it"), (2, "zz yy")], "item_id long, text string")
    want = {tuple(r) for r in rows.collect()}
    same = lambda df: df.columns == rows.columns and {tuple(r) for r in df.collect()} == want
    assert same(minhash.drop_near_copies(rows)) and same(secrets.redact(rows))
    for block in (200_000, 1):
        assert same(decontaminate.drop_contaminated(rows, bench, block_words=block)) and same(decontaminate.remove_spans(rows, bench, block_words=block))
    kept = toxicity.drop_toxic(rows, labels)
    assert kept.columns == rows.columns and {tuple(r) for r in kept.collect()} <= want
    assert same(shards.ingest(rows).read())
    assert bpe.digest(rows).count() == minhash.digest(rows).count() == lm.score(rows).count() == secrets.digest(rows).count() == decontaminate.digest(rows, bench).count() == 12
    vectors = rows.selectExpr("doc_id as vec_id", "array(double(doc_id), 1D) as embedding", *[f"`{n}`" for n in names if n != "id"])
    assert embed.digest(vectors).count() == 12


def test_isotonic_rises():
    rng = np.random.default_rng(3)
    m = rng.normal(size=400)
    at, value = toxicity.fit_isotonic(m, (rng.random(400) < 1 / (1 + np.exp(-2 * m))).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all() and 0 < value[0] < value[-1] < 1


def brute_scores(toks, learn):
    """The model's scores from plain dictionaries of all n-grams; weights by the same EM over plain cells."""
    import pandas as pd

    def counts(ids):
        one, two = Counter(), Counter()
        for i in ids:
            one.update(toks[i])
            two.update(zip([None, *toks[i][:-1]], toks[i], strict=True))
        return one, two

    deleted = {i for i in learn if zlib.crc32(str(i).encode()) % 10 == lm.DELETED_FOLD}
    one, two = counts(learn - deleted)
    n, v = sum(one.values()), len(one)
    cells = Counter()
    for i in deleted:
        for a, b in zip([None, *toks[i][:-1]], toks[i], strict=True):
            r2 = two[a, b] / max(one[a], 1) * (v + 1)
            r1 = one[b] / max(n, 1) * (v + 1)
            cells[int(lm.bucket_of(np.array([one[a]]))[0]), int(lm._ratio_bin(np.array([r2]))[0]), int(lm._ratio_bin(np.array([r1]))[0])] += 1
    w = lm.learn_weights(pd.DataFrame([(*k, c) for k, c in cells.items()], columns=["bucket", "two", "one", "n"]))
    one, two = counts(learn)
    n, v = sum(one.values()), len(one)
    out = {}
    for i, t in toks.items():
        p = 0.0
        for a, b in zip([None, *t[:-1]], t, strict=True):
            x = w[int(lm.bucket_of(np.array([one[a]]))[0])]
            p += math.log10(x[0] * two[a, b] / max(one[a], 1) + x[1] * one[b] / max(n, 1) + x[2] / (v + 1))
        out[i] = p
    return out


def test_lm_counts_and_probabilities(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "B", "ccc", "d\tE", "é", "x"]) for _ in range(rng.randint(0, 40))) for _ in range(80)] + [None, "", "  \n"]
    rows = docs(spark, texts)
    got = {r.doc_id: r for r in lm.score(rows, block_bytes=400).collect()}
    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in enumerate(texts)}
    learn = {i for i in toks if zlib.crc32(str(i).encode()) % 10}
    c = Counter(t for i in learn for t in toks[i])
    n, v = sum(c.values()), len(c)
    for i, w in toks.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[t] > 0 for t in w), n, i not in learn)
        assert abs(r.base_score - sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w)) < 1e-9
        assert r.score < 0
    for i, p in brute_scores(toks, learn).items():
        assert abs(got[i].score - p) < 1e-6, i
    whole = {r.doc_id: r.score for r in lm.score(rows).collect()}
    assert all(abs(whole[i] - got[i].score) < 1e-9 for i in whole)  # blocks don't matter
    assert lm.score(rows.limit(0)).count() == 0


def test_lm_weights_add_up():
    import pandas as pd

    w = lm.learn_weights(pd.DataFrame({"bucket": [3, 3, 0], "two": [40, 0, 0], "one": [50, 0, 40], "n": [900, 100, 50]}))
    assert np.allclose(w.sum(1), 1) and (w[1:] > 0).all() and w[0, 0] == 0


def test_shards_compact_and_commit(spark, tmp_path):
    rows = docs(spark, [f"text {i} " * (i % 50) for i in range(400)] + [None])
    store = shards.ShardStore(spark, str(tmp_path / "s"), target=1 << 16, base=1 << 10)
    for k in range(6):
        store.append(rows.where(f"doc_id % 6 = {k}").repartition(3))
    many = len(store.shards())
    last = store.compact()
    assert len(store.shards()) < many and store.compact() == last == store.versions()[-1]
    assert store.read().exceptAll(rows).isEmpty() and rows.exceptAll(store.read()).isEmpty()
    assert store.read(6).count() == 401  # an older version
    files = len(store._written("data"))
    store.vacuum()  # nothing is a day old
    assert len(store._written("data")) == files
    store.vacuum(0)
    assert store.read().count() == 401 and len(store._written("data")) == len(store.shards())
    stale = store.manifest(last - 1)
    with pytest.raises(shards.ConcurrentCommit):
        store._commit(stale, [], rows.schema.json())


def test_shards_of_two_writers_and_a_dead_one(spark, tmp_path):
    one, two = (shards.ShardStore(spark, str(tmp_path / "w")) for _ in range(2))
    one.append(docs(spark, ["a"]))
    before = two.manifest()
    # what a writer leaves that dies before its rename
    (tmp_path / "w/manifests/.dead.tmp").write_text("{")
    (tmp_path / "w/data/00000002-dead").mkdir()
    one.append(docs(spark, ["b"]))
    with pytest.raises(shards.ConcurrentCommit):
        two._commit(before, two.shards(), before["schema"])
    assert two.append(docs(spark, ["c"])) == 3 and one.read().count() == 3


def test_shards_keep_columns_of_any_name(spark, tmp_path):
    names = ["doc_id", "path", "merge", "row", "_path", "_merge", "_metadata", "wave"]
    rows = spark.createDataFrame([(i, *["v"] * 7) for i in range(200)], "doc_id long, " + ", ".join(f"{n} string" for n in names[1:]))
    store = shards.ingest(rows.repartition(8), root=str(tmp_path / "n"))
    assert len(store.shards()) < 32 and store.read().columns == names
    assert store.read().exceptAll(rows).isEmpty() and store.read().count() == 200


def test_shard_plan():
    s = [shards.Shard(f"{i}", b) for i, b in enumerate([10] * 9 + [40] * 3 + [100])]
    plan = shards.plan_merges(s, target=100, base=16, fan_in=4)
    assert [sum(x.bytes for x in g) for g in plan] == [90]
    assert shards.plan_merges(s[:3], 100, 16, 4) == []


def test_shards_of_an_empty_table(spark, tmp_path):
    store = shards.ingest(docs(spark, []), root=str(tmp_path / "e"))
    assert store.read().count() == 0
