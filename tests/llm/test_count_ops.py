"""Token counts, collocations and ranked search on small fixtures."""

import functools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomline.llm import collocations, search, token_counts

SCHEMA = "doc_id long, text string, lang string, item string, id int, n long, h1 long, rank string, word string"
EDGE = [None, "", " ", "a", "same text here", "same text here", "naïve café 東京 " * 3, "x" * 5000, " \n\t" * 700, "</s><s><0x41> ▁ \x00", "it's 123 " * 900]


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or ["en"])[i % len(langs or ["en"])], "x", 1, 2, 3, "x", "x") for i, t in enumerate(texts)], SCHEMA)


# token counts


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path())


def random_texts(machine, n, seed=5):
    rng = random.Random(seed)
    pieces = list(machine.scores)
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            yield "".join(rng.choice("aab  e n.1\n\t-=é漢😀▁") for _ in range(rng.randint(0, 60)))
        elif kind < 0.6:
            yield "".join(rng.choice(pieces) for _ in range(rng.randint(0, 20)))
        else:
            yield rng.choice(["a", "-", "=", "ab", " ", "."]) * rng.randint(1, 200) + "".join(rng.choice("etaoinshr ") for _ in range(rng.randint(0, 80)))


def test_transducer_counts_as_the_library():
    machine, model = token_counts.transducer(token_counts.vocabulary_path()), library()
    for t in random_texts(machine, 1500):
        assert machine.count(t) == len(model.encode(t)), t


def test_chunk_maps_compose():
    machine, rng = token_counts.transducer(token_counts.vocabulary_path()), random.Random(2)
    for t in filter(None, random_texts(machine, 300, 8)):
        whole = " " + t.replace("▁", " ")
        n = rng.choice([1, 2, 5, 17])
        maps = [machine.state_map(whole[i : i + n]) for i in range(0, len(whole), n)]
        for _ in range(2):
            k = rng.randrange(len(maps))  # associative: any bracketing
            left, right = maps[:k], maps[k:]
            sides = [functools.reduce(machine.compose, side) for side in (left, right) if side]
            head, count, _ = functools.reduce(machine.compose, sides)
            assert count + machine.run(token_counts.START, head)[1] == machine.count(t)


def test_transducer_starts_over(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_STATES", 20)
    monkeypatch.setattr(token_counts, "KEPT_STRETCHES", 5)
    machine, model = token_counts.Transducer(token_counts.vocabulary_path()), library()
    for t in random_texts(machine, 40, 3):
        assert machine.count(t) == len(model.encode(t))


def test_token_counts(spark):
    model = library()
    texts = [*EDGE, "a" * 3000 + " end", "漢字" * 900, "word " * 4000, "-" * 2500]
    want = [len(model.encode(t or "")) for t in texts]
    for chunk in (16_384, 100, 7):
        got = token_counts.digest(docs(spark, texts)) if chunk == 16_384 else token_counts.count(docs(spark, texts), chunk_chars=chunk)
        got = got.toPandas().sort_values("doc_id")
        assert got["n_tokens"].tolist() == want, chunk
        assert got["n_bytes"].tolist() == [len((t or "").encode()) for t in texts]
        if chunk == 16_384:
            assert got["over_limit"].tolist() == [n > 4096 for n in want]


def test_token_counts_repeated_and_none(spark):
    rows = spark.createDataFrame([(None, "long text " * 30)] * 3 + [(7, "long text " * 30)] * 2, "doc_id long, text string")
    got = token_counts.count(rows, chunk_chars=50).toPandas()
    assert len(got) == 5 and got["doc_id"].isna().sum() == 3 and got["n_tokens"].nunique() == 1
    assert token_counts.digest(rows.limit(0)).count() == 0


# collocations


def brute_collocations(texts, langs, least=10, cover=50):
    f = defaultdict(Counter)
    for t, lang in zip(texts, langs, strict=True):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        total = sum(n for g, n in c.items() if len(g) == 1)
        found = {g: n for g, n in c.items() if len(g) > 1 and n >= least}
        rows = []
        for g, a in found.items():
            if any(len(h) == 3 and len(g) == 2 and g in (h[:2], h[1:]) and 100 * n >= cover * a for h, n in found.items()):
                continue
            cuts = [(1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:2000])]
    return sorted(out)


def test_collocations_against_brute_force(spark):
    rng = random.Random(4)
    words = ["Alpha", "beta", "gamma", "x", "é", "naïve", "12", "o'x", "-"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    texts += ["new york city " * 15, "the end of it. " * 12, None, "", "...", "a" * 700 + " b " * 30, "a" * 700 + " b"]
    langs = ["en", None, "de"] * len(texts)
    want = brute_collocations(texts, langs[: len(texts)])
    rows = docs(spark, texts, ["en", None, "de"])
    assert want and sorted(map(tuple, collocations.digest(rows).collect())) == want
    small = collocations.ranked(collocations.mine(rows, slice_bytes=500, range_bytes=300))
    assert sorted(map(tuple, small.collect())) == want


def test_collocations_of_nothing(spark):
    assert collocations.digest(docs(spark, [None, "", "one", "a b c"])).count() == 0
    assert collocations.digest(docs(spark, ["a"]).limit(0)).count() == 0


def test_words_are_cut_anywhere(monkeypatch):
    text = ("Some words, here\tand there.\n" * 40 + "y" * 90 + " tail").encode()
    whole = collocations.Words(text, 1)
    monkeypatch.setattr(collocations, "STEP_BYTES", 64)
    collocations._powers.cache_clear()
    cut = collocations.Words(text, 1)
    collocations._powers.cache_clear()
    assert (whole.distinct == cut.distinct).all() and (whole.at == cut.at).all() and (whole.joined == cut.joined).all()


def test_automaton_union_and_lookup():
    rng = np.random.default_rng(1)
    shards, want = [], Counter()
    for _ in range(5):
        grams, n = np.unique(rng.integers(0, 6, (200, 3)).astype(np.uint64), axis=0, return_counts=True)
        n = n * 150
        want.update({tuple(g.tolist()): int(k) for g, k in zip(grams, n, strict=True)})
        shards.append(collocations.Automaton.unpack(collocations.Automaton.of_sorted(list(grams.T), n).pack()))
    whole = collocations.Automaton.union(shards)
    assert {p: int(n) for *p, n in zip(*whole.paths(), whole.weights, strict=True) for p in [tuple(map(int, p))]} == want
    asked = rng.integers(0, 8, (300, 3)).astype(np.uint64)
    assert whole.weight_of(list(asked.T)).tolist() == [want.get(tuple(map(int, a)), 0) for a in asked]


# ranked search


def brute_search(texts, items, top=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    every = {i: Counter(terms(t)) for i, t in enumerate(texts)}
    every = {i: c for i, c in every.items() if c}
    size = {i: sum(c.values()) for i, c in every.items()}
    n, total = len(every), sum(size.values())
    df = Counter(t for c in every.values() for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in every.items():
            m = 50 + 50 * size[i] * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def test_search_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "THE", "the", "42"]
    texts = [" ".join(rng.choice(words[: rng.choice([8, 30, 64])]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["the cat"] * 60 + [None, "", "...", "w1 " * 5000, "w1," * 5000]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(25)] + [(90, "absent"), (91, ""), (92, None), (93, "the")]
    asked = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    want = brute_search(texts, items)
    rows = docs(spark, texts)
    for size, block in ((8192, 1 << 20), (70, 100)):
        got = search.search(rows, asked, tree_docs=size, item_bytes=block)
        assert sorted(map(tuple, got.collect())) == want, size
    assert search.digest(rows.limit(0), asked).count() == 0
    assert search.digest(rows, asked.limit(0)).count() == 0


def test_search_steps_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(search, "STEP_BYTES", 16)
    text = b"Some words-here and " + b"long" * 20 + b" then, MORE of 9them"
    assert [t for part in search.terms_of(text) for t in part] == re.findall(rb"[0-9a-z]+", text.lower())
    rows = spark.createDataFrame([(None, "cat"), (3, "cat"), (1, "cat"), (1, "cat")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cat dog")], "item_id long, text string")
    got = search.search(rows, asked).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 1, 3, None] or not got


def test_ball_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(300, rng.integers(1, 20), replace=False)) for _ in range(2000)]
    starts = np.cumsum([0, *map(len, rows)])
    terms, values = np.concatenate(rows), rng.random(starts[-1]) * 1e6
    tree = search.BallTree(starts, terms, values, 300)
    dense = np.zeros((2000, 300))
    for i, r in enumerate(rows):
        dense[i, r] = values[starts[i] : starts[i + 1]]
    asked = np.sort(rng.choice(300, 8, replace=False))
    w = rng.random(8) * 100
    bound = tree.bounds(asked, w)
    for (first, end, _, _), b in zip(tree.nodes, bound, strict=True):
        assert (dense[tree.order[first:end]][:, asked] @ w).max() <= b
    assert sorted(tree.order.tolist()) == list(range(2000))
    # one near group and far others: only the group's leaves are scored
    pack = {"docs": np.arange(2000), "sizes": np.full(2000, 50), "starts": np.arange(2001) * 2, "tf": np.tile([1, 1], 2000).astype("<u4")}
    pack["terms"] = np.stack([np.arange(2000) // 100, 20 + np.arange(2000) // 100], axis=1).ravel().astype("<u4")
    found = [search.Found(50)]
    visited = search.search_pack({k: np.asarray(v).tobytes() for k, v in pack.items()}, [np.array([3, 23])], np.full(40, 1000), 2000, 100_000, found)
    assert found[0].docs.tolist() == list(range(300, 350)) and visited < 32  # of 64 leaves


@pytest.mark.parametrize("size", [1, 48, 49, 500])
def test_ball_tree_of_equal_vectors(size):
    tree = search.BallTree(np.arange(size + 1) * 2, np.tile([0, 1], size), np.full(2 * size, 3.0), 2)
    assert len(tree.nodes) == 1 and tree.radii[0] < 1
