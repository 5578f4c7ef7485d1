"""The corpus run against a brute-force version of its stages, in plain Python."""

import hashlib
import os
import re

import numpy as np
import pandas as pd
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))


def contaminated(text, windows):
    w, hit = words(text), set()
    for k in windows:
        for j in range(len(w) - len(k) + 1):
            if tuple(w[j : j + len(k)]) == k:
                hit.update(range(j, j + len(k)))
    return bool(hit) and 20 * len(hit) >= len(w)


def masked(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = [m.span() for m in assign.finditer(text) if len(m[2]) >= 8]
    spans += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", text)]
    merged = []
    for a, b in sorted(spans):
        if merged and merged[-1][1] >= a:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in reversed(merged):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def test_pipeline_matches_brute_force(spark):
    import corpus_pipeline
    from loomline.llm import bpe, common, minhash, toxicity

    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").sort_index()
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    got = corpus_pipeline.run(spark, SF).toPandas().set_index("doc_id").sort_index()

    model = toxicity.train(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"))
    x = np.array([toxicity.features(t or "", model.lexicon) for t in docs.text])
    left = docs[model.score(x) < 0.5]

    shingler = minhash.Shingler()
    found = {i: shingler((t or "").encode()) for i, t in left.text.items()}
    root = {i: i for i in found}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(found)
    for n, i in enumerate(ids):
        a, u, _ = found[i]
        for j in ids[:n]:
            b, v, _ = found[j]
            if len(a) and len(b) and min(len(a), len(b)) / max(len(a), len(b)) > 0.1 and minhash.probability_jaccard(a, u.astype(float), b, v.astype(float)) >= 0.8:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    left = left[[find(i) == i for i in left.index]]

    windows = set()
    for t in bench.text:
        w = words(t)
        windows |= {tuple(w)} if 0 < len(w) < 13 else {tuple(w[j : j + 13]) for j in range(len(w) - 12)} if w else set()
    left = left[[not contaminated(t, windows) for t in left.text]]

    coder = bpe.Coder(bpe.vocabulary_path())
    assert list(got.index) == list(left.index)
    for i, t in left.text.items():
        t = masked(t or "")
        assert got.loc[i, "n_tokens"] == len(coder.ids(t)) // 4
        assert got.loc[i, "decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_stages_keep_columns_and_bear_edges(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "plain words that stay here", "en", "s", 5), (3, "plain words that stay here", "en", "s", 5), (None, "no id", None, None, 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "byte_bpe":
                assert out.columns == docs.columns, name
            assert out.count() == (0 if not data else {"near_dedup": 4}.get(name, 5)), name
