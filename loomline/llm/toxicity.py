"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

Features are densities and rates over the whole text: hits of a fixed lexicon and of one learned
from labelled rows (words and word stems), hits close to a second-person pronoun, capitals,
punctuation and obfuscation. The model is fitted in numpy on a bounded sample of labelled rows and
broadcast (its size is bounded by its parameters); scoring runs over all rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that a model is fitted on at most; all of them where there are fewer.
SAMPLE_ROWS = 12_000
LEXICON_SIZE = 2_000
FOLDS = 5

# Common insults in the four languages of the corpus.
INSULTS = frozenset(
    "idiot idiots idiotic stupid moron moronic imbecile dumb dumbass fool loser losers pathetic worthless scum trash garbage clown"
    " disgusting filthy vermin ugly jerk bastard bitch asshole bullshit crap shit fuck fucking retard pig"
    " idiote stupide crétin débile abruti connard salaud salope merde ordure minable pourriture"
    " idiotin dumm dummkopf blöd arschloch scheiße scheisse abschaum wertlos trottel versager widerlich"
    " estúpido estupido imbécil imbecil tonto basura mierda asqueroso inútil inutil cabrón puta patético".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself youre u ur ya du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos"
    " tú usted ustedes tus ti contigo vosotros".split()
)
LEET = str.maketrans("013457@$!|", "oieastasil")

_WORD = re.compile(r"[^\W_]+")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
#: Symbols inside a word, or single letters set apart, once the character before is a letter.
_OBFUSCATED = re.compile(r"[0-9@$!*|]+[^\W\d_]|[.\-_*]\w[.\-_*]\w")
_PUNCT = list(b"!?.,;:*#$%&@")
STEMS = (4, 5, 6)

FEATURES = (
    "fixed_rate fixed_any learned_rate learned_any learned_weight stem_rate stem_any stem_weight leet_rate near_you_rate you_rate"
    " capital_rate shout_rate exclaim_rate question_rate punct_rate obfuscated_rate repeat_rate log_words word_chars"
).split()


@dataclass
class Lexicon:
    """Learned words and stems with their log-odds; ``facts`` remembers what is known of a word."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    memo: dict[str, tuple | None] = field(default_factory=dict, repr=False)

    def facts(self, w: str) -> tuple | None:
        """(fixed hit, log-odds of the word, of its stem, second person), or None for none of it."""
        stem = max([self.stems.get(w[:k], 0.0) for k in STEMS if len(w) >= k], default=0.0)
        found = (w in INSULTS, self.words.get(w, 0.0), stem, w in SECOND_PERSON)
        if len(self.memo) > 100_000:
            self.memo.clear()
        self.memo[w] = known = found if any(found) else None
        return known


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


Counts = dict[str, tuple[Counter, Counter]]


def count_words(texts: list[str], labels: np.ndarray) -> Counts:
    """Texts that hold each word and each word stem, by label."""
    found: Counts = {"words": (Counter(), Counter()), "stems": (Counter(), Counter())}
    for text, label in zip(texts, labels, strict=True):
        words = set(words_of(text))
        found["words"][int(label)].update(words)
        found["stems"][int(label)].update({w[:k] for w in words for k in STEMS if len(w) >= k})
    return found


def learn_lexicon(found: Counts, n0: int, n1: int, size: int = LEXICON_SIZE, least: float = 24.0) -> Lexicon:
    """Words and stems that the ``n1`` toxic texts hold far more often than chance lets them (G-test)."""
    out = Lexicon()
    if not n1 or not n0:
        return out
    for kind, (clean, toxic) in found.items():
        scored = []
        for w, a in toxic.items():
            b = clean[w]
            if a / n1 <= b / n0:
                continue
            e1 = (a + b) * n1 / (n1 + n0)
            e0 = (a + b) - e1
            g = 2 * (a * math.log(a / e1) + (b * math.log(b / e0) if b else 0.0))
            if g >= least:
                scored.append((g, w, math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))))
        scored.sort(reverse=True)
        setattr(out, kind, {w: z for _, w, z in scored[:size]})
    return out


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Dense features of one whole text; an empty text has zeros."""
    words = words_of(text)
    n = max(1, len(words))
    chars = max(1, len(text))
    memo, facts = lexicon.memo, lexicon.facts
    fixed = learned = stem = 0
    weight = stem_weight = 0.0
    hits, you = [], []
    for i, w in enumerate(words):
        known = memo[w] if w in memo else facts(w)
        if known is None:
            continue
        insult, z, stem_z, second = known
        fixed += insult
        if z:
            learned += 1
            weight = max(weight, z)
        if stem_z:
            stem += 1
            stem_weight = max(stem_weight, stem_z)
        if insult or z or stem_z:
            hits.append(i)
        if second:
            you.append(i)
    near = 0
    if hits and you:
        at = np.searchsorted(you, hits)
        near = sum(
            min(abs(h - you[j]) for j in (a - 1, a) if 0 <= j < len(you)) <= 5 for h, a in zip(hits, at.tolist(), strict=True)
        )
    obfuscated = [m.start() for m in _OBFUSCATED.finditer(text) if m.start() and text[m.start() - 1].isalpha()]
    # a word is read up to 40 characters either way, so a text without blanks isn't read for each
    tokens = {text[max(text.rfind(" ", max(0, i - 40), i) + 1, i - 40) : i + 40].split()[0] for i in obfuscated}
    plain = [re.sub(r"[\W_]", "", o.lower().translate(LEET)) for o in tokens]
    leet = sum(o in INSULTS or o in lexicon.words for o in plain)
    codes = np.frombuffer(text.encode(), dtype=np.uint8)
    counts = np.bincount(codes, minlength=256)
    upper = counts[65:91].sum()
    shout = len(_SHOUT.findall(text)) if upper > 2 else 0
    marks = counts[33], counts[63]
    punct = counts[_PUNCT].sum()
    repeats = int(((codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2])).sum())
    return [
        fixed / n,
        min(fixed, 3),
        learned / n,
        min(learned, 3),
        weight,
        stem / n,
        min(stem, 3),
        stem_weight,
        leet / n,
        near / n,
        len(you) / n,
        upper / chars,
        shout / n,
        marks[0] / n,
        marks[1] / n,
        punct / chars,
        len(obfuscated) / n,
        repeats / n,
        math.log1p(len(words)),
        sum(map(len, words)) / n,
    ]


@dataclass
class Trees:
    """Boosted regression trees of equal depth, as arrays."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over feature histograms."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    # values between quantiles matter where most rows share one value
    cuts = [np.unique(np.concatenate([c, np.quantile(x[x[:, j] > c.min(), j], np.linspace(0, 1, bins // 2 + 1)[:-1])])) if (x[:, j] > c.min()).any() else c for j, c in enumerate(cuts)]
    coded = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = math.log(p / (1 - p))
    f = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    all_f, all_t, all_v = [], [], []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-f))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        feat, thr = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = node - first
            best = np.zeros(many)
            best_f, best_b = np.zeros(many, dtype=np.int64), np.full(many, -1)
            for j in range(m):
                at = local * width + coded[:, j]
                gs = np.bincount(at, g, many * width).reshape(many, width)
                hs = np.bincount(at, h, many * width).reshape(many, width)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1)[:, None], hs.sum(1)[:, None]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(many), k]
                better = top > best + 1e-9
                best[better], best_f[better], best_b[better] = top[better], j, k[better]
            for s in range(many):
                if best_b[s] >= 0:
                    feat[first + s], thr[first + s] = best_f[s], cuts[best_f[s]][best_b[s]]
            node = 2 * node + 1 + (x[np.arange(n), feat[node]] > thr[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        v = -rate * gs / (hs + l2)
        f += v[leaf]
        all_f.append(feat), all_t.append(thr), all_v.append(v)
    return Trees(np.array(all_f), np.array(all_t), np.array(all_v), base, depth)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a rising step function of the margin, as points to interpolate.

    Each end is smoothed by one imagined row of the other label, so no score is exactly 0 or 1.
    """
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # margin sum, label sum, rows
    for m, t in zip(margin[order], y[order], strict=True):
        blocks.append([m, t, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            a = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], a, strict=True)]
    at = np.array([b[0] / b[2] for b in blocks])
    value = np.array([(b[1] + 0.5 * y.mean() + 0.01) / (b[2] + 0.52) for b in blocks])
    return at, np.maximum.accumulate(np.clip(value, 1e-4, 1 - 1e-4))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    at: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.value[0])
        margin = self.trees.margin(x)
        # a share of the margin itself keeps the order within a step of the calibration
        step = np.interp(margin, self.at, self.value)
        return np.clip(step + 1e-6 * np.tanh(margin / 20), 0.0, 1.0)


def fit(texts: list[str], labels: np.ndarray, folds: int = 4, seed: int = 7) -> Model:
    """Lexicon, trees and calibration. No row meets a lexicon or calibration learned from itself.

    The trees see each row with a lexicon learned from the other folds; the calibration sees
    margins of trees grown on the other folds. No rows, or rows of one label alone, give a
    constant score: the share of toxic rows (0 if none).
    """
    y = np.asarray(labels, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(Lexicon(), None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]))
    part = np.random.default_rng(seed).permutation(len(y)) % folds
    x = np.zeros((len(y), len(FEATURES)))
    each = [count_words([texts[i] for i in np.flatnonzero(part == k)], y[part == k]) for k in range(folds)]

    every: Counts = {kind: tuple(sum((c[kind][t] for c in each), Counter()) for t in (0, 1)) for kind in ("words", "stems")}

    def lexicon(without: int | None) -> Lexicon:
        found = every if without is None else {kind: tuple(a - b for a, b in zip(every[kind], each[without][kind], strict=True)) for kind in every}
        rest = y if without is None else y[part != without]
        return learn_lexicon(found, int((rest == 0).sum()), int((rest == 1).sum()))

    for k in range(folds):
        own = lexicon(k)
        for i in np.flatnonzero(part == k):
            x[i] = features(texts[i], own)
    margin = np.zeros(len(y))
    for k in range(folds):
        margin[part == k] = fit_trees(x[part != k], y[part != k]).margin(x[part == k])
    return Model(lexicon(None), fit_trees(x, y), *fit_isotonic(margin, y))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows of the learning folds, at most ``sample_rows`` of them.

    The sample is the rows with the smallest hash of their id, so it is the same on every run.
    Rows without id, label or text aren't learned from; of texts that share an id the smallest is.
    """
    wanted = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y"))
    wanted = wanted.where((common.crc_fold("id", FOLDS) != 0) & F.col("y").isNotNull())
    wanted = wanted.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    # the sample's size is bounded by its limit
    rows = text.join(F.broadcast(wanted), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toPandas()
    rows = rows.sort_values("id")
    return fit(rows["text"].tolist(), (rows["y"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of every row; null texts count as empty; repeated rows score alike."""
    scored = docs.select(F.col(f"`{id_col}`"), _scorer(docs, model)(F.col(f"`{text_col}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _scorer(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for series in texts:
            x = np.array([features(t or "", own.lexicon) for t in series]).reshape(-1, len(FEATURES))
            yield pd.Series(own.score(x))

    return run


def digest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Score and prediction of every row, and whether its id is held out; an empty text is scored like any.

    A row without id is never learned from, so it counts as held out.
    """
    out = score(docs, train(docs, labels, id_col), id_col)
    return out.select(id_col, F.coalesce(common.crc_fold(id_col, FOLDS) == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the model doesn't reject, with their columns as they were; null texts count as empty."""
    model = train(docs, labels, id_col, text_col)
    scored = docs.select(common.boxed(docs), _scorer(docs, model)(F.col(f"`{text_col}`")).alias("score"))
    return common.unboxed(scored.where("score < 0.5"), docs.columns)
