"""Language-model scores by deleted interpolation of n-gram estimates.

``P(w | v) = a_b c(v, w) / c(v) + b_b c(w) / N + c_b / (V + 1)``: the maximum-likelihood estimates of
bigram and unigram and the uniform one, mixed by weights that depend on the bucket ``b`` of the
context's frequency. The weights are learned by expectation-maximisation on a held-out part of the
learning texts whose own counts are taken out (deleted) from the estimates.

Counts cover the whole corpus and are never gathered in one place. Texts are dealt into blocks. A
block asks for the counts of its distinct n-grams; questions are routed by the n-gram's hash to the
task that sums them over all blocks, and the answers go back to the block in the order asked.
An n-gram takes one entry a block, however frequent it is, so no hot word makes a hot task. There
is a route for every few blocks, so what a task sums is bounded; n-grams are told apart by the bits of
the route and 48 more, so by more bits the larger the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FOLDS = 10
#: Fold of the learning texts that the mixture weights are learned on.
DELETED_FOLD = 1
BLOCK_BYTES = 8 << 20
#: Blocks whose questions one route answers on average; each block sends a row to each route.
ROUTE_BLOCKS = 4
#: Context-frequency buckets: unseen, then powers of two.
BUCKETS = 26
#: Width in nats of the bins in which held-out ratios are counted for the EM.
BIN = 0.25
BINS = 120
EM_ROUNDS = 60

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0x5851F42D4C957F2D)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8; the end is not among them."""
    return (text or "").encode().lower().split()


class Block:
    """The n-grams of a block's texts: hashes of tokens in order, and the distinct n-grams."""

    def __init__(self, texts: list[str | None]):
        import xxhash

        words: list[bytes] = []
        sizes = np.empty(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            own = tokens_of(t)
            sizes[i] = len(own) + 1
            words += own
            words.append(b"")  # the end
        at, distinct = pd.factorize(np.array(words, dtype=object))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), dtype=np.uint64, count=len(distinct))
        del words
        token = hashes[at]
        ends = sizes.cumsum()
        token[ends - 1] = _END
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[ends - sizes] = _END
        with np.errstate(over="ignore"):
            pair = _mix(before * _GOLDEN + token)
        self.sizes, self.starts = sizes, ends - sizes
        self.text_of = np.repeat(np.arange(len(texts)), sizes)
        self.one, self.one_at = np.unique(token, return_inverse=True)
        self.two, self.two_at = np.unique(pair, return_inverse=True)
        # position of each token's context among the unigrams; a text starts after an end
        self.before_at = np.empty_like(self.one_at)
        self.before_at[1:] = self.one_at[:-1]
        self.before_at[self.starts] = self.one_at[ends - 1]

    def sums(self, per_token: np.ndarray) -> np.ndarray:
        return np.bincount(self.text_of, per_token, len(self.sizes))


def _route_edges(codes: np.ndarray, bits: int) -> np.ndarray:
    """Where each route begins among sorted codes: a route is the first ``bits`` of the hash."""
    return np.searchsorted(codes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _packed(codes: np.ndarray, bits: int) -> bytes:
    """Six bytes of each code, those behind the bits that the route says already."""
    return (codes << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(">u8")[:, 0].astype(np.uint64)


def _ask(bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = Block(pdf["text"].tolist())
        learn = np.repeat(pdf["learn"].to_numpy(), block.sizes)
        rows = []
        for order, codes, at in ((1, block.one, block.one_at), (2, block.two, block.two_at)):
            n = np.bincount(at, learn, len(codes)).astype("<u4")
            edges = _route_edges(codes, bits)
            for r in np.flatnonzero(np.diff(edges)):
                s = slice(edges[r], edges[r + 1])
                rows.append((order, int(r), int(pdf["block"].iloc[0]), bool(pdf["deleted"].iloc[0]), _packed(codes[s], bits), n[s].tobytes()))
        return pd.DataFrame(rows, columns=["order", "route", "block", "deleted", "codes", "n"])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    codes = [_unpacked(c) for c in pdf["codes"]]
    _, at = np.unique(np.concatenate(codes), return_inverse=True)
    n = np.frombuffer(b"".join(pdf["n"]), "<u4")
    every = np.bincount(at, n)
    held = np.bincount(at, n * np.repeat(pdf["deleted"].to_numpy(), [len(c) for c in codes]), len(every))
    rest = every - held
    edges = np.cumsum([0] + [len(c) for c in codes])
    rows = []
    for i, (block, deleted) in enumerate(zip(pdf["block"], pdf["deleted"], strict=True)):
        own = at[edges[i] : edges[i + 1]]
        # what all blocks of a route share is told once, with the first
        facts = (int(every.sum()), int((every > 0).sum()), int(rest.sum()), int((rest > 0).sum())) if i == 0 else (0, 0, 0, 0)
        rows.append((int(pdf["order"].iloc[0]), int(pdf["route"].iloc[0]), block, deleted, every[own].astype("<u4").tobytes(), rest[own].astype("<u4").tobytes() if deleted else None, *facts))
    return pd.DataFrame(rows, columns=["order", "route", "block", "deleted", "every", "rest", "tokens", "types", "rest_tokens", "rest_types"])


_ANSWERS = "order int, route int, block bigint, deleted boolean, every binary, rest binary, tokens bigint, types bigint, rest_tokens bigint, rest_types bigint"


def _counts(answers: pd.DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    rows = answers.sort_values(["order", "route"])
    return tuple(np.frombuffer(b"".join(rows.loc[rows["order"] == k, column]), "<u4").astype(np.float64) for k in (1, 2))


def bucket_of(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(BUCKETS - 1, 1 + np.log2(np.maximum(c, 1)).astype(int)), 0)


def _ratio_bin(r: np.ndarray) -> np.ndarray:
    """Bin of a ratio to the uniform estimate; 0 for none."""
    return np.where(r > 0, np.clip(np.round(np.log(np.maximum(r, 1e-12)) / BIN).astype(int) + BINS // 4, 1, BINS), 0)


def _bin_ratio(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, np.exp((b - BINS // 4) * BIN), 0.0)


def _held_out(tokens: int, types: int):
    def run(key: tuple, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "two", "one", "n"]
        if texts.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        block = Block(texts["text"].tolist())
        one, two = _counts(answers, "rest")
        before = one[block.before_at]
        r2 = two[block.two_at] / np.maximum(before, 1) * (types + 1)
        r1 = one[block.one_at] / max(tokens, 1) * (types + 1)
        cell = (bucket_of(before) * (BINS + 1) + _ratio_bin(r2)) * (BINS + 1) + _ratio_bin(r1)
        kinds, n = np.unique(cell, return_counts=True)
        return pd.DataFrame({"bucket": kinds // (BINS + 1) ** 2, "two": kinds // (BINS + 1) % (BINS + 1), "one": kinds % (BINS + 1), "n": n})

    return run


def learn_weights(cells: pd.DataFrame, rounds: int = EM_ROUNDS) -> np.ndarray:
    """(BUCKETS, 3): weights of bigram, unigram and uniform estimate of each context bucket.

    Each estimate starts with one imagined token of each kind, so a bucket without held-out tokens
    takes them alike and no weight is 0; an unseen context has no bigram estimate.
    """
    out = np.full((BUCKETS, 3), 1 / 3)
    out[0] = (0, 0.5, 0.5)
    for b in range(BUCKETS):
        own = cells[cells["bucket"] == b]
        if own.empty:
            continue
        n = own["n"].to_numpy(dtype=float)
        r = np.stack([_bin_ratio(own["two"].to_numpy()), _bin_ratio(own["one"].to_numpy()), np.ones(len(own))], axis=1)
        prior = np.array([0.0 if b == 0 else 1.0, 1.0, 1.0])
        for _ in range(rounds):
            share = r * out[b]
            share *= (n / share.sum(1))[:, None]
            out[b] = (share.sum(0) + prior) / (n.sum() + prior.sum())
    return out


def _score(tokens: int, types: int, weights: np.ndarray):
    def run(key: tuple, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = Block(texts["text"].tolist())
        one, two = _counts(answers, "every")
        c = one[block.one_at]
        base = np.log10((one + 0.1) / (tokens + 0.1 * (types + 1)))[block.one_at]
        before = one[block.before_at]
        w = weights[bucket_of(before)]
        p = w[:, 0] * two[block.two_at] / np.maximum(before, 1) + w[:, 1] * c / max(tokens, 1) + w[:, 2] / (types + 1)
        return pd.DataFrame(
            {
                "id": texts["id"],
                "held_out": ~texts["learn"],
                "n_tokens": block.sizes,
                "n_known": block.sums((c > 0).astype(float)).astype(np.int64),
                "train_tokens": tokens,
                "base_score": block.sums(base),
                "score": block.sums(np.log10(p)),
            }
        )

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Null texts are empty; an empty text is its end alone. Rows whose crc32(id as text) mod 10 is 0,
    and rows without id, are scored but not learned from. Repeated rows count and are scored each.
    No learning rows: every token is unknown. No rows give no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    size = (size[0] or 0) + size[1]
    blocks = max(1, -(-size // block_bytes), min(common.partitions(docs.sparkSession), size >> 20))
    bits = max(2, (-(-blocks // ROUTE_BLOCKS) - 1).bit_length())
    fold = common.crc_fold("id", FOLDS)
    # the deleted fold has blocks of its own, so what is learned on it reads no others
    own = max(1, blocks // (FOLDS - 1))
    spot = F.xxhash64("id", "text")
    deleted = F.coalesce(fold == DELETED_FOLD, F.lit(False))
    placed = rows.select(
        "id",
        "text",
        F.coalesce(fold != 0, F.lit(False)).alias("learn"),
        deleted.alias("deleted"),
        F.when(deleted, F.pmod(spot, F.lit(own))).otherwise(own + F.pmod(spot, F.lit(blocks))).alias("block"),
    )
    asked = placed.groupBy("block").applyInPandas(_ask(bits), "order int, route int, block bigint, deleted boolean, codes binary, n binary")
    answers = common.materialize(asked.groupBy("order", "route").applyInPandas(_answer, _ANSWERS), "lm-answers")
    facts = answers.where("order = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "rest_tokens", "rest_types")]).first()
    held = placed.where("deleted").groupBy("block").cogroup(answers.where("deleted").groupBy("block"))
    cells = held.applyInPandas(_held_out(facts["rest_tokens"], facts["rest_types"]), "bucket bigint, two bigint, one bigint, n bigint")
    # bounded: one row for each bucket and pair of bins
    cells = cells.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(cells)
    scored = placed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _score(facts["tokens"], facts["types"], weights),
        f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
    return scored.withColumnRenamed("id", id_col)
