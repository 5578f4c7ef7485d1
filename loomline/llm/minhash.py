"""MinHash near-dedup by ProbMinHash: weighted word shingles, banding, exact verification.

Each shingle of a text is an element whose weight is its count. Its arrivals form a Poisson process
of that rate, every arrival falls into a register drawn at random, and a register keeps its earliest
arrival. Two texts agree in a register with a probability equal to the probability Jaccard of their
weighted shingles. An element stops once its next arrival is later than every register's.

Bands of registers give candidate pairs. Those whose signatures agree well enough are verified by
the exact probability Jaccard. The result is one class per document. To find the classes no bucket
is expanded into all its pairs. A few bands come first, where members are compared with one member
of their bucket. Of all bands only those buckets go on whose members still lie in different classes:
their members are compared block by block inside the tasks, by signature and then by shingles, and
pairs leave a task only if they are alike and join two classes (a spanning forest); first within the
blocks of a bucket, then, with the classes found so far, between its blocks: there only the members
outside the bucket's largest class meet the others.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .decontaminate import words_of

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 40, 7
REGISTERS = BANDS * BAND_ROWS
#: Bands in which members are first compared with a leader.
LEAD_BANDS = 4
#: Members of a bucket that are compared in one block; larger buckets are split into pairs of blocks.
BLOCK_TEXTS = 256
#: Words of 64 bits of a block's packed incidence at most (32 MB); larger ones are compared by lists.
DENSE_WORDS = 4_000_000
#: Standard deviations below the threshold at which an agreement of signatures still counts.
SIGMAS = 6
#: Texts whose shingles a round may ask for by a broadcast of their ids (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Shingles of a batch in a task; a longer text is a batch of its own.
BATCH_SHINGLES = 400_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIER = np.uint64(0x100000001B3C6D9 | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Weighted shingles as 64-bit hashes; hashes of words are remembered within bounds."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(sorted shingle hashes, counts, digest of the words).

        A text of fewer words than a shingle has one shingle of all its words; one without words has
        none. Texts with the same words in the same order have the same digest.
        """
        import xxhash

        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), b""
        if len(self.words) > 100_000:
            self.words.clear()
        known, hashed = self.words, xxhash.xxh64_intdigest
        h = np.array([known[w] if w in known else known.setdefault(w, hashed(w)) for w in words], dtype=np.uint64)
        k = min(SHINGLE_WORDS, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = out * _MULTIPLIER + h[i : len(h) - k + 1 + i]
        if k < SHINGLE_WORDS:
            out = out + np.uint64(k)
        shingles, counts = np.unique(_mix(out), return_counts=True)
        return shingles, counts, hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """(n, m): for each text and register, the element that arrives first.

    ``doc``, ``element``, ``weight``: one entry for each weighted shingle of the n texts.
    """
    first = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    last = np.full(n, np.inf)  # latest of a text's registers: an arrival after it changes nothing
    act, time = np.arange(len(doc)), np.zeros(len(doc))
    i = 0
    with np.errstate(over="ignore"):
        while len(act):
            i += 1
            own = doc[act]
            r = _mix(element[act] + _GOLDEN * np.uint64(i))
            time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight[act]
            alive = time < last[own]
            act, time, own, r = act[alive], time[alive], own[alive], r[alive]
            slot = own * m + ((_mix(r + _GOLDEN) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(first, slot, time)
            won = time == first[slot]
            winner[slot[won]] = element[act[won]]
            if i < 6 or i % 8 == 0:
                left = np.unique(own)
                last[left] = first.reshape(n, m)[left].max(1)
    return winner.reshape(n, m)


def bands_of(winners: np.ndarray) -> np.ndarray:
    """(n, BANDS): one 64-bit key for each band of registers; keys of different bands differ."""
    parts = winners.reshape(len(winners), BANDS, BAND_ROWS)
    key = np.tile(_mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(winners), 1))
    with np.errstate(over="ignore"):
        for i in range(BAND_ROWS):
            key = _mix(key * _MULTIPLIER + parts[:, :, i])
    return key.view(np.int64)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    ids: list[int] = []
    hashes: list[int] = []
    digests: list[bytes] = []
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pd.DataFrame:
        doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        winners = prob_minhash(doc, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), len(parts))
        # one byte of each register is enough to compare signatures
        sketch = (winners >> np.uint64(56)).astype(np.uint8)
        return pd.DataFrame({"id": ids, "h": hashes, "digest": digests, "bands": list(bands_of(winners)), "sketch": [s.tobytes() for s in sketch]})

    for pdf in batches:
        for key, h, text in zip(pdf["id"], pdf["h"], pdf["text"], strict=True):
            shingles, counts, digest = shingler(text.encode())
            if not digest:
                continue
            ids.append(key), hashes.append(h), digests.append(digest), parts.append((shingles, counts))
            size += len(shingles)
            if size >= BATCH_SHINGLES:
                yield flush()
                ids, hashes, digests, parts, size = [], [], [], [], 0
    if ids:
        yield flush()


def _shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    for pdf in batches:
        for start in range(0, len(pdf), 500):
            part = pdf.iloc[start : start + 500]
            found = [shingler(t.encode()) for t in part["text"]]
            yield pd.DataFrame(
                {
                    "rep": part["rep"].to_numpy(),
                    "shingles": [s.tobytes() for s, _, _ in found],
                    # most texts hold each shingle once
                    "counts": [None if (c == 1).all() else c.astype("<u4").tobytes() for _, c, _ in found],
                }
            )


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Sum over common elements of 1 / sum over all of max(x_j / x_i, y_j / y_i).

    ``a``, ``b``: sorted elements; ``x``, ``y``: their weights. Equal weights give plain Jaccard.
    """
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if x.max() == x.min() and y.max() == y.min():
        return len(both) / (len(a) + len(b) - len(both))
    xi, yi = x[i], y[j]
    only_a, only_b = x.sum() - xi.sum(), y.sum() - yi.sum()
    # elements of the same two weights have the same term
    kinds, n = np.unique(xi * 2.0**26 + yi, return_counts=True)
    total = 0.0
    for kind, k in zip(kinds, n, strict=True):
        p, q = kind // 2.0**26, kind % 2.0**26
        total += k / (only_a / p + only_b / q + np.maximum(xi / p, yi / q).sum())
    return float(total)


def _weights(counts: bytes | None, n: int) -> np.ndarray:
    return np.ones(n) if counts is None else np.frombuffer(counts, "<u4").astype(float)


def _verify(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for p, c, q, d in zip(pdf["sa"], pdf["ca"], pdf["sb"], pdf["cb"], strict=True):
                a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                keep.append(probability_jaccard(a, _weights(c, len(a)), b, _weights(d, len(b))) >= similarity - 1e-12)
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _alike(similarity: float):
    """Pairs whose signatures agree as texts of that similarity may; others can't reach it."""
    least = _least_agreement(similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), REGISTERS) for c in ("sa", "sb"))
            yield pdf.loc[(x == y).mean(1) >= least, ["a", "b"]]

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): ``h`` tells rows apart that share an id."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows of (id, h) under one long key: a broadcast by one is a fraction of one by two."""
    rest = [c for c in rows.columns if c not in ("id", "h")]
    return rows.select(F.xxhash64("id", "h").alias("hk"), F.col("id").alias("i"), F.col("h").alias("hh"), *rest)


def _same_row(left: DataFrame, keyed: DataFrame) -> Column:
    """That ``left`` has the id and hash of a keyed row; as differences, so that they are no keys of their own."""
    exact = (left["id"].bitwiseXOR(keyed["i"]) == 0) & (left["h"].bitwiseXOR(keyed["hh"]) == 0)
    return (F.xxhash64(left["id"], left["h"]) == keyed["hk"]) & exact


def _classes_of_rows(rows: DataFrame, similarity: float) -> DataFrame:
    """(id, h, cls, class_id) of every row that has an id and words: its class's number and smallest id."""
    usable = rows.where("id is not null and text is not null")
    signed = usable.mapInPandas(_sign, "id bigint, h bigint, digest binary, bands array<bigint>, sketch binary")
    signed = common.materialize(signed, "minhash-signed")
    # exact copies are one text from here on, with a number of its own; copies are met before the shuffle
    first = F.min(F.struct("id", "h", "bands", "sketch"))
    reps = signed.groupBy("digest").agg(first.alias("r"))
    reps = reps.select("digest", F.monotonically_increasing_id().alias("rep"), F.col("r.id").alias("id"), "r.h", "r.bands", "r.sketch")
    reps = common.materialize(reps, "minhash-reps")
    repeated = not signed.groupBy("id", "h").count().where("count > 1").isEmpty()
    side = lambda t, x, cols: t.select(F.col(t.columns[0]).alias(x), *[F.col(c).alias(c[0] + x) for c in cols])

    def shingles_of(numbers: DataFrame) -> DataFrame:
        ids = common.materialize(_keyed(reps.select("rep", "id", "h").join(numbers.distinct(), "rep", "left_semi")), "minhash-ids")
        asked = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        found = usable.join(asked, _same_row(usable, ids)).select("rep", "text")
        found = found.mapInPandas(_shingle, "rep bigint, shingles binary, counts binary")
        if repeated:
            found = found.groupBy("rep").agg(F.first("shingles").alias("shingles"), F.first("counts").alias("counts"))
        found = common.materialize(found, "minhash-shingles")
        common.discard(ids)
        return found

    def verify(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
        both = pairs.join(side(shingles, "a", ["shingles", "counts"]), "a").join(side(shingles, "b", ["shingles", "counts"]), "b")
        return common.materialize(both.mapInPandas(_verify(similarity), "a bigint, b bigint"), "minhash-links")

    pairs = common.materialize(_leader_pairs(_open_buckets(reps, None, LEAD_BANDS)), "minhash-pairs")
    sketches = reps.select("rep", "sketch")
    both = pairs.join(side(sketches, "a", ["sketch"]), "a").join(side(sketches, "b", ["sketch"]), "b")
    both = common.materialize(both.mapInPandas(_alike(similarity), "a bigint, b bigint"), "minhash-alike")
    shingles = shingles_of(both.select(F.explode(F.array("a", "b")).alias("rep")))
    links = verify(both, shingles)
    common.discard(pairs, shingles)
    tested = [both]
    comps = common.connected_components(links, "a", "b")
    open_ = common.materialize(_open_buckets(reps, comps, BANDS), "minhash-open")
    shingles = shingles_of(open_.select("rep"))
    texts = sketches.join(shingles, "rep").select("rep", "sketch", "shingles", "counts")
    for across in (False, True):
        pairs = _block_pairs(open_, texts, comps, similarity, across)
        for done in tested:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        tested.append(common.materialize(pairs, "minhash-pairs"))
        links = links.unionByName(verify(tested[-1], shingles))
        comps = common.connected_components(links, "a", "b")
    common.discard(open_, shingles, *tested)
    placed = reps.select("digest", "rep", "id").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    joined = placed.where("component is not null")
    lowest = joined.groupBy("component").agg(F.min("id").alias("class_id"))
    of_text = joined.join(lowest, "component").select("digest", F.col("component").alias("cls"), "class_id")
    of_text = of_text.unionByName(placed.where("component is null").select("digest", F.col("rep").alias("cls"), F.col("id").alias("class_id")))
    return signed.select("id", "h", "digest").join(of_text, "digest").select("id", "h", "cls", "class_id")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id_col, class_id): the smallest id reachable over pairs of texts alike to ``similarity``.

    Words are runs of letters and digits, A-Z lower-cased. Texts without words (null, empty) and
    rows without id are classes of their own. Rows that share an id each have the smallest class of
    that id's texts. Integer ids; an empty table gives no rows; other columns are ignored. A pair is
    found with the probability of the bands: 0.9999 at the threshold, more above it.
    """
    rows = _rows(docs, id_col, text_col)
    of_id = _classes_of_rows(rows, similarity).groupBy("id").agg(F.min("class_id").alias("class_id"))
    out = rows.select("id").join(of_id, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"))


def _open_buckets(reps: DataFrame, comps: DataFrame | None, bands: int) -> DataFrame:
    """(key, rep, comp, n) of the buckets of the first bands whose members lie in more classes than one."""
    rows = reps.select("rep", F.slice("bands", 1, bands).alias("bands"))
    if comps is None:
        rows = rows.withColumn("comp", F.col("rep"))
    else:
        rows = rows.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    placed = rows.select("rep", "comp", F.explode("bands").alias("key"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    return placed.join(mixed.select("key", "n"), "key").select("key", "rep", "comp", "n")


def _leader_pairs(open_: DataFrame) -> DataFrame:
    """Each member with the leader of its bucket."""
    mark = F.struct(F.xxhash64("rep").alias("h"), "rep")
    lead = open_.groupBy("key").agg(F.min(mark).alias("lead"))
    both = open_.join(lead, "key").select("rep", F.col("lead.rep").alias("lead")).where("rep <> lead")
    return both.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()


def _least_agreement(similarity: float) -> float:
    return similarity - SIGMAS * (similarity * (1 - similarity) / REGISTERS) ** 0.5


class _Block:
    """Members of a bucket in one task, with packed incidence of their shingles where that is small."""

    def __init__(self, rows: pd.DataFrame, sketch: np.ndarray):
        self.rep, self.comp, self.part = (rows[c].to_numpy() for c in ("rep", "comp", "part"))
        self.split = rows["i"].iloc[0] != rows["j"].iloc[0]
        self.sketch, self.plain = sketch, rows["counts"].isna().to_numpy()
        self.shingles = [np.frombuffer(b, np.uint64) for b in rows["shingles"]]
        self.sizes = np.array([len(x) for x in self.shingles])
        self.counts = rows["counts"].tolist()
        self.totals = np.array([n if c is None else int(np.frombuffer(c, "<u4").sum()) for c, n in zip(self.counts, self.sizes, strict=True)])
        self.bits = None

    def candidates(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions of pairs of different classes whose signatures agree, the best first."""
        found = []
        for s in range(0, len(self.rep), 64):
            t = slice(s, s + 64)
            once = (self.part[t][:, None] < self.part[None]) if self.split else (self.rep[t][:, None] < self.rep[None])
            i, j = np.nonzero((self.comp[t][:, None] != self.comp[None]) & once)
            for k in range(0, len(i), 30_000):
                a, b = s + i[k : k + 30_000], j[k : k + 30_000]
                agree = (self.sketch[a] == self.sketch[b]).mean(1)
                found.append((agree[agree >= least], a[agree >= least], b[agree >= least]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        agree, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(-agree, kind="stable")
        return a[order], b[order]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common shingles of each pair."""
        if self.bits is None:
            every, at = np.unique(np.concatenate(self.shingles), return_inverse=True)
            words = -(-len(every) // 64)
            if words * len(self.rep) <= DENSE_WORDS:
                self.bits = np.zeros((len(self.rep), words), np.uint64)
                ends = self.sizes.cumsum()
                for r, end in enumerate(ends):
                    row = np.zeros(words * 64, bool)
                    row[at[end - self.sizes[r] : end]] = True
                    self.bits[r] = np.packbits(row).view(np.uint64)
            else:
                self.bits = False
        if self.bits is False:
            return np.array([len(np.intersect1d(self.shingles[x], self.shingles[y], assume_unique=True)) for x, y in zip(a, b, strict=True)])
        step = max(1, 2_000_000 // self.bits.shape[1])
        return np.concatenate([np.bitwise_count(self.bits[a[k : k + step]] & self.bits[b[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(a), step)])

    def alike(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Whether pairs reach the similarity, exactly."""
        n = self.shared(a, b)
        out = n >= (similarity - 1e-12) * (self.sizes[a] + self.sizes[b] - n)
        # where shingles repeat in a text, what only one text holds bounds the similarity from above
        weighted = ~(self.plain[a] & self.plain[b])
        bound = 1 - np.maximum((self.sizes[a] - n) / self.totals[a], (self.sizes[b] - n) / self.totals[b])
        out[weighted] = False
        for k in np.flatnonzero(weighted & (bound >= similarity - 1e-12)).tolist():
            x, y = a[k], b[k]
            u, v = self.shingles[x], self.shingles[y]
            out[k] = probability_jaccard(u, _weights(self.counts[x], len(u)), v, _weights(self.counts[y], len(v))) >= similarity - 1e-12
        return out


def _compare(similarity: float):
    least = _least_agreement(similarity)

    def pairs_of(block: _Block) -> list[tuple[int, int]]:
        a, b = block.candidates(least)
        if not len(a):
            return []
        _, root = np.unique(block.comp, return_inverse=True)
        out = []
        for k in range(0, len(a), 512):
            i, j = a[k : k + 512], b[k : k + 512]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            if not len(i):
                continue
            good = block.alike(i, j, similarity)
            for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
                if root[x] == root[y]:
                    continue
                root[root == root[y]] = root[x]
                out.append((min(block.rep[x], block.rep[y]), max(block.rep[x], block.rep[y])))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by block, so a block is whole once the next one begins."""
        held = None
        for pdf in itertools.chain(batches, [None]):
            rows = [x for x in (held, pdf) if x is not None and len(x)]
            if not rows:
                continue
            rows = pd.concat(rows, ignore_index=True)
            ids = rows[["key", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(1)])
            ends = np.r_[starts[1:], len(rows)]
            if pdf is not None:  # the last block may go on
                held = rows.iloc[starts[-1] :]
                starts, ends = starts[:-1], ends[:-1]
            comp = rows["comp"].to_numpy()
            sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), REGISTERS)
            out: set[tuple[int, int]] = set()
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b - a > 1 and (comp[a:b] != comp[a]).any():
                    out.update(pairs_of(_Block(rows.iloc[a:b], sketch[a:b])))
            if out:
                yield pd.DataFrame(sorted(out), columns=["a", "b"])

    return run


def _block_pairs(open_: DataFrame, texts: DataFrame, comps: DataFrame, similarity: float, across: bool) -> DataFrame:
    """(a, b): pairs that join classes, of texts that share a bucket; within its blocks, or across them.

    Across, a bucket's largest class needs no comparing with itself: its members go to the blocks of
    the others (outsiders) only, the outsiders to all blocks. Buckets of one block are done by then.
    """
    now = open_.drop("comp").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    spot = F.xxhash64("rep", "key")
    blocks = lambda n: F.ceil(n / BLOCK_TEXTS).cast("int")
    if across:
        now = now.where(F.col("n") > BLOCK_TEXTS)
        sizes = now.groupBy("key", "comp").agg(F.count("*").alias("n"))
        top = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("classes")).where("classes > 1")
        now = now.join(top.select("key", "top", (F.col("all") - F.col("top.n")).alias("out")), "key")
        p, q = blocks(F.col("top.n")), blocks(F.col("out"))
        inside = F.col("comp") == F.col("top.comp")
        # parts of the largest class come first, then those of the outsiders
        part = F.when(inside, F.pmod(spot, p)).otherwise(p + F.pmod(spot, q)).cast("int")
        other = F.explode(F.when(inside, F.sequence(p, p + q - 1)).otherwise(F.sequence(F.lit(0), p + q - 1)))
    else:
        part = other = F.pmod(spot, blocks(F.col("n"))).cast("int")
    rows = now.join(texts, "rep").select("key", "rep", "comp", "sketch", "shingles", "counts", part.alias("part"), other.alias("other"))
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "comp", "sketch", "shingles", "counts")
    dealt = common.spread(rows, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(_compare(similarity), "a bigint, b bigint").distinct()


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of every row, and whether the row is the one that stays; a row without id stays."""
    return classes(docs, id_col, text_col).withColumn("kept", F.coalesce(F.col("class_id") == F.col(id_col), F.lit(True)))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of texts, one with the smallest id; columns stay as they were.

    Decided by row and text: rows that share an id but not a class all stay. Rows without id or words
    (null or empty texts) stay. Of rows with the same id and text one is kept, whichever.
    """
    key = ["id", "h"]
    rows = docs.select(common.boxed(docs), F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    placed = _classes_of_rows(_rows(docs, id_col, text_col), similarity)
    placed = common.materialize(placed.groupBy(*key).agg(F.first("cls").alias("cls"), F.count("*").alias("n")), "minhash-placed")
    best = placed.groupBy("cls").agg(F.min(F.struct("id", "h", "n")).alias("b")).select("b.*")
    best = common.materialize(best, "minhash-kept")

    def few(t: DataFrame) -> DataFrame:
        return F.broadcast(t) if t.count() <= BROADCAST_IDS else t

    gone = common.materialize(_keyed(placed.select(*key).join(best, key, "left_anti")), "minhash-gone")
    kept = rows.join(few(gone), _same_row(rows, gone), "left_anti")
    repeated = best.where("n > 1").select(*key)
    if not repeated.isEmpty():
        repeated = few(repeated)
        once = kept.join(repeated, key, "left_semi").groupBy(*key).agg(F.first("row").alias("row"))
        kept = kept.join(repeated, key, "left_anti").select("row").unionByName(once.select("row"))
    return common.unboxed(kept, docs.columns)
