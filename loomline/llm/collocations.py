"""Phrase collocations by weighted acyclic automata.

Every task reads its texts in slices and builds, from the slice's sorted n-grams, an automaton that
counts them: one path for each n-gram, paths with equal beginnings shared, a weight at the end of
each. An automaton is cut into the ranges of its prefixes, so that the parts of all slices that
belong to a range meet in one task, where their union sums the weights. Counts of a phrase's parts
come from composing its path with these automata: the beginning of a phrase lies on its own path,
the rest is looked up in the range it belongs to.

Words are known by 64-bit hashes, made for a whole slice at once; their strings travel with the
automata of single words, where two words of one hash would be seen (the run then starts again with
another seed). Of three words only those are counted whose two halves are frequent: the frequent
pairs go into a Bloom filter of bounded size, which may let others pass, never loses one, and the
counts themselves are exact.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_COUNT = 10
TOP = 2_000
COVER_PERCENT = 50
UNKNOWN_LANG = "und"
#: Bytes of text in a slice of one language; a task holds two.
SLICE_BYTES = 4 << 20
#: Bytes that are hashed at a time.
STEP_BYTES = 1 << 18
#: Bytes of text for each range of prefixes.
RANGE_BYTES = 8 << 20
#: Largest Bloom filter, in bits; 16 bits for each frequent pair until then.
FILTER_BITS = 1 << 27
FILTER_CHUNK = 1 << 16
#: Longer words are hashed one by one.
LONG_WORD = 256

_WORD, _GAP, _STOP = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _GAP
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _STOP
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers up to the n-th and those of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.empty(n + 1, np.uint64)
        p[0], filled = 1, 1
        while filled <= n:
            more = min(filled, n + 1 - filled)
            p[filled : filled + more] = p[:more] * _U(pow(base, filled, 1 << 64))
            filled += more
        out.append(p)
    return out[0], out[1]


@functools.lru_cache(maxsize=4)
def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _cuts(text: bytes) -> list[int]:
    """Where a text is cut for hashing: behind a separator each, so no word is cut."""
    edges = [0]
    while len(text) - edges[-1] > STEP_BYTES:
        at = edges[-1]
        end = max(text.rfind(b" ", at, at + STEP_BYTES), text.rfind(b"\n", at, at + STEP_BYTES)) + 1
        if end <= at:
            ends = [e for e in (text.find(b" ", at), text.find(b"\n", at)) if e >= 0]
            end = min(ends) + 1 if ends else len(text)
        edges.append(end)
    return edges if edges[-1] == len(text) else [*edges, len(text)]


class Words:
    """The words of a slice in order: their hashes, and whether each goes on in the piece of the one before.

    ``distinct``: sorted hashes; ``at``: each word's place among them; ``strings()``: their bytes.
    """

    def __init__(self, text: bytes, seed: int):
        table, hashes, joined, starts, sizes = _letters(seed), [], [], [], []
        text = text.translate(_LOWER)
        edges = _cuts(text)
        carry = _STOP
        for a, b in zip(edges, edges[1:], strict=False):
            x = np.frombuffer(text, np.uint8, b - a, a)
            kind = _KIND[x]
            word = np.zeros(len(x) + 2, np.int8)
            word[1:-1] = kind == _WORD
            flank = np.diff(word)
            first, last = np.flatnonzero(flank == 1), np.flatnonzero(flank == -1)
            up, down = _powers(STEP_BYTES if len(x) <= STEP_BYTES else 1 << len(x).bit_length())
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(table[x] * up[: len(x)], out=total[1:])
            h = _mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * _U(_BASE))
            for i in np.flatnonzero(last - first > LONG_WORD):
                import xxhash

                h[i] = xxhash.xxh64_intdigest(text[a + first[i] : a + last[i]], seed)
            # a word goes on in its piece if no stop lies between it and the word before
            stops = np.concatenate([[0], np.cumsum(kind == _STOP)])
            before = np.concatenate([[0], last[:-1]]) if len(first) else first
            goes_on = stops[first] == stops[before]
            if len(goes_on):
                goes_on[0] &= carry != _STOP
                carry = _STOP if stops[-1] > stops[last[-1]] else _GAP
            elif stops[-1]:
                carry = _STOP
            hashes.append(h)
            joined.append(goes_on)
            starts.append(first + a)
            sizes.append(last - first)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self._text = text
        self._starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self._sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.joined = np.concatenate(joined) if joined else np.zeros(0, bool)
        self.distinct, self._firsts, self.at = np.unique(every, return_index=True, return_inverse=True)

    def strings(self, which: np.ndarray) -> bytes:
        """The distinct words at these places, each on a line."""
        first = self._firsts[which]
        return b"\n".join([self._text[s : s + n] for s, n in zip(self._starts[first].tolist(), self._sizes[first].tolist(), strict=True)])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(firsts, seconds, counts) of the distinct pairs in order, and each position's pair (-1: none)."""
        v = len(self.distinct)
        if len(self.at) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(max(0, len(self.at) - 1), -1)
        ok = self.joined[1:]
        keys, at, n = np.unique(self.at[:-1][ok] * v + self.at[1:][ok], return_inverse=True, return_counts=True)
        where = np.full(len(ok), -1)
        where[ok] = at
        return keys // v, keys % v, n, where


class Automaton:
    """An acyclic automaton over word hashes with a weight at the end of each path.

    ``levels``: for each depth the labels of the arcs in order, and how many arcs go on from each.
    """

    def __init__(self, levels: list[np.ndarray], fan_out: list[np.ndarray], weights: np.ndarray):
        self.levels, self.fan_out, self.weights = levels, fan_out, weights

    @classmethod
    def of_sorted(cls, columns: list[np.ndarray], weights: np.ndarray) -> Automaton:
        """From distinct n-grams in order: a new arc wherever the beginning differs from the one before."""
        levels, fan_out = [], []
        new = np.zeros(len(weights), bool)
        new[:1] = True
        starts = []
        for c in columns:
            new = new.copy()
            new[1:] |= c[1:] != c[:-1]
            starts.append(np.flatnonzero(new))
            levels.append(c[starts[-1]])
        for upper, lower in zip(starts, starts[1:], strict=False):
            fan_out.append(np.diff(np.append(np.searchsorted(lower, upper), len(lower))))
        return cls(levels, fan_out, weights)

    def paths(self) -> list[np.ndarray]:
        """The n-grams again, a column for each word."""
        out = list(self.levels)
        for depth in range(len(out) - 1):
            for lower in range(depth, len(self.fan_out)):
                out[depth] = np.repeat(out[depth], self.fan_out[lower])
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes()
        # a byte for each weight; 255 stands for a larger one, which follows behind all in eight
        w = self.weights
        weights = np.minimum(w, 255).astype(np.uint8).tobytes() + w[w >= 255].astype("<u8").tobytes()
        return b"".join([head, *(x.astype("<u8").tobytes() for x in self.levels), *(x.astype("<u4").tobytes() for x in self.fan_out), weights])

    @classmethod
    def unpack(cls, b: bytes) -> Automaton:
        depth = int(np.frombuffer(b, "<u4", 1)[0])
        sizes = np.frombuffer(b, "<u4", depth, 4).tolist()
        at, levels, fan_out = 4 + 4 * depth, [], []
        for n in sizes:
            levels.append(np.frombuffer(b, "<u8", n, at).astype(np.uint64))
            at += 8 * n
        for n in sizes[:-1]:
            fan_out.append(np.frombuffer(b, "<u4", n, at).astype(np.int64))
            at += 4 * n
        weights = np.frombuffer(b, np.uint8, sizes[-1], at).astype(np.int64)
        large = weights == 255
        weights[large] = np.frombuffer(b, "<u8", int(large.sum()), at + sizes[-1])
        return cls(levels, fan_out, weights)

    def weight_of(self, columns: list[np.ndarray]) -> np.ndarray:
        """Weights of these paths; 0 for one that the automaton doesn't have."""
        lo, hi = np.zeros(len(columns[0]), np.int64), np.full(len(columns[0]), len(self.levels[0]), np.int64)
        spot = lo
        for depth, label in enumerate(columns):
            arcs = self.levels[depth]
            spot, end = lo.copy(), hi.copy()
            while (open_ := spot < end).any():
                mid = (spot + end) // 2
                less = open_ & (arcs[np.minimum(mid, len(arcs) - 1)] < label)
                spot = np.where(less, mid + 1, spot)
                end = np.where(open_ & ~less, mid, end)
            found = (spot < hi) & (arcs[np.minimum(spot, len(arcs) - 1)] == label) if len(arcs) else np.zeros(len(label), bool)
            if depth < len(self.fan_out):
                edges = np.concatenate([[0], np.cumsum(self.fan_out[depth])])
                lo, hi = np.where(found, edges[np.where(found, spot, 0)], 0), np.where(found, edges[np.where(found, spot, 0) + 1], 0)
            else:
                return np.where(found, self.weights[np.where(found, spot, 0)] if len(self.weights) else 0, 0)
        raise ValueError("paths are shorter than the automaton's")

    @classmethod
    def union(cls, some: list[Automaton]) -> Automaton:
        """All paths of some automata of one depth; weights of equal paths are summed."""
        paths = [a.paths() for a in some]
        columns = [np.concatenate(c) for c in zip(*paths, strict=True)]
        weights = np.concatenate([a.weights for a in some])
        key = None
        parts = []
        for c in columns:
            labels, at = np.unique(c, return_inverse=True)
            key = at.astype(np.int64) if key is None else key * len(labels) + at
            # numbers are made dense again, so that they never pass 64 bits
            _, key = np.unique(key, return_inverse=True)
            parts.append(c)
        n = int(key.max()) + 1 if len(key) else 0
        first = np.zeros(n, np.int64)
        first[key] = np.arange(len(key))
        summed = np.zeros(n, np.int64)
        np.add.at(summed, key, weights)
        return cls.of_sorted([c[first] for c in parts], summed)

    def at_least(self, n: int) -> Automaton:
        keep = self.weights >= n
        return self.of_sorted([c[keep] for c in self.paths()], self.weights[keep])


def _range_of(first: np.ndarray, second: np.ndarray | None, bits: int) -> np.ndarray:
    """The range of a path's beginning: the first bits of the first word and, with pairs, of the second one.

    So the paths of a very common word lie in many ranges.
    """
    own = bits if second is None else bits - bits // 2
    out = (first >> _U(64 - own)).astype(np.int64) if own else np.zeros(len(first), np.int64)
    if second is not None and bits // 2:
        out = (out << (bits // 2)) | (second >> _U(64 - bits // 2)).astype(np.int64)
    return out


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    edges = np.flatnonzero(np.diff(keys, prepend=-1)).tolist()
    return list(zip(edges, [*edges[1:], len(keys)], strict=True)) if edges else []


def _ranged(lang: str, order: int, columns: list[np.ndarray], n: np.ndarray, bits: int, words: Words | None = None) -> Iterator[tuple]:
    """Rows of an automaton cut by ranges: (lang, order, range, automaton, words)."""
    spot = _range_of(columns[0], columns[1] if order > 1 else None, bits)
    by = np.argsort(spot, kind="stable")
    for a, b in _runs(spot[by]):
        own = by[a:b]
        strings = words.strings(own) if words is not None else None
        yield lang, order, int(spot[own[0]]), Automaton.of_sorted([c[own] for c in columns], n[own]).pack(), strings


_ROWS = "lang string, n_words int, range int, automaton binary, words binary"
_ROW_TYPE = pa.schema([("lang", pa.string()), ("n_words", pa.int32()), ("range", pa.int32()), ("automaton", pa.binary()), ("words", pa.binary())])


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """The texts of a task by language, in slices; a text's end is a stop."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            raw = text.as_buffer() if text.is_valid else None
            if not raw:
                continue
            held.setdefault(lang, []).append(raw.to_pybytes())
            sizes[lang] = sizes.get(lang, 0) + raw.size
            if sizes[lang] >= size or sum(sizes.values()) >= 2 * size:
                lang = max(sizes, key=sizes.__getitem__)
                sizes.pop(lang)
                yield lang, b"\n".join(held.pop(lang))
    for lang in list(held):
        yield lang, b"\n".join(held.pop(lang))


def _release() -> None:
    """Hand freed memory back to the system: a worker lives on, and what it has freed would count on."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_ROW_TYPE.names, r, strict=True)) for r in rows], _ROW_TYPE)


def _count_pairs(bits: int, seed: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _slices(batches, size):
            words = Words(text, seed)
            if not len(words.at):
                continue
            yield _batch(list(_ranged(lang, 1, [words.distinct], np.bincount(words.at), bits, words)))
            one, two, n, _ = words.pairs()
            rows = list(_ranged(lang, 2, [words.distinct[one], words.distinct[two]], n, bits)) if len(n) else []
            del text, words, one, two
            if rows:
                yield _batch(rows)
            del rows
            _release()

    return run


def _count_triples(bits: int, seed: int, size: int, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = np.frombuffer(held.value, np.uint8)
        for lang, text in _slices(batches, size):
            words = Words(text, seed)
            one, two, _, where = words.pairs()
            if len(where) < 2:
                continue
            h = words.distinct
            frequent = _in_filter(bloom, _pair_code(lang, h[one], h[two]))
            ok = np.append(frequent, False)[where]
            spots = np.flatnonzero(ok[:-1] & ok[1:])
            keys, n = np.unique(where[spots] * len(h) + words.at[spots + 2], return_counts=True)
            pair = keys // max(1, len(h))
            rows = list(_ranged(lang, 3, [h[one[pair]], h[two[pair]], h[keys % max(1, len(h))]], n, bits)) if len(n) else []
            del text, words, one, two, where, frequent, ok, spots, h
            if rows:
                yield _batch(rows)
            del rows
            _release()

    return run


def _union(least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, order, spot = pdf["lang"].iloc[0], int(pdf["n_words"].iloc[0]), int(pdf["range"].iloc[0])
        parts = [Automaton.unpack(b) for b in pdf["automaton"]]
        whole = Automaton.union(parts)
        total, clash, words = 0, False, None
        if order == 1:
            total = int(whole.weights.sum())
            names: dict[int, bytes] = {}
            for part, strings in zip(parts, pdf["words"], strict=True):
                for h, w in zip(part.levels[0].tolist(), strings.split(b"\n"), strict=True):
                    clash |= names.setdefault(h, w) != w
        kept = whole.at_least(least)
        if order == 1:
            words = b"\n".join(names[h] for h in kept.levels[0].tolist())
        return pd.DataFrame([(lang, order, spot, kept.pack(), words, total, clash, len(kept.weights))], columns=["lang", "n_words", "range", "automaton", "words", "total", "clash", "paths"])

    return run


def _pair_code(lang: str, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    import xxhash

    return _mix(_mix(one + _U(xxhash.xxh64_intdigest(lang.encode()))) * _U(_BASE) + two)


def _filter_bits(code: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(code >> _U(s)) % _U(bits) for s in (0, 31)]


def _in_filter(bloom: np.ndarray, code: np.ndarray) -> np.ndarray:
    ok = np.ones(len(code), bool)
    for b in _filter_bits(code, len(bloom) * 8):
        ok &= (bloom[(b >> _U(3)).astype(np.int64)] >> (b & _U(7)).astype(np.uint8) & 1).astype(bool)
    return ok


def _filter_marks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, packed in zip(b.column("lang").to_pylist(), b.column("automaton").to_pylist(), strict=True):
                one, two = Automaton.unpack(packed).paths()
                spots = np.unique(np.concatenate(_filter_bits(_pair_code(lang, one, two), bits))).astype(np.int64)
                chunk = spots // FILTER_CHUNK
                parts = [(int(chunk[a]), (spots[a:z] % FILTER_CHUNK).astype("<u2").tobytes()) for a, z in _runs(chunk)]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["chunk", "spots"])

    return run


def _filter_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    marks = np.zeros(FILTER_CHUNK, np.uint8)
    marks[np.frombuffer(b"".join(pdf["spots"]), "<u2")] = 1
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bytes": [np.packbits(marks, bitorder="little").tobytes()]})


def _bloom(pairs: DataFrame) -> bytes:
    """The filter of the frequent pairs: at most ``FILTER_BITS``, so at most 16 MB reach the driver."""
    n = pairs.agg(F.coalesce(F.sum("paths"), F.lit(0))).first()[0]
    bits = min(FILTER_BITS, max(FILTER_CHUNK, 1 << (16 * n).bit_length()))
    chunks = pairs.select("lang", "automaton").mapInArrow(_filter_marks(bits), "chunk int, spots binary").groupBy("chunk").applyInPandas(_filter_chunk, "chunk int, bytes binary")
    out = bytearray(bits // 8)
    for row in chunks.toLocalIterator():
        out[row["chunk"] * FILTER_CHUNK // 8 : (row["chunk"] + 1) * FILTER_CHUNK // 8] = row["bytes"]
    return bytes(out)


def _list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, packed, strings in zip(b.column("lang").to_pylist(), b.column("automaton").to_pylist(), b.column("words").to_pylist(), strict=True):
            a = Automaton.unpack(packed)
            if len(a.weights):
                words = [w.decode("utf-8", "replace") for w in strings.split(b"\n")]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(a.levels[0].view(np.int64)), pa.array(words), pa.array(a.weights)], ["lang", "h", "word", "n"])


def _list_triples(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each of the two pairs in a triple, dealt to the pair's range."""
        for b in batches:
            for lang, packed in zip(b.column("lang").to_pylist(), b.column("automaton").to_pylist(), strict=True):
                a = Automaton.unpack(packed)
                one, two, three = a.paths()
                for part, (x, y) in enumerate(((one, two), (two, three))):
                    cols = [pa.array(c.view(np.int64)) for c in (one, two, three)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(x), pa.string()), pa.array(_range_of(x, y, bits), pa.int32()), pa.array([part] * len(x), pa.int32()), *cols, pa.array(a.weights)], ["lang", "range", "part", "h1", "h2", "h3", "a"]
                    )

    return run


def _compose(key: tuple, asked: pd.DataFrame, automata: pd.DataFrame) -> pd.DataFrame:
    """Composition of a range's pairs with the pairs of triples that fall into it.

    Gives the pair's count to each triple (``part`` 0 or 1), and each pair itself (``part`` 2) with the
    count of the most frequent triple that holds it.
    """
    names = ["part", "h1", "h2", "h3", "a", "n"]
    empty = pd.DataFrame({"lang": pd.Series(dtype=str), **{c: pd.Series(dtype="int64") for c in names}})
    if automata.empty:
        return empty
    pairs = Automaton.unpack(automata["automaton"].iloc[0])
    one, two = pairs.paths()
    best = np.zeros(len(one), np.int64)
    out = [pd.DataFrame({"part": 2, "h1": one.view(np.int64), "h2": two.view(np.int64), "h3": 0, "a": pairs.weights, "n": 0})]
    if len(asked):
        h = [asked[c].to_numpy().view(np.uint64) for c in ("h1", "h2", "h3")]
        late = asked["part"].to_numpy() == 1
        x, y = np.where(late, h[1], h[0]), np.where(late, h[2], h[1])
        places = Automaton(pairs.levels, pairs.fan_out, np.arange(1, len(one) + 1))
        spot = places.weight_of([x, y]) - 1
        np.maximum.at(best, spot[spot >= 0], asked["a"].to_numpy()[spot >= 0])
        own = asked[["part", "h1", "h2", "h3", "a"]].copy()
        own["n"] = np.where(spot >= 0, pairs.weights[np.maximum(spot, 0)], 0)
        out.append(own[spot >= 0])
    out[0]["n"] = best
    whole = pd.concat(out, ignore_index=True)
    whole.insert(0, "lang", automata["lang"].iloc[0])
    return whole


def _counted(rows: DataFrame, least: int, label: str) -> DataFrame:
    shape = "lang string, n_words int, range int, automaton binary, words binary, total bigint, clash boolean, paths bigint"
    return common.materialize(rows.groupBy("lang", "n_words", "range").applyInPandas(_union(least), shape), label)


def _cut(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a^2 / (l r)) in decimals of 38 digits; counts are below 10^15."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, cover_percent: int = COVER_PERCENT, slice_bytes: int = SLICE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every collocation of two or three words.

    Null languages are ``und``, null texts are empty. Repeated rows count as often as they come. A
    language without collocations has no rows; no rows give none; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (-(-size // range_bytes) - 1).bit_length())
    for seed in range(8):
        counted = _counted(rows.mapInArrow(_count_pairs(bits, seed, slice_bytes), _ROWS), min_count, "collocation-pairs")
        if not counted.where("clash").take(1):
            break
        common.discard(counted)
    pairs = counted.where("n_words = 2").select("lang", "range", "automaton", "paths")
    held = spark.sparkContext.broadcast(_bloom(pairs))
    triples = _counted(rows.mapInArrow(_count_triples(bits, seed, slice_bytes, held), _ROWS), min_count, "collocation-triples")
    held.unpersist()
    totals = counted.where("n_words = 1").groupBy("lang").agg(F.sum("total").alias("n"))
    words = counted.where("n_words = 1").select("lang", "automaton", "words").mapInArrow(_list_words, "lang string, h bigint, word string, n bigint")
    asked = triples.select("lang", "automaton").mapInArrow(_list_triples(bits), "lang string, range int, part int, h1 bigint, h2 bigint, h3 bigint, a bigint")
    composed = asked.groupBy("lang", "range").cogroup(pairs.groupBy("lang", "range")).applyInPandas(_compose, "lang string, part int, h1 bigint, h2 bigint, h3 bigint, a bigint, n bigint")
    composed = common.materialize(composed, "collocation-parts")
    two = composed.where(f"part = 2 and 100 * n < {cover_percent} * a").select("lang", "h1", "h2", "a")
    three = composed.where("part < 2").groupBy("lang", "h1", "h2", "h3").agg(F.max("a").alias("a"), F.max(F.expr("if(part = 0, n, null)")).alias("n12"), F.max(F.expr("if(part = 1, n, null)")).alias("n23"))

    def named(found: DataFrame, size: int) -> DataFrame:
        for k in range(1, size + 1):
            found = found.join(words.select("lang", F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("n").alias(f"f{k}")), ["lang", f"h{k}"])
        return found.withColumn("phrase", F.concat_ws(" ", *[f"w{k}" for k in range(1, size + 1)]))

    two = named(two, 2).select("lang", "phrase", "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _cut(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    three = named(three, 3).withColumns({"s1": _cut(F.col("a"), F.col("f1"), F.col("n23")), "s2": _cut(F.col("a"), F.col("n12"), F.col("f3"))})
    late = F.col("s2") < F.col("s1")
    three = three.select("lang", "phrase", "a", F.when(late, F.col("n12")).otherwise(F.col("f1")).alias("l"), F.when(late, F.col("f3")).otherwise(F.col("n23")).alias("r"), F.least("s1", "s2").alias("score"))
    out = two.unionByName(three)
    return out.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first by score, count and phrase."""
    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def digest(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best collocations of each language."""
    return ranked(mine(docs, text_col, lang_col))
