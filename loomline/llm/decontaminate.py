"""Benchmark decontamination with a generalised suffix automaton of the normalised items.

The automaton is built over the words of all items of a block. Each text streams its words through
it; the length of the longest match ending at each word says which windows occur. Where the items
make several blocks, one automaton after another is built, broadcast, matched and dropped again, so
neither the driver nor a worker ever holds more than one.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW_WORDS = 13
#: Words of one block of items, so of one automaton; further items make further blocks.
BLOCK_WORDS = 200_000
COVERAGE = 20
#: Words of a span that may stay in a text that isn't contaminated.
LONGEST = 50

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of letters, digits and all characters beyond ASCII, A-Z lower-cased, as UTF-8."""
    return text.translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items of every window state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW_WORDS):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.link, self.length, self.next = [-1], [0], [{}]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        n = len(self.link)
        holders: list[set[str | None]] = [set() for _ in range(n)]
        short: list[list[tuple[int, str | None]]] = [[] for _ in range(n)]
        for name, seq in coded:
            v = 0
            for c in seq:
                v = self.next[v][c]
                u = v
                while u > 0 and self.length[u] >= window and name not in holders[u]:
                    holders[u].add(name)
                    u = self.link[u]
            if len(seq) < window:
                short[v].append((len(seq), name))
        order = sorted(range(1, n), key=self.length.__getitem__)
        top = [0] * n
        for v in order:
            up = self.link[v]
            top[v] = top[up] if self.length[up] >= window else v
            short[v] = short[v] + short[up]
        self.window_items = {v: frozenset(holders[top[v]]) for v in order if self.length[v] >= window}
        self.short_items = {v: tuple(short[v]) for v in order if short[v]}

    def _extend(self, last: int, c: int) -> int:
        link, length, nxt = self.link, self.length, self.next
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, c)
        cur = len(link)
        link.append(0), length.append(length[last] + 1), nxt.append({})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        link, length, nxt = self.link, self.length, self.next
        new = len(link)
        link.append(link[q]), length.append(length[p] + 1), nxt.append(dict(nxt[q]))
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words (end exclusive), and the items with occurring windows; a hit of an
        item without a name counts, but isn't named."""
        link, length, nxt, window, shorts = self.link, self.length, self.next, self.window, self.short_items
        spans: list[list[int]] = []
        items: set[str | None] = set()
        v = matched = 0
        for j, c in enumerate(map(self.ids.get, words)):
            if c is None:
                v = matched = 0
                continue
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            if c not in nxt[v]:
                matched = 0
                continue
            v = nxt[v][c]
            matched += 1
            first = j + 1
            if matched >= window:
                items |= self.window_items[v]
                first = j + 1 - window
            if v in shorts:
                for size, name in shorts[v]:
                    if size <= matched:
                        items.add(name)
                        first = min(first, j + 1 - size)
            if first <= j:
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append([first, j + 1])
        items.discard(None)
        return [(a, b) for a, b in spans], items


_SPANS = "array<struct<a:bigint,b:bigint>>"
_FOUND = f"struct<n:bigint,spans:{_SPANS},items:array<string>>"


def _scanner(spark: SparkSession, block: list[tuple[str | None, list[bytes]]], window: int):
    """(function of a text column to its words, spans and items; the broadcast automaton)."""
    shared = spark.sparkContext.broadcast(SuffixAutomaton(block, window))
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    kind = pa.struct([("n", pa.int64()), ("spans", span), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        auto = shared.value
        for texts in batches:
            found = []
            for text in texts.cast(pa.binary()):
                words = words_of(text.as_py() or b"")
                spans, items = auto.scan(words)
                found.append({"n": len(words), "spans": [{"a": a, "b": b} for a, b in spans], "items": sorted(items)})
            yield pa.array(found, kind)

    return F.arrow_udf(run, _FOUND), shared


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Distinct items by block, one block at a time on the driver; at least one block, maybe empty.

    An item is whole in one block, so a block has about ``block_words`` words or one item's.
    """
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).distinct()
    # a word has a character and a gap at least
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (2 * block_words)))
    if n > 1:  # written once, by block, so that each block is read alone
        path = common.fresh_path(items.sparkSession, "decontaminate-items")
        placed = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
        common.spread(placed, "block").write.partitionBy("block").parquet(path)
        placed = items.sparkSession.read.schema("id string, text string, block bigint").parquet(path)
    for k in range(n):
        own = placed.where(F.col("block") == k) if n > 1 else rows
        yield [(r["id"], words_of(r["text"].encode())) for r in own.toLocalIterator()]


def _match(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, block_words: int) -> DataFrame:
    """(row, text, n, spans, items) of each row of docs, boxed."""
    spark = docs.sparkSession
    rows = docs.select(common.boxed(docs), F.col(f"`{text_col}`").alias("text"))
    blocks = _blocks(items, item_col, item_text_col, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        scan, _ = _scanner(spark, first, window)
        return rows.withColumn("found", scan("text")).select("row", "text", "found.n", "found.spans", "found.items")
    # numbered once and written, as a number made anew could differ
    rows = common.materialize(rows.withColumn("at", F.monotonically_increasing_id()), "decontaminate-rows")
    parts = []
    for block in itertools.chain([first, second], blocks):
        scan, shared = _scanner(spark, block, window)
        found = rows.select("at", scan("text").alias("found")).select("at", "found.*")
        # every row once, for its words; after that only rows with hits
        parts.append(common.materialize(found if not parts else found.where("size(spans) > 0"), "decontaminate-hits"))
        shared.destroy()
    every = functools.reduce(DataFrame.unionByName, parts)
    merged = every.groupBy("at").agg(
        F.max("n").alias("n"),
        common.joined_spans(F.array_sort(F.flatten(F.collect_list("spans"))), "a", "b").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return rows.join(merged, "at").select("row", "text", "n", "spans", "items")


def match(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id_col, n_words, spans, items): hit word spans and the items with occurring windows.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is
    one window. Null and empty texts have no words and no hits. Items without words match nothing;
    windows of items without id count as hits, but no item is named for them. An item id on several
    rows has the windows of all of them. Repeated rows each get a row; other columns are ignored.
    No rows give no rows; without items nothing is hit.

    Items are read in blocks of at most about ``block_words`` words, each with an automaton of its
    own that is broadcast; more blocks than one are scanned one after another and merged by row.
    """
    found = _match(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), items, "text", item_col, item_text_col, window, block_words)
    return found.select(F.col("row.c0").alias(id_col), F.col("n").alias("n_words"), "spans", "items")


def _n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["b"] - s["a"])


def _contaminated(n_hit: Column, n: Column, coverage: int) -> Column:
    """Hit words make up a ``1 / coverage`` share of the text or more."""
    return (n_hit > 0) & (coverage * n_hit >= n)


def judge(matched: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """Adds n_hit and contaminated; a text without hits isn't."""
    out = matched.withColumn("n_hit", _n_hit())
    return out.withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words"), coverage))


def _too_much(spans: Column, contaminated: Column, longest: int) -> Column:
    """The spans that exceed a limit: those of over ``longest`` words, or all of a contaminated text."""
    return F.filter(spans, lambda s: contaminated | (s["b"] - s["a"] > longest))


def digest(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and hashes of what each text shares with the items, a row for each row.

    ``n_removed``: words that ``remove_spans`` would take.
    """
    out = judge(match(docs, items, id_col))
    cut = _too_much(F.col("spans"), F.col("contaminated"), LONGEST)
    return out.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
        F.aggregate(cut, F.lit(0).cast("bigint"), lambda acc, s: acc + s["b"] - s["a"]).alias("n_removed"),
    )


def _excise(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the characters from the first to the last word of each span."""

    def cut(text: str | None, own: list) -> str | None:
        if text is None or not len(own):
            return text
        places = [m.span() for m in _WORD.finditer(text)]
        kept, at = [], 0
        for s in own:
            kept.append(text[at : places[s["a"]][0]])
            at = places[s["b"] - 1][1]
        return "".join(kept) + text[at:]

    return pd.Series([cut(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)


def remove_spans(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    longest: int = LONGEST,
    coverage: int = COVERAGE,
    window: int = WINDOW_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows with hit spans of over ``longest`` words cut out, and all hit spans of texts whose
    hits reach the coverage limit. Columns, rows and null texts stay as they are.
    """
    found = _match(docs, items, text_col, item_col, item_text_col, window, block_words)
    cut = _too_much(F.col("spans"), _contaminated(_n_hit(), F.col("n"), coverage), longest)
    return common.unboxed(found.select("row", F.pandas_udf(_excise, "string")("text", cut).alias("text")), docs.columns, **{text_col: F.col("text")})


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows whose text isn't contaminated, with their columns as they were.

    Decided row by row, so rows that share an id are judged apart; null and empty texts stay.
    """
    found = _match(docs, items, text_col, item_col, item_text_col, WINDOW_WORDS, block_words)
    return common.unboxed(found.where(~_contaminated(_n_hit(), F.col("n"), COVERAGE)), docs.columns)
