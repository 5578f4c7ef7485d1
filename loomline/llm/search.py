"""Exact ranked lexical search by sparse ball trees.

A document's score for an item is an inner product: the weights of the item's terms with a vector of
saturated term frequencies. Documents are read once into sparse vectors over the items' terms. Each
few thousand vectors make a ball tree: every node has the centroid of its vectors and the radius
around it, so that no vector below it can score more than the centroid does plus the radius times
the item's length. An item walks the tree from the node with the highest bound on and stops when no
bound reaches its last kept score; bounds are rounded up by more than their floating-point error.
Leaves are scored in 64-bit integers, so the ranking is exact and ties are real. What a task keeps
for an item goes on to its next tree as the score to beat.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TOP = 50
#: Documents of one tree, and of a leaf (a leaf of equal vectors may hold more).
TREE_DOCS = 8_192
LEAF_DOCS = 48
#: Bytes of item texts that are searched for in one pass over the documents.
ITEM_BYTES = 1 << 20
#: Bytes of text that are split into terms at a time.
STEP_BYTES = 1 << 20
#: Relative margin of a bound; the error of a sum of a million doubles is far below it.
SAFETY = 1e-9

_DELIMITERS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_PLAIN = bytes.maketrans(_DELIMITERS + bytes(range(0x41, 0x5B)), b" " * len(_DELIMITERS) + bytes(range(0x61, 0x7B)))
_NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a list for each step of it."""
    text = text.translate(_PLAIN)
    at = 0
    while len(text) - at > STEP_BYTES:
        end = text.rfind(b" ", at + 1, at + STEP_BYTES)
        end = text.find(b" ", at + STEP_BYTES) if end < 0 else end
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def _bytes_of(value: pa.Scalar) -> bytes:
    raw = value.as_buffer() if value.is_valid else None
    return raw.to_pybytes() if raw else b""


_PACK = "docs binary, sizes binary, starts binary, terms binary, tf binary, df binary, n_docs bigint, n_terms bigint"
_PACK_TYPE = pa.schema([(c, pa.binary()) for c in ("docs", "sizes", "starts", "terms", "tf", "df")] + [("n_docs", pa.int64()), ("n_terms", pa.int64())])


@functools.lru_cache(maxsize=1)
def _numbers(held) -> dict[bytes, int]:
    return {t: i for i, t in enumerate(held.value)}


def _read(held, tree_docs: int):
    """Documents to packs of sparse vectors: (ids, terms in all, and for each of the items' terms how often)."""

    def pack(rows: list[tuple], seen: tuple[int, int]) -> pa.RecordBatch:
        terms = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int64)
        which, df = np.unique(terms, return_counts=True)
        values = {
            "docs": np.array([r[0] for r in rows], "<i8").tobytes(),
            "sizes": np.array([r[1] for r in rows], "<i8").tobytes(),
            "starts": np.cumsum([0, *(len(r[2]) for r in rows)]).astype("<i8").tobytes(),
            "terms": terms.astype("<u4").tobytes(),
            "tf": (np.concatenate([r[3] for r in rows]) if rows else terms).astype("<u4").tobytes(),
            "df": np.concatenate([which, df]).astype("<u4").tobytes(),
        }
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.binary()) for v in values.values()), pa.array([seen[0]]), pa.array([seen[1]])], schema=_PACK_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers(held).get
        rows, n_docs, n_terms = [], 0, 0
        for b in batches:
            for doc, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                size, found = 0, []
                for part in terms_of(_bytes_of(text)):
                    size += len(part)
                    found.append(np.array([i for i in map(number, part) if i is not None], np.int64))
                if not size:
                    continue
                n_docs += 1
                n_terms += size
                terms, tf = np.unique(np.concatenate(found), return_counts=True)
                if len(terms):
                    rows.append((_NO_ID if doc is None else doc, size, terms, tf))
                if len(rows) == tree_docs:
                    yield pack(rows, (n_docs, n_terms))
                    rows, n_docs, n_terms = [], 0, 0
        if n_docs:
            yield pack(rows, (n_docs, n_terms))

    return run


def _list_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for packed in b.column("df").to_pylist():
            which, df = np.frombuffer(packed, "<u4").reshape(2, -1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(df)], ["term", "df"])


class BallTree:
    """Sparse vectors (at least one entry each) in a tree of balls.

    ``order``: the vectors' places so that each node holds a slice; ``nodes``: (first, end, left,
    right) with -1 for a leaf; ``centroids`` and ``radii`` of the nodes.
    """

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int, leaf_docs: int = LEAF_DOCS):
        sizes = np.diff(starts)
        norms = np.add.reduceat(values * values, starts[:-1])
        self.order = np.arange(len(sizes))
        self.nodes: list[list[int]] = []
        centroids, radii = [], []
        waiting = [(0, len(sizes), -1, 0)]
        while waiting:
            first, end, parent, side = waiting.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][2 + side] = me
            docs = self.order[first:end]
            n = sizes[docs]
            heads = n.cumsum() - n
            flat = np.repeat(starts[docs] - heads, n) + np.arange(n.sum())
            t, u = terms[flat], values[flat]
            dots = lambda p, t=t, u=u, heads=heads: np.add.reduceat(u * p[t], heads)
            center = np.bincount(t, u, width) / len(docs)
            far = norms[docs] - 2 * dots(center) + center @ center
            radius = math.sqrt(max(0.0, far.max() + SAFETY * (norms[docs].max() + center @ center)))
            self.nodes.append([first, end, -1, -1])
            centroids.append(center)
            radii.append(radius)
            if len(docs) <= leaf_docs:
                continue
            ends = []
            for _ in range(2):
                pivot = np.zeros(width)
                at = int(far.argmax())
                own = slice(starts[docs[at]], starts[docs[at] + 1])
                pivot[terms[own]] = values[own]
                ends.append(pivot)
                far = norms[docs] - 2 * dots(pivot) + pivot @ pivot
            if far.max() <= SAFETY * norms[docs].max():
                continue  # all alike
            half = len(docs) // 2
            self.order[first:end] = docs[np.argpartition(dots(ends[1] - ends[0]), half)]
            waiting += [(first + half, end, me, 1), (first, first + half, me, 0)]
        self.centroids, self.radii = np.array(centroids), np.array(radii)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node a number that no inner product with a vector below it passes."""
        length = math.sqrt(float(weights @ weights))
        raw = self.centroids[:, terms] @ weights + length * self.radii
        return raw * (1 + SAFETY) + 1


class Found:
    """An item's best documents so far: highest score first, ties by id."""

    def __init__(self, top: int):
        self.top = top
        self.scores = np.zeros(0, np.int64)
        self.docs = np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document needs at least to be kept."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            scores, docs = np.concatenate([self.scores, scores[good]]), np.concatenate([self.docs, docs[good]])
            by = np.lexsort((docs, -scores))[: self.top]
            self.scores, self.docs = scores[by], docs[by]


def values_of(tf: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Saturated frequencies, in 64-bit integers."""
    m = 50 + (50 * sizes * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)


def search_pack(pack: dict, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, found: list[Found], leaf_docs: int = LEAF_DOCS) -> int:
    """Ranks a pack's documents for all items into ``found``; gives the number of leaf scorings."""
    docs, sizes, starts = (np.frombuffer(pack[c], "<i8") for c in ("docs", "sizes", "starts"))
    if not len(docs):
        return 0
    terms, tf = (np.frombuffer(pack[c], "<u4").astype(np.int64) for c in ("terms", "tf"))
    x = values_of(tf, np.repeat(sizes, np.diff(starts)), n_docs, n_terms)
    own, t = np.unique(terms, return_inverse=True)
    root = np.sqrt(weights[own].astype(float))
    tree = BallTree(starts, t, x * root[t], len(own), leaf_docs)
    # the vectors again in the order of the tree
    n = np.diff(starts)[tree.order]
    heads = n.cumsum() - n
    flat = np.repeat(starts[tree.order] - heads, n) + np.arange(n.sum())
    t, x, docs = t[flat], x[flat], docs[tree.order]
    edges = np.append(heads, len(t))
    visited = 0
    weight = np.zeros(len(own), np.int64)
    for wanted, best in zip(items, found, strict=True):
        at = np.searchsorted(own, wanted)
        at = at[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == wanted)]
        if not len(at):
            continue
        weight[at] = weights[own[at]]
        bound = tree.bounds(at, root[at])
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= best.least:
            _, node = heapq.heappop(heap)
            first, end, left, right = tree.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bound[child] >= best.least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            visited += 1
            part = slice(edges[first], edges[end])
            best.add(np.add.reduceat(weight[t[part]] * x[part], edges[first:end] - edges[first]), docs[first:end])
        weight[at] = 0
    return visited


def _search(held, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = held.value
        found = [Found(top) for _ in items]
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                search_pack({c: row.column(c)[0].as_py() for c in ("docs", "sizes", "starts", "terms", "tf")}, items, weights, n_docs, n_terms, found)
        for i, best in enumerate(found):
            if len(best.docs):
                ids = pa.array(best.docs, mask=best.docs == _NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.docs), i)), ids, pa.array(best.scores)], ["item", "doc", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, item_bytes: int = ITEM_BYTES, tree_docs: int = TREE_DOCS) -> DataFrame:
    """(item_col, rank, id_col, score): the ``top`` best documents with a score above 0 of each item.

    Ids of documents are integers; a null one goes last among equal scores. Null texts have no terms
    and are no documents. Repeated rows of documents are each ranked; equal rows of items are one
    item, different texts under one id are ranked apart. Without documents or terms no rows come
    out; other columns are ignored. Items are searched for in blocks of about ``item_bytes``, each
    with one pass over the documents.
    """
    kind = items.schema[item_col].dataType.simpleString()
    asked = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").alias("text")).where("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // item_bytes))
    out = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect() if size else []
        part = _search_block(docs, [(r["item"], r["text"]) for r in own], id_col, text_col, kind, top, tree_docs)
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"item": item_col, "doc": id_col}).select(item_col, "rank", id_col, "score")


def _search_block(docs: DataFrame, own: list[tuple], id_col: str, text_col: str, kind: str, top: int, tree_docs: int) -> DataFrame:
    spark = docs.sparkSession
    split = [sorted({t for part in terms_of(text.encode()) for t in part}) for _, text in own]
    vocabulary = sorted({t for terms in split for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    packs = common.materialize(rows.mapInArrow(_read(spark.sparkContext.broadcast(vocabulary), tree_docs), _PACK), "search-packs")
    facts = packs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_terms")]).first()
    n_docs, n_terms = facts["n_docs"], facts["n_terms"]
    # a number for each term of the block, whose bytes are bounded
    df = np.zeros(len(vocabulary), np.int64)
    for row in packs.select("df").mapInArrow(_list_frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[row["term"]] = row["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    items = [np.array([number[t] for t in terms], np.int64) for terms in split]
    held = spark.sparkContext.broadcast((items, weights))
    found = common.spread(packs.where("length(docs) > 0"), "docs").mapInArrow(_search(held, n_docs, n_terms, top), "item bigint, doc bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(own)], f"n bigint, item {kind}")
    return best.withColumnRenamed("item", "n").join(F.broadcast(names), "n").select("item", "rank", "doc", "score")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each item's best documents."""
    return search(docs, items)
