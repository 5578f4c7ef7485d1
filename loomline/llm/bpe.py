"""Byte-level BPE: overlapping chunks, stitched where pre-token boundaries resynchronise.

A text longer than one chunk is cut into overlapping chunks, which are dealt over the cluster and
pre-tokenised each on its own, in parallel. Two neighbours agree from any boundary that both find
inside their overlap, as a pre-token depends on nothing before its start; there the text is cut.
Where they share none, a place in it where white space follows something else will do, as no
pre-token spans one, whatever came before; without such a place the next chunk goes on in the same
piece. Only offsets are gathered to find the cuts. The pieces are then encoded independently and
their ids joined in order; decoding looks up the raw bytes of the tokens and joins them.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 1_024
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of text that a worker encodes before it hands on what it has.
SLICE_BYTES = 2 << 20
#: Pieces whose places a broadcast may hold (some 100 bytes each); beyond it they are joined by a shuffle.
BROADCAST_PIECES = 200_000
#: White space of this length or more is cut out before the tokenizer's pattern, which can't take a million of it.
LONG_BLANK = 10_000

#: Unicode's White_Space, as the pattern's \s takes it.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SURE = re.compile(f"[^{_WHITE}][{_WHITE}]")
_BLANK = re.compile(f"[{_WHITE}]{{{LONG_BLANK},}}")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Coder:
    """A rank file's tokenizer, and the bytes of all tokens in one array."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        make = functools.partial(tiktoken.Encoding, mergeable_ranks=ranks, special_tokens={})
        self._pattern = make("bytes", pat_str=public_tokenizers.PATTERN).encode_ordinary
        self._make_whole = functools.partial(make, "whole", pat_str=r"(?s:.+)")
        self._whole = None
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self._sizes = np.array([len(t) for t in tokens])
        self._starts = self._sizes.cumsum() - self._sizes
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def ids(self, text: str) -> bytes:
        """Packed ids of a text."""
        out, at = [], 0
        for m in _BLANK.finditer(text) if len(text) >= LONG_BLANK else ():
            # the last blank goes with what follows, if anything does
            end = m.end() if m.end() == len(text) else m.end() - 1
            self._whole = self._whole or self._make_whole().encode_ordinary
            out += [self._pattern(text[at : m.start()]), self._whole(text[m.start() : end])]
            at = end
        out.append(self._pattern(text[at:]))
        return b"".join(np.asarray(x, dtype="<u4").tobytes() for x in out if x)

    def narrow(self, ids: bytes) -> bytes:
        """Packed ids as they are shuffled: in two bytes each, where the vocabulary lets them."""
        return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if len(self._sizes) <= 1 << 16 else ids

    def wide(self, ids: bytes) -> bytes:
        return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(self._sizes) <= 1 << 16 else ids

    def bytes(self, ids: bytes) -> bytes:
        """The raw bytes of packed ids, joined."""
        out = []
        every = np.frombuffer(ids, "<u4")
        for s in range(0, len(every), 65_536):
            part = every[s : s + 65_536]
            sizes = self._sizes[part]
            ends = sizes.cumsum()
            at = np.arange(ends[-1]) + np.repeat(self._starts[part] - (ends - sizes), sizes)
            out.append(self._bytes[at].tobytes())
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def _coder(path: str) -> Coder:
    """The tokenizer of a rank file, built once in each Python worker."""
    return Coder(path)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``SLICE_BYTES`` of a column."""
    sizes = np.array([0 if v is None else v for v in pa.compute.binary_length(batch.column(column)).to_pylist()])
    cut = np.flatnonzero(np.diff(sizes.cumsum() // SLICE_BYTES, prepend=0))
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(sizes)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _add(batch: pa.RecordBatch, names: list[str], drop: str | None = None, **new: pa.Array) -> pa.RecordBatch:
    kept = [n for n in names if n != drop]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *new.values()], [*kept, *new])


def _encode_texts(path: str, decoded: bool):
    """id, text to id, ids and, if asked for, the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for part in (s for b in batches for s in _slices(b, "text")):
            ids = [coder.ids(t.as_py()) for t in part.column("text")]
            new = {"ids": pa.array(ids, pa.binary())}
            if decoded:
                new["bytes"] = pa.array([coder.bytes(x) for x in ids], pa.binary())
            yield _add(part, ["id"], **new)

    return run


def _split(chunk: int, overlap: int):
    """Overlapping chunks of each text."""
    step = chunk - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                text = batch.column("text")[r].as_py()
                starts = range(0, max(1, len(text) - overlap), step)
                for first in range(0, len(starts), 64):
                    part = starts[first : first + 64]
                    own = [pa.concat_arrays([batch.column(c).slice(r, 1)] * len(part)) for c in ("id", "key")]
                    i, at = pa.array(range(first, first + len(part)), pa.int32()), pa.array(part, pa.int64())
                    texts = pa.array([text[s : s + chunk] for s in part], pa.string())
                    yield pa.RecordBatch.from_arrays([*own, i, at, texts], ["id", "key", "i", "start", "text"])

    return run


def boundaries(text: str, at_end: bool) -> list[int]:
    """Starts of the pre-tokens of a chunk that hold whatever follows the chunk.

    The last match may go on behind the chunk, so its end isn't one unless the text ends there; a
    contraction of three characters may be cut by the chunk's end, so starts within it don't count.
    """
    import public_tokenizers
    import regex

    starts = [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)]
    return starts + [len(text)] if at_end else [b for b in starts if b <= len(text) - 3]


def _agreeable(text: str, at: int) -> bool:
    """Whether a boundary may be a cut: white space in front of a cut would be matched as at the end
    of a text, and libraries differ in the classes of newer characters."""
    old = unicodedata.ucd_3_2_0.category
    return 0 < at < len(text) and not text[at - 1].isspace() and "Cn" not in (old(text[at - 1]), old(text[at]))


def _pretokenise(chunk: int, overlap: int):
    """Adds each chunk's boundaries in its overlaps, and ``sync``: the first place where it is in step for sure."""
    step = chunk - overlap
    names = ["id", "key", "i", "start", "text", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for b in batches for s in _slices(b, "text")):
            heads, tails, syncs = [], [], []
            for start, text in zip(part.column("start").to_pylist(), part.column("text").to_pylist(), strict=True):
                found = [b for b in boundaries(text, False) if (b < overlap or b >= step) and _agreeable(text, b)]
                heads.append([start + b for b in found if b < overlap])
                tails.append([start + b for b in found if b >= step])
                sure = _SURE.search(text)
                syncs.append(start + sure.start() + 1 if sure else None)
            places = pa.list_(pa.int64())
            size = pa.compute.utf8_length(part.column("text")).cast(pa.int64())
            yield _add(part, names, heads=pa.array(heads, places), tails=pa.array(tails, places), sync=pa.array(syncs, pa.int64()), size=size)

    return run


def _cuts(marked: DataFrame, overlap: int) -> DataFrame:
    """(key, i, from, to, piece, parts): what of each chunk belongs to which piece of its text.

    A piece reaches from one cut to the next; ``parts`` chunks have a part of it, nearly always one.
    """
    order = Window.partitionBy("key").orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    shared = F.array_intersect("tails", F.lead("heads").over(order))
    rows = marked.select("key", "i", "start", "size", "sync", "tails", "heads").select(
        "key",
        "i",
        "start",
        "sync",
        # the middle one of the agreed boundaries
        F.when(F.size(shared) > 0, F.get(shared, (F.size(shared) / 2).cast("int"))).alias("agreed"),
        F.lead("sync").over(order).alias("next_sync"),
        F.coalesce(F.lead("start").over(order), F.col("start") + F.col("size")).alias("next"),
    )
    # an agreed boundary is one of the whole text's if the chunk is in step there: for sure, or since its own cut was
    sure = F.col("agreed").isNotNull() & ((F.col("i") == 0) | F.coalesce(F.col("sync") <= F.col("agreed"), F.lit(False)))
    last = lambda when: F.coalesce(F.max(F.when(when, F.col("i"))).over(so_far), F.lit(-1))
    in_step = last(sure) > last(F.col("agreed").isNull())
    blank = F.when(F.col("next_sync") < F.col("next") + overlap, F.col("next_sync"))
    cut = F.when(in_step, F.col("agreed")).otherwise(blank)
    rows = rows.select("key", "i", "start", "next", cut.alias("cut"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "key",
        "i",
        F.coalesce(F.lag("cut").over(order), "start").alias("from"),
        F.coalesce("cut", "next").alias("to"),
        F.coalesce(F.count("cut").over(before), F.lit(0)).alias("piece"),
    )
    return rows.withColumn("parts", F.count("*").over(Window.partitionBy("key", "piece")))


def _join(path: str, decoded: bool):
    """Ids of the pieces of each text, which come in order, joined; and decoded, if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)

        def text_of(own: pa.Array, copies: int, ids: list[bytes]) -> Iterator[pa.RecordBatch]:
            packed = coder.wide(b"".join(ids))
            new = {"ids": packed, "bytes": coder.bytes(packed)} if decoded else {"ids": packed}
            columns = [pa.array([v], pa.binary()) for v in new.values()]
            one = pa.RecordBatch.from_arrays([own, *columns], ["id", *new])
            for _ in range(copies):
                yield one

        held = None
        for batch in batches:
            for r in range(batch.num_rows):
                key = batch.column("key")[r].as_py()
                if held and held[0] != key:
                    yield from text_of(*held[1:])
                    held = None
                if not held:
                    held = key, batch.column("id").slice(r, 1), batch.column("copies")[r].as_py(), []
                held[3].append(batch.column("ids")[r].as_py())
        if held:
            yield from text_of(*held[1:])

    return run


def _encode_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for part in (s for b in batches for s in _slices(b, "text")):
            ids = pa.array([coder.narrow(coder.ids(t.as_py())) for t in part.column("text")], pa.binary())
            yield _add(part, ["id", "key", "piece", "copies"], ids=ids)

    return run


def _coded(docs: DataFrame, id_col: str, text_col: str, path: str, chunk: int, overlap: int, decoded: bool) -> DataFrame:
    if not 0 < overlap * 2 <= chunk:
        raise ValueError("the overlap must be at most half a chunk")
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, ids binary" + (", bytes binary" if decoded else "")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInArrow(_encode_texts(path, decoded), out)
    # rows alike in id and text are one from here to the end
    key = F.unhex(F.sha2(F.concat_ws("\0", F.col("id").cast("string"), "text"), 256))
    long = rows.where(F.length("text") > chunk).select("id", key.alias("key"), "text")
    chunks = long.mapInArrow(_split(chunk, overlap), f"id {kind}, key binary, i int, start bigint, text string")
    chunks = chunks.groupBy("key", "i").agg(*[F.first(c).alias(c) for c in ("id", "start", "text")], F.count("*").alias("copies"))
    marks = "heads array<bigint>, tails array<bigint>, sync bigint, size bigint"
    marked = chunks.mapInArrow(_pretokenise(chunk, overlap), f"id {kind}, key binary, i int, start bigint, text string, copies bigint, {marks}")
    marked = common.materialize(marked, "bpe-chunks")
    cuts = common.materialize(_cuts(marked, overlap), "bpe-cuts")
    places = F.broadcast(cuts) if cuts.count() <= BROADCAST_PIECES else cuts
    own = F.expr("substring(text, cast(from - start + 1 as int), cast(to - from as int))").alias("text")
    placed = marked.select("id", "key", "i", "start", "text", "copies").join(places, ["key", "i"]).select("id", "key", "piece", "parts", "i", "copies", own)
    pieces = placed.where("parts = 1").select("id", "key", "piece", "copies", "text")
    if not cuts.where("parts > 1").isEmpty():
        parts = F.array_sort(F.collect_list(F.struct("i", "text")))
        wide = placed.where("parts > 1").groupBy("key", "piece").agg(F.first("id").alias("id"), F.first("copies").alias("copies"), parts.alias("p"))
        pieces = pieces.unionByName(wide.select("id", "key", "piece", "copies", F.array_join("p.text", "").alias("text")))
    coded = pieces.mapInArrow(_encode_pieces(path), f"id {kind}, key binary, piece bigint, copies bigint, ids binary")
    ordered = common.spread(coded, "key").sortWithinPartitions("key", "piece")
    joined = ordered.mapInArrow(_join(path, decoded), out)
    return short.unionByName(joined).withColumnRenamed("id", id_col)


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """(id_col, ids): the token ids of each text as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids (an empty binary). Repeated rows each get a row; other
    columns are ignored, whatever their names. No special tokens are made. No rows give no rows.
    """
    return _coded(docs, id_col, text_col, path or vocabulary_path(), chunk_chars, overlap_chars, False)


def round_trip(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """(id_col, ids, bytes): as ``encode``, with the ids decoded to raw bytes again in the same pass."""
    return _coded(docs, id_col, text_col, path or vocabulary_path(), chunk_chars, overlap_chars, True)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for part in (s for b in batches for s in _slices(b, "ids")):
            yield _add(part, ["id", "ids"], bytes=pa.array([coder.bytes(x.as_py()) for x in part.column("ids")], pa.binary()))

    return run


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id_col, ids, bytes): the raw bytes of the tokens, joined; ids are packed as by ``encode``.

    Null ids count as none. Repeated rows each get a row; other columns are ignored.
    """
    kind = coded.schema[id_col].dataType.simpleString()
    rows = coded.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{ids_col}`"), F.lit(b"")).alias("ids"))
    return rows.mapInArrow(_decode(path or vocabulary_path()), f"id {kind}, ids binary, bytes binary").withColumnRenamed("id", id_col)


def digests() -> list[Column]:
    """Columns of the counts and hashes of ``ids`` and ``bytes``."""
    return [
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    ]


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Counts and hashes of the encoded and decoded texts, a row for each row."""
    return round_trip(docs, id_col, text_col, path).select(id_col, *digests())
