"""Token counts by a finite-state transducer compiled from a piece vocabulary.

A text's encoding by merges has, for every prefix, one last token, and that is the one piece ending
there which merges with nothing of the token before it. So a state needs only the pieces that are
under way: for each, its node in the tree of pieces, the last token before it and how many tokens
that prefix has more than the present one. Reading a character leads to one next state; the
transition carries the change of the number of tokens, which the library would have emitted so far.
Transitions are compiled when a text first takes them, and a stretch between two places that no
piece spans is one compiled transition from the start state back to it.

A text longer than a chunk is split. A chunk's state map says, for any state it is entered in, the
state it is left in and the tokens in between: up to the first place that no piece spans it depends
on what came before and is kept as text, from there on it is fixed. Maps compose associatively, so
those of a text are composed by runs of 64, level by level.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

VOCABULARY = "piece_bpe_32k.model"
CHUNK_CHARS = 16_384
LIMIT = 4_096
#: Chunks whose maps one task composes at a time.
RUN = 64
#: Stretches of a generation (a worker keeps two) and states that are kept compiled; others are compiled again when needed.
KEPT_STRETCHES = 300_000
KEPT_STATES = 200_000
#: Longer stretches are read character by character and not kept.
STRETCH_CHARS = 48

SPACE = "▁"
_ROOT = 0
_NEVER = float("-inf")
#: The state at a place that no piece spans: the root alone, with nothing before it.
START = ((_ROOT, "", 0),)
#: Stretches of letters or of anything else with the spaces before them, and spaces at the end.
_BY_KIND = re.compile(r" *[^\W\d_]+| *(?:(?! )[\W\d_])+| +")
_BY_SPACE = re.compile(r" *[^ ]+| +")
_LETTER = re.compile(r"[^\W\d_]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class State:
    """A state with the transitions that were taken from it: to which state, with how many tokens more."""

    __slots__ = ("key", "next")

    def __init__(self, key: tuple):
        self.key = key
        self.next: dict[str, tuple[State, int]] = {}


class Transducer:
    """The deterministic transducer of a sentencepiece model of kind BPE with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in ids]
        self.scores = {model.id_to_piece(i).replace(SPACE, " "): model.get_score(i) for i in ids if not special[i]}
        #: Pairs of characters that some piece holds side by side; any other pair is a cut.
        self.inside = {p[k : k + 2] for p in self.scores for k in range(len(p) - 1)}
        if any(x[1] == " " != x[0] for x in self.inside):
            raise ValueError("a piece goes on with a space, so stretches can't be taken apart")
        # letters and other characters can be taken apart too where no piece holds both
        mixed = any(x[0] != " " and bool(_LETTER.match(x[0])) != bool(_LETTER.match(x[1])) for x in self.inside)
        self.stretches = (_BY_SPACE if mixed else _BY_KIND).findall
        self.children: list[dict[str, int]] = [{}]
        self.piece: list[str] = [""]
        for p in self.scores:
            at = _ROOT
            for c in p:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.piece.append("")
                at = nxt
            self.piece[at] = p
        self._apart = functools.lru_cache(1 << 17)(self._stay_apart)
        self._states: dict[tuple, State] = {}
        self._stretches: dict[str, int] = {}
        self._older: dict[str, int] = {}
        self._spines: dict[str, tuple] = {}

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by the merges themselves: best score first, leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _spine(self, piece: str) -> tuple[bool, list[str], list[str]]:
        """Whether a piece is its own encoding, and its parts at its start and at its end, in the order in which they arise."""
        found = self._spines.get(piece)
        if found is None:
            parts, firsts, lasts = list(piece), [piece[0]], [piece[-1]]
            while True:
                scores = [self.scores.get(x + y, _NEVER) for x, y in zip(parts, parts[1:], strict=False)]
                best = max(scores, default=_NEVER)
                if best == _NEVER:
                    break
                at = scores.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    firsts.append(parts[0])
                if at == len(parts) - 1:
                    lasts.append(parts[-1])
            found = self._spines[piece] = (len(parts) == 1, firsts, lasts)
        return found

    def _stay_apart(self, before: str, piece: str) -> bool:
        """Whether the merges of the two tokens side by side are those of each alone.

        A part at the end of the first and one at the start of the second meet; they merge with each
        other if that has a better score than what takes either further, the left one of equals.
        """
        whole, firsts, _ = self._spine(piece)
        if not before or not whole:
            return whole
        if before[-1] + piece[0] not in self.inside:
            return True
        if before[0] == " " == piece[-1]:
            return self.merged(before + piece) == [before, piece]  # runs of spaces have one score
        lasts = self._spine(before)[2]
        i = j = 0
        while True:
            left = self.scores[lasts[i + 1]] if i + 1 < len(lasts) else _NEVER
            right = self.scores[firsts[j + 1]] if j + 1 < len(firsts) else _NEVER
            both = self.scores.get(lasts[i] + firsts[j], _NEVER)
            if both > left and both >= right and both != _NEVER:
                return False
            if left == right == _NEVER:
                return True
            if left >= right:
                i += 1
            else:
                j += 1

    def _state(self, key: tuple) -> State:
        found = self._states.get(key)
        if found is None:
            if len(self._states) >= KEPT_STATES:
                # those that are still in use lead on, and to new ones
                for old in self._states.values():
                    old.next.clear()
                self._states.clear()
            found = self._states[key] = State(key)
        return found

    def _compile(self, state: tuple, c: str) -> tuple[tuple, int]:
        """The next state and how many tokens more the text has with this character."""
        before = state[-1][1]
        if before and before[-1] + c not in self.inside:
            state = START
        if c not in self.scores:
            # no piece: its bytes, and nothing merges with them
            return ((_ROOT, c, 0),), len(c.encode())
        under_way, last, more = [], "", 0
        for node, token, ahead in state:
            nxt = self.children[node].get(c)
            if nxt is None:
                continue
            under_way.append((nxt, token, ahead))
            if not last and self.piece[nxt] and self._apart(token, self.piece[nxt]):
                last, more = self.piece[nxt], ahead + 1
        alive = [(n, t, ahead - more) for n, t, ahead in under_way if self.children[n]]
        return (*alive, (_ROOT, last, 0)), more

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        """Where a text leads from a state, and the tokens it adds."""
        at, total = self._state(state), 0
        for c in text:
            found = at.next.get(c)
            if found is None:
                key, more = self._compile(at.key, c)
                found = at.next[c] = (self._state(key), more)
            at, more = found
            total += more
        return at.key, total

    def stretch(self, text: str) -> int:
        """Tokens of a text between two cuts."""
        n = self._stretches.get(text)
        if n is not None:
            return n
        n = self._older.get(text)
        if n is None:
            n = self.run(START, text)[1]
        if len(text) <= STRETCH_CHARS:
            if len(self._stretches) >= KEPT_STRETCHES:
                self._older, self._stretches = self._stretches, {}
            self._stretches[text] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return self._counted(" " + _plain(text)) if text else 0

    def _counted(self, text: str) -> int:
        return sum(map(self.stretch, self.stretches(text)))

    def state_map(self, text: str) -> tuple[str, int, tuple | None]:
        """(head, tokens behind the head, state at the end); no state where no cut was found, the head is all then."""
        cut = next((i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.inside), None)
        if cut is None:
            return text, 0, None
        *known, last = self.stretches(text[cut:])
        state, total = self.run(START, last)
        return text[:cut], total + sum(map(self.stretch, known)), state

    def compose(self, one: tuple, two: tuple) -> tuple:
        """The map of two neighbouring stretches of text."""
        if one[2] is None and one[0][-1] + two[0][0] in self.inside:
            return one[0] + two[0], two[1], two[2]
        state, n = self.run(one[2] or START, two[0])
        return one[0], one[1] + n + two[1], state if two[2] is None else two[2]


def _plain(text: str) -> str:
    """The character that pieces show for a space is one."""
    return text.replace(SPACE, " ")


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """The transducer of a model, built once in each Python worker."""
    return Transducer(path)


@contextlib.contextmanager
def _uncollected() -> Iterator[None]:
    """No garbage collection meanwhile: the states are many, all alive, and leave no cycle when they go."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _texts(column: pa.Array) -> Iterator[str]:
    for t in column:
        yield t.as_py() or ""


def _count_short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            with _uncollected():
                n = pa.array([machine.count(t) for t in _texts(b.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), n], ["id", "n_bytes", "n_tokens"])

    return run


def _split(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in enumerate(_texts(b.column("text"))):
                row = b.slice(k, 1)
                starts = range(0, len(t), chunk)
                for some in range(0, len(starts), RUN):
                    own = starts[some : some + RUN]
                    same = [pa.concat_arrays([row.column(c)] * len(own)) for c in ("id", "key", "n_bytes")]
                    first = [" " if s == 0 else "" for s in own]
                    parts = [f + _plain(t[s : s + chunk]) for f, s in zip(first, own, strict=True)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array([s // chunk for s in own], pa.int64()), pa.array(parts, pa.string())], ["id", "key", "n_bytes", "i", "text"])

    return run


def _written(state: tuple | None) -> str | None:
    return None if state is None else repr(state)


def _read(state: str | None) -> tuple | None:
    import ast

    return None if state is None else ast.literal_eval(state)


def _map_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            with _uncollected():
                maps = [machine.state_map(t) for t in _texts(b.column("text"))]
            new = [pa.array([m[0] for m in maps], pa.string()), pa.array([m[1] for m in maps], pa.int64()), pa.array([_written(m[2]) for m in maps], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "key", "n_bytes", "i")), *new], ["id", "key", "n_bytes", "i", "head", "n", "state"])

    return run


_MAP_COLUMNS = ["id", "key", "n_bytes", "i", "copies", "head", "n", "state", "n_tokens"]


def _compose_runs(path: str, kind: pa.DataType):
    """Maps in order, those of a run as one, with the tokens of a text that begins with it."""
    types = [kind, pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(_MAP_COLUMNS, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        at, whole, out = None, None, []

        def ended() -> dict:
            head, n, state = whole
            return at | {"i": at["run"], "head": head, "n": n, "state": _written(state), "n_tokens": n + machine.run(START, head)[1]}

        for b in batches:
            for r in b.to_pylist():
                own = (r["head"], r["n"], _read(r["state"]))
                if at is not None and (r["id"], r["key"], r["run"]) == (at["id"], at["key"], at["run"]):
                    whole = machine.compose(whole, own)
                    continue
                if at is not None:
                    out.append(ended())
                at, whole = r, own
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if at is not None:
            yield pa.RecordBatch.from_pylist([ended()], schema)

    return run


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(id_col, n_bytes, n_tokens) of every row, as the model's library counts them without begin or end.

    Null and empty texts have no bytes and no tokens. Strings of special tokens are ordinary text.
    Repeated rows and rows without id come out as often as they come in; no rows give no rows; other
    columns are ignored. Texts up to ``chunk_chars`` are counted where they are read; the chunks of
    longer ones are dealt over the cluster.
    """
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(_count_short(path), f"id {kind}, n_bytes bigint, n_tokens bigint")
    long = rows.where(F.length("text") > chunk_chars).withColumn("key", F.unhex(F.sha2("text", 256)))
    chunks = common.spread(long.mapInArrow(_split(chunk_chars), f"id {kind}, key binary, n_bytes bigint, i bigint, text string"), "id", "key", "i")
    maps = chunks.mapInArrow(_map_chunks(path), f"id {kind}, key binary, n_bytes bigint, i bigint, head string, n bigint, state string")
    # equal rows have equal chunks; they are composed once and come out as often as they came in
    maps = maps.groupBy("id", "key", "n_bytes", "i").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("head", "n", "state")])
    maps = common.materialize(maps, "chunk-maps")
    last = maps.agg(F.max("i")).first()[0]
    shape = f"id {kind}, key binary, n_bytes bigint, i bigint, copies bigint, head string, n bigint, state string, n_tokens bigint"
    # a text that was split has two chunks at least, so its maps are composed once at least
    maps = maps.withColumn("n_tokens", F.lit(0).cast("bigint"))
    while last:
        dealt = common.spread(maps.withColumn("run", F.expr(f"i div {RUN}")), "id", "key", "run").sortWithinPartitions("id", "key", "run", "i")
        maps = dealt.mapInArrow(_compose_runs(path, to_arrow_type(docs.schema[id_col].dataType)), shape)
        last //= RUN
    whole = maps.select("id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")
    return short.unionByName(whole).withColumnRenamed("id", id_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row."""
    return count(docs, id_col, text_col).withColumn("over_limit", F.col("n_tokens") > limit)
