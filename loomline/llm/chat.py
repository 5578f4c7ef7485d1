"""Event-sourced chat reconstruction and formatting, with DataFrame functions alone.

A log row is one event of a conversation:

* ``message``     starts a message of ``role`` with ``text`` (whole, or the first part);
* ``delta``       appends ``text`` to the message (a streamed part);
* ``edit``        replaces the message's text so far by ``text``;
* ``regenerate``  discards the message's text so far and starts again with ``text``.

Events of one message share ``message_id`` and are folded in order of ``seq``. The folded messages
of a conversation are put in order of their first event and rendered by a template whose control
strings are escaped inside texts, reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
# A text may hold this template's marks or those of other common templates; each starts with < or [
_ANGLE = r"<(?=\||/?s>|<?/?SYS>)"
_SQUARE = r"\[(?=/?INST\])"
EVENTS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    """Control strings lose their first character to a two-character escape; so do backslashes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.regexp_replace(out, _ANGLE, r"\\l")
    return F.regexp_replace(out, _SQUARE, r"\\i")


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\i"), F.lit("["))
    out = F.replace(out, F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def fold_messages(log: DataFrame) -> DataFrame:
    """(conv_id, message_id, pos, role, text): the final messages of a log.

    ``log`` has conv_id, seq, kind, message_id, role, text; other columns are ignored. A null text
    is empty, a null role is empty, an unknown or null kind counts as ``message``. A message with
    several ``message`` events gives one message for each, so repeated rows stay repeated rows; a
    ``delta``, ``edit`` or ``regenerate`` before any ``message`` starts one itself. Ties of ``seq``
    are broken by kind, role and text. Only the events of one message meet in a group.
    """
    kind = F.when(F.col("kind").isin(*EVENTS[1:]), F.col("kind")).otherwise("message")
    rank = F.when(kind == "message", 0).otherwise(1)
    event = F.struct(
        F.col("seq").alias("seq"),
        rank.alias("rank"),
        kind.alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    events = log.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(event)).alias("e"))
    last = F.size("e")
    numbered = F.transform("e", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    starts = F.filter(numbered, lambda y: (y["x"]["kind"] == "message") | (y["i"] == 0))
    ends = F.concat(F.transform(F.slice("s", 2, last), lambda y: y["i"]), F.array(last))
    spans = F.zip_with("s", ends, lambda y, b: F.struct(y["i"].alias("a"), b.alias("b"), y["x"].alias("x")))
    rows = events.withColumn("s", starts).select("conv_id", "message_id", "e", F.explode(spans).alias("p"))
    part = F.slice("e", F.col("p.a") + 1, F.col("p.b") - F.col("p.a"))
    rows = rows.select("conv_id", "message_id", "p", part.alias("part"))
    # the last event that throws away what was there before it
    whole = F.array_max(F.transform("part", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(F.lit(0))))
    kept = F.slice("part", whole + 1, F.size("part"))
    return rows.select(
        "conv_id",
        "message_id",
        F.col("p.x.seq").alias("pos"),
        F.col("p.x.role").alias("role"),
        F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, segments): a conversation as one string and as its loss mask.

    ``segments`` are the consecutive parts of ``formatted`` with ``loss`` true where a text is
    trained on, so joining them gives the string back. Messages are in order of ``pos``, ties by
    role and text. Rows of a conversation are pre-aggregated before the shuffle; one conversation
    gives one row, as the string of a conversation is one value.
    """
    turn = F.struct("pos", "role", "text")
    convs = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces = F.transform(
        "turns",
        lambda t: F.array(
            F.struct(F.lit(False).alias("loss"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY)).alias("text")),
            F.struct(t["role"].isin(*trained_roles).alias("loss"), escape(t["text"]).alias("text")),
            F.struct(F.lit(False).alias("loss"), F.lit(END).alias("text")),
        ),
    )
    out = convs.select("conv_id", F.flatten(pieces).alias("segments"))
    return out.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def format_log(log: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Fold a log and render it."""
    return render(fold_messages(log), trained_roles)


def parse(formatted: Column) -> Column:
    """The turns read back from a rendered string: array of (role, text), unescaped."""
    # nothing stands before the first mark
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda t, i: i > 0)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(t, BODY, 1)).alias("role"),
            unescape(F.regexp_replace(F.substring_index(t, BODY, -1), r"<\|end\|>\z", "")).alias("text"),
        ),
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(log: DataFrame) -> DataFrame:
    """What the rendered conversations hold, read back from them."""
    out = format_log(log).withColumn("turns", parse(F.col("formatted"))).withColumn("lost", loss_text(F.col("segments")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def log_of_turns(turns: DataFrame) -> DataFrame:
    """A table of whole turns as a log: one ``message`` event for each row."""
    return turns.select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.lit("message").alias("kind"),
        F.col("turn").cast("string").alias("message_id"),
        "role",
        "text",
    )


def streamed_log(turns: DataFrame) -> DataFrame:
    """A table of whole turns as the log that such a conversation leaves, to be folded into them again.

    By a hash of conversation and turn, a turn is one message, a message with two deltas, a draft with
    a delta that is generated anew in two parts, or another text that is edited. Equal rows are
    messages of their own; a row without turn is one event.
    """
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    text = F.coalesce("text", F.lit(""))
    cut = (F.length(text) / 3).cast("int")
    first, rest = F.substr(text, F.lit(1), cut), F.substr(text, cut + 1)
    middle, end = F.substr(text, cut + 1, cut), F.substr(text, 2 * cut + 1)
    events = lambda *e: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), t.alias("text")) for k, (kind, t) in enumerate(e)])
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    said = (
        F.when(F.col("turn").isNull() | (way == 0), events(("message", text)))
        .when(way == 1, events(("message", first), ("delta", middle), ("delta", end)))
        .when(way == 2, events(("message", F.concat(F.lit("Draft: "), end)), ("delta", first), ("regenerate", first), ("delta", rest)))
        .otherwise(events(("message", F.concat(rest, first)), ("edit", text)))
    )
    key = F.concat_ws("/", F.col("turn").cast("string"), "copy", F.xxhash64("role", "text").cast("string"))
    out = rows.select("conv_id", "turn", key.alias("message_id"), "role", F.explode(said).alias("e"))
    return out.select("conv_id", (F.col("turn") * 10 + F.col("e.k")).alias("seq"), F.col("e.kind").alias("kind"), "message_id", "role", F.col("e.text").alias("text"))
