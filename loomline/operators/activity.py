"""An activity stream in batch: validation, dedupe, classification, sessions, spans, artifacts, replay.

Rows carry ``seq``, their arrival order; every fold goes by it, so results don't depend on how rows
are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import text
from .ordering import Down, carried, numbered, running_totals

# Lifetimes in milliseconds and bounds of the live view.
PULSE_MS, FAILED_PULSE_MS, RAY_MS, MARKER_MS = 60_000, 120_000, 30_000, 30_000
STALLED_MS, FAILED_MS, INACTIVE_MS = 180_000, 60_000, 300_000
GROUP_TTL_MS = 660_000
RING, SEEN, MARKERS, MARKERS_PER_GROUP = 256, 1_000, 64, 12
NEAR_MS = 200
TERMINAL = ("session.ended",)


def millis(c: str | Column = "ts") -> Column:
    """Milliseconds since 1970 of a time with or without a zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", epoch, F.col(c) if isinstance(c, str) else c)


# Each rule: code, condition that a valid row fails. The first that holds rejects the row.
def rules() -> list[tuple[str, Column]]:
    return [
        ("MISSING_SEQUENCE", F.col("seq").isNull()),
        ("NEGATIVE_SEQUENCE", F.col("seq") < 0),
        ("MISSING_SESSION", F.col("session").isNull() | (F.trim("session") == "")),
        ("SESSION_TOO_LONG", F.length("session") > 256),
        ("MISSING_TIMESTAMP", F.col("ts").isNull()),
        ("MISSING_TYPE", F.col("type").isNull() | ~F.col("type").rlike(r"^[A-Za-z][A-Za-z0-9._:-]{0,127}$")),
        ("BAD_TOOL_CALL", F.col("tool_call") < 0),
    ]


def validate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with their first ``code``)."""
    code = F.lit(None).cast("string")
    for name, bad in reversed(rules()):
        code = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(code)
    marked = events.withColumn("code", code)
    return marked.where("code is null").drop("code"), marked.where("code is not null")


def dedupe(events: DataFrame, *key: str) -> DataFrame:
    """The first arrival of each key. Copies of a key are reduced before the shuffle."""
    rest = [c for c in events.columns if c not in key]
    first = events.groupBy(*key).agg(F.min_by(F.struct(*rest), "seq").alias("r"))
    return first.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*events.columns)


def _runs(events: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, np.ndarray, bool, bool]]:
    """(part, key, times, first, last) of the first and the last key of each part, from rows in order."""
    part, key, ms, first = None, None, [], True
    for batch in events:
        for p, k, t in zip(*(batch.column(c).to_pylist() for c in ("_part", "_key", "_ms")), strict=True):
            if (p, k) != (part, key):
                if ms and (first or p != part):
                    yield part, key, np.array(ms), first, p != part
                first = p != part
                part, key, ms = p, k, []
            ms.append(t)
    if ms:
        yield part, key, np.array(ms), first, True


def _handed_on(window_ms: int):
    """For each part, the last kept time at its end for every time that may be handed to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, key, ms, first, last in _runs(batches):
            then = np.searchsorted(ms, ms + window_ms, "right")
            at = np.where(then < len(ms), then, np.arange(len(ms)))
            while (at[at] != at).any():
                at = at[at]
            # only the first row of a window, or one within a window of the part's start, can be kept first
            starts, ends = ms[: then[0] + 1 if first else 1], ms[at][: then[0] + 1 if first else 1]
            turn = np.append(np.flatnonzero(ends[1:] != ends[:-1]), len(ends) - 1)
            rows = [{"_part": part, "_key": key, "first": first, "last": last, "starts": starts[turn].tolist(), "ends": ends[turn].tolist()}]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("_part", pa.int32()), ("_key", pa.string()), ("first", pa.bool_()), ("last", pa.bool_()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]))

    return run


def _keep_first(window_ms: int, handed: dict[int, tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key = kept = None
        for batch in batches:
            keep = []
            for p, k, t in zip(*(batch.column(c).to_pylist() for c in ("_part", "_key", "_ms")), strict=True):
                if p != part:
                    part, (key, kept) = p, handed.get(p, (None, None))
                if k != key:
                    key, kept = k, None
                new = kept is None or t - kept > window_ms
                kept = t if new else kept
                keep.append(new)
            rest = [c for c in batch.schema.names if c not in ("_part", "_at", "_key", "_ms")]
            yield batch.filter(pa.array(keep, pa.bool_())).select(rest)

    return run


def near_duplicates(events: DataFrame, *key: str, window_ms: int = NEAR_MS) -> DataFrame:
    """Rows without those that follow a kept row of their key within the window.

    Only kept rows count, so a chain of close rows keeps one a window: a fold in order of time. Rows
    are dealt by ranges of key and time, so a key with many rows spans tasks; each part says what
    last kept time it would hand on for each that it may get (no more than it has rows in its first
    window), the driver follows these through the parts, and each part is folded as a sorted stream.
    Rows without a time are kept and no others are compared to them.
    """
    spark = events.sparkSession
    names = events.columns
    rest = [c for c in names if c not in key]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = events.withColumns({"_ms": millis(), "_key": F.to_json(F.struct(*key))})
    timed = rows.where("_ms is not null").repartitionByRange(n, "_key", "_ms", "seq").sortWithinPartitions("_key", "_ms", "seq", F.struct(*rest))
    timed = storage.keep(timed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "near")
    in_order = lambda df: df.repartition(n, "_part").sortWithinPartitions("_part", "_at")
    ends = in_order(timed.select("_part", "_at", "_key", "_ms")).mapInArrow(_handed_on(window_ms), "_part int, _key string, first boolean, last boolean, starts array<bigint>, ends array<bigint>")
    handed: dict[int, tuple[str, int]] = {}
    at = None
    for r in sorted(ends.collect(), key=lambda r: (r["_part"], not r["first"])):
        got = None
        if r["first"] and at and at[0] == r["_key"]:
            handed[r["_part"]] = at
            got = at[1]
        if r["last"]:
            end = next((e for s, e in zip(r["starts"], r["ends"], strict=True) if got is None or s - got > window_ms), got)
            at = (r["_key"], end)
    out = in_order(timed).mapInArrow(_keep_first(window_ms, handed), events.schema)
    return out.unionByName(rows.where("_ms is null").select(*names))


def kind(actions: Column | None = None) -> Column:
    """What an event is about: permission, read, write, search, execute, network, session, error or unknown.

    ``actions``: what is done to the event's resources, in order. The first that isn't ``network``
    decides, wherever it stands, then ``network``, then the event's type.
    """
    t = F.coalesce(F.col("type"), F.lit(""))
    under = lambda p: (t == p) | t.startswith(p + ".")
    of_type = (
        F.when(t == "file.read", "read").when(t == "file.write", "write").when(t == "search", "search").when((t == "execute") | under("tool"), "execute")
        .when(t.startswith("session.") | t.startswith("agent."), "session").when(under("error"), "error").otherwise("unknown")
    )
    if actions is not None:
        first = F.get(F.filter(actions, lambda a: a.isin("read", "reference", "write", "search", "execute")), F.lit(0))
        network = F.coalesce(F.array_contains(actions, "network"), F.lit(False))
        of_type = F.when(first == "reference", "read").when(first.isNotNull(), first).when(network, "network").otherwise(of_type)
    return F.when(under("permission"), "permission").otherwise(of_type)


def lifecycle() -> Column:
    """started, completed or failed for tool events; null for others."""
    t = F.col("type")
    return F.when(t.startswith("tool"), F.when(t.endswith("started"), "started").when((F.col("status") == "failed") | t.endswith("failed"), "failed").otherwise("completed"))


def ring(events: DataFrame, size: int = RING) -> DataFrame:
    """(session, kept, first_kept, trimmed_through): the last events of each session, and what fell out."""
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq")))
    marked = events.withColumn("rank", rank)
    return marked.groupBy("session").agg(
        F.count_if(F.col("rank") <= size).alias("kept"), F.min(F.when(F.col("rank") <= size, F.col("seq"))).alias("first_kept"), F.max(F.when(F.col("rank") > size, F.col("seq"))).alias("trimmed_through")
    )


def replay_from(events: DataFrame, cursors: DataFrame, size: int = RING) -> DataFrame:
    """(session, events, gap): what a reader at a cursor still gets, and whether some is lost."""
    kept = ring(events, size)
    later = events.join(cursors, "session").where("seq > cursor").groupBy("session").agg(F.count("*").alias("later"))
    out = cursors.join(kept, "session").join(later, "session", "left")
    return out.select("session", F.least(F.coalesce("later", F.lit(0)), F.col("kept")).alias("events"), F.coalesce(F.col("cursor") < F.col("trimmed_through"), F.lit(False)).alias("gap"))


def turns(events: DataFrame) -> DataFrame:
    """(session, turn, first_seq, last_seq, events, open): opened by a prompt, closed by what ends a turn
    (``sessions.closes_turn``).

    Windows are cut by the data: the number of prompts so far names the turn. Events before the first
    prompt belong to none.
    """
    order = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("turn", F.sum((F.col("type") == "prompt.submitted").cast("int")).over(order)).where("turn > 0")
    from loomline.operators.sessions import closes_turn

    closing = F.when(closes_turn(), F.col("seq"))
    close = F.min(closing).over(Window.partitionBy("session", "turn"))
    rows = rows.withColumn("close", close).where(F.col("close").isNull() | (F.col("seq") <= F.col("close")))
    return rows.groupBy("session", "turn").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("events"), F.max("close").isNull().alias("open"))


def tool_spans(events: DataFrame) -> DataFrame:
    """(session, tool_call, end_seq, start_seq, duration_ms): each end with the latest open start of its call.

    A start answers the first end behind it; an end without one has no duration.
    """
    order = Window.partitionBy("session", "tool_call").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    step = lifecycle()
    rows = events.withColumn("step", step).where("step is not null and tool_call is not null")
    started = F.last(F.when(F.col("step") == "started", F.struct("seq", "ts")), ignorenulls=True).over(before)
    ended = F.last(F.when(F.col("step") != "started", F.col("seq")), ignorenulls=True).over(before)
    rows = rows.withColumn("start", started).withColumn("last_end", ended).where("step <> 'started'")
    own = F.col("start.seq").isNotNull() & (F.col("last_end").isNull() | (F.col("start.seq") > F.col("last_end")))
    return rows.select(
        "session", "tool_call", F.col("seq").alias("end_seq"), F.when(own, F.col("start.seq")).alias("start_seq"),
        F.when(own, F.greatest(F.lit(0), millis() - millis("start.ts"))).alias("duration_ms"), F.col("step").alias("outcome"),
    )


def session_states(events: DataFrame, now: Column) -> DataFrame:
    """One row a session: counts, last times, open turn, and its status at ``now``.

    failed for a while after a failure, stalled if a turn is open and nothing happens, active while a
    turn is open, else idle. Everything is a pre-aggregated maximum, so a hot session is no hot task.
    """
    at = lambda t: F.max(F.when(F.col("type") == t, F.col("seq")))
    out = events.groupBy("session").agg(
        F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("last_at"), at("prompt.submitted").alias("opened"), at("turn.completed").alias("closed"),
        F.max(F.when(F.col("status") == "failed", F.col("ts"))).alias("failed_at"), F.max_by("type", "seq").alias("last_type"), F.count_if(F.col("status") == "failed").alias("failures"),
    )
    open_ = F.col("opened").isNotNull() & (F.col("closed").isNull() | (F.col("opened") > F.col("closed")))
    age = lambda c: millis(now) - millis(c)
    status = F.when(F.coalesce(age("failed_at") <= FAILED_MS, F.lit(False)), "failed").when(open_ & (age("last_at") > STALLED_MS), "stalled").when(open_, "active").otherwise("idle")
    return out.select("session", "events", "started", "last_at", "failures", "last_type", open_.alias("turn_open"), status.alias("status"))


def artifacts(events: DataFrame, now: Column) -> DataFrame:
    """(kind, seq, session, expires_ms) of the pulses, rays and markers alive at ``now``."""
    ms = millis()
    failed = F.col("status") == "failed"
    made = F.array(
        F.struct(F.lit("pulse").alias("kind"), (ms + F.when(failed, FAILED_PULSE_MS).otherwise(PULSE_MS)).alias("expires_ms")),
        F.struct(F.lit("ray").alias("kind"), (ms + F.when(failed, 2 * RAY_MS).otherwise(RAY_MS)).alias("expires_ms")),
        F.struct(F.lit("marker").alias("kind"), (ms + MARKER_MS).alias("expires_ms")),
    )
    # whatever has ended before the longest lifetime can't be alive: the filter reaches the scan
    recent = events.where(F.col("ts") > now - F.expr(f"INTERVAL {FAILED_PULSE_MS // 1000} SECONDS"))
    out = recent.select("seq", "session", F.explode(made).alias("m")).select("m.kind", "seq", "session", "m.expires_ms")
    return out.where(F.col("expires_ms") > millis(now))


def capped_markers(events: DataFrame, group: str = "session", each: int = MARKERS_PER_GROUP, total: int = MARKERS) -> DataFrame:
    """The newest markers: at most ``each`` of a group, then at most ``total``."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("seq")))
    return events.withColumn("rank", rank).where(F.col("rank") <= each).orderBy(F.desc("seq")).limit(total).drop("rank")


def replay_frames(events: DataFrame) -> DataFrame:
    """(session, seq, virtual_ms): time since the session's first event that never runs backwards."""
    by = Window.partitionBy("session").orderBy("seq")
    rel = millis() - F.first(millis()).over(by)
    rows = events.withColumn("rel", rel)
    return rows.select("session", "seq", F.greatest(F.lit(0), F.max("rel").over(by.rowsBetween(Window.unboundedPreceding, 0))).alias("virtual_ms"))


def state_at(events: DataFrame, virtual_ms: int) -> DataFrame:
    """Counts of each session once its replay has run for some time."""
    return replay_frames(events).where(F.col("virtual_ms") <= virtual_ms).groupBy("session").agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"))


def group_specs(events: DataFrame) -> DataFrame:
    """(kind, weight, last_at, last_status, sessions): activity by kind of event."""
    return events.withColumn("kind", kind()).groupBy("kind").agg(
        F.count("*").alias("weight"), F.max("ts").alias("last_at"), F.max_by("status", "seq").alias("last_status"), F.count_distinct("session").alias("sessions")
    )


def within(marks: DataFrame, times: DataFrame, life_ms: int, **folds: Callable[[str], Column]) -> DataFrame:
    """(at, id, last_at, folds): what the marks of an id come to that lie up to ``life_ms`` before a time.

    ``marks``: id, ms and a column for each of ``folds``, an aggregate that may be made in parts (``max``,
    ``min``, ``sum``); ``times``: ``at``, in milliseconds. Ids without such a mark have no row.

    Marks of one id and millisecond are one first. Buckets are one life long, so a life ends in its
    time's bucket and began in the one before: the first marks of the one and the last ones of the other.
    Both are running folds over the marks of a bucket, forwards and backwards, that times only look up;
    marks and times never meet in pairs. Rows are dealt by their number.
    """
    folds = {"last_at": F.max, **folds}
    bucket = lambda ms: F.floor(F.col(ms) / life_ms)
    made = lambda over: [over(f(c)).alias(c) for c, f in folds.items()]
    marks = marks.where("ms is not null").withColumn("last_at", F.col("ms")).repartition(storage.shares(marks), "id", "ms")
    marks = storage.keep(marks.groupBy("id", "ms").agg(*made(lambda c: c)), "marks")
    times = storage.keep(times.where("at is not null").select("at").distinct(), "times")
    near = marks.select("id", bucket("ms").alias("b")).distinct().select("id", F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("bucket")).distinct()
    asked = near.join(times.withColumn("bucket", bucket("at")), "bucket")
    side = lambda late, shift, place: F.struct(F.lit(late).alias("late"), (F.col("bucket") + shift).alias("bucket"), place.alias("place"))
    both = lambda df, *sides: df.withColumn("s", F.explode(F.array(*sides))).select("id", "s.*", *[c for c in df.columns if c in folds or c == "at"])
    rows = both(marks.withColumn("bucket", bucket("ms")), side(False, 0, F.col("ms")), side(True, 1, -F.col("ms")))
    rows = rows.unionByName(both(asked, side(False, 0, F.col("at")), side(True, 0, life_ms - F.col("at"))), allowMissingColumns=True)
    rows = rows.repartition(storage.shares(rows), "id", "bucket")
    # a mark comes before a time at the same place
    upto = Window.partitionBy("id", "bucket", "late").orderBy("place", F.col("at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("id", "bucket", "at", *made(lambda c: c.over(upto))).where("at is not null and last_at is not null")
    return rows.groupBy("id", "bucket", "at").agg(*made(lambda c: c)).select("at", "id", *folds)


def live_groups(specs: DataFrame, times: DataFrame, ttl_ms: int = GROUP_TTL_MS) -> DataFrame:
    """(at, id, parent, label, kind, last_at, expires_at, weight, outcome): the groups alive at each time.

    ``specs``: a row (seq, ms, id, parent, label, kind, weight, outcome) for each group that an event
    touches; ``times``: ``at``, in milliseconds. A group lives for ``ttl_ms`` behind each of its events.
    It keeps its first label, takes parent and kind of its last event, and carries the last outcome
    that was known; what has expired by then doesn't count.
    """
    told = lambda *c: F.when(F.col("seq").isNotNull(), F.struct("seq", *c))
    known = F.when(F.col("outcome").isNotNull(), told("outcome"))
    marks = specs.select("id", "ms", told("parent", "kind").alias("newest"), told("label").alias("oldest"), F.coalesce("weight", F.lit(0)).alias("weight"), known.alias("known"))
    out = within(marks, times, ttl_ms, newest=F.max, oldest=F.min, weight=F.sum, known=F.max)
    return out.select("at", "id", "newest.parent", "oldest.label", "newest.kind", "last_at", (F.col("last_at") + ttl_ms).alias("expires_at"), F.col("weight").cast("bigint").alias("weight"), "known.outcome")


def signatures(live: DataFrame, agents: DataFrame, inactive_ms: int = INACTIVE_MS) -> DataFrame:
    """(at, signature): a print of what a layout is made of at each time: groups with parent, label, kind
    and last activity, agents with parent, label, last update and whether they have gone inactive.

    ``agents``: (at, id, parent, label, updated_at), of one id the latest. Prints of rows are combined
    without order, so nothing is gathered.
    """
    own = F.xxhash64(F.lit("group"), "id", "parent", "label", "kind", "last_at")
    last = agents.groupBy("at", "id").agg(F.max_by(F.struct("parent", "label", "updated_at"), "updated_at").alias("a"))
    seen = last.select("at", F.xxhash64(F.lit("agent"), "id", "a.parent", "a.label", "a.updated_at", F.col("at") - F.col("a.updated_at") >= inactive_ms).alias("h"))
    rows = live.select("at", own.alias("h")).unionByName(seen)
    return rows.groupBy("at").agg(F.struct(F.bit_xor("h").alias("x"), F.count("*").alias("n")).alias("p")).select("at", F.xxhash64("p.x", "p.n").alias("signature"))


def notifications(events: DataFrame) -> DataFrame:
    """(session, seq, streak): the first failure of every run of failures of a session."""
    by = Window.partitionBy("session").orderBy("seq")
    rows = events.withColumn("before", F.lag("status").over(by)).where("status = 'failed' and coalesce(before, '') <> 'failed'")
    return rows.select("session", "seq", F.row_number().over(by).alias("streak"))


def page(events: DataFrame, after: int, size: int = 100) -> DataFrame:
    """The next rows behind a cursor."""
    return events.where(F.col("seq") > after).orderBy("seq").limit(size)


def retention(recordings: DataFrame, most: int = 20, events: int = 100_000, size: int = 100 << 20, now: Column | None = None, days: int = 14) -> DataFrame:
    """Recordings that stay: active ones, and the newest others whose running totals fit.

    ``recordings``: recording_id, created, active, event_count, byte_count. With ``now``, recordings
    that were created more than ``days`` before it go first, active ones excepted.
    """
    if now is not None:
        recordings = recordings.where(F.col("active") | (F.col("created") >= now - F.make_dt_interval(F.lit(days))))
    newest = [Down("active"), Down("created"), Down("recording_id")]
    run = running_totals(recordings, newest, _n=F.lit(1), _e=F.col("event_count"), _b=F.col("byte_count"))
    return run.where(F.col("active") | ((F.col("_n") <= most) & (F.col("_e") <= events) & (F.col("_b") <= size))).drop("_n", "_e", "_b")


def resolve_targets(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, node, how): the node a mentioned path stands for.

    The exact file first; else the longest suffix that belongs to one file alone. A file's node is its
    smallest one by id.
    """
    from loomline.operators.history import path_suffixes

    files = nodes.where("file is not null").groupBy("file").agg(F.min("id").alias("node"))
    ends = files.select("file", "node", F.posexplode(path_suffixes(F.col("file"))).alias("k", "suffix"))
    unique = ends.groupBy("suffix").agg(F.count_distinct("file").alias("n"), F.min("node").alias("node")).where("n = 1").drop("n")
    asked = paths.select("path").distinct().select("path", F.posexplode(path_suffixes(F.col("path"))).alias("k", "suffix"))
    exact = paths.select("path").distinct().join(files.withColumnRenamed("file", "path"), "path").select("path", "node", F.lit("exact").alias("how"))
    found = asked.join(unique, "suffix").groupBy("path").agg(F.min_by("node", "k").alias("node")).select("path", "node", F.lit("suffix").alias("how"))
    return exact.union(found.join(exact, "path", "left_anti"))


def attributed(events: DataFrame, column: str) -> DataFrame:
    """Events with the last known value of a column of their session; those before any go."""
    return carried(events, ["session"], ["seq"], **{column: F.col(column)}).where(F.col(column).isNotNull()).select(*events.columns)


def retained(events: DataFrame, size: Column, most: int, most_bytes: int) -> DataFrame:
    """The newest events of each session whose number and running size fit; the oldest go first."""
    newest = Window.partitionBy("session").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    run = events.withColumn("_n", F.count("*").over(newest)).withColumn("_b", F.sum(size).over(newest))
    return run.where((F.col("_n") <= most) & (F.col("_b") <= most_bytes)).drop("_n", "_b")


def delivery(status: Column) -> Column:
    """delivered, retry or dropped for an HTTP status: client errors but timeouts and throttling are final."""
    return F.when(status.between(200, 299), "delivered").when(status.between(400, 499) & ~status.isin(408, 429), "dropped").otherwise("retry")


def merged_resources(*lists: Column, most: int = 32) -> Column:
    """The lists joined in order, without repeats, cut to a number."""
    return F.slice(F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists])), 1, most)


def latest_by_ancestor(events: DataFrame, place: str) -> DataFrame:
    """(path, seq, type): the latest event on each dotted place or anything below it."""
    parts = F.split(place, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    rows = events.where(F.col(place).isNotNull()).select(F.explode(prefixes).alias("path"), "seq", "type")
    return rows.groupBy("path").agg(F.max("seq").alias("seq"), F.max_by("type", "seq").alias("type"))


def inactive(events: DataFrame, now: Column, after_ms: int = INACTIVE_MS) -> DataFrame:
    """(session, idle_ms): sessions without an event for some time."""
    idle = millis(now) - millis("last")
    return events.groupBy("session").agg(F.max("ts").alias("last")).select("session", idle.alias("idle_ms")).where(F.col("idle_ms") >= after_ms)


def evicted(sessions: DataFrame, most: int) -> DataFrame:
    """(session): the least recently used idle sessions beyond a number; active ones never go.

    ``sessions``: session, active, last_seq.
    """
    ranked = numbered(sessions, [Down("active"), Down("last_seq"), "session"], "_k", first=1)
    return ranked.where((F.col("_k") > most) & ~F.col("active")).select("session")


# Tools that share the shell's group.
SHELLS = ("bash", "sh", "shell", "zsh", "fish", "cmd", "powershell", "pwsh", "terminal", "exec", "run", "run_command", "command")


def group_id(tool: Column, kind_: Column, type_: Column) -> Column:
    """Group of an event in the live view: one for all shells and for work without a tool, one for each
    other tool; null for what is no work."""
    name = F.lower(text.safe_tool(tool))
    work = name.isNotNull() | (kind_ == "execute") | type_.startswith("tool.") | (type_ == "tool")
    shown = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    return F.when(work, F.when(name.isNull() | name.isin(*SHELLS), "group:activity:bash").otherwise(F.concat(F.lit("group:activity:tool:"), shown)))


def group_label(group: Column, tool: Column) -> Column:
    """What the group is called in the live view."""
    name = F.lower(text.safe_tool(tool))
    return F.when((group == "group:activity:bash") | name.isNull(), "bash commands").otherwise(F.concat(F.lit("tool · "), name))


def recent(events: DataFrame, number: int = 0, size: int = 10) -> DataFrame:
    """A page of the newest events, newest first."""
    return events.orderBy(F.desc("seq")).offset(number * size).limit(size)


def agents(events: DataFrame, agent: str = "agent") -> DataFrame:
    """(session, agent, events, last_type, failed, waiting): the last known state of each agent."""
    known = events.where(F.col(agent).isNotNull())
    out = known.groupBy("session", agent).agg(
        F.count("*").alias("events"), F.max_by("type", "seq").alias("last_type"), F.bool_or(F.col("status") == "failed").alias("failed"),
        F.max(F.when(F.col("type") == "permission.requested", F.col("seq"))).alias("asked"), F.max(F.when(F.col("type") == "permission.completed", F.col("seq"))).alias("answered"),
    )
    waiting = F.col("asked").isNotNull() & (F.col("answered").isNull() | (F.col("asked") > F.col("answered")))
    return out.withColumn("waiting", waiting).drop("asked", "answered")


def connection_coverage(actions: DataFrame) -> DataFrame:
    """The actions (key, seq, action, status) of connections with the ``coverage`` behind each.

    Coverage begins as ``unavailable`` and is that again when a connection says so; a ``gap`` makes it
    ``partial`` until then. Any other news from an unavailable connection makes it ``observed``, and an
    ``event`` after that ``exact``. What counts is thus the last of the first two kinds and how much
    of the others came since, which is known from running totals over ranges and values carried on.
    """
    reset = (F.col("action") == "gap") | ((F.col("action") == "connection") & F.coalesce(F.col("status") == "unavailable", F.lit(False)))
    begin = actions.groupBy("key").agg((F.min("seq") - 1).alias("seq")).select("key", "seq", F.lit("connection").alias("action"), F.lit("unavailable").alias("status"), F.lit(True).alias("begin"))
    rows = actions.select("key", "seq", "action", "status").withColumn("begin", F.lit(False)).unionByName(begin)
    rows = running_totals(rows, ["key", "seq"], news=F.when(reset, 0).otherwise(1), events=F.when(F.col("action") == "event", 1).otherwise(0))
    rows = carried(rows, ["key"], ["seq"], since=F.when(reset, F.struct("action", "news", "events")))
    first = ~reset & (F.col("news") - F.col("since.news") == 1)
    rows = carried(rows, ["key"], ["seq"], opened=F.when(first, (F.col("action") == "event").cast("int")))
    later = F.col("events") - F.col("since.events") - F.col("opened")
    state = F.when(F.col("since.action") == "gap", "partial").when(F.col("news") == F.col("since.news"), "unavailable").when(later > 0, "exact").otherwise("observed")
    return rows.where("not begin").select("key", "seq", "action", "status", state.alias("coverage"))


# Names that providers give to events, with type and status.
PROVIDER_EVENTS = {
    "session.start": ("session", "started"),
    "session.resume": ("session", "resumed"),
    "session.idle": ("session", "idle"),
    "session.shutdown": ("session", "completed"),
    "session.error": ("error", "failed"),
    "session.warning": ("error", "warning"),
    "session.context_changed": ("session", "updated"),
    "session.task_complete": ("session", "task_complete"),
    "user.message": ("prompt", "submitted"),
    "assistant.message": ("assistant", "completed"),
    "assistant.message_delta": ("assistant", "streaming"),
    "tool.execution_start": ("tool", "started"),
    "tool.execution_complete": ("tool", "completed"),
    "tool.execution_failure": ("tool", "failed"),
    "permission.requested": ("permission", "requested"),
    "permission.completed": ("permission", "completed"),
    "permission.granted": ("permission", "granted"),
    "permission.denied": ("permission", "denied"),
    "agent.started": ("agent", "started"),
    "agent.completed": ("agent", "completed"),
    "agent.failed": ("agent", "failed"),
    "subagent.started": ("agent", "started"),
    "subagent.completed": ("agent", "completed"),
    "subagent.failed": ("agent", "failed"),
}


def from_hook_type(name: Column) -> Column:
    """(type, status) of a provider's name of an event: known names as they are, others by what they hold."""
    pair = lambda t, s: F.struct(F.lit(t).alias("type"), (F.lit(s) if isinstance(s, str) else s).alias("status"))
    bad = name.rlike("(?i)fail|error")
    out = F.when(name.isNull(), pair("error", "unknown"))
    for known, (t, s) in PROVIDER_EVENTS.items():
        out = out.when(name == known, pair(t, s))
    return (
        out.when(name.rlike("(?i)permission"), pair("permission", "requested")).when(name.rlike("(?i)prompt|user"), pair("prompt", "submitted"))
        .when(name.rlike("(?i)assistant|response|message"), pair("assistant", "completed")).when(name.rlike("(?i)tool|execute"), pair("tool", F.when(bad | name.rlike("(?i)denied"), "failed").otherwise("started")))
        .when(name.rlike("(?i)agent"), pair("agent", F.when(bad, "failed").otherwise("started"))).when(bad, pair("error", "failed")).otherwise(pair("error", "unknown"))
    )


def from_hook(raw: DataFrame, body: str = "body") -> DataFrame:
    """(type, status, session, tool): provider payloads in JSON as events; unknown names stay themselves."""
    at = lambda p: F.get_json_object(body, p)
    name = F.coalesce(at("$.hook_event_name"), at("$.event"), at("$.type"))
    kind_ = (
        F.when(name == "UserPromptSubmit", "prompt.submitted").when(name == "PreToolUse", "tool.started").when(name.isin("PostToolUse", "PostToolUseFailure"), "tool.completed")
        .when(name == "SessionStart", "session.started").when(name == "SessionEnd", "session.ended").when(name == "Stop", "turn.completed").when(name == "PermissionRequest", "permission.requested").otherwise(F.lower(name))
    )
    failed = name.endswith("Failure") | at("$.error").isNotNull()
    return raw.select(kind_.alias("type"), F.when(F.coalesce(failed, F.lit(False)), "failed").otherwise("ok").alias("status"), F.coalesce(at("$.session_id"), at("$.sessionId")).alias("session"), F.coalesce(at("$.tool_name"), at("$.tool")).alias("tool"))
