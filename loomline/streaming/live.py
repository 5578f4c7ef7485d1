"""The activity stream as Structured Streaming: dedupe, keyed session state, and sinks by micro-batch.

Every function takes a streaming DataFrame with the columns of ``operators.activity`` and gives one
back, so the same rows through a batch operator and through a stream give the same result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.operators import activity as act
from loomline.operators import sessions as ses
from loomline.sources import archive

SESSION = "session string, events bigint, opened bigint, closed bigint, failures bigint, last_type string, turn_open boolean"
SESSION_STATE = "events bigint, opened bigint, closed bigint, failures bigint, last_seq bigint, last_type string"
OPEN, CLOSE = "prompt.submitted", "turn.completed"


def dedupe(stream: DataFrame, *key: str, within: str = "10 minutes", at: str = "ts") -> DataFrame:
    """The first row of each key within a time of the watermark; state is dropped behind it."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(list(key))


def _in_ring(size: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = dict.fromkeys(state.get[0] if state.exists else ())
        for pdf in batches:
            kept = []
            for place, one in enumerate(pdf["id"]):
                if one is not None and one in seen:
                    continue
                kept.append(place)
                if one is not None:
                    seen[one] = None
                    if len(seen) > size:
                        del seen[next(iter(seen))]
            yield pdf.iloc[kept][["row"]]
        state.update((list(seen),))

    return run


def dedupe_in_ring(stream: DataFrame, by: str, id_col: str, ring: int = act.RING) -> DataFrame:
    """The rows whose id isn't among the last ``ring`` ids that were kept for their key.

    State ends by number, not by time: once ``ring`` other ids have come in, an id is new again. Rows
    of a key are taken in the order in which a micro-batch holds them; rows without id all stay.
    """
    names = stream.columns
    rows = stream.select(F.col(f"`{by}`").alias("key"), F.col(f"`{id_col}`").cast("string").alias("id"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("row"))
    kept = rows.groupBy("key").applyInPandasWithState(_in_ring(ring), "row string", "ids array<string>", "append", "NoTimeout")
    return kept.select(F.from_json("row", stream.schema).alias("r")).select(*[F.col(f"r.`{c}`").alias(c) for c in names])


_MARKS = ("opened", "closed", "begun", "ended", "error", "asked", "answered", "denied", "started", "finished", "broken")
LIFECYCLE = (
    "session string, events bigint, started bigint, last_at bigint, failures bigint, last_type string, last_seq bigint, turn_open boolean, waiting_call bigint, waiting_since bigint,"
    " ended_at bigint, denied_at bigint, last_outcome string, outcome_at bigint, error_at bigint"
)


def _live(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    s = json.loads(state.get[0]) if state.exists else {"events": 0, "failures": 0, "last_at": None, "at": {}}
    for pdf in batches:
        pdf = pdf.sort_values("seq")
        s.setdefault("started", int(pdf["ms"].iloc[0]))
        s["events"] += len(pdf)
        s["failures"] += int(pdf["failed"].sum())
        s["last_at"] = max(int(pdf["ms"].max()), s["last_at"] if s["last_at"] is not None else int(pdf["ms"].max()))
        s["last_type"], s["last_seq"] = pdf["type"].iloc[-1], int(pdf["seq"].iloc[-1])
        for mark in _MARKS:
            own = pdf[pdf[mark]]
            if len(own):
                s["at"][mark] = [int(own["seq"].iloc[-1]), int(own["ms"].iloc[-1])]
        for row in pdf[pdf["asked"] | pdf["started"] | pdf["finished"] | pdf["broken"]].itertuples(index=False):
            if pd.isna(row.tool_call):
                continue
            if row.asked:
                s["request"] = [int(row.seq), int(row.ms), int(row.tool_call)]
            elif s.get("request") and s["request"][2] == int(row.tool_call):
                s["request"] = None  # its call has gone on
    state.update((json.dumps(s),))
    at = s["at"]
    later = lambda a, b: a is not None and (b is None or a[0] > b[0])
    waiting = later(s.get("request"), at.get("answered"))
    done = max(at.get("finished") or [-1, -1], at.get("broken") or [-1, -1])
    row = {
        "session": key[0], "events": s["events"], "started": s["started"], "last_at": s["last_at"], "failures": s["failures"], "last_type": s["last_type"], "last_seq": s["last_seq"],
        "turn_open": later(at.get("opened"), at.get("closed")), "waiting_call": s["request"][2] if waiting else None, "waiting_since": s["request"][1] if waiting else None,
        "ended_at": at["ended"][1] if later(at.get("ended"), at.get("begun")) else None, "denied_at": at["denied"][1] if "denied" in at else None,
        "last_outcome": None if done[0] < 0 else "failed" if done == at.get("broken") else "completed", "outcome_at": None if done[0] < 0 else done[1], "error_at": at["error"][1] if "error" in at else None,
    }
    out = pd.DataFrame([row])
    numbers = [c for c in out.columns if c not in ("session", "last_type", "last_outcome", "turn_open")]
    yield out.astype(dict.fromkeys(numbers, "Int64"))


def session_lifecycle(stream: DataFrame) -> DataFrame:
    """The state of each session that a micro-batch touched: turn, open permission, end, denial, last outcome.

    The batch operator is ``sessions.states``; events of a session come in by ``seq``. State is a
    few values a session, however many calls it has. ``status_at`` tells the status at a time.
    """
    call, permission = ses.tool_step(), ses.permission_step()
    flags = {
        "opened": ses.opens_turn(), "closed": ses.closes_turn(), "begun": ses.starts_session(), "ended": ses.ends_session(), "error": ses.is_error(), "asked": permission == "requested",
        "answered": permission == "completed", "denied": (permission == "completed") & F.col("result").startswith(ses.DENIED), "started": call == "started", "finished": call == "completed", "broken": call == "failed",
        "failed": (F.col("status") == "failed") | (call == "failed"),
    }
    rows = stream.select("session", "seq", act.millis().alias("ms"), "type", "tool_call", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()])
    return rows.groupBy("session").applyInPandasWithState(_live, LIFECYCLE, "state string", "update", "NoTimeout")


def status_at(sessions: DataFrame, now_ms: Column) -> DataFrame:
    """The rows of ``session_lifecycle`` with the ``status`` at a time: waiting, failed, stalled, active, ended or idle."""
    recent = lambda c: F.coalesce(now_ms - F.col(c) <= act.FAILED_MS, F.lit(False))
    failed = recent("error_at") | (F.coalesce(F.col("last_outcome") == "failed", F.lit(False)) & recent("outcome_at"))
    quiet = now_ms - F.col("last_at") > act.STALLED_MS
    status = (
        F.when(F.col("waiting_since").isNotNull(), "waiting").when(failed, "failed").when(F.col("turn_open") & quiet, "stalled")
        .when(F.col("turn_open"), "active").when(F.col("ended_at").isNotNull(), "ended").otherwise("idle")
    )
    return sessions.withColumn("status", status)


def counts(stream: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling or sliding windows of event time."""
    by = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = stream.withWatermark("ts", late).groupBy(by, act.kind().alias("kind")).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "kind", "n")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    events, opened, closed, failures, last_seq, last_type = state.get if state.exists else (0, -1, -1, 0, -1, None)
    for pdf in batches:
        events += len(pdf)
        failures += int((pdf["status"] == "failed").sum())
        for kind, name in ((OPEN, "o"), (CLOSE, "c")):
            top = pdf.loc[pdf["type"] == kind, "seq"].max()
            if pd.notna(top):
                opened, closed = (max(opened, int(top)), closed) if name == "o" else (opened, max(closed, int(top)))
        row = pdf.loc[pdf["seq"].idxmax()]
        if row["seq"] > last_seq:
            last_seq, last_type = int(row["seq"]), row["type"]
    state.update((events, opened, closed, failures, last_seq, last_type))
    yield pd.DataFrame([(key[0], events, opened, closed, failures, last_type, opened > closed)], columns=["session", "events", "opened", "closed", "failures", "last_type", "turn_open"])


def sessions(stream: DataFrame) -> DataFrame:
    """The state of each session that a micro-batch touched; bounded state of six values a session.

    The fold keeps maxima by arrival order, so it is the same however a session's rows are batched.
    """
    rows = stream.select("session", "seq", "type", "status")
    return rows.groupBy("session").applyInPandasWithState(_fold, SESSION, SESSION_STATE, "update", "NoTimeout")


def _pair(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    start = state.get if state.exists else None
    out = []
    for pdf in batches:
        for row in pdf.sort_values("seq").itertuples(index=False):
            if row.type == "tool.started":
                start = (int(row.seq), int(row.ms))
            else:
                out.append((key[0], key[1], int(row.seq), start[0] if start else -1, max(0, int(row.ms) - start[1]) if start else -1))
                start = None
    if start:
        state.update(start)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["session", "tool_call", "end_seq", "start_seq", "duration_ms"])


def tool_spans(stream: DataFrame) -> DataFrame:
    """Each end of a call with the open start before it, in order of arrival; -1 where there is none.

    Only open calls hold state.
    """
    rows = stream.where("type like 'tool%' and tool_call is not null").select("session", "tool_call", "seq", "type", act.millis().alias("ms"))
    out = "session string, tool_call bigint, end_seq bigint, start_seq bigint, duration_ms bigint"
    return rows.groupBy("session", "tool_call").applyInPandasWithState(_pair, out, "seq bigint, ms bigint", "append", "NoTimeout")


def archive_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch to an archive, each batch in a folder of its own.

    A batch that is run again after a failure overwrites its folder, so no row is doubled. Lines of a
    recording are numbered by arrival when they are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        lines = batch.select(F.col("session").alias("recording_id"), "seq", F.col("ts").alias("capturedAt"), F.to_json(F.struct(*batch.columns), archive.TIMES).alias("event"))
        lines.write.mode("overwrite").options(**archive.TIMES).json(f"{path}/batch={number:09d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reject_stream(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejects with their code."""
    return act.validate(stream)


def frames(stream: DataFrame) -> DataFrame:
    """Rows as server-sent events: id, event and data lines."""
    body = F.to_json(F.struct(*stream.columns))
    return stream.select(F.format_string("id: %d\nevent: activity\ndata: %s\n\n", "seq", body).alias("frame"))
