"""Sessions of agents: lifecycle of tools, permissions and turns, status, who owns a permission, notices.

Events carry ``seq``, their arrival order, ``session``, ``type``, ``status``, ``ts``, ``tool_call``,
``agent`` and ``result`` (of a permission). All folds go by arrival order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .activity import FAILED_MS, STALLED_MS, millis

# Types and statuses that start and end a session.
STARTS = ("session.start", "session.started", "session.status", "agent.start")
START_STATUS = ("started", "resumed", "active", "updated")
ENDS = ("session.end", "session.ended", "agent.stop", "agent.error")
END_STATUS = ("completed", "ended", "failed", "stopped")
DENIED = "denied"


def _type() -> Column:
    return F.coalesce(F.col("type"), F.lit(""))


def _status() -> Column:
    return F.coalesce(F.col("status"), F.lit(""))


def tool_step() -> Column:
    """started, completed or failed of a tool event; null for others."""
    t, s = _type(), _status()
    plain = t == "tool"
    return (
        F.when(t.isin("tool.started", "tool.start") | (plain & s.isin("started", "running")), "started")
        .when(t.isin("tool.completed", "tool.end") | (plain & s.isin("completed", "complete")), "completed")
        .when(t.isin("tool.failed", "tool.error") | (plain & s.isin("failed", "error")), "failed")
    )


def permission_step() -> Column:
    """requested or completed of a permission event; null for others. Without status or result it is a request."""
    t = _type()
    own = (t == "permission") | t.startswith("permission.")
    asked = (t == "permission.requested") | (own & (t != "permission.completed") & (_status().isin("requested", "pending") | (F.col("status").isNull() & F.col("result").isNull())))
    done = (t == "permission.completed") | (own & (_status().isin("completed", "complete") | F.col("result").isNotNull()))
    return F.when(asked, "requested").when(done, "completed")


def starts_session() -> Column:
    return _type().isin(*STARTS) | ((_type() == "session") & _status().isin(*START_STATUS))


def ends_session() -> Column:
    return _type().isin(*ENDS) | ((_type() == "session") & _status().isin(*END_STATUS))


def opens_turn() -> Column:
    t = _type()
    return (t == "user.message") | (((t == "prompt") | t.startswith("prompt.")) & F.coalesce(F.col("status").isin("submitted", "started", "ok"), F.lit(True)))


def closes_turn() -> Column:
    """The session idles or ends, or its own agent (not one below it) is done."""
    t = _type()
    idle = (t == "session.idle") | ((t == "session") & (_status() == "idle")) | (t == "turn.completed")
    top = F.coalesce(F.coalesce(F.col("agent"), F.col("session")) == F.col("session"), F.lit(False))
    done = t.rlike(r"^(?:sub)?agent(?:\..*)?$") & (_status().isin("completed", "complete") | t.endswith("completed"))
    return idle | ends_session() | (top & done)


def is_error() -> Column:
    """A session's own error; warnings and events that nobody knows are none."""
    return (_type() == "error") & ~_status().isin("warning", "unknown")


def states(events: DataFrame, now: Column) -> DataFrame:
    """One row a session: its counts, times, open turn, open permission, last denial, and status at ``now``.

    waiting if a permission that was asked for is open: neither answered nor has its tool call gone on;
    failed for a while after an error or a failed last tool; stalled if a turn is open and nothing
    happens; active while one is; else idle, or ended. Everything is an aggregate of each tool call of
    a session, then of each session, so a hot session is reduced before it is shuffled.
    """
    seq = F.col("seq")
    at = lambda when: F.max(F.when(when, F.struct("seq", "ts")))
    rows = events.withColumns({"_tool": tool_step(), "_permission": permission_step()})
    calls = rows.groupBy("session", "tool_call").agg(
        F.count("*").alias("events"), F.min_by("ts", "seq").alias("first_ts"), F.min("seq").alias("first_seq"), F.max("ts").alias("last_at"), F.max_by("type", "seq").alias("last_type"), F.max("seq").alias("last_seq"),
        F.count_if((F.col("status") == "failed") | (F.col("_tool") == "failed")).alias("failures"),
        at(opens_turn()).alias("opened"), at(closes_turn()).alias("closed"), at(starts_session()).alias("begun"), at(ends_session()).alias("ended"), at(is_error()).alias("error"),
        at(F.col("_permission") == "requested").alias("asked"), at(F.col("_permission") == "completed").alias("answered"), at((F.col("_permission") == "completed") & F.col("result").startswith(DENIED)).alias("denied"),
        at(F.col("_tool").isNotNull()).alias("tool"), F.max(F.when(F.col("_tool").isin("completed", "failed"), F.struct("seq", "ts", "_tool"))).alias("outcome"),
    )
    # a request without a call opens nothing
    asked = F.when(F.col("tool_call").isNotNull() & F.col("asked").isNotNull(), F.struct(F.col("asked.seq").alias("seq"), F.col("asked.ts").alias("ts"), "tool_call", F.col("tool.seq").alias("went_on")))
    top = lambda c: F.max(c).alias(c)
    out = calls.groupBy("session").agg(
        F.sum("events").alias("events"), F.min_by("first_ts", "first_seq").alias("started"), F.max("last_at").alias("last_at"), F.sum("failures").alias("failures"), F.max_by("last_type", "last_seq").alias("last_type"),
        *[top(c) for c in ("opened", "closed", "begun", "ended", "error", "answered", "denied", "outcome")], F.max(asked).alias("asked"),
    )
    later = lambda a, b: F.col(f"{a}.seq").isNotNull() & (F.col(f"{b}.seq").isNull() | (F.col(f"{a}.seq") > F.col(f"{b}.seq")))
    waiting = later("asked", "answered") & (F.col("asked.went_on").isNull() | (F.col("asked.went_on") < F.col("asked.seq")))
    turn_open, ended = later("opened", "closed"), later("ended", "begun")
    recent = lambda c: F.coalesce(millis(now) - millis(c) <= FAILED_MS, F.lit(False))
    failed = recent("error.ts") | (F.coalesce(F.col("outcome._tool") == "failed", F.lit(False)) & recent("outcome.ts"))
    quiet = millis(now) - millis("last_at") > STALLED_MS
    status = F.when(waiting, "waiting").when(failed, "failed").when(turn_open & quiet, "stalled").when(turn_open, "active").when(ended, "ended").otherwise("idle")
    return out.select(
        "session", "events", "started", "last_at", "failures", "last_type", turn_open.alias("turn_open"), status.alias("status"),
        F.when(waiting, F.col("asked.tool_call")).alias("waiting_call"), F.when(waiting, F.col("asked.ts")).alias("waiting_since"),
        F.when(ended, F.col("ended.ts")).alias("ended_at"), F.col("denied.ts").alias("denied_at"), F.col("outcome._tool").alias("last_outcome"),
    )


def permissions(events: DataFrame) -> DataFrame:
    """(session, tool_call, asked_seq, answered_seq, waited_ms, result, owner, how): each permission asked for.

    The next completion or step of its tool call answers it, unless it is asked for again first. Its owner is the agent named, else the session's own agent if it was seen before, else
    the agent seen last; a completion that names another agent still belongs to the request's.
    """
    rows = events.withColumns({"_tool": tool_step(), "_permission": permission_step()})
    so_far = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    top_seen = F.coalesce(F.max((F.col("agent") == F.col("session")).cast("int")).over(so_far), F.lit(0)) == 1
    last_seen = F.last("agent", ignorenulls=True).over(so_far)
    owner = F.coalesce("agent", F.when(top_seen, F.col("session")), last_seen)
    how = F.when(F.col("agent").isNotNull(), "named").when(top_seen, "top").when(last_seen.isNotNull(), "recent").otherwise("none")
    rows = rows.withColumns({"owner": owner, "how": how})
    rows = rows.where(F.col("tool_call").isNotNull() & (F.col("_permission").isNotNull() | F.col("_tool").isNotNull()))
    # read backwards, what comes next is the last one seen: a frame that only grows is kept up row by row, one that only shrinks isn't
    ahead = Window.partitionBy("session", "tool_call").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    answers = (F.col("_permission") == "completed") | F.col("_tool").isNotNull()
    answer = F.last(F.when(F.coalesce(answers, F.lit(False)), F.struct("seq", "ts", "result", "_permission")), ignorenulls=True).over(ahead)
    again = F.last(F.when(F.col("_permission") == "requested", F.col("seq")), ignorenulls=True).over(ahead)
    asked = rows.withColumns({"answer": answer, "again": again}).where("_permission = 'requested'")
    own = F.col("answer.seq").isNotNull() & (F.col("again").isNull() | (F.col("again") > F.col("answer.seq")))
    return asked.select(
        "session", "tool_call", F.col("seq").alias("asked_seq"), F.when(own, F.col("answer.seq")).alias("answered_seq"), F.when(own, F.greatest(F.lit(0), millis("answer.ts") - millis())).alias("waited_ms"),
        F.when(own, F.coalesce("answer.result", F.when(F.col("answer._permission").isNull(), "ran"))).alias("result"), "owner", "how",
    )


def notices(before: DataFrame, after: DataFrame) -> DataFrame:
    """(session, status, key): sessions that wait or have failed and didn't so before, each told once by its key."""
    key = F.concat_ws(":", "session", "status", F.coalesce(F.col("waiting_call").cast("string"), F.lit("")))
    told = before.where(F.col("status").isin("waiting", "failed")).select(key.alias("key"))
    now = after.where(F.col("status").isin("waiting", "failed")).select("session", "status", key.alias("key"))
    return now.join(told, "key", "left_anti").select("session", "status", "key")


def event_order() -> Column:
    """Sort key of events of mixed origin: recorded order, else time, sequence and identity.

    A pairwise rule (same session: sequence before time) is no total order over mixed rows; this one is.
    """
    late = F.lit(2**62)
    return F.struct(F.coalesce("recording_sequence", late).alias("r"), "ts", F.coalesce("sequence", late).alias("s"), F.concat_ws("|", "session", F.coalesce("id", F.lit(""))).alias("i"))


def buffered(events: DataFrame, size: int = 500) -> DataFrame:
    """The last ``size`` events of each session in their order: what a viewer keeps."""
    rank = F.row_number().over(Window.partitionBy("session").orderBy(event_order().desc()))
    return events.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_rank")


def watcher_dedupe(events: DataFrame, content: str) -> DataFrame:
    """The first arrival of each event by session and id, or by a hash of its content where it has no id."""
    key = F.when(F.col("id").isNotNull(), F.concat_ws(":", "session", "id")).otherwise(F.sha2(F.concat_ws(":", "session", content), 256))
    rest = events.columns
    first = events.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rest), "seq").alias("r"))
    return first.select("r.*")


#: Readers that one pass serves at most.
MAX_READERS = 64


def subscriptions(events: DataFrame, readers: list[tuple[str, str | None, int]], queue: int = 128) -> DataFrame:
    """(reader, sent, dropped): events behind each reader's cursor, of its workspace or (None) of all.

    What exceeds a reader's queue is dropped. ``readers``: (name, workspace, cursor), a bounded number,
    so all are counted in one pass as columns of one aggregate.
    """
    if len(readers) > MAX_READERS:
        raise ValueError(f"at most {MAX_READERS} readers")
    wants = lambda w, c: (F.col("seq") > c) & (F.lit(True) if w is None else F.coalesce(F.col("workspace") == w, F.lit(False)))
    counts = events.agg(*[F.count_if(wants(w, c)).alias(f"n{i}") for i, (_, w, c) in enumerate(readers)])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("reader"), F.col(f"n{i}").alias("n")) for i, (name, _, _) in enumerate(readers)])).alias("r")).select("r.*")
    return rows.select("reader", F.least("n", F.lit(queue)).alias("sent"), F.greatest(F.col("n") - queue, F.lit(0)).alias("dropped"))


def flushes(events: DataFrame, every_ms: int = 45) -> DataFrame:
    """(session, flush, events, first_seq, last_seq): events by the interval of time in which they are flushed."""
    return events.groupBy("session", F.floor(millis() / every_ms).alias("flush")).agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def paused(events: DataFrame, start: Column, end: Column, size: int = 500) -> DataFrame:
    """Events that a reader sees who pauses in between: of those of the pause the newest ``size`` of each session."""
    held = (F.col("ts") >= start) & (F.col("ts") < end)
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq")))
    return events.where(~held).unionByName(events.where(held).withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_rank"))


def agent_nodes(events: DataFrame) -> DataFrame:
    """(session, agent, events, last_type, last_at, waiting_call, denied_at): the state of each agent of a session.

    An event without an agent is its session's own. A permission is its owner's (see ``permissions``),
    whoever answers it.
    """
    asked = permissions(events)
    who = F.coalesce("agent", "session")
    own = events.withColumn("agent", who).groupBy("session", "agent").agg(F.count("*").alias("events"), F.max_by("type", "seq").alias("last_type"), F.max("ts").alias("last_at"))
    open_ = asked.where("answered_seq is null").groupBy("session", F.coalesce("owner", "session").alias("agent")).agg(F.max_by("tool_call", "asked_seq").alias("waiting_call"))
    denied = asked.where(F.col("result").startswith(DENIED)).join(events.select("session", F.col("seq").alias("answered_seq"), "ts"), ["session", "answered_seq"])
    denied = denied.groupBy("session", F.coalesce("owner", "session").alias("agent")).agg(F.max("ts").alias("denied_at"))
    return own.join(open_, ["session", "agent"], "left").join(denied, ["session", "agent"], "left")
