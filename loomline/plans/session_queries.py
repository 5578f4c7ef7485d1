"""Queries over the derived stream of sessions, tools and permissions, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import sessions
from loomline.plans.graph_queries import longs
from loomline.sources import relational as src

BASE = "WITH " + src.LIFECYCLE_SQL
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ms(c: str) -> str:
    return f"(epoch_us({c}) // 1000)"


def _states(name: str, rows: str, now: str) -> str:
    """Common table expressions ``name``: sessions of ``rows`` at a time."""
    last = lambda when: f"max(seq) FILTER ({when})"
    at = lambda when: f"max_by(ts, seq) FILTER ({when})"
    error, outcome, denied = "type = 'error' AND status <> 'warning'", "type IN ('tool.completed', 'tool.failed')", "type = 'permission.completed' AND starts_with(result, 'denied')"
    return f""", {name}_m AS (SELECT session, count(*) AS events, min_by(ts, seq) AS started, max(ts) AS last_at, max_by(type, seq) AS last_type, count(*) FILTER (status = 'failed' OR type = 'tool.failed') AS failures,
  {last("type = 'permission.requested' AND tool_call IS NOT NULL")} AS a, max_by(tool_call, seq) FILTER (type = 'permission.requested' AND tool_call IS NOT NULL) AS call, {at("type = 'permission.requested' AND tool_call IS NOT NULL")} AS since,
  {last("type = 'permission.completed'")} AS p, {last("type = 'prompt.submitted'")} AS o, {last("type IN ('turn.completed', 'session.ended')")} AS c, {last("type = 'session.started'")} AS b, {last("type = 'session.ended'")} AS e, {at("type = 'session.ended'")} AS e_at,
  {at(error)} AS err, max_by(type, seq) FILTER ({outcome}) AS out, {at(outcome)} AS out_at, {at(denied)} AS denied_at FROM {rows} GROUP BY session),
{name}_w AS (SELECT m.*, a IS NOT NULL AND (p IS NULL OR a > p) AND NOT EXISTS (SELECT 1 FROM {rows} t WHERE t.session = m.session AND t.tool_call = m.call AND t.type LIKE 'tool%' AND t.seq > m.a) AS waiting,
  o IS NOT NULL AND (c IS NULL OR o > c) AS turn_open, e IS NOT NULL AND (b IS NULL OR e > b) AS over FROM {name}_m m),
{name} AS (SELECT session, events, started, last_at, failures, last_type, turn_open,
  CASE WHEN waiting THEN 'waiting' WHEN {_ms(now)} - {_ms('err')} <= 60000 OR (out = 'tool.failed' AND {_ms(now)} - {_ms('out_at')} <= 60000) THEN 'failed' WHEN turn_open AND {_ms(now)} - {_ms('last_at')} > 180000 THEN 'stalled' WHEN turn_open THEN 'active' WHEN over THEN 'ended' ELSE 'idle' END AS status,
  CASE WHEN waiting THEN call END AS waiting_call, CASE WHEN waiting THEN since END AS waiting_since, CASE WHEN over THEN e_at END AS ended_at, denied_at, substr(out, 6) AS last_outcome FROM {name}_w)"""


def _shown(*columns: str) -> str:
    """The same in SQL: names with ``@`` are times, with ``#`` numbers, with ``$`` texts."""
    form = {"@": "coalesce(strftime({0}, '%Y-%m-%d %H:%M:%S.%f'), '-') AS {0}", "#": "coalesce({0}, -1)::BIGINT AS {0}", "$": "coalesce({0}, '-') AS {0}"}
    return ", ".join(form[c[0]].format(c[1:]) if c[0] in form else c for c in columns)


def _plain_times(df: DataFrame) -> DataFrame:
    """Times as text with six digits of a second, so that both sides write them alike."""
    return df.withColumns({c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("-")) for c, k in df.dtypes if k.startswith("timestamp")}).fillna("-").fillna(-1)


@query(BASE + ", n AS (SELECT max(ts) AS now FROM lifecycle)" + _states("states", "lifecycle", "(SELECT now FROM n)") + " SELECT " + _shown("session", "events", "@started", "@last_at", "failures", "last_type", "turn_open", "status", "#waiting_call", "@waiting_since", "@ended_at", "@denied_at", "$last_outcome") + " FROM states")
def session_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    e = src.lifecycle(spark, d)
    return _plain_times(longs(sessions.states(e, F.lit(e.agg(F.max("ts")).first()[0]))))


@query(
    BASE
    + """, w AS (SELECT *, max(CASE WHEN agent = session THEN 1 ELSE 0 END) OVER s AS top, last_value(agent IGNORE NULLS) OVER s AS last_agent FROM lifecycle
  WINDOW s AS (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, coalesce(agent, CASE WHEN top = 1 THEN session END, last_agent) AS owner, CASE WHEN agent IS NOT NULL THEN 'named' WHEN top = 1 THEN 'top' WHEN last_agent IS NOT NULL THEN 'recent' ELSE 'none' END AS how FROM w WHERE type = 'permission.requested' AND tool_call IS NOT NULL),
m AS (SELECT r.*, (SELECT min(x.seq) FROM lifecycle x WHERE x.session = r.session AND x.tool_call = r.tool_call AND x.seq > r.seq AND (x.type = 'permission.completed' OR x.type LIKE 'tool%')) AS nxt,
  (SELECT min(x.seq) FROM lifecycle x WHERE x.session = r.session AND x.tool_call = r.tool_call AND x.seq > r.seq AND x.type = 'permission.requested') AS again FROM r),
f AS (SELECT m.session, m.tool_call, m.seq AS asked_seq, l.seq AS answered_seq, greatest(0, (epoch_us(l.ts) // 1000) - (epoch_us(m.ts) // 1000)) AS waited, l.result AS res, l.type AS ltype, owner, how FROM m LEFT JOIN lifecycle l ON l.seq = m.nxt AND (m.again IS NULL OR m.again > m.nxt))
SELECT session, tool_call, asked_seq, coalesce(answered_seq, -1) AS answered_seq, CASE WHEN answered_seq IS NULL THEN -1 ELSE waited END AS waited_ms, coalesce(res, CASE WHEN ltype LIKE 'tool%' THEN 'ran' END, '-') AS result, coalesce(owner, '-') AS owner, how FROM f"""
)
def permission_spans(spark: SparkSession, d: str) -> DataFrame:
    return sessions.permissions(src.lifecycle(spark, d)).fillna("-", ["result", "owner"]).fillna(-1, ["answered_seq", "waited_ms"])


_HALF = ", h AS (SELECT max(seq) // 2 AS mid FROM lifecycle), early AS (SELECT * FROM lifecycle, h WHERE seq <= mid), n AS (SELECT max(ts) AS now FROM lifecycle), nh AS (SELECT max(ts) AS now FROM early)"


@query(
    BASE
    + _HALF
    + _states("old", "early", "(SELECT now FROM nh)")
    + _states("new", "lifecycle", "(SELECT now FROM n)")
    + """, k AS (SELECT session, status, session || ':' || status || ':' || coalesce(waiting_call::VARCHAR, '') AS key FROM new WHERE status IN ('waiting', 'failed'))
SELECT * FROM k WHERE key NOT IN (SELECT session || ':' || status || ':' || coalesce(waiting_call::VARCHAR, '') FROM old WHERE status IN ('waiting', 'failed'))"""
)
def session_notices(spark: SparkSession, d: str) -> DataFrame:
    """What is new to tell at the end, as against half way."""
    e = src.lifecycle(spark, d)
    mid = e.agg(F.max("seq")).first()[0] // 2
    early = e.where(F.col("seq") <= mid)
    now = lambda x: F.lit(x.agg(F.max("ts")).first()[0])
    return sessions.notices(sessions.states(early, now(early)), sessions.states(e, now(e)))


@query(
    BASE
    + """, a AS (SELECT session, coalesce(agent, session) AS agent, count(*) AS events, max_by(type, seq) AS last_type, max(ts) AS last_at FROM lifecycle GROUP BY 1, 2)
SELECT session, agent, events, last_type, strftime(last_at, '%Y-%m-%d %H:%M:%S.%f') AS last_at FROM a"""
)
def agent_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _plain_times(sessions.agent_nodes(src.lifecycle(spark, d)).select("session", "agent", "events", "last_type", "last_at"))


_MIXED = ", mixed AS (SELECT *, CASE WHEN seq % 3 = 0 THEN seq * 7 % 1000 END AS recording_sequence, CASE WHEN seq % 4 > 0 THEN seq END AS sequence, seq::VARCHAR AS id FROM lifecycle)"


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq")
    return src.lifecycle(spark, d).withColumns({"recording_sequence": F.when(s % 3 == 0, s * 7 % 1000), "sequence": F.when(s % 4 > 0, s), "id": s.cast("string")})


@query(
    BASE
    + _MIXED
    + """, r AS (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY coalesce(recording_sequence, 4611686018427387904) DESC, ts DESC, coalesce(sequence, 4611686018427387904) DESC, session || '|' || id DESC) AS k FROM mixed)
SELECT session, seq FROM r WHERE k <= 20"""
)
def event_order(spark: SparkSession, d: str) -> DataFrame:
    """The last 20 events of each session, in an order of recorded and live ones."""
    return sessions.buffered(_mixed(spark, d), 20).select("session", "seq")


@query(
    BASE
    + """, x AS (SELECT session, CASE WHEN seq % 4 > 0 THEN (seq // 3)::VARCHAR END AS id, type || ':' || coalesce(tool_call, -1) AS content, seq FROM lifecycle)
SELECT min(seq) AS seq, arg_min(session, seq) AS session FROM x GROUP BY coalesce(session || ':' || id, '#' || session || ':' || content)"""
)
def watcher_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Events with ids that up to three share, and without any."""
    e = src.lifecycle(spark, d).withColumns({"id": F.when(F.col("seq") % 4 > 0, F.expr("cast(seq div 3 as string)")), "content": F.concat_ws(":", "type", F.coalesce("tool_call", F.lit(-1)).cast("string"))})
    return sessions.watcher_dedupe(e.select("seq", "session", "id", "content"), "content").select("seq", "session")


@query(
    BASE
    + """, r(reader, w, c) AS (VALUES ('all', NULL, 100), ('w1', 'w1', 0), ('w2', 'w2', 900), ('none', 'nowhere', 0)),
k AS (SELECT reader, (SELECT count(*) FROM lifecycle WHERE seq > c AND (w IS NULL OR workspace = w)) AS n FROM r)
SELECT reader, least(n, 128) AS sent, greatest(n - 128, 0) AS dropped FROM k"""
)
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    return longs(sessions.subscriptions(src.lifecycle(spark, d), [("all", None, 100), ("w1", "w1", 0), ("w2", "w2", 900), ("none", "nowhere", 0)]))


@query(BASE + " SELECT session, ((epoch_us(ts) // 1000) // 3600000)::BIGINT AS flush, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq FROM lifecycle GROUP BY ALL")
def flush_windows(spark: SparkSession, d: str) -> DataFrame:
    return sessions.flushes(src.lifecycle(spark, d), 3_600_000)


@query(
    BASE
    + """, t AS (SELECT min(ts) + (max(ts) - min(ts)) / 4 AS a, min(ts) + (max(ts) - min(ts)) / 2 AS b FROM lifecycle),
p AS (SELECT session, seq, ts >= a AND ts < b AS held, row_number() OVER (PARTITION BY session, ts >= a AND ts < b ORDER BY seq DESC) AS k FROM lifecycle, t)
SELECT session, seq FROM p WHERE NOT held OR k <= 5"""
)
def paused_view(spark: SparkSession, d: str) -> DataFrame:
    e = src.lifecycle(spark, d)
    a, b = e.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 4"), F.expr("min(ts) + (max(ts) - min(ts)) / 2")).first()
    return sessions.paused(e, F.lit(a), F.lit(b), 5).select("session", "seq")
