"""Queries over the derived activity stream, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import hashing, text
from loomline.operators import activity as act
from loomline.plans.graph_queries import longs
from loomline.sources import archive
from loomline.sources import relational as src
from loomline.storage import fresh_path, table

BASE = "WITH " + src.ACTIVITY_SQL
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _now(events: DataFrame):
    return F.lit(events.agg(F.max("ts")).first()[0])


@query(BASE + " SELECT CASE WHEN seq < 100 THEN 'MISSING_SESSION' WHEN value < 1 THEN 'MISSING_TYPE' WHEN tool_call > 95 THEN 'BAD_TOOL_CALL' ELSE 'valid' END AS code, count(*) AS n FROM activity GROUP BY 1")
def event_validation(spark: SparkSession, d: str) -> DataFrame:
    """Rows with blank sessions, null types and negative calls planted by value."""
    e = src.activity(spark, d)
    e = e.withColumn("session", F.when(F.col("seq") < 100, " ").otherwise(F.col("session"))).withColumn("type", F.when(F.col("value") >= 1, F.col("type")))
    e = e.withColumn("tool_call", F.when(F.col("tool_call") > 95, -1).otherwise(F.col("tool_call")))
    valid, rejects = act.validate(e)
    return valid.groupBy().agg(F.count("*").alias("n")).select(F.lit("valid").alias("code"), "n").unionByName(rejects.groupBy("code").agg(F.count("*").alias("n")))


@query(BASE + " SELECT session, type, tool_call, min(seq) AS seq, arg_min(value, seq) AS value FROM activity GROUP BY session, type, tool_call")
def event_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return act.dedupe(src.activity(spark, d), "session", "type", "tool_call").select("session", "type", "tool_call", "seq", "value")


@query(
    "WITH RECURSIVE "
    + src.ACTIVITY_SQL
    + """, e AS (SELECT session, type, seq, epoch_us(ts) // 1000 AS ms FROM activity),
kept AS (SELECT session, type, min((ms, seq)) AS p FROM e GROUP BY session, type
  UNION ALL SELECT k.session, k.type, (SELECT min((ms, seq)) FROM e WHERE e.session = k.session AND e.type = k.type AND e.ms > k.p[1] + 3600000) AS p FROM kept k WHERE k.p IS NOT NULL)
SELECT session, type, p[2] AS seq FROM kept WHERE p IS NOT NULL"""
)
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Of a session's events of a type, those within an hour of a kept one go."""
    return act.near_duplicates(src.activity(spark, d), "session", "type", window_ms=3_600_000).select("session", "type", "seq")


@query(
    BASE
    + """, a AS (SELECT *, CASE seq % 7 WHEN 0 THEN ['network', 'read'] WHEN 1 THEN ['network'] WHEN 2 THEN ['write', 'search'] WHEN 3 THEN ['reference'] WHEN 4 THEN ['other', 'execute'] ELSE [] END AS acts,
  CASE seq % 11 WHEN 0 THEN 'file.read' WHEN 1 THEN 'permission.requested' WHEN 2 THEN 'agent.started' WHEN 3 THEN 'search' WHEN 4 THEN 'file.write' WHEN 5 THEN 'error.occurred' ELSE type END AS kind_of FROM activity),
b AS (SELECT seq, kind_of, list_filter(acts, lambda x: x IN ('read', 'reference', 'write', 'search', 'execute'))[1] AS act, list_contains(acts, 'network') AS net, type FROM a)
SELECT seq, CASE WHEN kind_of LIKE 'permission%' THEN 'permission' WHEN act = 'reference' THEN 'read' WHEN act IS NOT NULL THEN act WHEN net THEN 'network' WHEN kind_of = 'file.read' THEN 'read' WHEN kind_of = 'file.write' THEN 'write' WHEN kind_of = 'search' THEN 'search'
  WHEN kind_of LIKE 'tool%' THEN 'execute' WHEN kind_of LIKE 'agent.%' THEN 'session' WHEN kind_of LIKE 'error%' THEN 'error' ELSE 'unknown' END AS kind,
  CASE WHEN type = 'tool.started' THEN 'started' WHEN type = 'tool.completed' THEN 'completed' END AS lifecycle FROM b"""
)
def event_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Events with planted types and actions on resources."""
    texts = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    e = src.activity(spark, d)
    acts = F.coalesce(*[F.when(F.col("seq") % 7 == i, texts(*x)) for i, x in enumerate((("network", "read"), ("network",), ("write", "search"), ("reference",), ("other", "execute")))], texts())
    planted = F.coalesce(*[F.when(F.col("seq") % 11 == i, F.lit(x)) for i, x in enumerate(("file.read", "permission.requested", "agent.started", "search", "file.write", "error.occurred"))], F.col("type"))
    rows = e.withColumns({"acts": acts, "step": act.lifecycle(), "type": planted})
    return rows.select("seq", act.kind(F.col("acts")).alias("kind"), F.col("step").alias("lifecycle"))


@query(
    BASE
    + """, t AS (SELECT seq, CASE seq % 9 WHEN 0 THEN ' Bash' WHEN 1 THEN 'pwsh' WHEN 2 THEN 'Grep' || tool_call WHEN 3 THEN 'C:/x' WHEN 4 THEN 'a.b-c' WHEN 5 THEN 'run_command' END AS tool, CASE WHEN seq % 2 = 0 THEN 'tool.started' ELSE 'session.started' END AS type FROM activity),
n AS (SELECT *, CASE WHEN tool = 'C:/x' THEN NULL ELSE lower(trim(tool)) END AS name FROM t),
g AS (SELECT *, CASE WHEN name IS NULL AND type = 'session.started' THEN NULL WHEN name IS NULL OR name IN ('bash', 'pwsh', 'run_command') THEN 'group:activity:bash' ELSE 'group:activity:tool:' || name END AS group_ FROM n)
SELECT group_, CASE WHEN group_ IS NULL THEN NULL WHEN group_ = 'group:activity:bash' THEN 'bash commands' ELSE 'tool · ' || name END AS label, count(*) AS n FROM g GROUP BY ALL"""
)
def event_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of events by tool, with their labels."""
    k = F.col("seq") % 9
    tool = F.when(k == 0, " Bash").when(k == 1, "pwsh").when(k == 2, F.concat(F.lit("Grep"), "tool_call")).when(k == 3, "C:/x").when(k == 4, "a.b-c").when(k == 5, "run_command")
    e = src.activity(spark, d).withColumns({"tool": tool, "type": F.when(F.col("seq") % 2 == 0, "tool.started").otherwise("session.started")})
    e = e.withColumn("group_", act.group_id(F.col("tool"), act.kind(), F.col("type")))
    return e.select("group_", F.when(F.col("group_").isNotNull(), act.group_label(F.col("group_"), F.col("tool"))).alias("label")).groupBy("group_", "label").agg(F.count("*").alias("n"))


_RANKED = ", ranked AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS k FROM activity)"
_RING = ", ring AS (SELECT session, count(*) FILTER (k <= 32) AS kept, min(seq) FILTER (k <= 32) AS first_kept, max(seq) FILTER (k > 32) AS trimmed_through FROM ranked GROUP BY session)"


@query(BASE + _RANKED + _RING + " SELECT * FROM ring")
def session_ring(spark: SparkSession, d: str) -> DataFrame:
    return act.ring(src.activity(spark, d), 32)


@query(
    BASE
    + _RANKED
    + _RING
    + """, cur AS (SELECT session, ((min(seq) + max(seq)) // 2)::BIGINT AS cursor FROM activity GROUP BY session)
SELECT c.session, least((SELECT count(*) FROM activity a WHERE a.session = c.session AND seq > cursor), kept)::BIGINT AS events, coalesce(cursor < trimmed_through, false) AS gap FROM cur c JOIN ring USING (session)"""
)
def replay_cursors(spark: SparkSession, d: str) -> DataFrame:
    e = src.activity(spark, d)
    cursors = e.groupBy("session").agg(F.expr("cast((min(seq) + max(seq)) div 2 as bigint)").alias("cursor"))
    return longs(act.replay_from(e, cursors, 32))


@query(
    "WITH "
    + src.LIFECYCLE_SQL
    + """, t AS (SELECT *, sum(CASE WHEN type = 'prompt.submitted' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS turn FROM lifecycle),
c AS (SELECT *, min(CASE WHEN type IN ('turn.completed', 'session.ended') THEN seq END) OVER (PARTITION BY session, turn) AS done FROM t WHERE turn > 0)
SELECT session, turn::BIGINT AS turn, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS events, max(done) IS NULL AS open FROM c WHERE done IS NULL OR seq <= done GROUP BY session, turn"""
)
def turn_windows(spark: SparkSession, d: str) -> DataFrame:
    return act.turns(src.lifecycle(spark, d))


@query(
    BASE
    + """, t AS (SELECT * FROM activity WHERE type LIKE 'tool%' AND tool_call IS NOT NULL),
m AS (SELECT e.session, e.tool_call, e.seq AS end_seq, e.ts, (SELECT max(s.seq) FROM t s WHERE s.session = e.session AND s.tool_call = e.tool_call AND s.type = 'tool.started' AND s.seq < e.seq) AS s,
  (SELECT max(x.seq) FROM t x WHERE x.session = e.session AND x.tool_call = e.tool_call AND x.type <> 'tool.started' AND x.seq < e.seq) AS p FROM t e WHERE type <> 'tool.started')
SELECT m.session, m.tool_call, end_seq, coalesce(b.seq, -1) AS start_seq, greatest(0, (epoch_us(m.ts) // 1000) - (epoch_us(b.ts) // 1000)) AS duration_ms, 'completed' AS outcome
FROM m LEFT JOIN t b ON b.seq = m.s AND (m.p IS NULL OR m.s > m.p)""".replace("greatest(0, (epoch_us(m.ts) // 1000) - (epoch_us(b.ts) // 1000))", "CASE WHEN b.seq IS NOT NULL THEN greatest(0, (epoch_us(m.ts) // 1000) - (epoch_us(b.ts) // 1000)) ELSE -1 END")
)
def tool_spans(spark: SparkSession, d: str) -> DataFrame:
    """Ends without a start have -1 for it and for their duration."""
    return act.tool_spans(src.activity(spark, d)).fillna(-1, ["start_seq", "duration_ms"])


@query(
    BASE
    + """, n AS (SELECT max(ts) AS now FROM activity),
s AS (SELECT session, count(*) AS events, min(ts) AS started, max(ts) AS last_at, max(seq) FILTER (type = 'prompt.submitted') AS o, max(seq) FILTER (type = 'turn.completed') AS c,
  max(ts) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'failed') AS failures, arg_max(type, seq) AS last_type FROM activity GROUP BY session),
z AS (SELECT *, o IS NOT NULL AND (c IS NULL OR o > c) AS turn_open FROM s, n)
SELECT session, events, started, last_at, failures, last_type, turn_open, CASE WHEN (epoch_us(now) // 1000) - (epoch_us(f) // 1000) <= 60000 THEN 'failed' WHEN turn_open AND (epoch_us(now) // 1000) - epoch_ms(last_at) > 180000 THEN 'stalled' WHEN turn_open THEN 'active' ELSE 'idle' END AS status FROM z"""
)
def session_states(spark: SparkSession, d: str) -> DataFrame:
    e = src.activity(spark, d)
    return act.session_states(e, _now(e))


@query(
    BASE
    + """, n AS (SELECT max(ts) AS now FROM activity), a AS (
  SELECT 'pulse' AS kind, seq, session, (epoch_us(ts) // 1000) + CASE WHEN status = 'failed' THEN 120000 ELSE 60000 END AS expires_ms FROM activity
  UNION ALL SELECT 'ray', seq, session, (epoch_us(ts) // 1000) + CASE WHEN status = 'failed' THEN 60000 ELSE 30000 END FROM activity
  UNION ALL SELECT 'marker', seq, session, (epoch_us(ts) // 1000) + 30000 FROM activity)
SELECT kind, seq, session, expires_ms FROM a, n WHERE expires_ms > (epoch_us(now) // 1000)"""
)
def live_artifacts(spark: SparkSession, d: str) -> DataFrame:
    e = src.activity(spark, d)
    return act.artifacts(e, _now(e))


@query(BASE + _RANKED + " SELECT session, seq FROM ranked WHERE k <= 12 ORDER BY seq DESC LIMIT 64")
def marker_caps(spark: SparkSession, d: str) -> DataFrame:
    return act.capped_markers(src.activity(spark, d)).select("session", "seq")


_FRAMES = ", r AS (SELECT session, seq, (epoch_us(ts) // 1000) - first_value((epoch_us(ts) // 1000)) OVER (PARTITION BY session ORDER BY seq) AS rel FROM activity), frames AS (SELECT session, seq, greatest(0, max(rel) OVER (PARTITION BY session ORDER BY seq)) AS virtual_ms FROM r)"


@query(BASE + _FRAMES + " SELECT * FROM frames")
def replay_frames(spark: SparkSession, d: str) -> DataFrame:
    return act.replay_frames(src.activity(spark, d))


@query(BASE + _FRAMES + " SELECT session, count(*) AS events, max(seq) AS last_seq FROM frames WHERE virtual_ms <= 86400000 GROUP BY session")
def state_at(spark: SparkSession, d: str) -> DataFrame:
    return act.state_at(src.activity(spark, d), 86_400_000)


@query(
    BASE
    + """ SELECT CASE WHEN type LIKE 'tool%' THEN 'execute' WHEN type LIKE 'error%' THEN 'error' ELSE 'unknown' END AS kind, count(*) AS weight, max(ts) AS last_at,
arg_max(status, seq) AS last_status, count(DISTINCT session) AS sessions FROM activity GROUP BY 1"""
)
def activity_groups(spark: SparkSession, d: str) -> DataFrame:
    return act.group_specs(src.activity(spark, d))


@query(
    BASE
    + """, b AS (SELECT *, lag(status) OVER (PARTITION BY session ORDER BY seq) AS p FROM activity)
SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq) AS streak FROM b WHERE status = 'failed' AND coalesce(p, '') <> 'failed'"""
)
def notifications(spark: SparkSession, d: str) -> DataFrame:
    return longs(act.notifications(src.activity(spark, d)))


@query(BASE + " SELECT session AS recording_id, count(*) AS event_count, min(ts) AS first_at, max(ts) AS last_at, 1::BIGINT AS first_sequence, count(*) AS last_sequence FROM activity GROUP BY session")
def recording_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines by recording, read back and summed up."""
    path = fresh_path(spark, "archive")
    archive.append(archive.to_recordings(src.activity(spark, d)), path)
    return archive.manifest(archive.read(spark, path)).drop("byte_count")


@query(
    BASE
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM activity), h AS (SELECT session, i FROM n WHERE NOT (type = 'error' AND i % 7 = 0)),
b AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY i) = i AS ok FROM h)
SELECT session AS recording_id, count(*) FILTER (ok)::BIGINT AS kept, CASE WHEN count(*) FILTER (ok) = count(*) THEN 'complete' ELSE 'partial' END AS status FROM b GROUP BY session"""
)
def recording_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Recordings that lost some of their failed events: what is left up to the first gap."""
    lines = archive.to_recordings(src.activity(spark, d))
    return longs(archive.recover(lines.where("not (get_json_object(event, '$.type') = 'error' and recordingSequence % 7 = 0)")))


@query(
    BASE
    + """, n AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM activity)
SELECT session AS recording_id, least(20, count(*))::BIGINT AS rows, CASE WHEN count(*) > 20 THEN 30::BIGINT END AS next_after FROM n WHERE i > 10 GROUP BY session"""
)
def recording_pages(spark: SparkSession, d: str) -> DataFrame:
    return archive.pages(archive.to_recordings(src.activity(spark, d)), 10, 20)


@query(
    BASE
    + """, r AS (SELECT session AS recording_id, min(ts) AS created, max(ts) >= (SELECT max(ts) - INTERVAL 1 HOUR FROM activity) AS active, count(*) AS event_count FROM activity GROUP BY session),
w AS (SELECT *, row_number() OVER (ORDER BY active DESC, created DESC, recording_id DESC) AS n, sum(event_count) OVER (ORDER BY active DESC, created DESC, recording_id DESC) AS e FROM r)
SELECT recording_id, event_count FROM w WHERE active OR (n <= 40 AND e <= 2000)"""
)
def recording_retention(spark: SparkSession, d: str) -> DataFrame:
    e = src.activity(spark, d)
    late = _now(e) - F.expr("INTERVAL 1 HOUR")
    r = e.groupBy(F.col("session").alias("recording_id")).agg(F.min("ts").alias("created"), (F.max("ts") >= late).alias("active"), F.count("*").alias("event_count"), F.count("*").alias("byte_count"))
    return act.retention(r, most=40, events=2000).select("recording_id", "event_count")


@query(
    """SELECT page_id, regexp_extract(url, '^(https?)://', 1) || '://' || lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) || regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)?', 1) AS clean FROM pages"""
)
def clean_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.clean_url(F.col("url")).alias("clean"))


@query(
    """WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^https?://|[?#].*$', '', 'g'), '/') AS s FROM pages)
SELECT page_id, len(s)::BIGINT AS depth, array_to_string(s[2:], '/') AS longest_suffix, s[1] AS first_prefix FROM p"""
)
def url_paths(spark: SparkSession, d: str) -> DataFrame:
    from loomline.operators.history import path_prefixes, path_suffixes

    bare = F.regexp_replace("url", r"^https?://|[?#].*$", "")
    p = table(spark, d, "pages").select("page_id", bare.alias("p"))
    return longs(
        p.select("page_id", F.size(path_suffixes(F.col("p"))).alias("depth"), F.coalesce(F.get(path_suffixes(F.col("p")), F.lit(1)), F.lit("")).alias("longest_suffix"), F.get(path_prefixes(F.col("p")), F.lit(0)).alias("first_prefix"))
    )


@query(
    r"""WITH a AS (SELECT doc_id, regexp_replace(text, '(?i)\b([a-z][a-z0-9+.-]*://)(?:[^/\s@]+@)+', '\1', 'g') AS t FROM documents),
-- RE2 has no lookahead: what must not be a value is marked first
b AS (SELECT doc_id, regexp_replace(t, '(?i)(\b(?:authorization|api[-_]?key|access[-_]?key|password|token)\s*[:=]\s*)((?:Bearer|Basic|Token)\b)', '\1' || chr(2) || '\2', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '(?i)(\b(?:Bearer|Basic|Token)\s*(?:[:=]\s*|\s+)|\b(?:authorization|api[-_]?key|access[-_]?key|password|token)\s*[:=]\s*)[^\s\x02]\S*', '\1[REDACTED]', 'g') AS t FROM b),
d AS (SELECT doc_id, replace(t, chr(2), '') AS t FROM c),
e AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,})\b', '[REDACTED]', 'g'), '\bAKIA[0-9A-Z]{16}\b', '[REDACTED]', 'g'), '\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{12,}\b', '[REDACTED]', 'g') AS t FROM d),
f AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}', '[REDACTED]', 'g'), '(?s)-----BEGIN [^-]+-----.*?-----END [^-]+-----', '[REDACTED]', 'g') AS t FROM e),
g AS (SELECT doc_id, regexp_replace(t, '(?i)(?:/(?:Users|home|private/var)/[^/\s]+(?:/[^\s]*)?|[A-Za-z]:\\Users\\[^\\\s]+(?:\\[^\s]*)?)', '[PATH]', 'g') AS t FROM f)
SELECT doc_id, len(regexp_extract_all(t, '\[REDACTED\]'))::BIGINT AS masked, sha256(t) AS text_sha256 FROM g"""
)
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    clean = text.redacted(F.col("text"))
    return docs.select("doc_id", F.size(F.regexp_extract_all(clean, F.lit(r"\[REDACTED\]"), F.lit(0))).cast("bigint").alias("masked"), F.sha2(clean, 256).alias("text_sha256"))


@query(r"""SELECT user_id, count(*) AS events, min(sha256('["x","' || user_id || '","' || event_type || '\u00e9\ud83d\ude00\""]'))[1:24] AS least_id FROM events GROUP BY user_id""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", hashing.ir_id("x", F.col("user_id").cast("string"), F.concat("event_type", F.lit('é😀"'))).alias("id"))
    return e.groupBy("user_id").agg(F.count("*").alias("events"), F.substring(F.min("id"), 3, 24).alias("least_id"))


@query(
    "WITH "
    + src.GRAPH_SQL.split(",\nnodes AS")[0]
    + """, h AS (SELECT id, list_reduce(list_prepend(2166136261::UBIGINT, [ascii(c)::UBIGINT FOR c IN string_split(id, '')]), lambda a, c: (xor(a, c) * 16777619::UBIGINT) % 4294967296::UBIGINT)::BIGINT AS hash FROM symbols)
SELECT id, hash, hash % 5 AS colour FROM h"""
)
def fnv_colours(spark: SparkSession, d: str) -> DataFrame:
    return src.symbols(spark, d).select("id", hashing.fnv1a(F.col("id")).alias("hash"), hashing.colour_index(F.col("id")).alias("colour"))


@query("WITH p AS (SELECT p_partkey, p_type || '/' || p_brand || '/' || p_name || '.src' AS f FROM part) SELECT p_partkey, f AS path, 'exact' AS how FROM p")
def resolved_targets(spark: SparkSession, d: str) -> DataFrame:
    nodes = src.nodes(spark, d)
    part = src.symbols(spark, d).select(F.substring("id", 5, 20).cast("bigint").alias("p_partkey"), F.col("file").alias("path"))
    return part.join(act.resolve_targets(part, nodes), "path").select("p_partkey", "path", "how")
