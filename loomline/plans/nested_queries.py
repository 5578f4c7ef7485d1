"""Nested JSON made from events: resources of arguments and strict validation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import nested
from loomline.storage import dealt, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Arguments of calls; ``#`` is the user's number, ``~`` a quote inside a text.
_ARGUMENTS = (
    '{"path":"src/a#.py","limit":#}',
    '{"options":{"files":["b#.py","lib/../c.py","/etc/x#"],"Query":"zz"},"uri":"https://me:pw@Host#.io:8443/p/q?x=1#f"}',
    '{"inner":"{~file~:~deep#.py~,~more~:[~m1~,~m2~]}","cwd":"/ws/sub#"}',
    'plain/p#.txt',
    '["/ws/c#.txt","[~n#~,{~dir~:~d~}]",5,null,""]',
    '{"a":{"b":{"c":{"d":{"file":"four#"},"e":["five"]}}},"z":"not a path"}',
    '{"a":{"b":{"c":{"d":{"e":{"file":"too deep"}}}}},"filename":"n#"}',
    '{"workspace":7,"file":{"path":"in#"},"directory":"ws://h#.io:80/live"}',
    '[' + ",".join(f'"f{i}"' for i in range(40)) + ']',
)
_CALLS_SQL = (
    "SELECT event_id, '/ws' AS root, CASE user_id % 3 WHEN 0 THEN 'grep' WHEN 1 THEN 'write_file' ELSE 'open' END AS tool, replace(replace(CASE event_id % 10 "
    + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ARGUMENTS))
    + " END, '~', chr(92) || '\"'), '#', '' || user_id) AS args FROM events"
)


@query(
    f"""
WITH RECURSIVE calls AS ({_CALLS_SQL}),
walk AS (
  SELECT event_id, 0 AS depth, []::VARCHAR[] AS place_, NULL::VARCHAR AS key, coalesce(TRY_CAST(args AS JSON), to_json(args)) AS v, FALSE AS leaf FROM calls WHERE args IS NOT NULL
  UNION ALL
  SELECT event_id, depth + 1, list_concat(place_, c.step), c.key, c.v, c.leaf FROM (
    SELECT event_id, depth, place_, unnest(CASE json_type(v)
      WHEN 'OBJECT' THEN list_filter(
        list_transform(json_keys(v), lambda k: {{'step': [k], 'key': k, 'v': json_extract(v, '$."' || k || '"'), 'leaf': json_type(v, '$."' || k || '"') = 'VARCHAR'}}),
        lambda c: json_type(c.v) IN ('OBJECT', 'ARRAY') OR (c.leaf AND regexp_full_match(lower(c.key), 'path|filepath|file|filename|uri|directory|dir|cwd|workspace')))
      WHEN 'ARRAY' THEN list_transform(range(0, json_array_length(v)::BIGINT), lambda i: {{'step': [lpad(i::VARCHAR, 6, '0')], 'key': NULL, 'v': json_extract(v, '$[' || i || ']'), 'leaf': FALSE}})
      WHEN 'VARCHAR' THEN CASE WHEN json_type(TRY_CAST((v->>'$') AS JSON)) IN ('OBJECT', 'ARRAY') THEN [{{'step': []::VARCHAR[], 'key': NULL, 'v': TRY_CAST((v->>'$') AS JSON), 'leaf': FALSE}}] END END) AS c
    FROM walk WHERE NOT leaf AND depth <= 4)),
said AS (
  SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY place_) - 1 AS place, key, v->>'$' AS said FROM walk
  WHERE leaf AND (v->>'$') <> '' OR NOT leaf AND depth <= 4 AND json_type(v) = 'VARCHAR' AND (v->>'$') <> '' AND coalesce(json_type(TRY_CAST((v->>'$') AS JSON)), '') NOT IN ('OBJECT', 'ARRAY')),
told AS (SELECT said.*, tool, root, key IS NOT NULL AND regexp_matches(said, '^(https?|wss?)://') AS url, CASE WHEN starts_with(said, '/') THEN said ELSE root || '/' || replace(said, 'lib/../', '') END AS whole FROM said JOIN calls USING (event_id) WHERE place < 32)
SELECT event_id, place::INT AS place, CASE WHEN url THEN 'url' ELSE 'path' END AS kind,
  CASE WHEN url THEN CASE WHEN starts_with(said, 'ws:') THEN replace(said, ':80/', '/') ELSE regexp_replace(regexp_replace(lower(said), '//[^@/]*@', '//'), '[?#].*$', '') END
    WHEN starts_with(whole, '/ws/') THEN substr(whole, 5) ELSE whole END AS path,
  NOT url AND NOT starts_with(whole, '/ws/') AS outside,
  CASE WHEN url THEN 'network' WHEN key IS NULL THEN 'reference' WHEN tool = 'grep' THEN 'search' WHEN tool = 'write_file' THEN 'write' WHEN lower(key) LIKE '%file%' THEN 'read' ELSE 'reference' END AS action
FROM told"""
)
def argument_resources(spark: SparkSession, d: str) -> DataFrame:
    """Resources that the arguments of calls name, to the fourth level and the 32nd resource."""
    # few bytes with much work: dealt by their number
    dealt(table(spark, d, "events").select("event_id", "user_id"), 20_000).createOrReplaceTempView("_events_of_calls")
    calls = spark.sql(_CALLS_SQL.replace("FROM events", "FROM _events_of_calls"))
    found = nested.nested_resources(calls)
    return found.select("event_id", "place", "kind", "path", "outside", "action")


_HEAD = '{"schemaVersion":1,"id":"e#","sessionId":"s#","timestamp":"2024-01-01T00:00:00Z","type":"t"'
_MAPS = ("source", "workspace", "metadata", "redactedMetadata")
#: Bodies of events: one or more for each rule, and valid ones between them.
_BODIES = (
    _HEAD + "}",
    _HEAD + ',"extra":1}',
    _HEAD.replace("n\":1", "n\":2") + "}",
    '{"schemaVersion":1,"id":"e#","sessionId":"s#","type":"t"}',
    "[#]",
    "{broken",
    *[_HEAD + f',"{m}":{{"prompt":"x"}}}}' for m in _MAPS],
    *[_HEAD + f',"{m}":{{"odd":"x"}}}}' for m in _MAPS],
    *[_HEAD + f',"{m}":[1]}}' for m in ("workspace", "metadata", "content", "source")],
    *[_HEAD + f',"metadata":{{"{f}":{v}}}}}' for f, v in (("summary", '"a\tb"'.replace("\t", "~u0009")), ("exitCode", "1.5"), ("exitCode", "-2147483649"), ("exitCode", "#"), ("bytes", "-1"), ("bytes", "2.5"), ("available", '"yes"'), ("available", "true"), ("permissionKind", '"Bad Kind"'), ("permissionKind", '"tool-use"'), ("name", '" "'), ("line", '"7"'))],
    _HEAD + ',"workspace":{"id":"w#","root":"/ws","branch":"main"},"resources":[{"path":"a","line":#,"span":{"start":{"line":1,"column":2},"end":{"line":3}}},{"kind":"url"}]}',
    _HEAD + ',"resources":[{"path":"a"},{"span":{"start":{"line":-1}}}]}',
    _HEAD + ',"resources":[{"span":{"begin":{}}}]}',
    _HEAD + ',"resources":[{"span":{"start":{"row":1}}}]}',
    _HEAD + ',"resources":[' + ",".join(["{}"] * 33) + "]}",
    _HEAD + ',"resources":{}}',
    _HEAD + ',"content":{"availability":"maybe"}}',
    _HEAD + ',"content":{"availability":"redacted","size":#,"sha256":"ab","redacted":true}}',
    _HEAD + ',"content":{"size":-1}}',
    _HEAD + ',"content":{"body":"x"}}',
    _HEAD + ',"sequence":-1}',
    _HEAD + ',"sequence":#,"agentName":"a","tool":"bash","source":"cli"}',
    _HEAD + ',"tool":""}',
    _HEAD + ',"tool":7}',
    _HEAD.replace("00Z", "00") + "}",
    _HEAD.replace("00Z", "00+02:00") + "}",
    _HEAD.replace("-01T", "-32T") + "}",
    _HEAD + ',"workspace":{"id":{"a":{"b":{"c":{}}}}}}',
    _HEAD.replace('"t"', '"' + "t" * 129 + '"') + "}",
)
_EVENTS_SQL = f"SELECT event_id, replace(replace(CASE event_id % {len(_BODIES) + 1} " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(_BODIES)) + " END, '~', chr(92)), '#', '' || user_id) AS body FROM events"
_TYPES = ", ".join(f"('{f}', '{kind}', {n})" for f, kind, n in nested.field_rules())
_ALLOWED = ", ".join(f"('{m}', '{f}')" for m, fields in nested.FIELDS.items() for f in fields.split())
_NUMBERS = "('UBIGINT', 'BIGINT', 'DOUBLE')"
_TOP = ", ".join(f"'{f}'" for f in (*nested.REQUIRED, *nested.OPTIONAL_TEXTS, *nested.OTHER_FIELDS))


@query(
    f"""
WITH bodies AS ({_EVENTS_SQL}),
events_ AS (SELECT event_id, TRY_CAST(body AS JSON) AS j FROM bodies),
types(field, kind, bound) AS (VALUES {_TYPES}), allowed(map, field) AS (VALUES {_ALLOWED}),
maps AS (
  SELECT event_id, 40 AS rank, 'source' AS place_, 'source' AS map, j->'source' AS m FROM events_ WHERE json_exists(j, '$.source') AND json_type(j, '$.source') <> 'VARCHAR'
  UNION ALL SELECT event_id, 41, 'workspace', 'workspace', j->'workspace' FROM events_ WHERE json_exists(j, '$.workspace')
  UNION ALL SELECT event_id, 43 + i, 'resources[' || i || ']', 'resources', j->('$.resources[' || i || ']') FROM (SELECT event_id, j, unnest(range(0, json_array_length(j, '$.resources')::BIGINT)) AS i FROM events_ WHERE json_type(j, '$.resources') = 'ARRAY')
  UNION ALL SELECT event_id, 101, 'metadata', 'metadata', j->'metadata' FROM events_ WHERE json_exists(j, '$.metadata')
  UNION ALL SELECT event_id, 102, 'redactedMetadata', 'metadata', j->'redactedMetadata' FROM events_ WHERE json_exists(j, '$.redactedMetadata')),
fields AS (SELECT *, m->('$.' || k) AS v, m->>('$.' || k) AS s, json_type(m, '$.' || k) AS t FROM (SELECT *, unnest(json_keys(m)) AS k FROM maps WHERE json_type(m) = 'OBJECT')),
points AS (SELECT *, v->('$.' || p) AS pv FROM (SELECT *, unnest(json_keys(v)) AS p FROM fields WHERE k = 'span' AND t = 'OBJECT')),
spots AS (SELECT *, pv->('$.' || c) AS cv FROM (SELECT *, unnest(json_keys(pv)) AS c FROM points WHERE json_type(pv) = 'OBJECT')),
texts(field, rank, longest) AS (VALUES ('id', 20, 256), ('sessionId', 21, 256), ('type', 22, 128), ('timestamp', 23, 64), {", ".join(f"('{f}', {30 + i}, 256)" for i, f in enumerate(nested.OPTIONAL_TEXTS))}),
errors AS (
  SELECT event_id, 0 AS rank, '' AS k, 'INVALID_EVENT' AS code, 'event' AS field FROM events_ WHERE coalesce(json_type(j), '') <> 'OBJECT'
  UNION ALL SELECT DISTINCT event_id, 1, '', 'INVALID_EVENT', 'depth' FROM (SELECT event_id, unnest(json_keys(j->'workspace'->'id'->'a'->'b')) AS x, j FROM events_) WHERE json_type(j, '$.workspace.id.a.b.c') = 'OBJECT'
  UNION ALL SELECT event_id, 2, k, 'UNSUPPORTED_EVENT_FIELD', k FROM (SELECT event_id, unnest(json_keys(j)) AS k FROM events_ WHERE json_type(j) = 'OBJECT') WHERE k NOT IN ({_TOP})
  UNION ALL SELECT event_id, 3, '', 'UNSUPPORTED_SCHEMA_VERSION', 'schemaVersion' FROM events_ WHERE coalesce(j->>'schemaVersion', '') <> '1'
  UNION ALL SELECT event_id, rank - 10, '', 'INVALID_EVENT', field FROM events_, texts WHERE rank < 24 AND NOT coalesce(json_exists(j, '$.' || field), FALSE)
  UNION ALL SELECT event_id, rank, '', 'INVALID_EVENT', field FROM events_, texts WHERE json_exists(j, '$.' || field) AND (json_type(j, '$.' || field) <> 'VARCHAR' OR trim(j->>field) = '' OR length(j->>field) > longest)
  UNION ALL SELECT event_id, 24, '', 'INVALID_EVENT', 'timestamp' FROM events_ WHERE NOT regexp_full_match(j->>'timestamp', '.*(Z|[+-]\\d\\d:\\d\\d)') OR TRY_CAST(left(j->>'timestamp', 10) AS DATE) IS NULL
  UNION ALL SELECT event_id, 25, '', 'INVALID_EVENT', 'sequence' FROM events_ WHERE json_exists(j, '$.sequence') AND json_type(j, '$.sequence') <> 'UBIGINT'
  UNION ALL SELECT event_id, 42, '', 'INVALID_EVENT', 'resources' FROM events_ WHERE json_exists(j, '$.resources') AND (json_type(j, '$.resources') <> 'ARRAY' OR json_array_length(j, '$.resources') > 32)
  UNION ALL SELECT event_id, rank, '', 'INVALID_EVENT', place_ FROM maps WHERE json_type(m) <> 'OBJECT' OR len(json_keys(m)) > 24
  UNION ALL SELECT event_id, rank, k, CASE WHEN k = 'prompt' THEN 'UNSAFE_EVENT_CONTENT' ELSE 'UNSAFE_EVENT_FIELD' END, place_ FROM fields ANTI JOIN allowed ON allowed.map = fields.map AND allowed.field = k
  UNION ALL SELECT event_id, rank, k, 'INVALID_EVENT', place_ || '.' || k FROM fields JOIN allowed ON allowed.map = fields.map AND allowed.field = k JOIN types ON types.field = k
    WHERE kind IN ('text', 'summary', 'slug') AND (t <> 'VARCHAR' OR trim(s) = '' OR length(s) > bound) OR kind = 'slug' AND NOT regexp_full_match(s, '[a-z][a-z0-9-]*')
      OR kind = 'count' AND (t NOT IN {_NUMBERS} OR TRY_CAST(s AS DOUBLE) < 0) OR kind = 'flag' AND t <> 'BOOLEAN' OR kind = 'exit' AND (t NOT IN ('UBIGINT', 'BIGINT') OR abs(TRY_CAST(s AS DOUBLE)) > bound)
  UNION ALL SELECT event_id, rank, k, 'UNSAFE_EVENT_CONTENT', place_ || '.' || k FROM fields WHERE k = 'summary' AND regexp_matches(s, '[\\x00-\\x1F\\x7F]')
  UNION ALL SELECT event_id, rank, k, 'UNSAFE_EVENT_FIELD', place_ || '.span' FROM points WHERE p NOT IN ('start', 'end')
  UNION ALL SELECT event_id, rank, k, CASE WHEN c IN ('line', 'column') THEN 'INVALID_EVENT' ELSE 'UNSAFE_EVENT_FIELD' END, place_ || '.span.' || p || CASE WHEN c IN ('line', 'column') THEN '.' || c ELSE '' END
    FROM spots WHERE p IN ('start', 'end') AND (c NOT IN ('line', 'column') OR TRY_CAST(cv AS DOUBLE) < 0)
  UNION ALL SELECT event_id, 100, '', 'INVALID_EVENT', 'content' FROM events_ WHERE json_exists(j, '$.content') AND (json_type(j, '$.content') <> 'OBJECT' OR json_exists(j, '$.content.body'))
  UNION ALL SELECT event_id, 100, 'availability', 'INVALID_EVENT', 'content.availability' FROM events_ WHERE (j->'content'->>'availability') NOT IN ('available', 'unavailable', 'redacted')
  UNION ALL SELECT event_id, 100, 'size', 'INVALID_EVENT', 'content.size' FROM events_ WHERE TRY_CAST((j->'content'->>'size') AS DOUBLE) < 0),
first AS (SELECT event_id, arg_min(code, (rank, k)) AS code, arg_min(field, (rank, k)) AS field FROM errors GROUP BY event_id)
SELECT event_id, code, field FROM bodies LEFT JOIN first USING (event_id)"""
)
def event_errors(spark: SparkSession, d: str) -> DataFrame:
    """The first rule of the closed event schema that each event breaks."""
    table(spark, d, "events").selectExpr("event_id", "user_id").createOrReplaceTempView("_events_of_bodies")
    return nested.validate_events(spark.sql(_EVENTS_SQL.replace("FROM events", "FROM _events_of_bodies"))).drop("body")
