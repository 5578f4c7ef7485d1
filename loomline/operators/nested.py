"""Nested JSON as VARIANT: resources that a tool's arguments name, and validation against a closed schema.

Both walk a value level by level inside its row, with array functions alone: nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import text

# Names of arguments that hold a path, and the action that a name or a tool stands for, in order.
PATH_ARGUMENT = r"(?i)^(path|filePath|file|filename|uri|directory|dir|cwd|workspace)$"
ACTIONS = (
    ("search", r"(?i)search|grep|glob|find|query"),
    ("write", r"(?i)write|edit|create|patch|delete|remove|move|rename"),
    ("read", r"(?i)read|view|file|list|glob|grep|search|find"),
)
DEPTH, MOST_RESOURCES = 4, 32

_VALUES = "array<struct<key:string,v:variant,said:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(v: Column) -> Column:
    """object, array, string, whole, number, boolean or null."""
    return let(
        F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1),
        lambda k: F.when(k == "STRING", "string").when(k == "OBJECT", "object").when(k == "ARRAY", "array").when(k == "BIGINT", "whole")
        .when(k.isin("DECIMAL", "DOUBLE", "FLOAT"), "number").when(k == "BOOLEAN", "boolean").otherwise("null"),
    )


def entries(v: Column) -> Column:
    """Fields of an object in the order of their names."""
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _is_container(v: Column) -> Column:
    return F.coalesce(kind_of(v).isin("object", "array"), F.lit(False))


def _value(key: Column, v: Column, said: Column) -> Column:
    return F.struct(key.cast("string").alias("key"), v.cast("variant").alias("v"), said.cast("string").alias("said"))


def _descend(x: Column) -> Column:
    """What a value holds: texts that are told, and values to go on with."""
    none = F.lit(None)
    v = x["v"]
    # only a text that begins like a container can be one
    inner = F.when(_text(v).rlike(r"^\s*[\[{]"), F.try_parse_json(_text(v)))
    of_text = let(inner, lambda i: F.when(_is_container(i), F.array(_value(none, i, none))).otherwise(F.array(_value(none, none, _text(v)))))
    of_list = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda i: _value(none, i, none))
    told = F.transform(entries(v), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("v"), kind_of(e["value"]).alias("kind")))
    named = F.filter(told, lambda e: e["kind"].isin("object", "array") | (e["key"].rlike(PATH_ARGUMENT) & (e["kind"] == "string")))
    of_object = F.transform(named, lambda e: F.when(e["kind"] == "string", _value(e["key"], none, _text(e["v"]))).otherwise(_value(none, e["v"], none)))
    held = let(kind_of(v), lambda kind: F.when(kind == "string", of_text).when(kind == "array", of_list).when(kind == "object", of_object))
    return F.when(x["said"].isNotNull(), F.array(x)).otherwise(F.coalesce(held, F.array().cast(_VALUES))).cast(_VALUES)


def nested_values(args: Column, depth: int = DEPTH) -> Column:
    """(key, said) of each path or address that a value names, in order: under a name that stands for a
    path, or as a plain text in a list or alone. Texts that hold JSON are read as such. What lies
    deeper than ``depth`` is left out."""
    parsed = F.try_parse_json(args)
    start = F.when(parsed.isNull(), _value(F.lit(None), F.lit(None), args)).otherwise(_value(F.lit(None), parsed, F.lit(None)))
    found = reduce(lambda state, _: F.flatten(F.transform(state, _descend)), range(depth + 1), F.array(start))
    return F.transform(F.filter(found, lambda x: F.coalesce(F.trim(x["said"]) != "", F.lit(False))), lambda x: F.struct(x["key"].alias("key"), x["said"].alias("said")))


def nested_resources(calls: DataFrame, args: str = "args", root: str = "root", tool: str = "tool", depth: int = DEPTH, most: int = MOST_RESOURCES) -> DataFrame:
    """The calls with a row for each resource that their arguments name, the first ``most`` of a call.

    Adds ``place`` (from 0), ``kind`` (url or path), ``path`` (address without user, query and
    fragment, or the path: relative to the root where it lies below it), ``outside``, ``action`` and
    ``confidence``. Fields are taken in the order of their names, as a VARIANT keeps none. Arguments
    that are no JSON are one path; null ones have no resource. Files aren't looked at.
    """
    rows = calls.withColumn("_said", F.slice(nested_values(F.col(args), depth), 1, most))
    rows = rows.select(*calls.columns, F.posexplode("_said").alias("place", "_x"))
    key, said = F.col("_x.key"), F.col("_x.said")
    address = F.when(key.isNotNull() & said.rlike("(?i)^(http|ws)s?://"), text.clean_url(said))
    names = F.concat_ws(" ", key, F.coalesce(F.col(tool), F.lit("")))
    action = reduce(lambda rest, a: F.when(names.rlike(a[1]), a[0]).otherwise(rest), reversed(ACTIONS), F.lit("reference"))
    place = text.resource_path(said, F.col(root))
    plain = F.coalesce(text.folded(said), said)
    url = address.isNotNull()
    return rows.select(
        *calls.columns,
        "place",
        F.when(url, "url").otherwise("path").alias("kind"),
        F.when(url, address).when(F.col(root).isNull(), plain).otherwise(place["path"]).alias("path"),
        F.coalesce(~url & F.col(root).isNotNull() & place["outside"], F.lit(False)).alias("outside"),
        F.when(url, "network").when(key.isNull(), "reference").otherwise(action).alias("action"),
        F.when(url, "inferred").otherwise("observed").alias("confidence"),
    )


# The event schema. Each field of a metadata map with its type and bound.
EVENT_VERSION = 1
REQUIRED = ("id", "sessionId", "timestamp", "type")
OPTIONAL_TEXTS = ("parentId", "agentId", "turnId", "toolCallId", "status", "tool", "snippet", "sessionName", "agentName")
OTHER_FIELDS = ("schemaVersion", "sequence", "source", "workspace", "resources", "content", "metadata", "redactedMetadata")
SENSITIVE = ("prompt", "message", "command", "arguments", "result", "output", "code", "headers", "env", "content")
TEXT_LIMITS = {
    32: "action confidence availability coverage",
    64: "kind status errorClassification errorCode client version",
    128: "provider providerEventType scope",
    256: "id name nodeId graphNodeId sessionName agentName providerToolCallId providerMessageId branch workspaceId repoId targetAgentId targetAgentNodeId targetSessionId targetWorkspaceId",
    512: "ref repository",
    1024: "path file relativePath worktree",
    4096: "root",
}
SUMMARIES = "summary snippet"
COUNTS = "durationMs count line column startLine endLine endColumn bytes"
FLAGS = "available outsideRoot unknownEvent contentAvailable redacted"
SLUGS = "permissionResult permissionKind"
FIELDS = {
    "source": "client kind version",
    "workspace": "id name root path file relativePath repository branch worktree workspaceId repoId status summary",
    "resources": "id name path file relativePath ref kind nodeId status summary provider action confidence durationMs available outsideRoot line endLine column endColumn span redacted",
    "metadata": "id name path file ref kind status summary provider scope availability coverage workspaceId repoId durationMs count line column startLine endLine endColumn available redacted"
    " providerEventType providerToolCallId providerMessageId errorClassification errorCode unknownEvent contentAvailable targetAgentId targetAgentNodeId targetSessionId targetWorkspaceId"
    " graphNodeId nodeId permissionResult permissionKind exitCode bytes",
}
CONTENT_TEXTS = {"availability": 32, "localRef": 1024, "localReference": 1024, "mimeType": 128, "sha256": 128}
MOST_FIELDS, MOST_CONTENT, DEEPEST = 24, 8, 4
INVALID, UNSAFE, UNKNOWN_INSIDE, UNKNOWN_FIELD, OTHER_VERSION = "INVALID_EVENT", "UNSAFE_EVENT_CONTENT", "UNSAFE_EVENT_FIELD", "UNSUPPORTED_EVENT_FIELD", "UNSUPPORTED_SCHEMA_VERSION"
ZONED_TIME = r"^[+-]?\d{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"


def field_rules() -> list[tuple[str, str, int]]:
    """(field, type, bound): the schema's table of metadata fields."""
    rules = [(f, "text", n) for n, fields in TEXT_LIMITS.items() for f in fields.split()]
    rules += [(f, "summary", 256) for f in SUMMARIES.split()] + [(f, "slug", 64) for f in SLUGS.split()]
    return rules + [(f, "count", 0) for f in COUNTS.split()] + [(f, "flag", 0) for f in FLAGS.split()] + [("span", "span", 0), ("exitCode", "exit", 1 << 31)]


def _error(code: str, field: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(field) if isinstance(field, str) else field).alias("field"))


def _bad_text(v: Column, limit: Column | int) -> Column:
    return F.coalesce((kind_of(v) != "string") | _text(v).rlike(r"^(?U)\s*$") | (F.length(_text(v)) > limit), F.lit(True))


def _is_number(v: Column) -> Column:
    return F.coalesce(kind_of(v).isin("whole", "number"), F.lit(False))


def _bad_count(v: Column) -> Column:
    return ~_is_number(v) | F.coalesce(F.try_variant_get(v, "$", "double") < 0, F.lit(False))


def _first(errors: Column) -> Column:
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))


def _span_error(v: Column, at: Column) -> Column:
    def point(e: Column) -> Column:
        spot = F.concat(at, F.lit("."), e["key"])
        inner = entries(e["value"])
        each = F.transform(inner, lambda p: F.when(~p["key"].isin("line", "column"), _error(UNKNOWN_INSIDE, spot)).when(_bad_count(p["value"]), _error(INVALID, F.concat(spot, F.lit("."), p["key"]))))
        return (
            F.when(~e["key"].isin("start", "end"), _error(UNKNOWN_INSIDE, at)).when(F.coalesce(kind_of(e["value"]) != "object", F.lit(True)) | (F.size(inner) > 2), _error(INVALID, spot))
            .otherwise(_first(each))
        )

    return F.when(F.coalesce(kind_of(v) != "object", F.lit(True)) | (F.size(entries(v)) > 2), _error(INVALID, at)).otherwise(_first(F.transform(entries(v), point)))


def _map_error(v: Column, at: Column, allowed: str) -> Column:
    """The first error of a metadata map, by the order of its fields."""
    table = F.create_map(*[F.lit(x) for f, kind, bound in field_rules() for x in (f, f"{kind} {bound}")])

    def field(e: Column) -> Column:
        spot, value = F.concat(at, F.lit("."), e["key"]), e["value"]
        rule = F.split(F.try_element_at(table, e["key"]), " ")
        kind, bound = F.get(rule, F.lit(0)), F.get(rule, F.lit(1)).cast("bigint")
        whole = F.try_variant_get(value, "$", "bigint")
        return (
            F.when(e["key"].isin(*SENSITIVE), _error(UNSAFE, at))
            .when(~e["key"].isin(*FIELDS[allowed].split()), _error(UNKNOWN_INSIDE, at))
            .when(kind.isin("text", "summary", "slug") & _bad_text(value, bound), _error(INVALID, spot))
            .when((kind == "slug") & ~_text(value).rlike("^[a-z][a-z0-9-]{0,63}$"), _error(INVALID, spot))
            .when((kind == "summary") & _text(value).rlike(r"\p{Cntrl}"), _error(UNSAFE, spot))
            .when((kind == "count") & _bad_count(value), _error(INVALID, spot))
            .when((kind == "exit") & ((kind_of(value) != "whole") | (whole < -bound) | (whole > bound)), _error(INVALID, spot))
            .when((kind == "flag") & (kind_of(value) != "boolean"), _error(INVALID, spot))
            .when(kind == "span", _span_error(value, spot))
        )

    wrong = F.coalesce(kind_of(v) != "object", F.lit(True)) | (F.size(entries(v)) > MOST_FIELDS)
    return F.when(wrong, _error(INVALID, at)).otherwise(_first(F.transform(entries(v), field)))


def _content_error(v: Column) -> Column:
    at = F.lit("content")

    def field(e: Column) -> Column:
        spot, value = F.concat(at, F.lit("."), e["key"]), e["value"]
        out = F.when(~e["key"].isin(*CONTENT_TEXTS, "size", "redacted"), _error(INVALID, at))
        for name, limit in CONTENT_TEXTS.items():
            out = out.when((e["key"] == name) & _bad_text(value, limit), _error(INVALID, spot))
        out = out.when((e["key"] == "availability") & ~_text(value).isin("available", "unavailable", "redacted"), _error(INVALID, spot))
        return out.when((e["key"] == "size") & _bad_count(value), _error(INVALID, spot)).when((e["key"] == "redacted") & (kind_of(value) != "boolean"), _error(INVALID, spot))

    wrong = F.coalesce(kind_of(v) != "object", F.lit(True)) | (F.size(entries(v)) > MOST_CONTENT)
    return F.when(wrong, _error(INVALID, at)).otherwise(_first(F.transform(entries(v), field)))


def _too_deep(v: Column, deepest: int = DEEPEST) -> Column:
    """Whether a container lies deeper than ``deepest`` levels below the value."""

    def inside(x: Column) -> Column:
        some = F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.transform(entries(x), lambda e: e["value"]))
        return F.filter(some, _is_container)

    found = reduce(lambda state, _: F.flatten(F.transform(state, inside)), range(deepest + 1), F.array(v))
    return F.size(found) > 0


def event_error(v: Column) -> Column:
    """(code, field) of the first rule that an event breaks, null for a valid one.

    Rules go in a fixed order and, within a map, by the order of field names. What isn't an object is
    invalid as a whole (field ``event``).
    """
    has = lambda f: F.array_contains(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), f)
    of = lambda f: F.try_variant_get(v, f"$.{f}", "variant")
    known = (*REQUIRED, *OPTIONAL_TEXTS, *OTHER_FIELDS)
    unknown = F.get(F.filter(F.transform(entries(v), lambda e: e["key"]), lambda k: ~k.isin(*known)), F.lit(0))
    checks = [
        F.when(F.coalesce(kind_of(v) != "object", F.lit(True)), _error(INVALID, "event")),
        F.when(_too_deep(v), _error(INVALID, "depth")),
        F.when(unknown.isNotNull(), _error(UNKNOWN_FIELD, unknown)),
        F.when(~F.coalesce((kind_of(of("schemaVersion")) == "whole") & (F.try_variant_get(v, "$.schemaVersion", "bigint") == EVENT_VERSION), F.lit(False)), _error(OTHER_VERSION, "schemaVersion")),
        *[F.when(~has(f), _error(INVALID, f)) for f in REQUIRED],
        *[F.when(_bad_text(of(f), n), _error(INVALID, f)) for f, n in (("id", 256), ("sessionId", 256), ("type", 128), ("timestamp", 64))],
        F.when(~_text(of("timestamp")).rlike(ZONED_TIME) | F.try_to_timestamp(F.substring(_text(of("timestamp")), 1, 10), F.lit("yyyy-MM-dd")).isNull(), _error(INVALID, "timestamp")),
        F.when(has("sequence") & ((kind_of(of("sequence")) != "whole") | (F.try_variant_get(v, "$.sequence", "bigint") < 0)), _error(INVALID, "sequence")),
        *[F.when(has(f) & _bad_text(of(f), 256), _error(INVALID, f)) for f in OPTIONAL_TEXTS],
        F.when(has("source"), F.when(kind_of(of("source")) == "string", F.when(_bad_text(of("source"), 256), _error(INVALID, "source"))).otherwise(_map_error(of("source"), F.lit("source"), "source"))),
        F.when(has("workspace"), _map_error(of("workspace"), F.lit("workspace"), "workspace")),
    ]
    items = F.try_variant_get(v, "$.resources", "array<variant>")
    wrong = F.coalesce(kind_of(of("resources")) != "array", F.lit(True)) | (F.size(items) > MOST_RESOURCES)
    each = F.transform(items, lambda r, i: _map_error(r, F.concat(F.lit("resources["), i.cast("string"), F.lit("]")), "resources"))
    checks += [
        F.when(has("resources"), F.when(wrong, _error(INVALID, "resources")).otherwise(_first(each))),
        F.when(has("content"), _content_error(of("content"))),
        F.when(has("metadata"), _map_error(of("metadata"), F.lit("metadata"), "metadata")),
        F.when(has("redactedMetadata"), _map_error(of("redactedMetadata"), F.lit("redactedMetadata"), "metadata")),
    ]
    return F.coalesce(*checks)


def validate_events(rows: DataFrame, body: str = "body") -> DataFrame:
    """The rows with ``code`` and ``field`` of the first rule that their JSON breaks; both null where it is valid."""
    error = F.col("_error")
    marked = rows.withColumn("_error", event_error(F.try_parse_json(F.col(body))))
    return marked.select(*rows.columns, error["code"].alias("code"), error["field"].alias("field"))
