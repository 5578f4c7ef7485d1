"""Functions of text, paths and addresses as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def slashes(c: Column) -> Column:
    """Forward slashes alone, none doubled, no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./)+", ""), "/{2,}", "/")


def folded(c: Column) -> Column:
    """Path with ``.`` and ``..`` folded; a path that leaves its root is null."""
    parts = F.filter(F.split(slashes(c), "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    bad = F.array(F.lit("\u0000"))
    step = lambda acc, p: F.when(F.array_contains(acc, "\u0000"), acc).when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(bad)
    out = F.aggregate(parts, none, step)
    root = F.when(slashes(c).startswith("/"), "/").otherwise("")
    return F.when(~F.array_contains(out, "\u0000"), F.concat(root, F.array_join(out, "/")))


def within(path: Column, root: Column) -> Column:
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def relative_to(path: Column, root: Column) -> Column:
    """The path below a root; null outside of it."""
    return F.when(path == root, "").when(within(path, root), F.substr(path, F.length(root) + 2))


def clean_url(c: Column) -> Column:
    """Scheme, lower-case host, a port that isn't the scheme's own, and path; http, https, ws and wss alone.

    Hosts of other characters than letters, digits, dots and hyphens (numbers of IPv6) give null, and so
    does an address of more than 512 characters.
    """
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    authority = F.regexp_replace(F.substring_index(rest, "/", 1), r"^.*@", "")
    path = F.regexp_extract(rest, r"(?s)^[^/]*(/.*)$", 1)
    host, port = F.lower(F.regexp_replace(authority, r":\d*$", "")), F.regexp_extract(authority, r":(\d+)$", 1)
    usual = (scheme.isin("http", "ws") & (port == "80")) | (scheme.isin("https", "wss") & (port == "443"))
    shown = F.when((port == "") | usual, "").otherwise(F.concat(F.lit(":"), port))
    out = F.concat(scheme, F.lit("://"), host, shown, path)
    return F.when(scheme.isin("http", "https", "ws", "wss") & host.rlike(r"^[a-z0-9.-]+$") & (F.length(port) <= 5) & (F.length(out) <= 512), out)


# What a text must not show, with its replacement, in order.
REDACTIONS = (
    (r"(?i)\b([a-z][a-z0-9+.-]*://)(?:[^/\s@]+@)+", "$1"),
    (
        r"(?i)(\b(?:Bearer|Basic|Token)\s*(?:[:=]\s*|\s+)|\b(?:authorization|api[-_]?key|access[-_]?key|password|token)\s*[:=]\s*(?!(?:Bearer|Basic|Token)\b))\S+",
        "$1[REDACTED]",
    ),
    (r"\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,})\b", "[REDACTED]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED]"),
    (r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{12,}\b", "[REDACTED]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}", "[REDACTED]"),
    (r"(?s)-----BEGIN [^-]+-----.*?-----END [^-]+-----", "[REDACTED]"),
)
PRIVATE_PATH = r"(?i)(?:/(?:Users|home|private/var)/[^/\s]+(?:/[^\s]*)?|[A-Za-z]:\\Users\\[^\\\s]+(?:\\[^\s]*)?)"
SECRET_KEY = r"(?i)(password|passwd|secret|token|bearer|basic|api[-_]?key|authorization|cookie|credential|private[-_]?key|access[-_]?key|prompt|content|result|argument|command|code|environment|env|stack)"
PATH_KEY = r"(?i)(^|[-_])(path|file|directory|cwd|workspace|root|uri|url)$"


def redacted(c: Column, paths: bool = True, home: str | None = None) -> Column:
    """Credentials replaced; with ``paths`` the home folder and private absolute paths too."""
    for pattern, mark in REDACTIONS:
        c = F.regexp_replace(c, pattern, mark)
    if paths:
        if home:
            c = F.replace(c, F.lit(home), F.lit("[HOME]"))
        c = F.regexp_replace(c, PRIVATE_PATH, "[PATH]")
    return c


def redacted_map(c: Column, longest: int = 256) -> Column:
    """A map of texts without keys that name secrets or paths; values redacted and cut."""
    kept = F.map_filter(c, lambda k, v: ~k.rlike(SECRET_KEY) & ~k.rlike(PATH_KEY) & v.isNotNull())
    kept = F.transform_keys(kept, lambda k, v: F.left(k, F.lit(80)))
    return F.transform_values(kept, lambda k, v: F.left(redacted(v), F.lit(longest)))


def redacted_json(c: Column, depth: int = 3, items: int = 16) -> Column:
    """Metadata as JSON, redacted down to a depth: objects lose keys that name secrets or paths, arrays
    are cut to a number of items, what lies deeper is emptied; numbers and booleans stay.

    Objects and arrays are opened level by level, so the expression grows with the depth alone. What
    isn't JSON is null.
    """
    kind = lambda v: F.left(F.ltrim(v), F.lit(1))

    def shown(v: Column, level: int) -> Column:
        text = F.when(kind(v) == '"', F.to_json(F.array(F.left(redacted(F.get_json_object(F.concat(F.lit("["), v, F.lit("]")), "$[0]")), F.lit(256)))))
        text = F.substring(text, 2, 2**30)
        plain = F.when(v.rlike(r"^\s*(?:-?[0-9]|true|false)"), F.trim(v)).when(kind(v) == '"', F.left(text, F.length(text) - 1))
        if level >= depth:
            return F.when(kind(v) == "{", "{}").when(kind(v) == "[", "[]").otherwise(plain)
        pairs = F.from_json(v, "map<string,variant>")
        each = F.transform(F.map_entries(F.map_filter(pairs, lambda k, _: ~k.rlike(SECRET_KEY) & ~k.rlike(PATH_KEY))), lambda e: F.struct(F.left(e["key"], F.lit(80)).alias("k"), shown(F.to_json(e["value"]), level + 1).alias("v")))
        inside = F.array_join(F.transform(F.filter(each, lambda e: e["v"].isNotNull()), lambda e: F.concat(F.to_json(F.array(e["k"])), F.lit(":"), e["v"])), ",")
        # the key stands in brackets of its own
        inside = F.regexp_replace(inside, r'\[("(?:[^"\\]|\\.)*")\]:', "$1:")
        listed = F.transform(F.slice(F.from_json(v, "array<variant>"), 1, items), lambda x: shown(F.to_json(x), level + 1))
        listed = F.array_join(F.filter(listed, lambda x: x.isNotNull()), ",")
        return F.when(kind(v) == "{", F.concat(F.lit("{"), inside, F.lit("}"))).when(kind(v) == "[", F.concat(F.lit("["), listed, F.lit("]"))).otherwise(plain)

    return shown(c, 0)


def error_class(name: Column, context: Column) -> Column:
    """What an error is about: its context if that is a known one, else by its name."""
    known = F.when(context.isin("model_call", "tool_execution", "system", "user_input"), context)
    return F.coalesce(known, F.when(name.rlike("(?i)timeout"), "timeout").when(name.rlike("(?i)permission|denied|forbidden"), "permission").otherwise("error"))


def error_code(code: Column) -> Column:
    """An error's code if it looks like one."""
    return F.when(code.rlike(r"^[A-Za-z][A-Za-z0-9_.-]{1,63}$"), code)


def safe_label(c: Column, longest: int = 160) -> Column:
    """Without control characters, white space collapsed, cut to a length."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "), r"\s+", " ")), F.lit(longest))


def duration(ms: Column) -> Column:
    """``120ms``, ``9s``, ``3m 07s`` or ``2h 05m``."""
    s = F.floor(ms / 1000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit("ms")))
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), two(s % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), two(F.floor(s % 3600 / 60)), F.lit("m")))
    )


def relative_module(module: Column, package: Column) -> Column:
    """An import with leading dots resolved against its package; others stay."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    parts = F.split(package, r"\.")
    base = F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - dots + 1))
    name = F.regexp_replace(module, r"^\.+", "")
    return F.when(dots == 0, module).otherwise(F.array_join(F.filter(F.concat(base, F.array(name)), lambda p: p != ""), "."))


def patch_files(c: Column, most: int = 32) -> Column:
    """Distinct files of the headers of a patch, in order."""
    found = F.regexp_extract_all(c, F.lit(r"(?m)^(?:(?:---|\+\+\+) |\*\*\* (?:Add|Update|Delete) File: )(\S+)"), F.lit(1))
    files = F.transform(found, lambda f: F.regexp_replace(f, "^[ab]/", ""))
    return F.slice(F.array_distinct(F.filter(files, lambda f: f != "/dev/null")), 1, most)


def repository_path(c: Column) -> Column:
    """A path below a repository, ``./`` taken off and ``..`` folded; null if it is absolute, has a drive or
    backslashes, or leaves the repository."""
    bad = c.contains("\\") | c.startswith("/") | c.rlike("^[A-Za-z]:")
    return F.when(~bad, F.nullif(folded(c), F.lit("")))


def safe_relative(c: Column) -> Column:
    """A relative path of harmless characters, else null."""
    path = repository_path(slashes(c))
    return F.when(path.rlike(r"^[a-zA-Z0-9_.@+~() /-]+$"), path)


def safe_tool(c: Column) -> Column:
    """A tool's name, white space collapsed; null if it looks like a path or isn't plain."""
    name = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(name.rlike(r"^[a-zA-Z0-9._:-]{1,80}$") & ~name.rlike(r"^[a-zA-Z]:[\\/]"), name)


def safe_type(c: Column) -> Column:
    return F.when(c.rlike(r"^[a-zA-Z0-9_.:-]{1,80}$"), c).otherwise("provider event")


# Folders that mark a repository, and folders that hold several.
INSIDE_REPOSITORY = (
    ".devcontainer", ".github", ".gitlab", ".vscode", "bin", "components", "config", "docs", "examples", "fixtures",
    "lib", "packages", "producer", "public", "resources", "scripts", "src", "test", "tests",
)
CONTAINERS = (
    "code", "dev", "development", "git", "github", "projects", "repos", "repositories", "source", "sources", "workspace", "workspaces",
)


def project_root(path: Column, workspace: Column) -> Column:
    """The project that an absolute path within a workspace belongs to.

    A workspace that is a container of projects has one in each folder, unless that folder is one of a
    repository's own.
    """
    parts = F.filter(F.split(relative_to(path, workspace), "/"), lambda p: p != "")
    holds = F.lower(F.element_at(F.filter(F.split(workspace, "/"), lambda p: p != ""), -1)).isin(*CONTAINERS)
    own = (F.size(parts) > 1) & holds & ~F.lower(F.get(parts, F.lit(0))).isin(*INSIDE_REPOSITORY)
    return F.when(F.coalesce(own, F.lit(False)), F.concat(workspace, F.lit("/"), F.get(parts, F.lit(0)))).otherwise(workspace)


# Fixed value: the folder of an agent's own files.
AGENT_FOLDER = ".copilot"


def outside_root(path: Column, directory: Column) -> Column:
    """What a path outside of any workspace is grouped by: ``/tmp``, the agent's own folder, the part up to a
    folder that marks a repository, else its folder."""
    p = slashes(path)
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    last = F.greatest(F.lit(0), F.size(parts) - F.when(directory, 0).otherwise(1))
    marks = F.filter(F.transform(parts, lambda x, i: F.when((i > 0) & (i < last) & F.lower(x).isin(*INSIDE_REPOSITORY), i)), lambda i: i.isNotNull())
    keep = F.coalesce(F.get(marks, F.lit(0)), F.greatest(F.lit(1), last))
    root = F.concat(F.when(p.startswith("/"), "/").otherwise(""), F.array_join(F.slice(parts, 1, keep), "/"))
    return (
        F.when((p == "") | (~p.startswith("/") & (F.size(parts) <= 1)), "activity")
        .when(p.startswith("/") & (F.get(parts, F.lit(0)) == "tmp"), "/tmp")
        .when(p.startswith("/") & F.array_contains(parts, AGENT_FOLDER), F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(1), F.array_position(parts, AGENT_FOLDER).cast("int"))), "/"))).otherwise(root)
    )


def resource_path(path: Column, root: Column) -> Column:
    """(path, outside) of a path that a tool names: relative to the root where it lies below, else whole.

    Files aren't looked at, so links aren't followed and nothing is known to exist.
    """
    whole = F.when(path.startswith("/"), folded(path)).otherwise(folded(F.concat(root, F.lit("/"), path)))
    below = relative_to(whole, root)
    return F.struct(F.coalesce(below, whole).alias("path"), below.isNull().alias("outside"))


def safe_snippet(c: Column, resources: Column | None = None, longest: int = 120) -> Column:
    """A short text to show: credentials replaced, rare characters blanked, paths folded, cut.

    A placeholder of a path is the resource's path if there is exactly one.
    """
    out = F.left(F.trim(c), F.lit(140))
    out = F.regexp_replace(out, r"(?i)\b([a-z][a-z0-9+.-]*://)(?:[^/\s@]+@)+", "$1")
    keys = r"password|passwd|token|secret|api[_-]?key|authorization|cookie|credential|access[_-]?key|private[_-]?key"
    out = F.regexp_replace(out, rf"(?i)\b((?:Bearer|Basic|Token)\s*(?:[:=]\s*|\s+)|(?:{keys})\s*[:=]\s*(?!(?:Bearer|Basic|Token)\b))\S+", "$1[redacted]")
    out = F.regexp_replace(out, r"[^\w .:/@+={}\[\]\\\-·]", " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\\", "/"), r"\s+", " "))
    if resources is not None:
        one = F.when(F.size(resources) == 1, F.get(resources, F.lit(0))).otherwise("unknown path")
        parts = F.split(out, r"\[(?:PATH|path|path redacted)\]", -1)
        out = F.array_join(parts, "\u0000")
        out = F.replace(out, F.lit("\u0000"), one)
    return F.nullif(F.left(out, F.lit(longest)), F.lit(""))


def argument_snippet(tool: Column, arguments: Column, longest: int = 120) -> Column:
    """What a tool was asked, from its arguments (a map of texts): its command, what it views or looks for,
    a statement's verb, the number of files of a patch, or up to four harmless pairs."""
    at = lambda *keys: F.coalesce(*[F.try_element_at(arguments, F.lit(k)) for k in keys])
    name = F.lower(tool)
    joined = lambda *parts: F.left(F.concat_ws(" · ", tool, *parts), F.lit(longest))
    verb = F.upper(F.nullif(F.regexp_extract(at("query", "sql", "statement", "operation", "action"), r"(?i)^\s*(select|insert|update|delete|with|create|alter|drop|pragma)\b", 1), F.lit("")))
    files = F.size(patch_files(at("patch", "diff", "input")))
    unsafe = r"(?i)(argument|command|code|content|credential|environment|env|output|prompt|result|secret|stack|token)"
    pairs = F.slice(F.filter(F.map_entries(arguments), lambda e: e["key"].rlike(r"^[a-zA-Z0-9_.-]{1,48}$") & ~e["key"].rlike(unsafe)), 1, 4)
    shown = F.filter(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), safe_snippet(e["value"]))), lambda x: x.isNotNull())
    return (
        F.when(at("command", "cmd").isNotNull(), safe_snippet(at("command", "cmd")))
        .when(name.rlike("apply[-_]?patch|patch"), joined(F.concat(files.cast("string"), F.when(files == 1, " file").otherwise(" files"))))
        .when(name.rlike("^view(?:[-_]|$)|read[-_]?file|cat"), joined(safe_relative(at("path", "filePath", "file", "filename", "directory"))))
        .when(name.rlike("^(?:rg|ripgrep)(?:[-_]|$)|search|grep"), joined(safe_snippet(at("pattern", "searchTerm", "term", "query")), safe_relative(at("path", "paths", "directory", "glob"))))
        .when(name.rlike("sql|query"), joined(verb))
        .otherwise(F.left(F.concat_ws(" · ", tool, F.nullif(F.array_join(shown, " · "), F.lit(""))), F.lit(longest)))
    )
