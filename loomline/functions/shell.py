"""Shell lines as Spark expressions: simple commands, what they are for, what they search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import clean_url

_TOKEN = r"\"[^\"]*\"|'[^']*'|&&|\|\||[^\s|;&]+|[|;&]"
_SEGMENT = "struct<command:string,args:array<string>>"
_FOUND = "struct<kind:string,name:string,action:string,ref:string>"

# Words in front of a command that aren't it.
WRAPPERS = ("env", "command", "exec", "sudo")
CHAINS = ("|", "||", "&&", ";", "&")
SEARCHES = ("rg", "ripgrep", "grep", "find", "fd", "fdfind")
VALUE_OPTIONS = ("--regexp", "--file", "--glob", "--iglob", "--type", "--type-not", "--type-add", "-e", "-f", "-g", "-t")

# Package managers, their registries, and the first arguments that fetch from these (none: any).
REGISTRIES = (
    ("npm", "registry.npmjs.org", ("install", "i", "ci", "add", "update")),
    ("pnpm", "registry.npmjs.org", ("install", "add", "i", "update")),
    ("yarn", "registry.npmjs.org", ("add", "install")),
    ("pip", "pypi.org", ("install",)),
    ("pip3", "pypi.org", ("install",)),
    ("uv", "pypi.org", ("pip install", "add")),
    ("poetry", "pypi.org", ("add", "install")),
    ("dotnet", "api.nuget.org", ("add package", "restore")),
    ("nuget", "api.nuget.org", ()),
    ("cargo", "crates.io", ("add", "install", "fetch")),
    ("go", "proxy.golang.org", ("get", "mod download")),
    ("brew", "formulae.brew.sh", ("install", "upgrade")),
)
# Commands that run tests and that build, with the first arguments that do (none: any).
TESTS = (
    ("npm", ("test",)), ("pnpm", ("test",)), ("yarn", ("test",)), ("pytest", ()), ("dotnet", ("test",)), ("go", ("test",)), ("cargo", ("test",)),
    ("lein", ("test",)), ("mvn", ("test",)), ("gradle", ("test",)),
)
BUILDS = (
    ("npm", ("run build",)), ("pnpm", ("build",)), ("vite", ("build",)), ("tsc", ()), ("dotnet", ("build", "publish")), ("cargo", ("build",)),
    ("go", ("build",)), ("make", ()), ("gradle", ("build", "assemble")), ("mvn", ("package", "compile")),
)
GIT_NETWORK = ("push", "pull", "fetch", "clone", "ls-remote")
MOST = 32


def segments(line: Column) -> Column:
    """The simple commands of a line, as (command, args): quotes, assignments, wrappers and folders taken off."""
    tokens = F.transform(F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(0)), lambda t: F.regexp_replace(t, r"^[\"']|[\"']$", ""))
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("now"))
    step = lambda s, t: F.when(t.isin(*CHAINS), F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), none.alias("now"))).otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], F.array(t)).alias("now")))
    lists = F.aggregate(tokens, start, step, lambda s: F.concat(s["done"], F.array(s["now"])))
    extra = lambda t: t.isin(*WRAPPERS) | t.rlike("^[A-Za-z_][A-Za-z0-9_]*=")
    first = lambda words: F.coalesce(F.array_min(F.filter(F.transform(words, lambda t, i: F.when(~extra(t), i)), lambda i: i.isNotNull())), F.lit(-1))
    found = F.transform(lists, lambda w: F.struct(F.lower(F.regexp_replace(F.get(w, first(w)), r"^.*[/\\]", "")).alias("command"), F.slice(w, first(w) + 2, F.size(w)).alias("args"), first(w).alias("at")))
    found = F.filter(found, lambda s: s["at"] >= 0)
    return F.transform(found, lambda s: F.struct(s["command"].alias("command"), s["args"].alias("args")))


def _begins(args: Column, words: tuple[str, ...]) -> Column:
    """Whether the arguments begin with one of the words (or pairs of words); without words they do."""
    if not words:
        return F.lit(True)
    one, two = [w for w in words if " " not in w], [w for w in words if " " in w]
    hit = F.coalesce(F.get(args, F.lit(0)).isin(*one), F.lit(False)) if one else F.lit(False)
    return hit | F.coalesce(F.concat_ws(" ", F.slice(args, 1, 2)).isin(*two), F.lit(False)) if two else hit


def _made(kind: str, name: Column | str, action: Column | str, ref: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(kind).alias("kind"), lit(name).alias("name"), lit(action).alias("action"), (ref if ref is not None else F.lit(None).cast("string")).alias("ref"))


def intents(found: Column, most: int = MOST) -> Column:
    """What the commands reach or do: (kind, name, action, ref) of urls first, then registries, tests, git, builds.

    Nothing of a line but addresses, known names and git's own subcommands is shown.
    """

    def urls(s: Column) -> Column:
        clean = F.filter(F.transform(s["args"], clean_url), lambda u: u.isNotNull())
        return F.transform(clean, lambda u: _made("url", F.regexp_extract(u, "^[a-z]+://([^/]*)", 1), "network", F.when(u.rlike("^[a-z]+://[^/]*$"), F.concat(u, F.lit("/"))).otherwise(u)))

    def registry(s: Column) -> Column:
        out = F.when((s["command"] == "npx") & (F.size(s["args"]) > 0) & ~F.array_contains(s["args"], "--no-install"), "registry.npmjs.org")
        for command, host, words in REGISTRIES:
            out = out.when((s["command"] == command) & _begins(s["args"], words), host)
        return F.when(out.isNotNull(), _made("url", out, "network", F.concat(F.lit("https://"), out, F.lit("/"))))

    def tests(s: Column) -> Column:
        first, second = F.get(s["args"], F.lit(0)), F.get(s["args"], F.lit(1))
        out = F.when((s["command"] == "npm") & (first == "run") & second.startswith("test"), "npm")
        out = out.when((s["command"] == "npx") & first.isin("vitest", "jest", "mocha"), first).when((s["command"] == "npx") & (first == "playwright") & (second == "test"), "playwright")
        out = out.when(s["command"].isin("python", "python3") & (first == "-m") & second.isin("pytest", "unittest"), second)
        out = out.when((s["command"] == "clojure") & F.exists(s["args"], lambda a: a.rlike("(?i)^-M:.*test")), "clojure")
        for command, words in TESTS:
            out = out.when((s["command"] == command) & _begins(s["args"], words), command)
        return F.when(out.isNotNull(), _made("tests", out, "execute"))

    def git(s: Column) -> Column:
        sub = F.get(s["args"], F.lit(0))
        return F.when((s["command"] == "git") & sub.rlike("^[a-z-]{1,32}$"), _made("git", sub, F.when(sub.isin(*GIT_NETWORK), "network").otherwise("execute")))

    def builds(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for command, words in BUILDS:
            out = F.when((s["command"] == command) & _begins(s["args"], words), command).otherwise(out)
        return F.when(out.isNotNull(), _made("build", out, "execute"))

    families = [F.flatten(F.transform(found, urls)), *[F.filter(F.transform(found, f), lambda x: x.isNotNull()) for f in (registry, tests, git, builds)]]
    return F.slice(F.array_distinct(F.concat(*families)), 1, most)


def search_targets(found: Column) -> Column:
    """Paths that rg, grep, find and fd look through: arguments that are neither options nor the pattern."""

    def of(s: Column) -> Column:
        start = F.struct(F.lit(False).alias("skip"), F.lit(False).alias("end"), F.lit(False).alias("given"), F.array().cast("array<string>").alias("pos"))

        def step(a: Column, t: Column) -> Column:
            option = ~a["end"] & t.startswith("-")
            return (
                F.when(a["skip"], F.struct(F.lit(False).alias("skip"), a["end"].alias("end"), a["given"].alias("given"), a["pos"].alias("pos")))
                .when(~a["end"] & (t == "--"), F.struct(F.lit(False).alias("skip"), F.lit(True).alias("end"), a["given"].alias("given"), a["pos"].alias("pos")))
                .when(option, F.struct(t.isin(*VALUE_OPTIONS).alias("skip"), a["end"].alias("end"), (a["given"] | t.isin("-e", "-f", "--regexp", "--file")).alias("given"), a["pos"].alias("pos")))
                .otherwise(F.struct(F.lit(False).alias("skip"), a["end"].alias("end"), a["given"].alias("given"), F.concat(a["pos"], F.array(t)).alias("pos")))
            )

        at = F.aggregate(s["args"], start, step)
        first = F.when((s["command"] == "find") | (at["given"] & ~s["command"].isin("fd", "fdfind")), 1).otherwise(2)
        return F.when(s["command"].isin(*SEARCHES), F.slice(at["pos"], first, F.greatest(F.lit(0), F.size(at["pos"])))).otherwise(F.array().cast("array<string>"))

    return F.filter(F.flatten(F.transform(found, of)), lambda t: t != ".")
