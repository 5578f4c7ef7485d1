"""Python source as a graph: each file is parsed on its own, names are resolved by joins.

Reads any folder that Spark lists; parsing is a small helper inside ``mapInPandas``.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.storage import dealt

IGNORED = r"(^|/)(\.git|node_modules|__pycache__|\.venv|venv|build|dist|target)(/|$)"
FACTS = "path string, module string, fact string, name string, owner string, line int, end_line int, print string"
# Names that are the language's own, and how sure a way of resolving a name is.
BUILTINS = ("bool", "bytes", "dict", "float", "getattr", "int", "len", "list", "object", "print", "set", "str", "super", "tuple", "type")
SURE = {"import": 0.95, "builtin": 0.8, "import of a module": 0.75, "import of another": 0.65, "scope": 0.85, "self": 0.85, "module": 0.9, "wildcard": 0.35, "none": 0.0}


def scan(spark: SparkSession, folder: str, glob: str = "*.py") -> DataFrame:
    """(path, source) of the files below a folder, ignored folders left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/") + "/"
    path = F.expr(f"substring(path, locate('{root}', path) + {len(root)})")
    return raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("source")).where(~F.col("path").rlike(IGNORED))


def module_name(path: str) -> str:
    parts = path.removesuffix(".py").split("/")
    if parts and parts[0] in ("src", "lib", "python"):
        parts = parts[1:]
    return ".".join(parts[:-1] if parts and parts[-1] == "__init__" else parts)


def facts_of(path: str, source: str) -> Iterator[tuple]:
    """Definitions, imports, bases and calls of a file; a file that can't be parsed gives one ``error``.

    ``print`` of a definition hashes its tree without lines and columns: code that is moved keeps it.
    """
    module = module_name(path)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        yield path, module, "error", type(e).__name__, module, getattr(e, "lineno", 0) or 0, 0, None
        return

    def name_of(node: ast.AST) -> str:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            left = name_of(node.value)
            return f"{left}.{node.attr}" if left else ""
        return ""

    def walk(node: ast.AST, owner: str) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            line, end = getattr(child, "lineno", 0), getattr(child, "end_lineno", 0) or 0
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                own = f"{owner}.{child.name}"
                mark = hashlib.sha256(ast.dump(child, include_attributes=False).encode()).hexdigest()[:16]
                yield path, module, "class" if isinstance(child, ast.ClassDef) else "function", own, owner, line, end, mark
                for base in getattr(child, "bases", []):
                    if name_of(base):
                        yield path, module, "inherits", name_of(base), own, line, end, None
                yield from walk(child, own)
                continue
            if isinstance(child, ast.Import):
                for a in child.names:
                    first = a.name.partition(".")[0]
                    yield path, module, f"import:{a.asname or first}", a.name if a.asname else first, owner, line, end, None
                    if not a.asname and first != a.name:
                        yield path, module, "requires", a.name, owner, line, end, None
            elif isinstance(child, ast.ImportFrom):
                base = child.module or ""
                if child.level:
                    package = module.split(".")
                    package = package if path.endswith("__init__.py") else package[:-1]
                    base = ".".join([*package[: len(package) - child.level + 1], *([base] if base else [])])
                for a in child.names:
                    whole = f"{base}.{a.name}" if base else a.name
                    yield path, module, "wildcard" if a.name == "*" else f"import:{a.asname or a.name}", base if a.name == "*" else whole, owner, line, end, None
            elif isinstance(child, ast.Call) and name_of(child.func):
                yield path, module, "calls", name_of(child.func), owner, line, end, None
            yield from walk(child, owner)

    yield path, module, "module", module, module, 1, source.count("\n") + 1, None
    yield from walk(tree, module)


def facts(files: DataFrame, each: int = 2_000) -> DataFrame:
    """The facts of all files. Files are dealt out first: a small compressed table would be parsed by one task.

    Some rows are parsed at a time, so what a task holds doesn't grow with its share.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                rows = [r for p, s in zip(part["path"], part["source"], strict=True) for r in facts_of(p, s or "")]
                yield pd.DataFrame(rows, columns=["path", "module", "fact", "name", "owner", "line", "end_line", "print"])

    return dealt(files, each).mapInPandas(run, FACTS)


def _scopes(owner: Column, module: Column) -> Column:
    """The definitions around a use, innermost first; the module isn't one."""
    inner = F.split(F.substr(owner, F.length(module) + 2), r"\.")
    upto = lambda k: F.concat(module, F.lit("."), F.array_join(F.slice(inner, 1, k), "."))
    return F.when(owner == module, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.size(inner), F.lit(1), F.lit(-1)), upto))


def resolve(found: DataFrame) -> DataFrame:
    """(module, owner, fact, name, line, target, state, confidence) of every call and base.

    A name is taken, in this order, as one of the language's own, as an import, as a definition in the
    scopes around it from the innermost on, behind ``self.`` as a member of the classes around it or of
    their bases, and as a definition of the module. A name that is none of these is ``ambiguous`` where
    the module imports everything from another, else ``unresolved``. Imports that lead to nothing
    known are ``external``. Candidates of all kinds are one table, which is joined with the known
    definitions once; the first that is known counts. A base is resolved before members are.
    """
    known = found.where("fact in ('class', 'function')").select(F.col("name").alias("target"), F.lit(True).alias("known"), (F.col("fact") == "class").alias("is_class")).dropDuplicates(["target"])
    modules = found.where("fact = 'module'").select(F.col("module").alias("target")).distinct().withColumn("is_module", F.lit(True))
    imports = found.where("fact like 'import:%'").groupBy("module", F.expr("substring(fact, 8)").alias("first")).agg(F.max_by("name", "line").alias("real"))
    wild = found.where("fact = 'wildcard'").select("module").distinct().withColumn("wild", F.lit(True))
    uses = found.where("fact in ('calls', 'inherits')").select("module", "owner", "fact", "name", "line").withColumn("first", F.substring_index("name", ".", 1))
    uses = uses.groupBy("module", "owner", "fact", "name", "first").agg(F.collect_list("line").alias("lines"))
    uses = uses.join(imports, ["module", "first"], "left").join(wild, "module", "left")
    imported = F.concat("real", F.expr("substring(name, length(first) + 1)"))
    # the scopes of a class's own bases are those around the class
    around = F.when(F.col("fact") == "inherits", F.expr("left(owner, length(owner) - length(substring_index(owner, '.', -1)) - 1)")).otherwise(F.col("owner"))
    uses = uses.withColumns({"imported": imported, "scopes": _scopes(around, F.col("module"))})

    def decided(uses: DataFrame, members: DataFrame | None) -> DataFrame:
        spot = lambda rank, way, target: F.struct(F.lit(rank).alias("rank"), F.lit(way).alias("way"), target.alias("target"))
        ways = [
            F.when(F.col("name").isin(*BUILTINS), F.array(spot(0, "builtin", F.concat(F.lit("builtins."), "name")))),
            F.when(F.col("imported").isNotNull(), F.array(spot(1, "import", F.col("imported")))),
            F.transform("scopes", lambda s, i: F.struct((i + 10).alias("rank"), F.lit("scope").alias("way"), F.concat(s, F.lit("."), "name").alias("target"))),
            F.array(spot(1_000_000, "module", F.concat_ws(".", "module", "name"))),
        ]
        empty = F.array().cast("array<struct<rank:int,way:string,target:string>>")
        key = ["module", "owner", "fact", "name"]
        rows = uses.select(*key, "lines", "wild", F.explode(F.concat(*[F.coalesce(w, empty) for w in ways])).alias("c")).select(*key, "lines", "wild", "c.*")
        if members is not None:
            rows = rows.unionByName(members)
        rows = rows.join(known.drop("is_class"), "target", "left").join(modules, "target", "left")
        # what is named by the language or an import is decided there, known or not
        rows = rows.where("known or rank < 2 or rank = 1000000")
        best = rows.groupBy(*key).agg(F.min_by(F.struct("rank", "way", "target", "known", "is_module"), "rank").alias("c"), F.first("lines").alias("lines"), F.first("wild").alias("wild"))
        c = lambda f: F.col(f"c.{f}")
        way = (
            F.when(c("way") == "import", F.when(c("known"), "import").when(c("is_module"), "import of a module").otherwise("import of another"))
            .when((c("rank") == 0) | c("known"), c("way")).when(F.col("wild"), "wildcard").otherwise("none")
        )
        sure = F.create_map(*[x for k, v in SURE.items() for x in (F.lit(k), F.lit(v))])
        state = F.when(way.isin("import", "scope", "self", "module"), "resolved").when(way == "wildcard", "ambiguous").when(way == "none", "unresolved").otherwise("external")
        return best.select(*key, "lines", F.when(way.isin("wildcard", "none"), F.col("name")).otherwise(c("target")).alias("target"), state.alias("state"), sure[way].alias("confidence"))

    bases = decided(uses.where("fact = 'inherits'"), None)
    own = bases.where("state = 'resolved'").groupBy(F.col("owner").alias("class")).agg(F.array_sort(F.collect_set("target")).alias("bases"))
    calls = uses.where("fact = 'calls'")
    classes = known.where("is_class").select(F.col("target").alias("class")).join(own, "class", "left")
    members = calls.where("name like 'self.%'").select("module", "owner", "fact", "name", "lines", "wild", F.posexplode("scopes").alias("i", "class")).join(classes, "class")
    holders = F.concat(F.array("class"), F.coalesce("bases", F.array().cast("array<string>")))
    members = members.select("module", "owner", "fact", "name", "lines", "wild", "i", F.posexplode(holders).alias("j", "holder"))
    members = members.select("module", "owner", "fact", "name", "lines", "wild", (1000 + F.col("i") * 1000 + F.col("j")).alias("rank"), F.lit("self").alias("way"), F.concat("holder", F.expr("substring(name, 5)")).alias("target"))
    out = bases.unionByName(decided(calls, members))
    return out.select("module", "owner", "fact", "name", F.explode("lines").alias("line"), "target", "state", "confidence")


def graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of facts; names that are ambiguous or unresolved have no edge."""
    defs = found.where("fact in ('module', 'class', 'function')")
    nodes = defs.select(F.col("name").alias("id"), F.when(F.col("fact") == "module", "namespace").otherwise("var").alias("kind"), F.col("module").alias("namespace"), "path", "line", "end_line", "print").dropDuplicates(["id"])
    calls = resolve(found).where("state in ('resolved', 'external')").select(F.col("fact").alias("kind"), F.col("owner").alias("source"), "target", (F.col("state") == "resolved").alias("resolved"))
    modules = nodes.where("kind = 'namespace'").select(F.col("id").alias("m")).withColumn("is_module", F.lit(True))
    req = found.where("fact like 'import:%' or fact in ('requires', 'wildcard')").select("module", F.col("name").alias("real"), F.col("fact").startswith("import:").alias("plain"))
    req = req.join(modules, req["real"] == modules["m"], "left")
    req = req.select(F.lit("requires").alias("kind"), F.col("module").alias("source"), F.when(F.col("is_module") | ~F.col("plain"), F.col("real")).otherwise(F.regexp_replace("real", r"\.[^.]*$", "")).alias("target"))
    req = req.join(modules.select(F.col("m").alias("target"), "is_module"), "target", "left").select("kind", "source", "target", F.coalesce("is_module", F.lit(False)).alias("resolved"))
    edges = calls.unionByName(req).groupBy("kind", "source", "target", "resolved").agg(F.count("*").alias("n"))
    return nodes, edges
