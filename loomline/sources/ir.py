"""Parser output as tables: normalisation, contract checks and projection to the graph.

nodes: id, kind (namespace, symbol), semantic, name, qualified, file, visibility, status.
relationships: id, kind, category, source, target, status, confidence, occurrences ARRAY<STRING>.
occurrences: id, owner, file, line, column, end_line, end_column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.hashing import ir_id

# Fixed values of the interchange format.
KINDS = ("requires", "calls", "mentions", "inherits", "implements", "exports", "reexports", "overrides", "contains", "project-references", "type-reference", "jsx")
PROJECTED = ("requires", "calls", "mentions")
STATES = ("resolved", "external", "ambiguous", "unresolved")


def normalize_nodes(raw: DataFrame) -> DataFrame:
    """Nodes under ids of their meaning (kind, namespace, name, project, file); copies are one, with the best status."""
    none = F.lit("")
    project = F.coalesce("project_id", none) if "project_id" in raw.columns else none
    meaning = F.concat_ws("|", "kind", F.coalesce("namespace", none), F.coalesce("qualified", "name"), project, F.coalesce("file", none))
    key = ir_id(F.concat(F.lit("node-"), F.col("kind")), meaning)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), F.col("status")), F.lit(9))
    rest = [c for c in raw.columns if c != "id"]
    best = raw.withColumn("key", key).groupBy("key").agg(F.min_by(F.struct(*rest), F.struct(rank.alias("r"), "id")).alias("n"), F.array_sort(F.collect_set("id")).alias("raw_ids"))
    return best.select(F.col("key").alias("id"), *[F.col(f"n.{c}").alias(c) for c in rest], "raw_ids")


def rekey(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relationships between the new ids, with ids of their own; ends that no node has become null."""
    ids = nodes.select(F.explode("raw_ids").alias("raw"), "id")
    a = ids.select(F.col("raw").alias("source"), F.col("id").alias("_a"))
    b = ids.select(F.col("raw").alias("target"), F.col("id").alias("_b"))
    out = relationships.join(a, "source", "left").join(b, "target", "left")
    keep = [c for c in relationships.columns if c not in ("id", "source", "target")]
    return out.select(ir_id("rel", F.col("kind"), F.coalesce("_a", F.lit("")), F.coalesce("_b", F.lit(""))).alias("id"), *keep, F.col("_a").alias("source"), F.col("_b").alias("target"))


def violations(nodes: DataFrame, relationships: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(code, id): broken rules of the contract, one row each; no rows for a sound document."""
    found = []

    def rule(code: str, df: DataFrame, bad: Column) -> None:
        found.append(df.where(bad).select(F.lit(code).alias("code"), F.coalesce("id", F.lit("")).alias("id")))

    every = nodes.select("id").unionByName(relationships.select("id")).unionByName(occurrences.select("id"))
    found.append(every.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("DUPLICATE_ID").alias("code"), F.coalesce("id", F.lit("")).alias("id")))
    rule("NODE_ID", nodes, F.col("id").isNull() | (F.col("id") == ""))
    rule("PATH", nodes, F.col("file").rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)"))
    rule("KIND", relationships, ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)))
    rule("CATEGORY", relationships, F.col("category") != F.col("kind"))
    rule("STATUS", relationships, ~F.coalesce(F.col("status").isin(*STATES), F.lit(False)))
    rule("CONFIDENCE", relationships, ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)))
    rule("SPAN", occurrences, (F.col("line") < 1) | (F.col("column") < 0) | (F.col("end_line") < F.col("line")) | ((F.col("end_line") == F.col("line")) & (F.col("end_column") < F.col("column"))))
    known = nodes.select(F.col("id").alias("end")).distinct()
    for c in ("source", "target"):
        lost = relationships.join(known, relationships[c] == known["end"], "left_anti")
        found.append(lost.select(F.lit(f"{c.upper()}_MISSING").alias("code"), "id"))
    owners = known.unionByName(relationships.select(F.col("id").alias("end"))).distinct()
    found.append(occurrences.join(owners, occurrences["owner"] == owners["end"], "left_anti").select(F.lit("OWNER_MISSING").alias("code"), "id"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def project(nodes: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, diagnostics) of the graph.

    Nodes that aren't resolved go; of the relationships the three projected kinds stay where kind and
    category agree. An edge to a node that went is a warning, one to a node that never was an error.
    """
    good = nodes.where(F.col("kind").isin("namespace", "symbol") & ~F.coalesce(F.col("status").isin("unresolved", "ambiguous"), F.lit(False)))
    kind = F.when(F.col("semantic") == "keyword", "keyword").when(F.col("kind") == "namespace", "namespace").otherwise("var")
    namespace = F.when(F.col("kind") == "namespace", F.col("qualified")).otherwise(F.regexp_replace("qualified", r"[./][^./]*$", ""))
    out = good.select("id", kind.alias("kind"), F.col("name").alias("label"), namespace.alias("namespace"), (F.coalesce("status", F.lit("")) == "external").alias("external"), "file", (F.col("visibility") == "private").alias("private"))
    ends = nodes.select("id").withColumn("known", F.lit(True)).join(out.select("id").withColumn("kept", F.lit(True)), "id", "left")
    side = lambda c: ends.select(F.col("id").alias(c), F.col("known").alias(f"known_{c}"), F.coalesce("kept", F.lit(False)).alias(f"kept_{c}"))
    rels = relationships.where(F.col("kind").isin(*PROJECTED) & (F.col("kind") == F.col("category"))).join(side("source"), "source", "left").join(side("target"), "target", "left")
    fine = F.coalesce(F.col("kept_source") & F.col("kept_target"), F.lit(False))
    edges = rels.where(fine).select("id", "kind", "source", "target", F.greatest(F.lit(1), F.size("occurrences")).alias("n"))
    lost = F.col("known_source").isNull() | F.col("known_target").isNull()
    diagnostics = rels.where(~fine).select("id", F.when(lost, "DANGLING_ENDPOINT").otherwise("UNRESOLVED_ENDPOINT").alias("code"), F.when(lost, "error").otherwise("warning").alias("severity"))
    return out, edges, diagnostics


def evidence(relationships: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(id, evidence): the places of each relationship in order."""
    rows = relationships.select("id", F.explode("occurrences").alias("o"))
    place = occurrences.select(F.col("id").alias("o"), F.struct("file", "line", "column", "end_line", "end_column").alias("e"))
    return rows.join(place, "o").groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("evidence"))


def ownership(nodes: DataFrame, relationships: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(file, nodes, relationships): what each file holds, sorted."""
    own = nodes.where("file is not null").groupBy("file").agg(F.array_sort(F.collect_set("id")).alias("nodes"))
    rel = relationships.select(F.col("id").alias("owner")).join(occurrences.where("file is not null").select("owner", "file"), "owner").groupBy("file").agg(F.array_sort(F.collect_set("owner")).alias("relationships"))
    none = F.array().cast("array<string>")
    return own.join(rel, "file", "full_outer").select("file", F.coalesce("nodes", none).alias("nodes"), F.coalesce("relationships", none).alias("relationships"))


def one_based(occurrences: DataFrame, line_base: int, column_base: int) -> DataFrame:
    """Spans with lines from 1 and columns from 0, from an adapter's own bases."""
    shift = lambda c, base, want: (F.col(c) + (want - base)).alias(c)
    rest = [c for c in occurrences.columns if c not in ("line", "end_line", "column", "end_column")]
    return occurrences.select(*rest, shift("line", line_base, 1), shift("end_line", line_base, 1), shift("column", column_base, 0), shift("end_column", column_base, 0))


def detect_languages(files: DataFrame, markers: DataFrame) -> DataFrame:
    """(language, score, ambiguous): twice the files, at most ten of them, and the weights of marker files.

    ``files``: path, language. ``markers``: language, weight.
    """
    by = files.groupBy("language").agg((2 * F.least(F.count("*"), F.lit(10))).alias("s")).unionByName(markers.groupBy("language").agg(F.sum("weight").cast("bigint").alias("s")))
    scores = by.groupBy("language").agg(F.sum("s").alias("score"))
    top = scores.agg(F.max("score").alias("top"))
    both = scores.join(F.broadcast(top))
    return both.join(F.broadcast(both.agg(F.count_if(F.col("score") == F.col("top")).alias("ties")))).select("language", "score", ((F.col("score") == F.col("top")) & (F.col("ties") > 1)).alias("ambiguous"))
