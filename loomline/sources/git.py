"""Git text as tables: logs, name-status lists and diff hunks, parsed with DataFrame functions.

Input is lines with their place: (file, line_no, text). The last header above a line is carried on over
ranges of lines, so one long log is parsed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.ordering import carried

SEPARATOR = "\x1f"
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def parse_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, changes) of logs whose header lines hold hash, time, author and message between separators.

    commits: hash, ts, author, message. changes: hash, status, path, old_path, one row for each path line
    below a header; plain paths have status M, renames and copies two paths.
    """
    header = F.col("text").contains(SEPARATOR)
    parts = F.split("text", SEPARATOR)
    rows = carried(lines, ["file"], ["line_no"], hash=F.when(header, parts[0]))
    commits = rows.where(header).select("hash", F.to_timestamp(parts[1]).alias("ts"), parts[2].alias("author"), parts[3].alias("message"))
    fields = F.split("text", "\t")
    status = F.when(F.size(fields) > 1, F.left(fields[0], F.lit(1))).otherwise("M")
    two = status.isin("R", "C") & (F.size(fields) > 2)
    path = F.when(two, F.get(fields, F.lit(2))).when(F.size(fields) > 1, F.get(fields, F.lit(1))).otherwise(fields[0])
    changes = rows.where(~header & (F.trim("text") != "") & F.col("hash").isNotNull())
    return commits, changes.select("hash", status.alias("status"), path.alias("path"), F.when(two, F.get(fields, F.lit(1))).alias("old_path"))


def parse_hunks(lines: DataFrame) -> DataFrame:
    """(file, path, start, end): closed ranges of new lines; deletions alone have none."""
    path = F.nullif(F.regexp_extract("text", r"^\+\+\+ b/(.*)$", 1), F.lit(""))
    rows = carried(lines, ["file"], ["line_no"], path=path).where(F.col("text").rlike(HUNK))
    start = F.regexp_extract("text", HUNK, 1).cast("bigint")
    n = F.coalesce(F.nullif(F.regexp_extract("text", HUNK, 2), F.lit("")).cast("bigint"), F.lit(1))
    return rows.select("file", "path", start.alias("start"), (start + n - 1).alias("end"), n.alias("n")).where("n > 0").drop("n")


def commit_deltas(changes: DataFrame) -> DataFrame:
    """(hash, added, changed, deleted, renamed): sorted distinct paths of each commit by what happened."""
    of = lambda *s: F.array_sort(F.collect_set(F.when(F.col("status").isin(*s), F.col("path"))))
    return changes.groupBy("hash").agg(of("A", "C").alias("added"), of("M", "R").alias("changed"), of("D").alias("deleted"), F.array_sort(F.collect_set(F.when(F.col("status") == "R", F.concat_ws(">", "old_path", "path")))).alias("renamed"))
