"""Numbers and running totals over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.storage import keep


def running_totals(df: DataFrame, order: list[Column | str], **sums: Column) -> DataFrame:
    """The rows with the total of each of ``sums`` over the rows up to and with their own, in an order.

    Rows are dealt by ranges of the order and summed up range by range; each range's start is the
    total of those before it, a row a range. Rows that tie get any order among them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, made = df.columns, list(sums)
    rows = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), *[F.coalesce(e, F.lit(0)).alias(f"s{i}") for i, e in enumerate(sums.values())], *[_bare(o).alias(f"o{i}") for i, o in enumerate(order)])
    keys = [_directed(o, F.col(f"o{i}")) for i, o in enumerate(order)]
    # numbered as they are written, so a range is a number's high bits from then on
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("row", *[f"s{i}" for i in range(len(made))], F.monotonically_increasing_id().alias("at"))
    rows = keep(rows, "ordered").withColumn("part", F.shiftright("at", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(made))])
    starts = starts.select("part", *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"t{i}") for i in range(len(made))])
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(starts), "part")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], *[(F.sum(f"s{i}").over(within) + F.col(f"t{i}")).alias(c) for i, c in enumerate(made)])


def numbered(df: DataFrame, order: list[Column | str], name: str = "i", first: int = 0) -> DataFrame:
    """The rows with their place in an order, from ``first`` on."""
    return running_totals(df, order, **{name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) - 1 + first)


def carried(df: DataFrame, by: list[str], order: list[str], **values: Column) -> DataFrame:
    """The rows with, for each of ``values``, its last one that isn't null among the rows of the same
    ``by`` up to and with their own, in an order; null where there is none yet.

    Rows are dealt by ranges of (by, order), so the rows of one very frequent ``by`` lie in many
    ranges. Within a range values are carried on row by row; what a range begins with is the last
    value of those before it, a row a range. Columns of ``by`` tie nulls together.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, made = df.columns, list(values)
    boxed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row")
    group = F.struct(*[F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(by)]).alias("by")
    said = [F.when(e.isNotNull(), F.struct(group, e.alias("v"))).alias(f"v{i}") for i, e in enumerate(values.values())]
    rows = df.select(boxed, group, *said, *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)])
    keys = ["by", *[f"o{i}" for i in range(len(order))]]
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("row", "by", *[f"v{i}" for i in range(len(made))], F.monotonically_increasing_id().alias("at"))
    rows = keep(rows, "carried").withColumn("part", F.shiftright("at", 33))
    ends = rows.groupBy("part").agg(*[F.max_by(f"v{i}", F.when(F.col(f"v{i}").isNotNull(), F.col("at"))).alias(f"v{i}") for i in range(len(made))])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("part", *[F.last(f"v{i}", ignorenulls=True).over(before).alias(f"s{i}") for i in range(len(made))])
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(starts), "part")
    known = [F.coalesce(F.last(f"v{i}", ignorenulls=True).over(within), F.col(f"s{i}")).alias(f"k{i}") for i in range(len(made))]
    out = out.select("row", "by", *known)
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names) if c not in values], *[F.when(F.col(f"k{i}.by").eqNullSafe(F.col("by")), F.col(f"k{i}.v")).alias(c) for i, c in enumerate(made)])


class Down:
    """A descending key of an order."""

    def __init__(self, key: Column | str):
        self.key = key


def _bare(key: Column | str | Down) -> Column:
    key = key.key if isinstance(key, Down) else key
    return F.col(key) if isinstance(key, str) else key


def _directed(key: Column | str | Down, column: Column) -> Column:
    return column.desc_nulls_last() if isinstance(key, Down) else column.asc_nulls_first()
