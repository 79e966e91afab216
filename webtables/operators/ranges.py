"""Order over whole tables without one task for it: rows sorted by ranges, written once, and numbered.

A range sort gives each task a bounded run of the order, however many rows one group has. What a row needs from the rows
before its run is one value per task, so looking back and adding up go over the edges of tasks by a table of that size.
The sorted rows are written in the shared folder, where a lost executor does not change them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.workdir import fresh_path

AT, PART = "__at", "__part"


def ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows with ``__part``, the number of their run in the order, and ``__at``, ascending in the order; null first."""
    path = fresh_path(df.sparkSession, "ranged")
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id())
    numbered.write.parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path).withColumn(PART, F.shiftright(AT, 33))


def row_before(rows: DataFrame, value: Column) -> tuple[DataFrame, Column]:
    """Ranged rows, and ``value`` of the row right before each, null for the first: the run's own, or the last of the run
    before."""
    inside = F.lag(value).over(Window.partitionBy(PART).orderBy(AT))
    last = rows.groupBy(F.col(PART).alias("__next")).agg(F.max_by(value, F.col(AT)).alias("__value"))  # one row per run
    edge = last.select("__next", F.lag("__value").over(Window.orderBy("__next")).alias("__edge"))
    joined = rows.withColumn("__inside", inside).join(edge, F.col(PART) == F.col("__next"), "left")
    return joined, F.coalesce("__inside", "__edge")


def running_before(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each in its group, 0 for the first."""
    rows = ranged(df, [*group, *order])
    keyed = [F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]
    names = [f"__g{i}" for i in range(len(group))]
    sums = rows.groupBy(F.col(PART).alias("__of"), *keyed).agg(F.sum(value).alias("__sum"))  # a row per run and group
    earlier = F.sum("__sum").over(Window.partitionBy(*names).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("__earlier", earlier).drop("__sum")
    same = F.col(PART) == F.col("__of")
    for g, n in zip(group, names):
        same = same & F.col(g).eqNullSafe(F.col(n))
    inside = F.sum(value).over(Window.partitionBy(PART, *group).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1))
    total = F.coalesce("__inside", F.lit(0)) + F.coalesce("__earlier", F.lit(0))
    return rows.withColumn("__inside", inside).join(sums, same).withColumn(name, total).select(*df.columns, name)
