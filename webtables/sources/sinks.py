"""Sinks and keyed table maintenance.

Keyed operations are pure functions of (existing, incoming); a writer stores their result under a new
path or replaces whole partitions, so a path that is being read is never overwritten.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions import text


# ---------------------------------------------------------------- writers


def write_result(df: DataFrame, path: str, mode: str = "overwrite", *, delimiter: str = ",") -> int:
    """Write a result with a header per file, ``overwrite`` or ``append``; returns the rows written.

    The count comes from an observation on the same job, not from a second pass.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"Invalid mode: {mode}")
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode(mode).option("header", True).option("sep", delimiter).option("escape", '"').csv(path)
    return seen.get["rows"]


def write_table(df: DataFrame, path: str, mode: str = "append", *, partition_by: Sequence[str] = ()) -> int:
    """Append to a Parquet table or replace it; any other mode is refused."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"Invalid mode: {mode}")
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if partition_by:
        _rebalanced(counted, partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        counted.write.mode(mode).parquet(path)
    return seen.get["rows"]


def _rebalanced(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of one partition value together, so tasks write few files; the adaptive plan splits hot values."""
    return df.hint("rebalance", *[F.col(c) for c in columns])


def load_delimited(
    spark: SparkSession,
    source: str,
    target: str,
    schema: str,
    *,
    skip_lines: int = 1,
    mode: str = "append",
    delimiter: str = ",",
    line_breaks: bool = True,
) -> int:
    """Load delimited text into a Parquet table, skipping leading lines of every file; returns the rows loaded.

    A quoted cell may hold line breaks, so a file is read by one task. ``line_breaks=False`` lets Spark split files that
    are known to have none. Leading lines are plain lines: their quotes do not join them to the next one unless
    ``line_breaks`` is on and a quoted cell is left open in them.
    """
    options = {"sep": delimiter, "escape": '"', "enforceSchema": True, "multiLine": line_breaks}
    if skip_lines > 1 and not line_breaks:
        lines = _without_leading_lines(spark, source, skip_lines)
        rows = lines.select(F.from_csv("value", schema, {"sep": delimiter, "escape": '"'}).alias("r")).select("r.*")
    elif skip_lines > 1:
        rows = _without_leading_records(spark, spark.read.schema(schema).options(**options).csv(source), source, skip_lines)
    else:
        rows = spark.read.schema(schema).options(**options).option("header", skip_lines == 1).csv(source)
    return write_table(rows, target, mode)


def _without_leading_records(spark: SparkSession, rows: DataFrame, source: str, count: int) -> DataFrame:
    """Rows of files that one task reads each, without those of the first ``count`` lines; empty lines are no rows.

    How many of these lines are rows is told from the lines at the head of each file; one row per file is joined.
    """
    heads = spark.read.text(source).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("start"))
    heads = heads.filter("start = 0").withColumn("n", F.monotonically_increasing_id())
    first = heads.groupBy("__file").agg(F.min("n").alias("low"))
    leading = heads.join(first, "__file").filter(F.col("n") - F.col("low") < count)
    skipped = leading.groupBy("__file").agg(F.count_if(F.col("value") != "").alias("__skip"))
    numbered = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__n"))
    starts = numbered.groupBy("__file").agg(F.min("__n").alias("__low")).join(skipped, "__file")
    return numbered.join(starts, "__file").filter(F.col("__n") - F.col("__low") >= F.col("__skip")).select(*rows.columns)


def _without_leading_lines(spark: SparkSession, source: str, count: int) -> DataFrame:
    """Lines of the files without the first ``count`` of each, told apart by the byte position of the block start.

    Only the head of each file is read to find the offset at which its data starts.
    """
    lines = spark.read.text(source).select("value", "_metadata.file_path", "_metadata.file_block_start")
    first_blocks = lines.filter("file_block_start = 0")
    heads = first_blocks.withColumn("__n", F.monotonically_increasing_id())
    starts = heads.groupBy("file_path").agg(F.min("__n").alias("__first"))
    numbered = heads.join(starts, "file_path").filter(F.col("__n") - F.col("__first") >= count)
    return numbered.select("value").unionByName(lines.filter("file_block_start > 0").select("value"))


def write_chunked(df: DataFrame, path: str, rows_per_chunk: int = 100_000, *, delimiter: str = "\t") -> None:
    """Split a table into header-bearing files of at most the given number of rows, without numbering rows."""
    if rows_per_chunk < 1:
        raise ValueError("rows_per_chunk must be 1 or greater")
    df.write.option("maxRecordsPerFile", rows_per_chunk).option("header", True).option("sep", delimiter).csv(path)


# ---------------------------------------------------------------- schema


def align_schema(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing rows then incoming ones; new columns are appended, none removed."""
    return existing.unionByName(incoming, allowMissingColumns=True)


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name, missing columns null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def clean_table(df: DataFrame) -> DataFrame:
    """Trim header names and drop rows in which every cell is null or blank."""
    renamed = df.toDF(*[c.strip() for c in df.columns])
    filled = F.lit(False)
    for name in renamed.columns:
        filled = filled | ~text.is_blank(F.col(name))
    return renamed.filter(filled)


# ---------------------------------------------------------------- keyed merges


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for key in keys:
        out = out & left[key].eqNullSafe(right[prefix + key])
    return out


def one_per_key(df: DataFrame, keys: Sequence[str], order: str | Column | None = None) -> DataFrame:
    """One row per key tuple: the greatest by ``order``, then by its values."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.select(*keys).distinct()
    values = F.struct(*others)
    rank = F.struct(F.col(order) if isinstance(order, str) else order, values) if order is not None else values
    best = df.groupBy(*keys).agg(F.max_by(values, rank).alias("__best"))
    return best.select(*keys, "__best.*").select(*df.columns)


def latest_per_key(df: DataFrame, key: str, updated: str) -> DataFrame:
    """One record per key, the newest update, newest first; blank keys are dropped."""
    rows = df.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return one_per_key(rows, [key], updated).orderBy(F.desc_nulls_last(updated), key)


def _without_keys(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    taken = incoming.select(*[F.col(k).alias("__i_" + k) for k in keys]).distinct()
    return existing.join(taken, _same(existing, taken, keys, "__i_"), "left_anti")


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], *, sort_by: Sequence[str] | None = None, order: str | None = None
) -> DataFrame:
    """Incoming rows replace existing rows of equal key; an empty input changes nothing. Sorted only by ``sort_by``, if given."""
    fresh = one_per_key(incoming, keys, order)
    merged = align_schema(_without_keys(existing, fresh, keys), fresh)
    return merged.orderBy(*[F.asc_nulls_last(c) for c in dict.fromkeys([*sort_by, *keys])]) if sort_by else merged


def insert_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Append incoming rows whose key values are not there yet; without keys append all."""
    if not keys:
        return align_schema(existing, incoming)
    fresh = one_per_key(incoming, keys)
    return align_schema(existing, _without_keys(fresh, existing, keys))


def _text_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumns({k: text.strip_blank(F.col(k).cast("string")) for k in keys})


def _columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def replace_groups(
    existing: DataFrame,
    incoming: DataFrame,
    group_keys: Sequence[str],
    *,
    columns: Sequence[str],
    sort_by: Sequence[str] = (),
) -> DataFrame:
    """Drop existing rows whose group occurs in incoming, then append incoming; sorted only if ``sort_by`` is given.

    Group keys are compared and kept as stripped text; the columns are exactly the given list.
    """
    old, new = (_text_keys(_columns(df, columns), group_keys) for df in (existing, incoming))
    merged = align_schema(_without_keys(old, new, group_keys), new)
    return merged.orderBy(*[F.asc_nulls_last(c) for c in sort_by]) if sort_by else merged


def replace_group_partitions(incoming: DataFrame, path: str, group_keys: Sequence[str]) -> None:
    """Replace groups of a table partitioned by its group keys; only the partitions of incoming are rewritten."""
    rows = _rebalanced(_text_keys(incoming, group_keys), group_keys)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*group_keys).parquet(path)


def evolve_schema(current: Mapping[str, str], wanted: Mapping[str, str]) -> dict[str, str]:
    """Column types after additive evolution: wanted columns that are absent follow the current ones."""
    return {**current, **{name: kind for name, kind in wanted.items() if name not in current}}
