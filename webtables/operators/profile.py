"""Profiles of whole tables, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import text
from .quantiles import grouped_percentiles

DATE_COLUMNS = ("date", "month", "ym", "yearMonth", "published")


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def column_stats(df: DataFrame) -> DataFrame:
    """Type and null count of every column, one row each, from a single scan."""
    nulls = df.agg(*[F.count_if(text.without_nan(df, c).isNull()).alias(c) for c in df.columns])
    kinds = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    long = nulls.unpivot([], df.columns, "column_name", "null_count")
    return long.select("column_name", kinds[F.col("column_name")].alias("dtype"), "null_count")


def numeric_profile(df: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per numeric column."""
    names = _numeric(df)
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column_name string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
        )
    values = {c: text.to_double(df, c) for c in names}
    calls = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    moments = lambda columns: [f(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in calls.items()]
    found = grouped_percentiles(df, [], values, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, once=moments)
    own = {k: F.coalesce(*[F.when(F.col("__column") == c, F.col(f"{k}_{i}").cast("double")) for i, c in enumerate(names)]).alias(k) for k in calls}
    return found.select(
        F.col("__column").alias("column_name"), F.col("__n").alias("count"), own["mean"], own["std"], own["min"], "p25", "p50", "p75", own["max"])


def top_values(df: DataFrame, n: int | None = None) -> DataFrame:
    """Values of every non-numeric column by frequency, the top ``n`` if given; null is shown as ``<NA>``.

    Values are counted before they are ranked, and the rank filter prunes inside each task.
    """
    names = [c for c in df.columns if c not in _numeric(df)]
    shown = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")).alias(c) for c in names])
    counts = shown.unpivot([], names, "column_name", "value").groupBy("column_name", "value").agg(F.count("*").alias("count"))
    order = Window.partitionBy("column_name").orderBy(F.desc("count"), "value")
    ranked = counts.withColumn("value_rank", F.row_number().over(order).cast("bigint"))
    return ranked if n is None else ranked.filter(F.col("value_rank") <= n)


def extent(df: DataFrame) -> DataFrame:
    """Row count with the bounds of the first date-like column that is present."""
    name = next((c for c in DATE_COLUMNS if c in df.columns), None)
    if name is None:
        empty = F.lit("")
        return df.agg(F.count("*").alias("row_count")).select(
            "row_count", empty.alias("date_column"), empty.alias("min_value"), empty.alias("max_value")
        )
    value = text.without_nan(df, name)
    return df.agg(
        F.count("*").alias("row_count"),
        F.lit(name).alias("date_column"),
        F.coalesce(F.min(value).cast("string"), F.lit("")).alias("min_value"),
        F.coalesce(F.max(value).cast("string"), F.lit("")).alias("max_value"),
    )
