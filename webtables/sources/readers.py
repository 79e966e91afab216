"""Readers: result files, delimited loads, key-value files, parameterised SQL."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Small literal table whose size Spark knows, so that joins with it are planned by that size."""
    fields = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(values, to_arrow_type(f.dataType)) for values, f in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, names=fields.names))


def read_result(spark: SparkSession, path: str, schema: str | T.StructType, *, line_breaks: bool = True) -> DataFrame:
    """Saved result with a header line; the schema is declared, so no pass is spent on inference.

    A quoted cell may hold line breaks, so a file is read by one task. ``line_breaks=False`` lets Spark split files
    that are known to have none.
    """
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", line_breaks).csv(path)


def read_head(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """First rows by an explicit key, because file order is not defined."""
    if rows <= 0:
        raise ValueError("rows must be greater than 0")
    if not keys:
        raise ValueError("a sort key is needed")
    return df.orderBy(*keys).limit(rows)


def read_key_value_tsv(
    spark: SparkSession, path: str, columns: list[str], *, order: str | None = None, line_breaks: bool = True
) -> DataFrame:
    """Classification file: trimmed ``Key`` and columns, blank keys dropped, one row per key.

    The row that wins is the last by ``order``, or without such a column the largest by its values. A quoted cell may
    hold line breaks; ``line_breaks=False`` lets Spark split files that are known to have none.
    """
    names = ["Key", *columns]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names + ([order] if order else [])])
    raw = spark.read.schema(schema).option("header", True).option("sep", "\t").option("escape", '"').option("multiLine", line_breaks).csv(path)
    trimmed = raw.withColumns({n: text.strip_blank(F.coalesce(n, F.lit(""))) for n in names}).filter("Key <> ''")
    return last_per_key(trimmed, "Key", columns, order)


def last_per_key(df: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the last by ``order``, ties and missing order settled by the values."""
    values = F.struct(*columns)
    rank = F.struct(F.col(order).try_cast("bigint").alias("__order"), values.alias("__values")) if order else values
    best = df.groupBy(key).agg(F.max_by(values, rank).alias("__best"))
    return best.select(key, "__best.*")


_PARAMETER_TYPES = {
    "STRING": str,
    "INT64": int,
    "INTEGER": int,
    "FLOAT64": float,
    "FLOAT": float,
    "NUMERIC": Decimal,
    "BOOL": bool,
    "BOOLEAN": bool,
    "DATE": lambda v: v if isinstance(v, date) else date.fromisoformat(v),
    "DATETIME": lambda v: v if isinstance(v, datetime) else datetime.fromisoformat(v),
    "TIMESTAMP": lambda v: v if isinstance(v, datetime) else datetime.fromisoformat(v),
}


def sql_query(
    spark: SparkSession, sql: str, params: Mapping[str, object] | None = None, **tables: DataFrame
) -> DataFrame:
    """SQL text with named parameters (``:name``) over the given tables (``{table}``).

    A parameter is text unless it is a ``(type, value)`` pair.
    """
    args = {}
    for name, value in (params or {}).items():
        kind, plain = value if isinstance(value, tuple) else ("STRING", value)
        if kind.upper() not in _PARAMETER_TYPES:
            raise ValueError(f"Unsupported parameter type: {kind}")
        args[name] = None if plain is None else _PARAMETER_TYPES[kind.upper()](plain)
    return spark.sql(sql, args=args, **tables)


def count_where(df: DataFrame, predicate: str | None = None, params: Mapping[str, object] | None = None) -> DataFrame:
    """Row count under an optional predicate with bound parameters, as a one-row table."""
    if predicate is None:
        return df.agg(F.count("*").alias("n"))
    return sql_query(df.sparkSession, f"SELECT count(*) AS n FROM {{__t}} WHERE {predicate}", params, __t=df)
