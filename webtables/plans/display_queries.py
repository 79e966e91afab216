"""Tables prepared for display."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import display
from ..sources.readers import read_table
from .registry import query, rounded


@query(
    """
    SELECT format('{:,}', o_orderkey) AS o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day_text,
           o_orderstatus, CAST(o_custkey AS VARCHAR) AS o_custkey, format('{:,.1f}', floor(o_totalprice)) AS price,
           format('{:.1f}', CASE WHEN ratio <= 1 OR (ratio < 2 AND ratio <> floor(ratio)) THEN ratio * 100 ELSE ratio END) || '%' AS ratio
    FROM (SELECT *, (o_orderkey % 16) / 4.0 AS ratio FROM orders)
    """
)
def format_table(spark, sf):
    rows = read_table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", F.date_format("o_orderdate", "MMM d, yyyy").alias("day_text"), "o_orderstatus", "o_custkey",
        F.floor("o_totalprice").alias("price"), (F.col("o_orderkey") % 16 / 4.0).alias("ratio"),
    )
    return display.format_table(rows, hints={"o_custkey": "text", "price": "currency", "ratio": "percent"}, decimals=1)


@query("SELECT 'week_label' AS column_name, count(*) AS row_count FROM orders")
def time_axis(spark, sf):
    rows = read_table(spark, sf, "orders").select(
        "o_orderstatus", F.date_format("o_orderdate", "yyyy/M/d").alias("label"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("week_label")
    )
    return rows.agg(F.count("*").alias("row_count")).select(F.lit(display.time_axis(rows)).alias("column_name"), "row_count")


_SERIES = """
    WITH r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN user_id % 31 = 0 THEN '(null)' ELSE CAST(user_id AS VARCHAR) END AS series, value FROM events),
    top AS (SELECT series FROM r GROUP BY series ORDER BY count(*) DESC, series LIMIT 20)
"""


def _series_rows(spark, sf):
    return read_table(spark, sf, "events").select(
        F.col("ts").cast("date").cast("string").alias("day"), F.when(F.col("user_id") % 31 != 0, F.col("user_id")).alias("series"), "value"
    )


@query(_SERIES + "SELECT day, series, round(sum(value), 4) AS total FROM r WHERE series IN (SELECT series FROM top) GROUP BY day, series")
def series_totals(spark, sf):
    return rounded(display.series_totals(_series_rows(spark, sf), "day", "value", "series", limit=20), "total", places=4)


@query(
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, "
    + ", ".join(f"round(sum(value) FILTER (WHERE event_type = '{k}'), 4) AS \"{k}\"" for k in ("click", "error", "purchase", "signup", "view"))
    + " FROM events GROUP BY 1"
)
def series_matrix(spark, sf):
    rows = read_table(spark, sf, "events").select(F.col("ts").cast("date").cast("string").alias("day"), "event_type", "value")
    out = display.series_matrix(rows, "day", "value", "event_type", limit=20)
    return rounded(out, *out.columns[1:], places=4)
