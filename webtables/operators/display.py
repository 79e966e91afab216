"""Preparation of tables for display: formatted text, time axis, chart series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text
from ..sources.workdir import fresh_path

HINTS = ("date", "int", "float", "currency", "percent", "text")
TIME_WORDS = ("date", "day", "time", "month", "week")
DATE_SHARE = 0.8
MOST_SERIES = 10_000


def _date_text(value: Column) -> Column:
    """Date of ``2026-1-31`` or ``Jan 31, 2026``, null for other text."""
    plain = text.strip_blank(value)
    iso = F.when(plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(plain, F.lit("yyyy-M-d")))
    named = F.when(
        plain.rlike(r"^[A-Za-z]{3}\s+\d{1,2},\s+\d{4}$"),
        F.try_to_timestamp(F.regexp_replace(F.initcap(plain), r"\s+", " "), F.lit("MMM d, yyyy")),
    )
    return F.coalesce(iso, named).cast("date")


def _separated(value: Column, decimals: int, thousands: bool) -> Column:
    shown = F.format_number(value, decimals)
    return shown if thousands else F.replace(shown, F.lit(","), F.lit(""))


def percent_value(value: Column) -> Column:
    """Ratios (up to 1, or fractional below 2) times 100, other values as they are."""
    size = F.abs(value)
    fractional = F.abs(size - F.round(size)) > 1e-9
    return F.when((size <= 1) | ((size < 2) & fractional), value * 100).otherwise(value)


def _number_text(value: Column, hint: str, decimals: int, thousands: bool) -> Column:
    if hint == "int":
        shown = _separated(F.round(value), 0, thousands)
    elif hint == "percent":
        shown = F.concat(_separated(percent_value(value), decimals, thousands), F.lit("%"))
    else:
        shown = _separated(value, decimals, thousands)
    return F.coalesce(shown, F.lit(""))


_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def format_table(
    df: DataFrame,
    *,
    hints: Mapping[str, str] | None = None,
    decimals: int = 2,
    thousands: bool = True,
    date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """Every column as its display form; hints win, the rest is detected over the whole table in one aggregate.

    Unhinted text is shown as a date when at least 80 % of it parses, an unhinted numeric column as whole
    numbers when all its values are.
    """
    wanted = {k: v.lower() for k, v in (hints or {}).items()}
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in wanted]
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in wanted]
    facts = {}
    if texts or numbers:
        parsed = [F.avg(_date_text(F.col(c)).isNotNull().cast("int")).alias(c) for c in texts]
        whole = [
            F.bool_and(F.abs(text.to_double(df, c) - F.round(text.to_double(df, c))) < 1e-9).alias(c) for c in numbers
        ]
        facts = df.agg(*parsed, *whole).first().asDict()
    out = {}
    for field in df.schema:
        name, value, hint = field.name, F.col(field.name), wanted.get(field.name, "")
        as_text = value.cast("string")
        if hint == "text":
            out[name] = as_text
        elif isinstance(field.dataType, _TIMES):
            out[name] = F.coalesce(F.date_format(value, date_format), F.lit(""))
        elif hint in ("int", "float", "currency", "percent"):
            out[name] = _number_text(text.to_double(df, name), hint, decimals, thousands)
        elif name in numbers:
            out[name] = _number_text(text.to_double(df, name), "int", decimals, thousands) if facts[name] else value
        elif isinstance(field.dataType, T.StringType) and (hint == "date" or (facts.get(name) or 0) >= DATE_SHARE):
            out[name] = F.coalesce(F.date_format(_date_text(value), date_format), as_text)
        else:
            out[name] = value
    return df.select(*[c.alias(n) for n, c in out.items()])


def _time_text(value: Column) -> Column:
    """Instant read from the usual date and time spellings, null for other text."""
    plain = text.strip_blank(value)
    compact = F.when(plain.rlike(r"^\d{8}$"), F.try_to_timestamp(plain, F.lit("yyyyMMdd")).cast("timestamp_ntz"))
    slashed = F.regexp_replace(plain, r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3")
    iso = F.when(slashed.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?([T ].*)?$"), slashed.try_cast("timestamp_ntz"))
    return F.coalesce(compact, iso, _date_text(value).cast("timestamp_ntz"))


def time_axis(df: DataFrame) -> str | None:
    """Column to use as the time axis, decided on one aggregate row.

    ``date`` when any value parses, else the first timestamp column with a value, else the first column,
    those named like a time first, of which at least 80 % parses.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    numeric_date = isinstance(kinds.get("date"), T.IntegralType)  # 20260131, as saved reports have it
    parsable = [n for n, k in kinds.items() if isinstance(k, (T.StringType, *_TIMES)) or n == "date" and numeric_date]
    if not parsable:
        return None

    def parsed(name: str) -> Column:
        value = F.col(name) if isinstance(kinds[name], _TIMES) else _time_text(F.col(name).cast("string"))
        return F.avg(value.isNotNull().cast("int")).alias(name)

    share = df.agg(*[parsed(n) for n in parsable]).first().asDict()
    if (share.get("date") or 0) > 0:
        return "date"
    for name in parsable:
        if isinstance(kinds[name], _TIMES) and (share[name] or 0) > 0:
            return name
    parsable = [n for n in parsable if n != "date" or not numeric_date]
    hinted = [n for n in parsable if any(w in n.lower() for w in TIME_WORDS)]
    order = hinted + [n for n in parsable if n not in hinted]
    return next((n for n in order if (share[n] or 0) >= DATE_SHARE), None)


def series_totals(df: DataFrame, x: str, y: str, series: str, limit: int | None = None) -> DataFrame:
    """Sum of ``y`` by ``x`` and series; null series is ``(null)``. With ``limit``, for the series with the most rows.

    The series are ranked first, on a scan of their own columns; how their names reach the rows is left to Spark.
    """
    rows = df.filter(text.has_keys(df, [x, y])).withColumn("__series", F.coalesce(F.col(series).cast("string"), F.lit("(null)")))
    if limit is None:
        return rows.groupBy(F.col(x), F.col("__series").alias("series")).agg(F.sum(y).alias("total"))
    counts = rows.groupBy(F.col("__series").alias("series")).agg(F.count("*").alias("__n"))
    top = counts.orderBy(F.desc("__n"), "series").limit(limit).select("series")
    kept = rows.join(top, rows["__series"] == top["series"], "left_semi")
    return kept.groupBy(F.col(x), F.col("__series").alias("series")).agg(F.sum(y).alias("total"))


def series_matrix(df: DataFrame, x: str, y: str, series: str, limit: int | None = None) -> DataFrame:
    """One column per series, the ``limit`` with the most rows if given, one row per ``x``.

    The totals are written once, so that the names of the columns and the columns are taken from one run. More than
    ``MOST_SERIES`` columns are refused.
    """
    totals, path = series_totals(df, x, y, series, limit), fresh_path(df.sparkSession, "series")
    totals.write.parquet(path)
    cells = df.sparkSession.read.schema(totals.schema).parquet(path)
    names = [r["series"] for r in cells.select("series").distinct().orderBy("series").limit(MOST_SERIES + 1).collect()]
    if len(names) > MOST_SERIES:
        raise ValueError(f"more than {MOST_SERIES} series: name a limit")
    return cells.groupBy(x).pivot("series", names).agg(F.sum("total"))
