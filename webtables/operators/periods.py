"""Months, labelled periods and time limits."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import DataFrame, functions as F

from ..functions import dates


def with_month(df: DataFrame, column: str, output: str = "month") -> DataFrame:
    """Month start of a month text, number or timestamp; null when unreadable."""
    return df.withColumn(output, dates.parse_year_month(column))


def month_key(df: DataFrame, column: str, output: str = "month", fmt: str = "yyyyMM") -> DataFrame:
    return df.withColumn(output, dates.month_key(column, fmt))


def drop_current_month(
    df: DataFrame, column: str, *, reference: date | None = None, zone: str = dates.DEFAULT_ZONE
) -> DataFrame:
    """Remove rows of the month that is current in ``zone``; unreadable months stay."""
    current = (reference or dates.today_in(zone)).replace(day=1)
    month = dates.parse_year_month(column)
    return df.filter(month.isNull() | (month != F.lit(current)))


def recent_months(df: DataFrame, column: str, months: int) -> DataFrame:
    """Keep the latest ``months`` months up to the latest one in the data (a scalar subquery, one extra scan)."""
    month = dates.parse_year_month(column)
    latest = df.agg(F.max(month).alias("latest")).select(F.add_months("latest", 1 - months)).scalar()
    return df.filter(month >= latest)


# ---------------------------------------------------------------- periods


def parse_periods(tokens: str, reference: date | None = None) -> list[tuple[str, list[str]]]:
    """Period tokens as (label, months): ``N`` months ago, ``this-year``, ``YYYY``, ``YYYYQn``."""
    if not tokens or not str(tokens).strip():
        raise ValueError("tokens must be a non-empty string")
    today = reference or dates.today_in()
    periods = []
    for token in filter(None, (t.strip() for t in str(tokens).split(","))):
        quarter = re.fullmatch(r"(\d{4})Q([1-4])", token, re.IGNORECASE)
        if quarter:
            first = int(quarter[2]) * 3 - 2
            periods.append((f"{quarter[1]}Q{quarter[2]}", [f"{quarter[1]}{m:02d}" for m in range(first, first + 3)]))
        elif token.lower() == "this-year" or re.fullmatch(r"\d{4}", token):
            year = f"{today.year:04d}" if token.lower() == "this-year" else token
            periods.append((year, [f"{year}{m:02d}" for m in range(1, 13)]))
        else:
            label = dates.months_ago(int(token), today)
            periods.append((label, [label]))
    return periods


def period_rollup(df: DataFrame, month: str, metrics: list[str], tokens: str, reference: date | None = None) -> DataFrame:
    """Sums per period label; periods may overlap.

    Rows are summed per month first; each month then looks its labels up in a literal map, so nothing is
    joined and only one row per month is repeated.
    """
    labels: dict[str, list[str]] = {}
    for label, months in parse_periods(tokens, reference):
        for m in months:
            labels.setdefault(m, []).append(label)
    literal = F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])
    monthly = df.groupBy(F.col(month).cast("string").alias("__month")).agg(*[F.sum(m).alias(m) for m in metrics])
    labelled = monthly.select(F.explode(literal[F.col("__month")]).alias("period"), *metrics)
    return labelled.groupBy("period").agg(*[F.sum(m).alias(m) for m in metrics])


def month_ranges(df: DataFrame, start: str, end: str) -> DataFrame:
    """Split each row's date range into month pieces clipped at both ends.

    Adds ``month``, ``range_start`` and ``range_end``; rows with an unreadable or reversed range vanish.
    """
    first, last = F.col(start).try_cast("date"), F.col(end).try_cast("date")
    ready = df.withColumns({"__first": first, "__last": last}).filter("__first <= __last")
    step = F.expr("sequence(trunc(__first, 'MM'), __last, INTERVAL 1 MONTH)")
    pieces = ready.withColumn("__month", F.explode(step))
    return pieces.select(
        *df.columns,
        F.date_format("__month", "yyyyMM").alias("month"),
        F.greatest("__month", "__first").alias("range_start"),
        F.least(F.last_day("__month"), "__last").alias("range_end"),
    )


# ---------------------------------------------------------------- time limits


def with_reflection_time(df: DataFrame, column: str = "ts", output: str = "available_at") -> DataFrame:
    """When the half-hour bucket of an event becomes available: bucket close plus thirty minutes."""
    return df.withColumn(output, dates.reflection_time(column))


def _instant(now: datetime):
    if now.tzinfo is None:
        raise ValueError("now must carry a time zone")
    return F.lit(now.isoformat()).cast("timestamp_ltz")


def with_freshness(
    df: DataFrame,
    ttl_hours: float,
    *,
    now: datetime,
    field: str = "fetched_at",
    zone: str = dates.DEFAULT_ZONE,
    output: str = "is_fresh",
) -> DataFrame:
    """Fresh when the age of ``field`` (``fetched_at`` where blank) is at most ``ttl_hours``.

    Missing or unreadable times are stale; times without an offset are read in ``zone``.
    """
    names = [n for n in dict.fromkeys((field, "fetched_at")) if n in df.columns]
    filled = [F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names]
    fetched = dates.text_to_instant(F.coalesce(*filled), zone) if filled else F.lit(None).cast("timestamp_ltz")
    age = F.unix_micros(_instant(now)) - F.unix_micros(fetched)
    return df.withColumn(output, F.coalesce(age <= int(ttl_hours * 3_600_000_000), F.lit(False)))


def overdue(
    df: DataFrame, *, now: datetime, due: str = "due_at", status: str = "status", zone: str = dates.DEFAULT_ZONE
) -> DataFrame:
    """Pending rows whose due time has passed, with whole overdue minutes."""
    late = F.unix_micros(_instant(now)) - F.unix_micros(dates.text_to_instant(due, zone))
    pending = df.filter(F.col(status) == "pending").withColumn("__late", late).filter("__late > 0")
    return pending.withColumn("overdue_minutes", F.expr("__late div 60000000")).drop("__late")


def to_datetime_col(df: DataFrame, column: str = "date") -> DataFrame:
    """Parse one column to a timestamp when it is present."""
    if column not in df.columns:
        return df
    return df.withColumn(column, F.coalesce(F.col(column).try_cast("timestamp_ntz"),
                                            F.try_to_timestamp(F.col(column).cast("string"), F.lit("yyyyMMdd")).cast("timestamp_ntz")))
