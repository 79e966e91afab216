"""Month, bucket and freshness columns, and the date words used in bounds."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, functions as F

from .text import ascii_digits, col

DEFAULT_ZONE = "Asia/Tokyo"


def parse_year_month(value: str | Column) -> Column:
    """First day of the month named by a text, number or timestamp; null when unreadable."""
    text = F.trim(ascii_digits(col(value).cast("string")))
    pattern = r"(?U)^(\d{4})(?:(\d{2})(?:\.0+)?|[-/.年]\s*(\d{1,2})(?:月|[-/.]\d{1,2}.*)?)$"
    year = F.regexp_extract(text, pattern, 1)
    month = F.concat(F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 3))
    month = month.try_cast("int")
    valid = (year != "") & month.between(1, 12)
    return F.when(valid, F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lit("01"))).try_cast("date")


def month_key(value: str | Column, fmt: str = "yyyyMM") -> Column:
    return F.date_format(col(value), fmt)


def day_dashes(value: str | Column) -> Column:
    """``YYYYMMDD`` as ``YYYY-MM-DD``; anything else stays."""
    return F.regexp_replace(col(value), r"(?U)^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def reflection_time(value: str | Column) -> Column:
    """Half-hour bucket close plus thirty minutes; a boundary instant opens the next bucket."""
    half_hour = F.expr("INTERVAL 30 MINUTES")
    minute = F.minute(col(value))
    return F.date_trunc("hour", col(value)) + F.when(minute < 30, half_hour).otherwise(half_hour + half_hour) + half_hour


def text_to_instant(value: str | Column, zone: str = DEFAULT_ZONE) -> Column:
    """ISO text as an instant; text without an offset is read in ``zone``; null when unreadable."""
    text = F.trim(col(value).cast("string"))
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$")
    aware = text.rlike(r"[T ].*(?:Z|[+-]\d{2}:?\d{2})$")
    full = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    zoned = F.when(aware, text).otherwise(F.concat(full, F.lit(f" {zone}")))
    return F.when(shape, zoned.try_cast("timestamp_ltz"))


# ---------------------------------------------------------------- date words


def _add_months(first: date, months: int) -> date:
    index = first.year * 12 + first.month - 1 + months
    return date(index // 12, index % 12 + 1, 1)


def today_in(zone: str = DEFAULT_ZONE) -> date:
    return datetime.now(ZoneInfo(zone)).date()


def resolve_date(word: str, reference: date | None = None, zone: str = DEFAULT_ZONE) -> str:
    """Date word (``today-7d``, ``prev-month-start``, ``7daysAgo``...) as ``YYYY-MM-DD``."""
    text = word.strip()
    today = reference or today_in(zone)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return date.fromisoformat(text).isoformat()
    if re.fullmatch(r"\d{8}", text):
        return datetime.strptime(text, "%Y%m%d").date().isoformat()
    shift = re.fullmatch(r"today([+-]\d+)d", text)
    if shift:
        return (today + timedelta(days=int(shift[1]))).isoformat()
    ago = re.fullmatch(r"(\d+)daysAgo", text)
    if ago:
        return (today - timedelta(days=int(ago[1]))).isoformat()
    edge = re.fullmatch(r"((?:prev-)*)month-(start|end)", text)
    if edge:
        back = edge[1].count("prev-")
        first = _add_months(today, -back)
        day = first if edge[2] == "start" else _add_months(first, 1) - timedelta(days=1)
        return day.isoformat()
    fixed = {
        "today": today,
        "yesterday": today - timedelta(days=1),
        "week-start": today - timedelta(days=today.weekday()),
        "year-start": date(today.year, 1, 1),
        "year-end": date(today.year, 12, 31),
    }
    if text not in fixed:
        raise ValueError(f"Unknown date word: {word}")
    return fixed[text].isoformat()


def months_ago(months: int, reference: date) -> str:
    """Month label ``YYYYMM`` the given number of months before the reference."""
    return _add_months(reference, -months).strftime("%Y%m")
