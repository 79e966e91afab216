"""Text and number parsing columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Full-width digits read as their ASCII counterparts.
FULL_WIDTH_DIGITS = "０１２３４５６７８９"
ASCII_DIGITS = "0123456789"

# Patterns of amounts and rates in Japanese financial text.
NUMBER_PATTERN = r"[-+]?[\d,]*\.?\d+"
MONEY_PATTERN = r"([\d,]+)\s*円"
YEAR_RATE_PATTERN = r"年\s*([\d.]+)\s*[%％]"
AMOUNT_RATE_PATTERN = r"([\d,]+)\s*円\s*([\d.]+)\s*[%％]"
CURRENCY_PATTERN = r"[¥￥$€£,%％\s]"

# A plain decimal number; keeps Java-only spellings such as "12d" out of casts.
_DECIMAL = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def strip_blank(value: str | Column) -> Column:
    """Remove every Unicode blank at both ends (``trim`` knows the space only)."""
    return F.regexp_replace(col(value), r"(?U)^\s+|\s+$", "")


def is_blank(value: str | Column) -> Column:
    """True for null and for text made of blanks only."""
    return F.coalesce(strip_blank(col(value).cast("string")) == "", F.lit(True))


def remove_blank(value: str | Column) -> Column:
    return F.regexp_replace(col(value), r"(?U)\s+", "")


def ascii_digits(value: str | Column) -> Column:
    return F.translate(col(value), FULL_WIDTH_DIGITS, ASCII_DIGITS)


def text_to_double(value: str | Column) -> Column:
    """Number held by a text, null when the text is anything else."""
    text = strip_blank(ascii_digits(value))
    return F.when(text.rlike(_DECIMAL), text.try_cast("double"))


def to_double(df: DataFrame, name: str) -> Column:
    """Column ``name`` as double: text is parsed, NaN counts as missing."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("int").cast("double")
    return text_to_double(F.col(name).cast("string"))


def without_nan(df: DataFrame, name: str) -> Column:
    """Column ``name`` with NaN replaced by null, its type kept."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(F.col(name)), F.col(name))
    return F.col(name)


def has_keys(df: DataFrame, keys: Sequence[str]) -> Column:
    """All keys present, as plain null tests that reach the file scan (NaN counts as missing)."""
    out = F.lit(True)
    for key in keys:
        out = out & F.col(key).isNotNull()
        if isinstance(df.schema[key].dataType, (T.DoubleType, T.FloatType)):
            out = out & ~F.isnan(key)
    return out


def force_text(value: str | Column) -> Column:
    """Prefix an apostrophe to values made of digits only."""
    value = col(value)
    return F.when(value.rlike(r"(?U)^\d+\z"), F.concat(F.lit("'"), value)).otherwise(value)


def _first_group(value: str | Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(ascii_digits(value), "(?U)" + pattern, group)
    return text_to_double(F.replace(found, F.lit(","), F.lit("")))


def parse_number(value: str | Column) -> Column:
    """First signed decimal number in a text, thousands commas allowed."""
    return _first_group(value, NUMBER_PATTERN, 0)


def parse_money(value: str | Column) -> Column:
    """First yen amount in a text."""
    return _first_group(value, MONEY_PATTERN, 1)


def parse_year_rate(value: str | Column) -> Column:
    """Annual rate written after the word for year."""
    return _first_group(value, YEAR_RATE_PATTERN, 1)


def parse_amount_rate(value: str | Column) -> Column:
    """Struct of amount and rate written next to each other."""
    return F.struct(
        _first_group(value, AMOUNT_RATE_PATTERN, 1).alias("amount"),
        _first_group(value, AMOUNT_RATE_PATTERN, 2).alias("rate"),
    )


def currency_to_double(value: str | Column) -> Column:
    """Number left after currency signs, commas, percent signs and blanks are dropped."""
    return text_to_double(F.regexp_replace(col(value), "(?U)" + CURRENCY_PATTERN, ""))
