"""Numeric coercion of table columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions import text


def parse_amounts(df: DataFrame, column: str) -> DataFrame:
    """Add every number reading of a text column: first number, yen amount, rates, amount with rate."""
    pair = text.parse_amount_rate(column)
    return df.withColumns(
        {
            "number": text.parse_number(column),
            "money": text.parse_money(column),
            "year_rate": text.parse_year_rate(column),
            "pair_amount": pair["amount"],
            "pair_rate": pair["rate"],
        }
    )


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Text with currency signs, commas and percent signs to double, anything else to null."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: text.currency_to_double(F.col(c).cast("string")) for c in present}) if present else df


def to_numeric_cols(
    df: DataFrame, columns: Iterable[str], *, fill: float | None = None, as_int: bool = False
) -> DataFrame:
    """Coerce listed columns that are present, fill what is unreadable, optionally cut to whole numbers."""
    values = {}
    for name in columns:
        if name not in df.columns:
            continue
        value = text.to_double(df, name)
        if fill is not None:
            value = F.coalesce(value, F.lit(float(fill)))
        values[name] = value.try_cast("bigint") if as_int else value
    return df.withColumns(values) if values else df
