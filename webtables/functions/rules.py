"""Ordered pattern rules compiled to one ``when`` chain."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession, functions as F

Rules = Mapping[str, str] | Sequence[tuple[str, str]]


def rule_list(rules: Rules) -> list[tuple[str, str]]:
    pairs = rules.items() if isinstance(rules, Mapping) else rules
    return [(str(pattern), str(label)) for pattern, label in pairs]


def _compile_error(spark: SparkSession, patterns: Sequence[str]) -> PySparkException | None:
    """Error of the first pattern that does not compile; constant expressions are folded, so no job runs."""
    tests = ", ".join(f"'' RLIKE :p{i} AS c{i}" for i in range(len(patterns)))
    try:
        spark.sql(f"SELECT {tests}", args={f"p{i}": unicode_pattern(p) for i, p in enumerate(patterns)}).collect()
    except PySparkException as error:
        return error
    return None


def valid_rules(spark: SparkSession, rules: Rules) -> list[tuple[str, str]]:
    """Rules whose pattern compiles; the others are reported and skipped."""
    pairs = rule_list(rules)
    if not pairs or _compile_error(spark, [pattern for pattern, _ in pairs]) is None:
        return pairs
    good = []
    for pattern, label in pairs:
        error = _compile_error(spark, [pattern])
        if error is None:
            good.append((pattern, label))
        else:
            warnings.warn(f"invalid pattern skipped: {pattern} ({error.getCondition()})", stacklevel=2)
    return good


def unicode_pattern(pattern: str) -> str:
    return "(?U)" + pattern


def search(value: Column, pattern: str) -> Column:
    """Regex search with Unicode character classes; null counts as no match."""
    return F.coalesce(value.rlike(unicode_pattern(pattern)), F.lit(False))


def contains_any(value: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | value.contains(word)
    return F.coalesce(hit, F.lit(False))


def first_label(value: Column, rules: Sequence[tuple[str, str]], default: Column) -> Column:
    """Label of the first rule whose pattern occurs in the value."""
    chain = None
    for pattern, label in rules:
        hit = search(value, pattern)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return default if chain is None else chain.otherwise(default)
