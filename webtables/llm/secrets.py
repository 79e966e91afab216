"""Secret scans of whole texts: stated patterns, and sliding-window entropy over candidate strings.

Everything is a Spark SQL expression per row; there is no Python in the tasks and no shuffle. Places come from the
lengths of the pieces between matches, so long texts cost one pass per pattern. The entropy of each window of a
candidate comes from character counts that one step changes in two places.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import hidden, need

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
CHUNK = 128


class CharacterClass(NamedTuple):
    name: str
    pattern: str  # whole candidates of this class
    alphabet: str
    window: int
    entropy: float  # bits a character; a window of at least so many is suspicious


CLASSES = (
    CharacterClass("entropy_hex", "^[0-9A-Fa-f]+$", "0123456789abcdef", 16, 2.85),
    CharacterClass("entropy_base64", "^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 20, 3.55),
)
ALLOWED = (
    "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",  # identifiers of the UUID form
    "^[0-9+/_-]+$",  # numbers, dates
    "^[A-Za-z+/_-]+$",  # words only
    # words and short numbers with separators: slugs, paths; possessive, as backtracking is deep in a long candidate
    "^[A-Za-z]++(?:[/_-]++(?:[A-Za-z]++|[0-9]{1,4}+))++$",
    "(?i)example|sample|dummy|placeholder|x{6}",
    "(?i)0123456789|abcdefghij",
)
_SPAN = "struct<start:bigint,kind:int,end:bigint,name:string>"


def _running(sizes: str) -> str:
    """SQL for the sums of an array before each element, in chunks, so that long arrays are not copied again and again."""
    step = f"aggregate({{}}, named_struct('total', 0L, 'out', cast(array() as array<bigint>)), (s, x) -> named_struct('total', s.total + x, 'out', concat(s.out, array(s.total))), s -> s.out)"
    chunks = f"sequence(0, cast(floor((size({sizes}) - 1) / {CHUNK}) as int))"
    sums = f"transform({chunks}, c -> aggregate(slice({sizes}, c * {CHUNK} + 1, {CHUNK}), 0L, (a, x) -> a + x))"
    inner = step.format(f"slice({sizes}, c.index * {CHUNK} + 1, {CHUNK})")
    starts = step.format(sums)
    pairs = f"transform({starts}, (before, index) -> named_struct('before', before, 'index', index))"
    return f"if(size({sizes}) = 0, cast(array() as array<bigint>), flatten(transform({pairs}, c -> transform({inner}, x -> x + c.before))))"


def _places(df: DataFrame, name: str, pattern: str, kind: int, label: str, keep: str = "true", group: int | None = None) -> DataFrame:
    """Column ``name``: spans of all matches that pass ``keep`` (over m, the match, and v, its group)."""
    found, gaps, sizes, ends = (f"_{name}_{x}" for x in ("match", "gap", "size", "start"))
    text = F.col("_text")
    matched = text.rlike(pattern)
    empty = F.array().cast("array<string>")
    df = df.withColumn(f"_{name}", matched)
    df = df.withColumns({
        found: F.when(F.col(f"_{name}"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty),
        gaps: F.when(F.col(f"_{name}"), F.split(text, pattern, -1)).otherwise(empty),
        f"_{name}_value": F.when(F.col(f"_{name}"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group or 0))).otherwise(empty) if group else F.lit(None).cast("array<string>"),
    })
    df = df.withColumn(sizes, F.expr(f"transform({found}, (m, i) -> cast(length({gaps}[i]) + length(m) as bigint))"))
    df = df.withColumn(ends, F.expr(_running(sizes)))
    value = f"_{name}_value[i]" if group else "m"
    span = f"named_struct('start', {ends}[i] + length({gaps}[i]), 'kind', {kind}, 'end', {ends}[i] + length({gaps}[i]) + length(m), 'name', '{label}')"
    kept = f"filter(transform({found}, (m, i) -> named_struct('s', {span}, 'm', m, 'v', {value})), x -> {keep})"
    return df.withColumn(name, F.expr(kept)).drop(f"_{name}", found, gaps, sizes, ends, f"_{name}_value")


def _entropy_span(item: str, start: str, kind: int, group: CharacterClass) -> str:
    """SQL: span from the first to the last window of ``item`` that reaches the entropy; null without such a window."""
    read = f"lower({item})" if group.alphabet == group.alphabet.lower() else item
    letters = f"concat(transform(split({read}, ''), c -> instr('{group.alphabet}', c)), array(0))"
    weight = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(group.window + 1)) + ")"
    limit = group.window * (math.log2(group.window) - group.entropy)
    into = "g.code[i - 1]"
    out = f"if(i > {group.window}, g.code[i - 1 - {group.window}], 0)"
    change = (
        f"if({into} = {out}, 0D, if({into} > 0, g.weight[s.count[{into} - 1] + 1] - g.weight[s.count[{into} - 1]], 0D)"
        f" + if({out} > 0, g.weight[s.count[{out} - 1] - 1] - g.weight[s.count[{out} - 1]], 0D))"
    )
    # a step first judges the window that ended at the character before, then takes the next character in
    full = f"(i > {group.window} AND s.total <= {limit!r}D)"
    step = (
        f"named_struct('count', transform(s.count, (n, k) -> n + if(k + 1 = {into}, 1, 0) - if(k + 1 = {out}, 1, 0)),"
        f" 'total', s.total + {change}, 'first', if({full} AND s.first = 0, i - {group.window}, s.first), 'last', if({full}, i - 1, s.last))"
    )
    begin = (
        f"named_struct('count', array_repeat(0, {len(group.alphabet)}), 'total', 0D, 'first', 0, 'last', 0)"
    )
    done = f"if(s.first = 0, null, named_struct('start', {start} + s.first - 1, 'kind', {kind}, 'end', {start} + s.last, 'name', '{group.name}'))"
    # the letters are bound outside of the steps, whose state is small and of one size
    given = f"array(named_struct('code', {letters}, 'weight', {weight}))"
    return f"transform({given}, g -> aggregate(sequence(1, size(g.code)), {begin}, (s, i) -> {step}, s -> {done}))[0]"


def find_secrets(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """All columns of ``docs`` and ``base`` and ``found``, arrays of spans (start, kind, end, name).

    ``base`` holds the matches of the stated patterns, which nothing suppresses; ``found`` these and the spans that
    the entropy of a candidate adds: runs of 20 or more characters that mix letters and digits, match no pattern of
    ``allowed`` and lie in no base span. A candidate belongs to the first class it matches. Places count code points
    from 0, ends are exclusive; spans are in the order of start, then kind. Null texts have no spans; texts of any
    length are read whole; rows do not influence each other. Input columns named base or found are replaced.
    """
    need(docs, "text")
    own, restore = hidden(docs)
    text = own.columns[docs.columns.index("text")]
    rows = own.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    rows = _places(rows, "_assign", ASSIGN, 0, "assign", f"length(x.v) >= {LEAST_VALUE}", 2)
    rows = _places(rows, "_access", ACCESS, 1, "access")
    rows = _places(rows, "_hex", HEX, 2, "hex")
    rows = rows.withColumn("base", F.array_sort(F.transform(F.concat("_assign", "_access", "_hex"), lambda x: x["s"])))
    mixed = " AND ".join(["x.m rlike '[0-9]'", "x.m rlike '[A-Za-z]'", *(f"NOT x.m rlike {_quoted(p)}" for p in allowed)])
    rows = _places(rows, "_candidate", CANDIDATE, 0, "", f"{mixed} AND NOT exists(base, b -> b.start <= x.s.start AND b.end >= x.s.end)")
    branches = " ".join(f"WHEN x.m rlike {_quoted(g.pattern)} THEN {_entropy_span('x.m', 'x.s.start', 3 + k, g)}" for k, g in enumerate(classes))
    added = F.expr(f"filter(transform(_candidate, x -> CASE {branches} END), y -> y IS NOT NULL AND NOT exists(base, b -> b.start <= y.start AND b.end >= y.end))")
    rows = rows.withColumn("_added", F.when(F.size("_candidate") > 0, added).otherwise(F.array().cast(f"array<{_SPAN}>")))
    rows = rows.withColumn("found", F.array_sort(F.concat("base", "_added")))
    return rows.select([c.alias(n) for c, n in zip(restore, docs.columns) if n not in ("base", "found")] + [F.col("base"), F.col("found")])


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, name: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["name"] == name)).cast("bigint")
