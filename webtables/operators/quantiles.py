"""Exact percentiles per group by selection on counts; no row is shuffled by its group.

A bounded sketch brackets each wanted rank of every heavy group. Brackets that may leave too many rows open are refined
by further sketches of what lies inside. One last scan counts, in each task before anything is sent, the rows below each
bracket as blocks and the rows inside one value by value. Groups that are not heavy have no bracket: all their values
are counted one by one. The result is the linearly interpolated percentile of the sorted group; a bracket that missed its
rank would stop the job rather than change a result.

There are at most ``HEAVY_GROUPS`` brackets, the groups with the most values, so they may be broadcast, and any other
group has less than ``1 / HEAVY_GROUPS`` of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

SKETCH_SIZE, SKETCH_ERROR = 16_384, 0.00026  # a KLL sketch and the rank error that 99 of 100 of its answers keep
MARGIN = 4 * SKETCH_ERROR  # ten standard deviations
ACCURACY = 20_000  # of the sketches inside brackets
HEAVY_ROWS, HEAVY_GROUPS = 10_000, 10_000
OPEN_ROWS = 1_000_000
GRID = 1000


class _Bracket:
    """Values between which a rank lies, and at most how many rows of the group lie between them."""

    def __init__(self, low: float, high: float, rows: float):
        self.low, self.high, self.open = low, high, rows


def _sketched(
    data: DataFrame, keys: Sequence[str], columns: Sequence[str], ps: Sequence[float], heavy_rows: int, more: Sequence[Column] = ()
) -> tuple[list[tuple[Row, list[list[_Bracket | None]]]], list[Row]]:
    """Heavy groups and, for each column and percentile, the bracket; at most ``HEAVY_GROUPS`` rows reach the driver.

    The second list holds these rows with the aggregates ``more``.
    """
    margin = max(MARGIN, 2 / heavy_rows + SKETCH_ERROR)  # two rows of the smallest heavy group: its neighbours, and rounding
    edges = F.array(*[F.lit(e) for p in ps for e in (max(p - margin, 0.0), min(p + margin, 1.0))])
    counts = [F.count(c).alias(f"__n{i}") for i, c in enumerate(columns)]
    sketch = lambda c: F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(c, F.lit(SKETCH_SIZE)), edges)
    sketches = [F.when(F.count(c) > 0, sketch(c)).alias(f"__e{i}") for i, c in enumerate(columns)]  # an empty one has no values
    found = data.groupBy(*keys).agg(*counts, *sketches, *more)
    most = F.greatest(F.lit(0), *[F.col(f"__n{i}") for i in range(len(columns))])
    out, rows = [], found.where(most > heavy_rows).orderBy(most.desc()).limit(HEAVY_GROUPS).collect() if keys else found.collect()
    for row in rows:
        if max(row[f"__n{i}"] for i in range(len(columns))) <= heavy_rows:
            continue
        brackets = []
        for i in range(len(columns)):
            n, e = row[f"__n{i}"], row[f"__e{i}"]
            share = 2 * (margin + SKETCH_ERROR)
            brackets.append([_Bracket(e[2 * j], e[2 * j + 1], n * share) if n else None for j in range(len(ps))])
        out.append((Row(*[row[k] for k in keys]), brackets))
    return out, rows


def _attached(data: DataFrame, keys: Sequence[str], heavy: list[tuple[Row, list[list[_Bracket | None]]]]) -> DataFrame:
    """``data`` with ``__low`` and ``__high``, an array of brackets per column and percentile, null where there is none."""
    values = [(*key, *[[None if b is None else getattr(b, side) for own in brackets for b in own] for side in ("low", "high")]) for key, brackets in heavy]
    if not keys:  # one group
        arrays = values[0] if values else (None, None)
        literal = lambda a: F.lit(None).cast("array<double>") if a is None else F.array(*[F.lit(x).cast("double") for x in a])
        return data.withColumns({"__low": literal(arrays[0]), "__high": literal(arrays[1])})
    named = [StructField("__k_" + k, data.schema[k].dataType) for k in keys]
    ends = [StructField(n, ArrayType(DoubleType())) for n in ("__low", "__high")]
    table = data.sparkSession.createDataFrame(values, StructType([*named, *ends]))
    same = F.lit(True)
    for k in keys:
        same = same & data[k].eqNullSafe(table["__k_" + k])
    return data.join(F.broadcast(table), same, "left").drop(*["__k_" + k for k in keys])  # at most HEAVY_GROUPS rows


def _refined(data: DataFrame, keys: Sequence[str], columns: Sequence[str], ps: Sequence[float], heavy: list, open_rows: int) -> None:
    """Narrow the brackets of groups with more than ``open_rows`` rows inside one, scan by scan, until none has or none
    gets narrower."""
    while True:
        todo = [h for h in heavy if any(b and b.open > open_rows and b.low < b.high for own in h[1] for b in own)]
        if not todo:
            return
        wide = _attached(data, keys, todo)
        wide = wide.where(F.col("__low").isNotNull())
        grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
        aggregates = []
        for i, c in enumerate(columns):
            aggregates.append(F.count(c).alias(f"__n{i}"))
            for j in range(len(ps)):
                low, high, slot = F.col("__low")[i * len(ps) + j], F.col("__high")[i * len(ps) + j], f"{i}_{j}"
                inside = F.when(F.col(c).between(low, high), F.col(c))
                aggregates += [
                    F.count_if(F.col(c) < low).alias(f"__below{slot}"), F.count(inside).alias(f"__in{slot}"),
                    F.percentile_approx(inside, grid, F.lit(ACCURACY)).alias(f"__grid{slot}")]
        found = {tuple(r[k] for k in keys): r for r in wide.groupBy(*keys).agg(*aggregates).collect()}  # a row per heavy group
        narrower = False
        for key, brackets in todo:
            row = found[tuple(key)]
            for i, own in enumerate(brackets):
                for j, bracket in enumerate(own):
                    if bracket is None or bracket.open <= open_rows or bracket.low == bracket.high:
                        continue
                    inside, grid_values = row[f"__in{i}_{j}"], row[f"__grid{i}_{j}"]
                    rank = (row[f"__n{i}"] - 1) * ps[j] - row[f"__below{i}_{j}"]
                    slack = inside / ACCURACY + 2
                    first = max(int((rank - slack) / inside * GRID) - 1, 0)
                    last = min(int((rank + slack) / inside * GRID) + 2, GRID)
                    low, high = grid_values[first], grid_values[last]
                    narrower |= low > bracket.low or high < bracket.high
                    # a value that alone fills the bracket's grid cells is counted as one
                    bracket.low, bracket.high, bracket.open = low, high, (last - first) / GRID * inside + 2 * slack
        if not narrower:
            return


def grouped_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, Column],
    percentiles: dict[str, float],
    direct: Callable[[Callable[[Column], Column]], list[Column]] | None = None,
    once: Callable[[list[Column]], list[Column]] | None = None,
    *,
    heavy_rows: int = HEAVY_ROWS,
    open_rows: int = OPEN_ROWS,
) -> DataFrame:
    """A row per key tuple and column: keys, ``__column`` (its name), ``__n`` values, a double per percentile.

    ``columns`` are expressions for doubles, null ones are ignored. ``direct(over)`` may name further aggregates of the
    group, each over columns wrapped in ``over``; they stand in a row of the group without a column. Without keys, ``once(values)`` may
    name numeric ones that are taken in the scan of the sketches and stand in the plan as literals.
    """
    keys, names, ps = list(keys), list(columns), list(percentiles.values())
    slots = [f"__v{i}" for i in range(len(names))]
    data = df.withColumns(dict(zip(slots, columns.values())))
    narrow = data.select(*keys, *slots)
    heavy, rows = _sketched(narrow, keys, slots, ps, heavy_rows, once([F.col(s) for s in slots]) if once else ())
    taken = {n: v for n, v in rows[0].asDict().items() if not n.startswith("__")} if once else {}
    _refined(narrow, keys, slots, ps, heavy, open_rows)
    wide = _attached(data, keys, heavy)

    # one row per column; with further aggregates also one for the group, -1, which alone they read
    rows = wide.withColumn("__i", F.explode(F.array(*[F.lit(i) for i in range(-1 if direct else 0, len(slots))])))
    whole = F.col("__i") == -1
    rows = rows.withColumn("__v", F.coalesce(*[F.when(F.col("__i") == i, F.col(s)) for i, s in enumerate(slots)]))
    rows = rows.where(F.col("__v").isNotNull() | whole) if direct else rows
    extra = direct(lambda value: F.when(whole, value)) if direct else []
    counts = rows.groupBy(*keys, "__i", *_anchored(len(ps))).agg(F.count("__v").alias("__c"), *extra)
    shown = [c for c in counts.columns if c not in (*keys, "__i", "__anchor", "__block", "__c")]

    column = Window.partitionBy(*keys, "__i")
    order = column.orderBy(F.asc_nulls_first("__anchor"), "__block")
    running = counts.withColumns({"__upto": F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum("__c").over(column)})
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("__i"))
    found = running.groupBy(*keys, "__i").agg(
        F.max("__n").alias("__n"), *[_interpolated(p).alias(n) for n, p in percentiles.items()], *[F.first(s, ignorenulls=True).alias(s) for s in shown])
    found = found.withColumns({"__column": label, **{n: F.lit(v) for n, v in taken.items()}})
    return found.select(*keys, "__column", "__n", *percentiles, *shown, *taken)


def _anchored(brackets: int) -> list[Column]:
    """What a value is counted as: itself inside a bracket or where there is none, else the block behind the last bracket
    below it."""
    value, below = F.col("__v"), F.lit(None).cast("double")
    ends = [(F.get("__low", F.col("__i") * brackets + j), F.get("__high", F.col("__i") * brackets + j)) for j in range(brackets)]
    alone = ends[0][0].isNull()
    for low, high in ends:
        alone = alone | value.between(low, high)
        below = F.greatest(below, F.when(high < value, high))
    alone = F.coalesce(alone, F.lit(True))
    return [F.when(alone, value).otherwise(below).alias("__anchor"), (~alone).alias("__block")]


def _value_at(rank: Column) -> Column:
    """Smallest exact value whose running count passes the rank; a rank inside a block would be an error."""
    reached, block = F.col("__upto") > rank, F.col("__block")
    in_bracket = F.min(F.when(reached & ~block, F.col("__upto")))
    in_block = F.min(F.when(reached & block, F.col("__upto")))
    missed = (F.max("__n") > 0) & (in_bracket.isNull() | F.coalesce(in_block < in_bracket, F.lit(False)))
    value = F.min(F.when(reached & ~block, F.col("__anchor")))
    return F.when(missed, F.raise_error(F.lit("percentile bracket missed its rank"))).otherwise(value)


def _interpolated(p: float) -> Column:
    rank = (F.col("__n") - 1) * F.lit(p)
    lower, upper = _value_at(F.floor(rank)), _value_at(F.ceil(rank))
    return lower + (upper - lower) * F.max(rank - F.floor(rank))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, percentiles: dict[str, float], *, heavy_rows: int = HEAVY_ROWS, open_rows: int = OPEN_ROWS
) -> DataFrame:
    """One row per key tuple that has values, with a column per named percentile of ``value`` (double, nulls ignored)."""
    found = grouped_percentiles(df, keys, {value: F.col(value).cast("double")}, percentiles, heavy_rows=heavy_rows, open_rows=open_rows)
    return found.where("__n > 0").select(*keys, *percentiles)
