"""Retention of journals and chunked runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F, types as T

from . import ranges
from .beacons import complete_runs


def trim_older_than(
    df: DataFrame, *, seq: str, day: str, max_age_days: int, today: date
) -> DataFrame:
    """Drop the contiguous leading rows older than the cutoff.

    A blank day or a newer row ends the trim, so the rows kept start at the smallest sequence number that
    is not old: one scalar aggregate instead of a window over the whole journal.
    """
    cutoff = (today - timedelta(days=max_age_days)).isoformat()
    text = F.substring(F.coalesce(F.col(day).cast("string"), F.lit("")), 1, 10)
    stop = df.filter((text == "") | (text >= cutoff)).agg(F.min(seq).alias("stop")).scalar()
    return df.filter(F.col(seq) >= stop)


def keep_last(df: DataFrame, *, seq: str, max_rows: int, keep_rows: int) -> DataFrame:
    """Keep the newest ``keep_rows`` rows once the used rows, header included, exceed ``max_rows``.

    ``seq`` is of any ordered type, null the oldest; the other columns that can be ordered break ties, so exactly
    ``keep_rows`` rows stay unless whole rows repeat. The keys are sorted by ranges and counted per range while the plan
    is built, which finds the one row at the cut; the table itself is filtered by that row and not sorted.
    """
    if keep_rows < 1:
        raise ValueError("keep_rows must be 1 or greater")
    ordered = [seq, *[f.name for f in df.schema if f.name != seq and isinstance(f.dataType, T.AtomicType)]]
    keys = ranges.ranged(df.select(*ordered), ordered)
    counts = sorted(keys.groupBy(ranges.PART).agg(F.count("*").alias("n")).collect())  # one row per range
    used = sum(r.n for r in counts) + 1
    if used <= max_rows or used - keep_rows < 2:
        return df
    left = used - 1 - keep_rows  # rows before the cut
    for part, n in counts:
        if left < n:
            break
        left -= n
    cut = keys.filter(F.col(ranges.AT) == (part << 33) + left).first()
    place = F.struct(*[F.lit(cut[c]).cast(df.schema[c].dataType).alias(c) for c in ordered])
    newest = F.struct(*ordered) >= place
    return df.filter(newest if cut[seq] is None else (F.col(seq) >= F.lit(cut[seq])) & newest)


def migrate_rows(df: DataFrame, header: Sequence[str], layouts: Sequence[Mapping[str, str]]) -> DataFrame:
    """Rewrite rows of a known old layout to the current header.

    Each layout maps an old column to its current name; the columns of the table must equal one layout (or
    start with the current header), otherwise the table is refused. New columns are empty text.
    """
    if list(df.columns[: len(header)]) == list(header):
        return df.select(*header)
    for layout in layouts:
        if list(df.columns[: len(layout)]) == list(layout):
            old_names = {new: old for old, new in layout.items()}
            return df.select(*[F.col(old_names[h]).alias(h) if h in old_names else F.lit("").alias(h) for h in header])
    raise ValueError(f"unknown layout: {df.columns}")


def keep_latest_runs(
    existing: DataFrame, incoming: DataFrame | None, *, max_runs: int, run: str = "run_id", started: str = "started_at"
) -> DataFrame:
    """Replace rows of incoming runs, then keep the newest ``max_runs`` runs by (started, id)."""
    combined = existing
    if incoming is not None:
        kept = existing.join(incoming.select(run).distinct(), run, "left_anti")
        combined = kept.unionByName(incoming)
    runs = combined.select(run, started).distinct().orderBy(F.desc(started), F.desc(run)).limit(max_runs)
    return combined.join(runs.select(run).distinct(), run, "left_semi")


def latest_complete_run(
    df: DataFrame,
    *,
    run: str = "run_id",
    started: str = "started_at",
    index: str = "part_index",
    count: str = "part_count",
) -> DataFrame:
    """Rows of the newest run whose parts are all there; broken runs are skipped."""
    times = df.groupBy(run).agg(F.max(started).alias("__started"))
    newest = complete_runs(df, run, index, count).join(times, run, "inner")
    newest = newest.orderBy(F.desc("__started"), F.desc(run)).limit(1).select(run)
    return df.join(newest, run, "left_semi")
