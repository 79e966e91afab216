"""Search-performance tables: aggregation, query variants, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import text, urls
from .chain import sort

METRICS = ("clicks", "impressions", "position")


def search_aggregate(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Sum clicks and impressions over every other column, position weighted by impressions.

    Columns outside ``metrics`` are group keys, so name a ready-made ratio such as ``ctr`` in
    ``metrics`` to have it dropped instead. Rows with a null key are left out; a null page is a group of its own.
    """
    has_page = "page" in df.columns
    if not {"clicks", "impressions"} <= set(df.columns):
        return df.withColumn("page", urls.normalize_page("page")) if has_page else df
    keys = [c for c in df.columns if c not in set(metrics) | set(METRICS)]
    # Null keys are tested before the page is rewritten, so the test reads a raw column.
    rows = df.filter(text.has_keys(df, [k for k in keys if k != "page"]))
    if has_page:
        rows = rows.withColumn("page", urls.normalize_page("page"))
    sums = [F.coalesce(F.sum(text.without_nan(df, m)), F.lit(0)).alias(m) for m in ("impressions", "clicks")]
    if "position" not in df.columns:
        return rows.groupBy(*keys).agg(*sums)
    weight = F.coalesce(text.to_double(df, "position") * text.to_double(df, "impressions"), F.lit(0.0))
    out = rows.groupBy(*keys).agg(*sums, F.sum(weight).alias("__weight"))
    position = F.when(F.col("impressions") > 0, F.col("__weight") / F.col("impressions")).otherwise(F.lit(0.0))
    return out.select(*keys, "impressions", "clicks", position.alias("position"))


def merge_query_variants(df: DataFrame, group_keys: Sequence[str] = ("month", "site", "page")) -> DataFrame:
    """Merge queries that differ by blanks only, under the spelling with the most impressions.

    Spellings are summed first: that step is a hash aggregate with map-side combine, so the second
    step, which picks the spelling, sees one row per spelling and not one per report row.
    """
    keys = list(group_keys)
    missing = sorted({*keys, "query", *METRICS} - set(df.columns))
    if missing:
        raise ValueError(f"merge_query_variants: missing columns {missing}")
    numbers = {m: text.without_nan(df, m) for m in ("impressions", "clicks", "position")}
    weight = F.coalesce(numbers["position"] * numbers["impressions"], F.lit(0)).cast("double")
    spellings = (
        df.filter(text.has_keys(df, [*keys, "query"]))
        .groupBy(*keys, "query")
        .agg(
            F.max(numbers["impressions"]).alias("__top"),
            F.coalesce(F.sum(numbers["impressions"]), F.lit(0)).alias("impressions"),
            F.coalesce(F.sum(numbers["clicks"]), F.lit(0)).alias("clicks"),
            F.sum(weight).alias("__weight"),
        )
    )
    merged = spellings.groupBy(*keys, text.remove_blank("query").alias("__query")).agg(
        F.min_by("query", F.struct(-F.coalesce(F.col("__top").cast("double"), F.lit(float("-inf"))), "query")).alias("query"),
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum("__weight").alias("__weight"),
    )
    position = F.when(F.col("impressions") > 0, F.col("__weight") / F.col("impressions")).otherwise(F.lit(0.0))
    ordered = [*keys[:2], "query", *keys[2:]]
    return merged.select(*ordered, "impressions", "clicks", position.alias("position"))


def threshold_filter(df: DataFrame, rules: DataFrame, group_col: str = "site") -> DataFrame:
    """Drop low-value rows by per-group rules; groups without a rule are removed.

    Columns ``min_impressions`` (default 10) and ``max_position`` (default 50) of a rule are optional.
    A rule table without rows returns the input unchanged, which is told when the query runs; a group with two rules
    is emitted once per rule.
    """
    def limit(name: str, default: float):
        value = text.to_double(rules, name) if name in rules.columns else F.lit(None).cast("double")
        return F.coalesce(value, F.lit(default)).alias("__" + name)

    group = text.strip_blank(F.col(group_col).cast("string"))
    bounds = rules.select(
        group.alias("__group"), limit("min_impressions", 10.0), limit("max_position", 50.0)
    ).filter("__group <> ''")
    clicks = F.coalesce(text.to_double(df, "clicks"), F.lit(0.0))
    impressions = F.coalesce(text.to_double(df, "impressions"), F.lit(0.0))
    position = F.coalesce(text.to_double(df, "position"), F.lit(9999.0))
    low = (clicks == 0) & ((impressions < F.col("__min_impressions")) | (position > F.col("__max_position")))
    unruled = rules.agg(F.count("*").alias("n")).scalar() == 0
    joined = df.join(bounds, df[group_col] == bounds["__group"], "left")
    return joined.filter(unruled | F.col("__group").isNotNull() & ~low).select(*[df[c] for c in df.columns])


def clicks_order(df: DataFrame) -> DataFrame:
    """Search reports stand by clicks, most first, when the column is present."""
    return sort(df, "clicks DESC") if "clicks" in df.columns else df


def force_text_column(df: DataFrame, column: str = "query") -> DataFrame:
    """Mark digit-only values of a column as text by a leading apostrophe."""
    return df.withColumn(column, text.force_text(F.col(column).cast("string"))) if column in df.columns else df


def page_paths(df: DataFrame, column: str = "page") -> DataFrame:
    """Reduce a page URL to its path."""
    return df.withColumn(column, urls.page_to_path(column)) if column in df.columns else df


def union_sites(
    facts: DataFrame,
    sites: DataFrame,
    *,
    url_col: str = "url",
    label_col: str | None = None,
    constants: dict[str, object] | None = None,
    aggregate: bool = True,
) -> DataFrame:
    """Rows of all listed sites with their label, aggregated per site; sites without URL are skipped.

    One scan of a fact table holding ``url_col`` replaces one request per site. Site URLs match with or
    without a trailing slash: the sites carry both spellings and are joined on the column as it is stored, so that a
    filter made of the sites reaches the scan.
    """
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    named = sites.select(
        urls.site_key(F.col(url_col).cast("string")).alias("__key"),
        text.strip_blank(F.coalesce(label, F.lit(""))).alias("__label"),
    ).filter("__key <> ''")
    # Reducing the facts per site before the labels come in keeps a site listed twice from doubling its sums.
    spelled = named.select("__key", F.explode(urls.site_spellings("__key")).alias("__url")).distinct()
    rows = facts.join(spelled, F.col(url_col) == F.col("__url")).drop(url_col, "__url")
    if aggregate:
        rows = search_aggregate(rows)
    rows = rows.join(named, "__key", "inner").drop("__key")
    rows = rows.withColumnRenamed("__label", label_col) if label_col else rows.drop("__label")
    return rows.withColumns({name: F.lit(value) for name, value in (constants or {}).items()}) if constants else rows
