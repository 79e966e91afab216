"""Traffic channels, sources and pattern classification."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as R, text, urls, variants as V

# Keyword lists of the channel rules.
AI_KEYWORDS = ("bard", "chatgpt", "claude", "copilot", "gemini", "perplexity")
SEARCH_KEYWORDS = ("search", "docomo.ne.jp", ".jword.jp", "jp.hao123.com")
SOCIAL_KEYWORDS = ("threads.net", "threads")

# Ordered patterns of the source-and-channel rules.
AI_FAMILIES = {
    "ChatGPT": r"(chatgpt|chat\.openai\.com)",
    "Copilot": r"(copilot|bing\.com|microsoftcopilot)",
    "Gemini": r"(gemini|bard|aistudio\.google\.com|makersuite\.google\.com)",
    "Claude": r"(claude|anthropic\.com)",
    "Perplexity": r"(perplexity|pplx\.ai)",
}
INTERNAL_PATTERN = r"(office\.net|sharepoint|teams|yammer)"
SEARCH_PATTERN = r"(service\.smt\.docomo\.ne\.jp|search|jp\.hao123\.com|\.jword\.jp)"
SOCIAL_FAMILIES = {
    "Twitter": r"(t\.co|twitter)",
    "Instagram": r"instagram",
    "Facebook": r"facebook",
    "Threads": r"threads",
    "TikTok": r"tiktok",
}
REFERRAL_SEARCH_PATTERN = r"search"
DEFAULT_RULE = "__default__"


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _plain_source(name: str) -> Column:
    return F.replace(F.lower(_filled(name)), F.lit("www."), F.lit(""))


def by_distinct_value(df: DataFrame, column: str, output: str, expression: Callable[[Column], Column]) -> DataFrame:
    """Evaluate a costly expression once per distinct value of ``column`` and join the result back.

    The distinct side has unique keys, so the join never multiplies rows, a hot value is split by the
    adaptive skew join, and Spark broadcasts the lookup only when its measured size allows.
    """
    lookup = df.select(F.col(column).alias("__value")).distinct()
    lookup = lookup.withColumn("__result", expression(F.col("__value")))
    joined = df.join(lookup, df[column].eqNullSafe(lookup["__value"]), "left")
    others = [c for c in df.columns if c != output]
    named = joined.select(*[df[c] for c in others], F.col("__result").alias(output))
    return named.select(*(df.columns if output in df.columns else [*df.columns, output]))


def pattern_map(
    df: DataFrame,
    column: str,
    mapping: R.Rules,
    *,
    output: str | None = None,
    default: str | None = None,
) -> DataFrame:
    """Label of the first pattern found in ``column`` (case-sensitive search), else the text or ``default``.

    Every row runs through the rules; :func:`pattern_map_distinct` runs them once per distinct value.
    """
    return _pattern_map(df, column, mapping, output, default, False)


def pattern_map_distinct(
    df: DataFrame, column: str, mapping: R.Rules, *, output: str | None = None, default: str | None = None
) -> DataFrame:
    """:func:`pattern_map` by a lookup of the distinct values, for long rule lists over a column of few values."""
    return _pattern_map(df, column, mapping, output, default, True)


def _pattern_map(df: DataFrame, column: str, mapping: R.Rules, output: str | None, default: str | None, distinct: bool) -> DataFrame:
    if not mapping or column not in df.columns:
        return df
    good = R.valid_rules(df.sparkSession, mapping)
    target = output or column

    def label(value: Column) -> Column:
        return R.first_label(value.cast("string"), good, value.cast("string") if default is None else F.lit(default))

    if distinct:
        return by_distinct_value(df, column, target, label)
    return df.withColumn(target, label(F.col(column)))


def classify_by_pattern(
    df: DataFrame, mapping: R.Rules, column: str, *, output: str = "category", default: str = "other"
) -> DataFrame:
    """:func:`pattern_map` with a mandatory fallback label, present even without any rule."""
    out = pattern_map(df, column, mapping, output=output, default=default)
    return out if output in out.columns else out.withColumn(output, F.lit(default))


def normalize_source(df: DataFrame, mapping: R.Rules, column: str = "source") -> DataFrame:
    """Map sources by pattern over their lower-case form; unmatched sources stay."""
    good = R.valid_rules(df.sparkSession, mapping)
    return df.withColumn(column, R.first_label(F.lower(column), good, F.col(column)))


def source_columns(df: DataFrame, column: str = "source") -> DataFrame:
    """Add ``domain`` and ``is_private`` of a source."""
    return df.withColumns({"domain": urls.normalize_domain(column), "is_private": urls.is_private_source(column)})


def classify_channel(
    df: DataFrame,
    *,
    output: str = "channel",
    channel: str = "channel",
    source: str = "source",
    medium: str = "medium",
    group_domains: Sequence[str] = (),
    ai_keywords: Sequence[str] = AI_KEYWORDS,
    search_keywords: Sequence[str] = SEARCH_KEYWORDS,
    social_keywords: Sequence[str] = SOCIAL_KEYWORDS,
) -> DataFrame:
    """Reclassify a channel by ordered source and medium rules."""
    src, med, current = _plain_source(source), F.lower(_filled(medium)), _filled(channel)
    referral = current == "Referral"
    label = (
        F.when(urls.is_private_source(src), "Direct")
        .when(R.contains_any(src, ai_keywords) | R.contains_any(med, ai_keywords), "AI")
        .when((med == "map") | R.search(src, r"(^|\.)maps?\."), "Map")
        .when(referral & R.contains_any(src, search_keywords), "Organic Search")
        .when(referral & R.contains_any(src, social_keywords), "Organic Social")
        .when(referral & R.contains_any(src, group_domains), "Group")
        .otherwise(current)
    )
    return df.withColumn(output, label)


def reclassify_source_channel(
    df: DataFrame,
    *,
    channel: str = "channel",
    source: str = "source",
    medium: str = "medium",
    ai_families: R.Rules = AI_FAMILIES,
    internal_pattern: str = INTERNAL_PATTERN,
    internal_label: str = "Internal",
    search_pattern: str = SEARCH_PATTERN,
    social_families: R.Rules = SOCIAL_FAMILIES,
    referral_search_pattern: str = REFERRAL_SEARCH_PATTERN,
    source_output: str = "source",
    channel_output: str = "channel",
) -> DataFrame:
    """Reclassify source and channel together; the first rule that holds decides both."""
    src, med, current = _plain_source(source), F.lower(_filled(medium)), _filled(channel)
    cases = [
        (R.search(src, pattern) | R.search(med, pattern), F.lit(name), F.lit("AI"))
        for name, pattern in R.rule_list(ai_families)
    ]
    cases.append((R.search(src, internal_pattern), src, F.lit(internal_label)))
    cases.append((R.search(src, search_pattern), src, F.lit("Organic Search")))
    cases += [
        (R.search(src, pattern), F.lit(name), F.lit("Organic Social"))
        for name, pattern in R.rule_list(social_families)
    ]
    referral = (current == "Referral") & R.search(src, referral_search_pattern)
    cases.append((referral, src, F.lit("Organic Search")))
    chain = None
    for condition, new_source, new_channel in cases:
        pair = F.struct(new_source.alias("source"), new_channel.alias("channel"))
        chain = F.when(condition, pair) if chain is None else chain.when(condition, pair)
    chain = chain.otherwise(F.struct(_filled(source).alias("source"), current.alias("channel")))
    out = df.withColumn("__pair", chain)
    return out.withColumns({source_output: F.col("__pair.source"), channel_output: F.col("__pair.channel")}).drop("__pair")


def trailing_slashes(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, urls.trailing_slash(column))


# ---------------------------------------------------------------- rules held as data

def _one_rule_per_pattern(rules: Column) -> Column:
    """A pattern listed twice keeps its first place and takes its last label."""
    def merged(found: Column) -> Column:
        def settle(rule: Column) -> Column:
            same = F.filter(found, lambda r: r["pattern"] == rule["pattern"])
            return F.struct(rule["pattern"].alias("pattern"), F.element_at(same, -1)["label"].alias("label"))

        firsts = F.filter(found, lambda rule, i: F.array_position(found["pattern"], rule["pattern"]) == i + 1)
        return F.transform(firsts, settle)

    return text.let(rules, merged)


def _explode_rules(df: DataFrame, columns: list[str], rules: Column) -> DataFrame:
    placed = df.select(*columns, F.posexplode(_one_rule_per_pattern(rules)).alias("rule_order", "__rule"))
    return placed.select(*columns, "rule_order", "__rule.pattern", "__rule.label")


_REGEX_TABLE = (
    "struct<parameter:array<struct<key:string,type:string,value:string,"
    "list:array<struct<map:array<struct<key:string,value:string>>>>>>>"
)


def regex_table_rules(df: DataFrame, column: str) -> DataFrame:
    """Ordered rules of regex-table JSON: the ``map`` list entries, then the default value.

    Adds ``rule_order``, ``pattern`` and ``label``; entries need both pattern and output.
    """
    parsed = df.withColumn("__doc", F.from_json(column, _REGEX_TABLE))
    params = F.coalesce(F.col("__doc.parameter"), F.array())

    def last_value(pairs: Column, key: str) -> Column:
        return F.try_element_at(F.filter(pairs, lambda i: i["key"] == key), F.lit(-1))["value"]

    lists = F.filter(params, lambda p: (p["key"] == "map") & (F.lower(p["type"]) == "list"))
    entries = F.flatten(F.transform(lists, lambda p: F.coalesce(p["list"], F.array())))
    rules = F.transform(
        entries,
        lambda e: F.struct(last_value(e["map"], "key").alias("pattern"), last_value(e["map"], "value").alias("label")),
    )
    rules = F.filter(rules, lambda r: (r["pattern"] != "") & (r["label"] != ""))
    first_default = F.try_element_at(F.filter(params, lambda p: p["key"] == "defaultValue"), F.lit(1))["value"]
    default_text = text.strip_blank(F.coalesce(first_default, F.lit("")))
    default = F.when(
        default_text != "", F.array(F.struct(F.lit(DEFAULT_RULE).alias("pattern"), default_text.alias("label")))
    ).otherwise(F.array())
    return _explode_rules(parsed, df.columns, F.concat(rules, default))


# Names of the two sides of a rule, the first filled one counts; JSON values that count as not filled.
_PATTERN_KEYS = ("key", "pattern", "regex", "source")
_LABEL_KEYS = ("value", "output", "site", "target")
_UNFILLED = ("null", '""', "[]", "{}", "0", "0.0", "false")


def list_rules(df: DataFrame, column: str) -> DataFrame:
    """Ordered rules of a JSON list whose entries name pattern and label under one of several keys.

    Only a list has rules, and only entries with text on both sides.
    """
    unfilled = ", ".join(map(V.literal, _UNFILLED))

    def side(keys: Sequence[str]) -> str:
        filled = ", ".join(f"if(to_json({V.at('e', k)}) NOT IN ({unfilled}), {V.at('e', k)}, NULL)" for k in keys)
        return f"if({V.kind(f'coalesce({filled})')} = 's', {V.at(f'coalesce({filled})', '', 'string')}, NULL)"

    listed = f"coalesce({V.members(V.document(V.name(column)))}, CAST(array() AS ARRAY<VARIANT>))"
    raw = F.expr(f"transform({listed}, e -> named_struct('pattern', {side(_PATTERN_KEYS)}, 'label', {side(_LABEL_KEYS)}))")
    rules = F.transform(raw, lambda r: F.struct(text.strip_blank(r["pattern"]).alias("pattern"), text.strip_blank(r["label"]).alias("label")))
    return _explode_rules(df, df.columns, F.filter(rules, lambda r: (r["pattern"] != "") & (r["label"] != "")))


def url_columns(df: DataFrame) -> DataFrame:
    """One row per text column that holds at least one value starting with ``http``."""
    names = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string")
    found = df.agg(*[F.coalesce(F.bool_or(F.col(n).startswith("http")), F.lit(False)).alias(n) for n in names])
    long = found.unpivot([], names, "column_name", "is_url")
    return long.filter("is_url").select("column_name")
