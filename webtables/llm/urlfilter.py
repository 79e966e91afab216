"""URL filters with redirect equivalence.

Rules name a host and a path; the longest rule that fits a URL decides it. URLs that redirect to each other or name
one canonical page are aliases: connected components over these edges carry a block to aliases without a rule of
their own, unless the component holds an explicitly allowed URL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import hidden, need, written
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
CONTENT_URL = r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*'?([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Text between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z folded; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """64-bit hash of the URL without its fragment, scheme and host folded."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, F.xxhash64(scheme, host_of(url), path_of(url), query))


def resolved(base: Column, link: Column) -> Column:
    """Absolute form of a link found on the page ``base``; null for a null or empty link."""
    scheme, host = F.substring_index(base, "://", 1), host_of(base)
    folder = F.regexp_extract(path_of(base), "^(.*/)?", 0)
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(
        link.startswith("/"), F.concat(scheme, F.lit("://"), host, link)).when(
        link != "", F.concat(scheme, F.lit("://"), host, F.when(folder == "", F.lit("/")).otherwise(folder), link))


def links(pages: DataFrame) -> DataFrame:
    """Rows (url, target) for the canonical link and the refresh of each page that has one."""
    tags = {CANONICAL: HREF, REFRESH: CONTENT_URL}
    found = [F.regexp_extract(F.regexp_extract("html", tag, 0), inner, 1) for tag, inner in tags.items()]
    rows = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select("url", F.explode(F.array(*found)).alias("link"))
    return rows.where(F.col("link") != "").select("url", resolved(F.col("url"), F.col("link")).alias("target")).where(F.col("target").isNotNull())


def decided(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (host, path, rule, action) for the distinct host and path pairs of ``urls`` that a rule fits.

    Every suffix of the host is looked up among the hosts of the rules; the longest rule wins, then the smallest text.
    """
    pairs = urls.select("host", "path").distinct().where(F.col("host") != "")
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    offered = pairs.withColumn("suffix", suffix)
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), "action")
    fitting = offered.join(named, "suffix").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("suffix", "rule_path")
    best = F.min(F.struct((-F.length(rule)).alias("size"), rule.alias("rule"), F.col("action").alias("action"))).alias("best")
    return fitting.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.action")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """All columns of ``pages`` and host, path, rule (the text of the rule or null), verdict (allow or block).

    ``rules`` are (host, path, allow or block). Aliases come from the canonical links and refreshes in ``html`` and
    from ``redirects`` (url, target), if given. A URL that no rule fits is blocked if its component holds a blocked
    URL and no allowed one, else allowed. Null URLs and those without ``://`` have an empty host and path and are
    allowed; null html has no links; repeated rows get equal verdicts. Computed columns replace those of equal name.
    """
    need(pages, "url", "html")
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.sql("SELECT '' AS host, '' AS path, '' AS action WHERE false") if not rules else spark.range(1).select(
            F.explode(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules])).alias("r")).select("r.*")
    own, restore = hidden(pages, "url", "html")
    named = own.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})

    edges = links(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.union(redirects.select("url", "target"))
    edges = edges.withColumns({"a": url_key(F.col("url")), "b": url_key(F.col("target"))}).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = written(edges)  # pages are read once for their links
    group = components(edges.select("a", "b"))
    ends = edges.select(F.col("a").alias("node"), "url").union(edges.select(F.col("b").alias("node"), F.col("target").alias("url")))
    ends = ends.select("node", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct()
    acts = ends.join(decided(ends, rules), ["host", "path"]).select("node", "action").distinct()
    held = group.join(acts, "node").groupBy("root").agg(F.max(F.col("action") == "block").alias("some"), F.max(F.col("action") == "allow").alias("free"))
    blocked = group.join(held.where("some AND NOT free").select("root"), "root").select(F.col("node").alias("key"), F.lit(True).alias("blocked"))

    rows = named.join(decided(named, rules), ["host", "path"], "left")
    rows = rows.withColumn("key", url_key(F.col("url"))).join(blocked, "key", "left")
    verdict = F.coalesce(F.col("action"), F.when(F.col("blocked"), F.lit("block")), F.lit("allow")).alias("verdict")
    new = ("host", "path", "rule", "verdict")
    return rows.select([c for c, name in zip(restore, pages.columns) if name not in new] + ["host", "path", "rule", verdict])
