"""Result chain, search tables, channels and number text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import chain, channels, numbers, search
from ..sources.readers import read_table, rule_table
from . import views
from .registry import query, rounded

# SQL texts of URL parts, written for RE2.
_DECODED = "url_decode(regexp_replace({c}, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|.?$)', '%25\\1', 'g'))"
_PATH = "regexp_replace(regexp_extract({c}, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)', 3), ';[^/]*$', '')"


def decoded(column: str) -> str:
    return _DECODED.format(c=column)


def path_of(column: str) -> str:
    return _PATH.format(c=column)


PAGE = f"lower(split_part(split_part({decoded('page')}, '?', 1), '#', 1))"


# ---------------------------------------------------------------- transforms


@query(
    "SELECT page_id, CASE WHEN regexp_full_match(day_text, '[0-9]{8}') THEN substr(day_text, 1, 4) || '-' || "
    "substr(day_text, 5, 2) || '-' || substr(day_text, 7, 2) ELSE day_text END AS day_text FROM url_rows",
    "url_rows",
)
def date_format(spark, sf):
    return chain.transform(views.url_rows(spark, sf).select("page_id", "day_text"), "day_text:date_format")


@query(f"SELECT page_id, {decoded('dirty_url')} AS dirty_url FROM url_rows", "url_rows")
def url_decode(spark, sf):
    return chain.transform(views.url_rows(spark, sf).select("page_id", "dirty_url"), "dirty_url:url_decode")


@query(
    f"SELECT page_id, CASE WHEN {path_of('dirty_url')} = '' THEN dirty_url ELSE {path_of('dirty_url')} END AS dirty_url FROM url_rows",
    "url_rows",
)
def path_only(spark, sf):
    return chain.transform(views.url_rows(spark, sf).select("page_id", "dirty_url"), "dirty_url:path_only")


@query("SELECT page_id, regexp_replace(dirty_url, '[?#].*$', '') AS dirty_url FROM url_rows", "url_rows")
def strip_qs(spark, sf):
    return chain.transform(views.url_rows(spark, sf).select("page_id", "dirty_url"), "dirty_url:strip_qs")


@query(
    """
    WITH items AS (
      SELECT page_id, unnest(str_split(regexp_extract(dirty_url, '^[^?#]*[?]([^#]*)', 1), '&')) AS item,
             generate_subscripts(str_split(regexp_extract(dirty_url, '^[^?#]*[?]([^#]*)', 1), '&'), 1) AS i
      FROM url_rows),
    named AS (
      SELECT page_id, i, split_part(item, '=', 1) AS name,
             url_decode(replace(CASE WHEN item LIKE '%=%' THEN substr(item, instr(item, '=') + 1) ELSE '' END, '+', ' ')) AS value
      FROM items WHERE item <> ''),
    kept AS (
      SELECT page_id, i, name, value, min(i) OVER (PARTITION BY page_id, name) AS first
      FROM named WHERE name IN ('id', 'x')),
    rebuilt AS (
      SELECT page_id, string_agg(name || '=' || replace(url_encode(value), '%20', '+'), '&' ORDER BY first, i) AS qs
      FROM kept GROUP BY page_id)
    SELECT u.page_id, regexp_extract(dirty_url, '^[^?#]*') || coalesce('?' || qs, '')
           || regexp_extract(dirty_url, '^[^#]*(#.+)$', 1) AS dirty_url
    FROM url_rows u LEFT JOIN rebuilt r ON u.page_id = r.page_id
    """,
    "url_rows",
)
def keep_qs(spark, sf):
    return chain.transform(views.url_rows(spark, sf).select("page_id", "dirty_url"), "dirty_url:strip_qs:id,x")


@query(f"SELECT page_id, {PAGE.replace('page', 'dirty_url', 1)} AS page FROM url_rows", "url_rows")
def normalize_page(spark, sf):
    return views.url_rows(spark, sf).select("page_id", urls.normalize_page("dirty_url").alias("page"))


@query(f"SELECT page_id, {path_of('dirty_url')} AS page FROM url_rows", "url_rows")
def page_to_path(spark, sf):
    rows = views.url_rows(spark, sf).select("page_id", F.col("dirty_url").alias("page"))
    return search.page_paths(rows)


# ---------------------------------------------------------------- result chain


@query("SELECT event_id, event_type, value, props FROM events WHERE event_type IN ('purchase', 'click') AND value > 20")
def where_rows(spark, sf):
    rows = read_table(spark, sf, "events").select("event_id", "event_type", "value", "props")
    return chain.where(rows, "event_type IN ('purchase', 'click') AND value > 20")


@query("SELECT event_type, event_id FROM events")
def select_columns(spark, sf):
    return chain.select_columns(read_table(spark, sf, "events"), "event_type, event_id")


@query("SELECT event_id AS id, event_type AS kind, value FROM events")
def alias_fields(spark, sf):
    return chain.alias_fields(read_table(spark, sf, "events"), [("event_id", "id"), ("event_type", "kind"), "value"])


@query(
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS sum_l_quantity, round(avg(l_extendedprice), 6) AS mean_l_extendedprice,
           count(l_discount) AS count_l_discount, min(l_tax) AS min_l_tax, max(l_extendedprice) AS max_l_extendedprice
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """
)
def group_aggregate(spark, sf):
    out = chain.group_aggregate(
        read_table(spark, sf, "lineitem"),
        "l_returnflag,l_linestatus",
        "sum:l_quantity,mean:l_extendedprice,count:l_discount,min:l_tax,max:l_extendedprice",
    )
    return rounded(out, "sum_l_quantity", "mean_l_extendedprice")


@query(
    """
    SELECT l_returnflag, count(l_orderkey) AS count_l_orderkey, round(median(l_extendedprice), 6) AS median_l_extendedprice,
           round(median(l_quantity), 6) AS median_l_quantity
    FROM lineitem GROUP BY l_returnflag
    """
)
def group_median(spark, sf):
    out = chain.group_aggregate(
        read_table(spark, sf, "lineitem"), "l_returnflag", "count:l_orderkey,median:l_extendedprice,median:l_quantity"
    )
    return rounded(out, "median_l_extendedprice", "median_l_quantity")


@query(
    """
    SELECT month_text, CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)), 0) AS BIGINT) AS total
    FROM month_rows WHERE month_text IS NOT NULL GROUP BY month_text
    """,
    "month_rows",
)
def group_sum(spark, sf):
    rows = views.month_rows(spark, sf).select("month_text", F.floor("o_totalprice").alias("total"))
    return chain.to_int(chain.group_sum(rows, ["month_text"], ["total"], min_count=1), ["total"])


@query(
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC NULLS LAST, o_custkey NULLS LAST, o_orderkey NULLS LAST LIMIT 50
    """
)
def sorted_head(spark, sf):
    rows = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return chain.head(chain.sort(rows, "o_totalprice DESC,o_custkey"), 50)


@query(
    """
    SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total_rows FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20
    """
)
def head_with_total(spark, sf):
    rows = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return chain.head_with_total(chain.sort(rows, "o_totalprice DESC"), 20)


@query(
    f"""
    SELECT page, sum_clicks, mean_position FROM (
      SELECT CASE WHEN {path_of('page')} = '' THEN page ELSE {path_of('page')} END AS page,
             CAST(sum(clicks) AS BIGINT) AS sum_clicks, round(avg(position), 6) AS mean_position
      FROM search_rows WHERE impressions > 5 GROUP BY 1)
    ORDER BY sum_clicks DESC, page LIMIT 25
    """,
    "search_rows",
)
def result_chain(spark, sf):
    out = chain.result_chain(
        views.search_rows(spark, sf),
        transforms="page:path_only",
        predicate="impressions > 5",
        group_by="page",
        aggregate="sum:clicks,mean:position",
        order="sum_clicks DESC,page",
        columns="page,sum_clicks,mean_position",
        rows=25,
    )
    return rounded(out, "mean_position")


# ---------------------------------------------------------------- search


_AGGREGATED = f"""
    SELECT site, month, {PAGE} AS page, query, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks,
           round(CASE WHEN sum(impressions) > 0 THEN sum(position * impressions) / sum(impressions) ELSE 0 END, 6) AS position
    FROM search_rows GROUP BY ALL
"""


@query(_AGGREGATED, "search_rows")
def search_aggregate(spark, sf):
    return rounded(search.search_aggregate(views.search_rows(spark, sf)), "position")


@query(f"SELECT * FROM ({_AGGREGATED}) ORDER BY clicks DESC, site, month, page, query LIMIT 100", "search_rows")
def search_top_pages(spark, sf):
    """Flagship: aggregated search rows, most clicks first."""
    out = rounded(search.search_aggregate(views.search_rows(spark, sf)), "position")
    return chain.head(chain.sort(out, "clicks DESC,site,month,page,query"), 100)


@query(
    """
    WITH keyed AS (SELECT *, regexp_replace(query, '[\\s\\x{3000}]+', '', 'g') AS query_key FROM search_rows),
    spelling AS (
      SELECT month, site, page, query_key, query FROM keyed
      QUALIFY row_number() OVER (PARTITION BY month, site, page, query_key ORDER BY impressions DESC, query) = 1),
    totals AS (
      SELECT month, site, page, query_key, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks,
             round(CASE WHEN sum(impressions) > 0 THEN sum(position * impressions) / sum(impressions) ELSE 0 END, 6) AS position
      FROM keyed GROUP BY ALL)
    SELECT month, site, query, page, impressions, clicks, position
    FROM totals JOIN spelling USING (month, site, page, query_key)
    """,
    "search_rows",
)
def merge_query_variants(spark, sf):
    return rounded(search.merge_query_variants(views.search_rows(spark, sf)), "position")


_RULES = [("site0 ", 20.0, 5.0), ("site1", None, 4.0), ("site1", 30.0, 50.0), ("", 1.0, 1.0), ("site3", 45.0, None)]


@query(
    """
    WITH rules(site_rule, low, far) AS (VALUES ('site0', 20.0, 5.0), ('site1', 10.0, 4.0), ('site1', 30.0, 50.0), ('site3', 45.0, 50.0))
    SELECT s.* FROM search_rows s JOIN rules ON s.site = site_rule
    WHERE NOT (clicks = 0 AND (impressions < low OR position > far))
    """,
    "search_rows",
)
def threshold_filter(spark, sf):
    rules = rule_table(spark, _RULES, "site string, min_impressions double, max_position double")
    return search.threshold_filter(views.search_rows(spark, sf), rules)


@query("SELECT site, page, clicks FROM search_rows", "search_rows")
def clicks_order(spark, sf):
    return search.clicks_order(views.search_rows(spark, sf).select("site", "page", "clicks"))


@query(
    "SELECT page_id, CASE WHEN regexp_full_match(query, '[0-9]+') THEN '''' || query ELSE query END AS query FROM "
    "(SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) ELSE url END AS query FROM pages)"
)
def force_text(spark, sf):
    rows = read_table(spark, sf, "pages").selectExpr(
        "page_id", "CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS STRING) ELSE url END AS query"
    )
    return search.force_text_column(rows)


_SITES = [("https://site.example.com/0", "zero"), ("https://site.example.com/1/", "one"), ("", "none"), ("sc-domain:site3", "three")]


def _site_facts(spark, sf):
    return views.search_rows(spark, sf).selectExpr(
        "CASE site WHEN 'site0' THEN 'https://site.example.com/0/' WHEN 'site1' THEN 'https://site.example.com/1'"
        " WHEN 'site3' THEN 'sc-domain:site3' ELSE 'sc-domain:site2/' END AS url",
        "query", "impressions", "clicks", "position",
    )


@query(
    """
    SELECT query, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks,
           round(CASE WHEN sum(impressions) > 0 THEN sum(position * impressions) / sum(impressions) ELSE 0 END, 6) AS position,
           CASE site WHEN 'site0' THEN 'zero' WHEN 'site1' THEN 'one' ELSE 'three' END AS label, '202605' AS batch
    FROM search_rows WHERE site IN ('site0', 'site1', 'site3') GROUP BY query, site
    """,
    "search_rows",
)
def union_sites(spark, sf):
    sites = rule_table(spark, _SITES, "url string, label string")
    out = search.union_sites(_site_facts(spark, sf), sites, label_col="label", constants={"batch": "202605"})
    return rounded(out, "position")


@query(
    """
    WITH facts AS (
      SELECT CASE site WHEN 'site0' THEN 'https://site.example.com/0/' WHEN 'site1' THEN 'https://site.example.com/1'
             WHEN 'site3' THEN 'sc-domain:site3' ELSE 'sc-domain:site2/' END AS url, clicks FROM search_rows),
    sites(key, label) AS (VALUES ('https://site.example.com/0', 'zero'), ('https://site.example.com/1', 'one'), ('sc-domain:site3', 'three'), ('sc-domain:site2', 'two'))
    SELECT label, CAST(sum(clicks) AS BIGINT) AS clicks FROM facts
    JOIN sites ON CASE WHEN url LIKE 'http%' THEN rtrim(url, '/') ELSE url END = key GROUP BY label
    """,
    "search_rows",
)
def site_key_join(spark, sf):
    sites = rule_table(spark, [*_SITES, ("sc-domain:site2", "two")], "site_url string, label string")
    keyed = sites.select(urls.site_key("site_url").alias("site_key"), "label")
    spelled = keyed.select("site_key", F.explode(urls.site_spellings("site_key")).alias("url")).distinct()
    totals = _site_facts(spark, sf).join(spelled, "url").groupBy("site_key").agg(F.sum("clicks").alias("clicks"))
    return totals.join(keyed, "site_key").select("label", "clicks")


# ---------------------------------------------------------------- channels

_SRC = "replace(lower(source), 'www.', '')"
_PRIVATE = (
    "regexp_matches(lower({c}), '^([a-z][a-z0-9+.-]*://)?(localhost|127[.][0-9.]+|10[.][0-9.]+|192[.]168[.][0-9.]+"
    "|172[.](1[6-9]|2[0-9]|3[01])[.][0-9.]+|[[]::1[]])(:[0-9]+)?([/?#]|$)')"
)


@query(
    f"""
    SELECT event_id, source, medium, CASE
      WHEN {_PRIVATE.format(c=_SRC)} THEN 'Direct'
      WHEN regexp_matches({_SRC} || '|' || lower(medium), 'bard|chatgpt|claude|copilot|gemini|perplexity') THEN 'AI'
      WHEN lower(medium) = 'map' OR regexp_matches({_SRC}, '(^|[.])maps?[.]') THEN 'Map'
      WHEN channel = 'Referral' AND regexp_matches({_SRC}, 'search|docomo[.]ne[.]jp|[.]jword[.]jp|jp[.]hao123[.]com') THEN 'Organic Search'
      WHEN channel = 'Referral' AND contains({_SRC}, 'threads') THEN 'Organic Social'
      WHEN channel = 'Referral' AND contains({_SRC}, 'group.example') THEN 'Group'
      ELSE channel END AS channel
    FROM traffic_rows
    """,
    "traffic_rows",
)
def classify_channel(spark, sf):
    return channels.classify_channel(views.traffic_rows(spark, sf), group_domains=["group.example"])


@query(
    f"""
    WITH s AS (SELECT *, {_SRC} AS src, lower(medium) AS med FROM traffic_rows)
    SELECT event_id, medium, CASE
      WHEN regexp_matches(src, 'chatgpt|chat[.]openai[.]com') THEN 'ChatGPT'
      WHEN regexp_matches(src, 'copilot|bing[.]com') THEN 'Copilot'
      WHEN regexp_matches(src, 'gemini|bard|aistudio[.]google[.]com|makersuite[.]google[.]com') THEN 'Gemini'
      WHEN regexp_matches(src, 'claude|anthropic[.]com') THEN 'Claude'
      WHEN regexp_matches(src, 'perplexity|pplx[.]ai') THEN 'Perplexity'
      WHEN regexp_matches(src, 'office[.]net|sharepoint|teams|yammer') THEN src
      WHEN regexp_matches(src, 'service[.]smt[.]docomo[.]ne[.]jp|search|jp[.]hao123[.]com|[.]jword[.]jp') THEN src
      WHEN regexp_matches(src, 't[.]co|twitter') THEN 'Twitter' WHEN contains(src, 'instagram') THEN 'Instagram'
      WHEN contains(src, 'facebook') THEN 'Facebook' WHEN contains(src, 'threads') THEN 'Threads' WHEN contains(src, 'tiktok') THEN 'TikTok'
      ELSE source END AS source,
      CASE
      WHEN regexp_matches(src, 'chatgpt|chat[.]openai[.]com|copilot|bing[.]com|gemini|bard|aistudio[.]google[.]com|makersuite[.]google[.]com|claude|anthropic[.]com|perplexity|pplx[.]ai') THEN 'AI'
      WHEN regexp_matches(src, 'office[.]net|sharepoint|teams|yammer') THEN 'Internal'
      WHEN regexp_matches(src, 'service[.]smt[.]docomo[.]ne[.]jp|search|jp[.]hao123[.]com|[.]jword[.]jp') THEN 'Organic Search'
      WHEN regexp_matches(src, 't[.]co|twitter|instagram|facebook|threads|tiktok') THEN 'Organic Social'
      ELSE channel END AS channel
    FROM s
    """,
    "traffic_rows",
)
def reclassify_source_channel(spark, sf):
    return channels.reclassify_source_channel(views.traffic_rows(spark, sf))


_PAGE_RULES = [(r"/fr/\d+", "french"), (r"\.html$", "file"), (r"^http://", "plain")]


@query(
    "SELECT page_id, url, CASE WHEN regexp_matches(url, '/fr/[0-9]+') THEN 'french' WHEN regexp_matches(url, '[.]html$') THEN 'file' "
    "WHEN url LIKE 'http://%' THEN 'plain' ELSE url END AS label FROM pages"
)
def pattern_map(spark, sf):
    return channels.pattern_map(read_table(spark, sf, "pages").select("page_id", "url"), "url", _PAGE_RULES, output="label")


@query(
    "SELECT event_id, CASE WHEN n > 0 AND n <= 90 THEN 'k' || n ELSE 'none' END AS label FROM "
    "(SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS n FROM events)"
)
def pattern_map_long(spark, sf):
    """A long rule list, classified once per distinct value."""
    rules = [(rf"\b{n}\b", f"k{n}") for n in range(1, 91)]
    rows = read_table(spark, sf, "events").select("event_id", "props")
    return channels.pattern_map_distinct(rows, "props", rules, output="label", default="none").drop("props")


@query(
    "SELECT page_id, CASE WHEN regexp_matches(url, '/fr/[0-9]+') THEN 'french' WHEN regexp_matches(url, '[.]html$') THEN 'file' "
    "WHEN url LIKE 'http://%' THEN 'plain' ELSE 'other' END AS category FROM pages"
)
def classify_by_pattern(spark, sf):
    return channels.classify_by_pattern(read_table(spark, sf, "pages"), _PAGE_RULES, "url").select("page_id", "category")


@query(
    "SELECT event_id, CASE WHEN contains(lower(source), 'google') THEN 'google' WHEN regexp_matches(lower(source), '^t[.]co$') THEN 'twitter' "
    "ELSE source END AS source FROM traffic_rows",
    "traffic_rows",
)
def normalize_source(spark, sf):
    rows = views.traffic_rows(spark, sf).select("event_id", "source")
    return channels.normalize_source(rows, {r"google": "google", r"^t\.co$": "twitter"})


@query(
    f"""
    SELECT event_id, source, regexp_extract(lower(source), '^([a-z][a-z0-9+.-]*://)?(www[.])?([^/?#]*)', 3) AS domain,
           {_PRIVATE.format(c='source')} AS is_private FROM traffic_rows
    """,
    "traffic_rows",
)
def source_columns(spark, sf):
    return channels.source_columns(views.traffic_rows(spark, sf).select("event_id", "source"))


@query(
    f"""
    SELECT page_id, CASE WHEN path = '' OR (path NOT LIKE '%/' AND NOT regexp_matches(path, '(^|/)[^/]*[.][^/.]+$')) THEN path || '/' ELSE path END AS path
    FROM (SELECT page_id, {path_of('url')} AS path FROM pages)
    """
)
def trailing_slash(spark, sf):
    rows = read_table(spark, sf, "pages").select("page_id", urls.page_to_path("url").alias("path"))
    return channels.trailing_slashes(rows, "path")


@query(
    """
    SELECT p_partkey, rule_order, pattern, label FROM (
      SELECT p_partkey, 0 AS rule_order, '^/' || p_type AS pattern, p_brand AS label FROM part
      UNION ALL SELECT p_partkey, 1, '^/x', 'x' FROM part
      UNION ALL SELECT p_partkey, 2, '__default__', p_name FROM part)
    """
)
def regex_table_rules(spark, sf):
    """Rules of one regex-table document per part; the entry without output is no rule."""
    docs = read_table(spark, sf, "part").selectExpr(
        "p_partkey",
        "concat('{\"parameter\":[{\"key\":\"map\",\"type\":\"LIST\",\"list\":[{\"map\":[{\"key\":\"key\",\"value\":\"^/', p_type,"
        " '\"},{\"key\":\"value\",\"value\":\"', p_brand, '\"}]},{\"map\":[{\"key\":\"key\",\"value\":\"^/y\"}]},"
        "{\"map\":[{\"key\":\"key\",\"value\":\"^/x\"},{\"key\":\"value\",\"value\":\"x\"}]}]},"
        "{\"key\":\"defaultValue\",\"value\":\" ', p_name, ' \"}]}') AS doc",
    )
    return channels.regex_table_rules(docs, "doc").drop("doc")


@query(
    """
    SELECT p_partkey, 0 AS rule_order, p_type AS pattern, p_brand AS label FROM part
    UNION ALL SELECT p_partkey, 1, p_name, 'site' FROM part
    """
)
def list_rules(spark, sf):
    docs = read_table(spark, sf, "part").selectExpr(
        "p_partkey",
        "concat('[{\"regex\":\" ', p_type, '\",\"output\":\"', p_brand, '\"},{\"key\":\"\",\"value\":\"v\"},{\"key\":\"\",\"pattern\":\"',"
        " p_name, '\",\"target\":\"later\",\"site\":\"site\"}]') AS doc",
    )
    return channels.list_rules(docs, "doc").drop("doc")


@query("SELECT 'url' AS column_name FROM pages HAVING bool_or(url LIKE 'http%')")
def url_columns(spark, sf):
    return channels.url_columns(read_table(spark, sf, "pages"))


# ---------------------------------------------------------------- number text


@query(
    """
    SELECT o_orderkey,
      TRY_CAST(replace(nullif(regexp_extract(amount_text, '[-+]?[0-9,]*[.]?[0-9]+'), ''), ',', '') AS DOUBLE) AS number,
      TRY_CAST(replace(nullif(regexp_extract(amount_text, '([0-9,]+)[ ]*円', 1), ''), ',', '') AS DOUBLE) AS money,
      TRY_CAST(nullif(regexp_extract(amount_text, '年[ ]*([0-9.]+)[ ]*[%％]', 1), '') AS DOUBLE) AS year_rate,
      TRY_CAST(replace(nullif(regexp_extract(amount_text, '([0-9,]+)[ ]*円[ ]*([0-9.]+)[ ]*[%％]', 1), ''), ',', '') AS DOUBLE) AS pair_amount,
      TRY_CAST(nullif(regexp_extract(amount_text, '([0-9,]+)[ ]*円[ ]*([0-9.]+)[ ]*[%％]', 2), '') AS DOUBLE) AS pair_rate
    FROM amount_rows
    """,
    "amount_rows",
)
def parse_amounts(spark, sf):
    return numbers.parse_amounts(views.amount_rows(spark, sf), "amount_text").drop("amount_text")


@query(
    "SELECT o_orderkey, TRY_CAST(regexp_replace(amount_text, '[¥￥$€£,%％ ]', '', 'g') AS DOUBLE) AS amount_text FROM amount_rows",
    "amount_rows",
)
def coerce_numeric(spark, sf):
    return numbers.coerce_numeric(views.amount_rows(spark, sf), ["amount_text", "absent"])


@query(
    "SELECT o_orderkey, CAST(coalesce(TRY_CAST(month_text AS DOUBLE), 0) AS BIGINT) AS month_text FROM month_rows",
    "month_rows",
)
def to_numeric_cols(spark, sf):
    rows = views.month_rows(spark, sf).select("o_orderkey", "month_text")
    return numbers.to_numeric_cols(rows, ["month_text", "absent"], fill=0, as_int=True)

