"""Reports over events, periods and time limits."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from ..operators import periods, reports
from ..sources.readers import read_table
from . import views
from .registry import query, rounded

NOW = datetime(2024, 1, 20, 12, 0, tzinfo=timezone.utc)


def _events(spark, sf):
    return read_table(spark, sf, "events")


# ---------------------------------------------------------------- reports


@query(
    """
    SELECT event_type AS kind, count(*) AS "eventCount", count(DISTINCT user_id) AS "activeUsers", round(sum(value), 4) AS "eventValue"
    FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-26' AND event_type <> 'error' AND value >= 1.5 GROUP BY event_type
    """
)
def report(spark, sf):
    out = reports.report(
        _events(spark, sf),
        [("event_type", "kind")],
        ["eventCount", "activeUsers", "eventValue"],
        date_column="ts",
        start="2024-01-05",
        end="2024-01-25",
        filters="event_type!=error; ;value>=1.5",
    )
    return rounded(out, "eventValue", places=4)


@query(
    """
    SELECT user_id, count(*) AS events, round(sum(value), 4) AS total FROM events
    GROUP BY user_id ORDER BY events DESC, user_id LIMIT 40
    """
)
def report_ranked(spark, sf):
    out = reports.report_ranked(_events(spark, sf), "user_id", {"events": "count:*", "total": "sum:value"}, limit=40)
    return rounded(out, "total", places=4)


@query(
    """
    SELECT event_id, user_id, event_type, value FROM events
    WHERE contains(event_type, 'i') AND NOT contains(props, '"k": 7') AND regexp_matches(event_type, '^(view|click|signup)$')
      AND NOT regexp_matches(props, '[02]}$') AND user_id > 3 AND value <= 40.5
    """
)
def report_filter(spark, sf):
    rows = reports.report_filter(
        _events(spark, sf), 'event_type=@i;props!@"k": 7;event_type=~^(view|click|signup)$;props!~[02]}$;user_id>3;value<=40.5'
    )
    return rows.select("event_id", "user_id", "event_type", "value")


@query(
    "SELECT event_id, event_type, value FROM events WHERE value > 5 AND (event_type = 'purchase' OR event_type = 'signup' OR (user_id = 7 AND value < 20))"
)
def report_filter_tree(spark, sf):
    tree = {"and": ["value>5", {"or": ["event_type==purchase", "event_type==signup", {"and": ["user_id==7", "value<20"]}]}]}
    return reports.report_filter(_events(spark, sf), tree).select("event_id", "event_type", "value")


@query(
    """
    SELECT page_id, url FROM pages WHERE contains(url, 'https://') AND NOT contains(url, 'blog')
      AND regexp_matches(url, '/(en|fr)/') AND NOT regexp_matches(url, 'utm_source') AND url <> 'https://m.ththth.example.net/en/25#top'
    """
)
def search_filter(spark, sf):
    specs = [
        "url:contains:https://", "url:notContains:blog", "url:includingRegex:/(en|fr)/", "url:excludingRegex:utm_source",
        "url:notEquals:https://m.ththth.example.net/en/25#top",
    ]
    return reports.search_filter(read_table(spark, sf, "pages"), specs).select("page_id", "url")


@query(
    """
    SELECT event_id, user_id FROM events WHERE value > 10 AND event_type = 'click'
      AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)
      AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')
    """
)
def segment_filter(spark, sf):
    rows = reports.segment_filter(
        _events(spark, sf),
        ["value > 10", F.col("event_type") == "click"],
        visitor_segments=["event_type = 'purchase' AND value > 60", "event_type = 'signup'"],
    )
    return rows.select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE ts >= '2024-01-10' AND ts < '2024-01-13'")
def date_range(spark, sf):
    return reports.date_range(_events(spark, sf), "ts", "2024-01-10", "2024-01-12").select("event_id")


@query(
    """
    SELECT user_id, count(*) AS events FROM events WHERE event_type = 'view' AND props = '{"k": 6}'
    GROUP BY user_id ORDER BY events DESC, user_id
    """
)
def breakdown(spark, sf):
    return reports.breakdown(_events(spark, sf), {"event_type": "view", "props": '{"k": 6}'}, "user_id", {"events": "count:*"})


@query(
    """
    SELECT event_type, user_id, events, item_rank FROM (
      SELECT event_type, user_id, count(*) AS events,
             row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS item_rank
      FROM events GROUP BY event_type, user_id)
    WHERE item_rank <= 5
    """
)
def breakdown_all(spark, sf):
    return reports.breakdown_all(_events(spark, sf), "event_type", "user_id", {"events": "count:*"}, per_parent=5)


@query(
    """
    SELECT query, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions,
           round(sum(clicks) / sum(impressions), 6) AS ctr, round(sum(position * impressions) / sum(impressions), 6) AS position,
           regexp_extract(page, '^https://[^/]*([^?#]*)', 1) AS page
    FROM search_rows WHERE contains(page, 'Brand#1') GROUP BY query, page
    ORDER BY clicks DESC, query, search_rows.page LIMIT 200
    """,
    "search_rows",
)
def search_report(spark, sf):
    rows = views.search_rows(spark, sf)
    out = reports.search_report(rows, ["query", "page"], filters=["page:contains:Brand#1"], limit=200)
    return rounded(out, "ctr", "position")


@query(
    """
    SELECT coalesce(site, '') AS site_name, TRY_CAST(month_text AS DOUBLE) AS visits, item AS "itemId" FROM (
      SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS site, o_orderkey AS item,
             CASE o_orderstatus WHEN 'F' THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS month_text FROM orders)
    """
)
def shape_report(spark, sf):
    raw = read_table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS `variables/eVar_5`",
        "CASE o_orderstatus WHEN 'F' THEN 'n/a' ELSE CAST(o_custkey AS STRING) END AS `metrics/Visits`",
        "o_orderkey AS itemId",
        "o_totalprice AS unused",
    )
    return reports.shape_report(raw, ("variables/evar5", "site_name"), [("metrics/visits", "visits"), "absent"])


@query("SELECT event_type, CAST(NULL AS VARCHAR) AS region, event_id, CAST(NULL AS DOUBLE) AS revenue FROM events")
def ensure_columns(spark, sf):
    wanted = {"event_type": "string", "region": "string", "event_id": "bigint", "revenue": "double"}
    return reports.ensure_columns(_events(spark, sf), wanted)


def _per_user(spark, sf, kind):
    rows = _events(spark, sf).filter(F.col("event_type") == kind)
    user = F.when(F.col("user_id") % 50 != 0, F.col("user_id"))
    return rows.groupBy(user.alias("user_id")).agg(F.count("*").alias(kind + "s"))


_PER_USER = """
    WITH e AS (SELECT CASE WHEN user_id % 50 <> 0 THEN user_id END AS user_id, event_type FROM events),
    v AS (SELECT user_id, count(*) AS views FROM e WHERE event_type = 'view' GROUP BY user_id),
    p AS (SELECT user_id, count(*) AS purchases FROM e WHERE event_type = 'purchase' GROUP BY user_id),
    s AS (SELECT user_id, count(*) AS signups FROM e WHERE event_type = 'signup' GROUP BY user_id)
"""


@query(
    _PER_USER
    + """
    SELECT v.user_id, views, coalesce(purchases, 0) AS purchases, signups
    FROM v LEFT JOIN p ON v.user_id IS NOT DISTINCT FROM p.user_id LEFT JOIN s ON v.user_id IS NOT DISTINCT FROM s.user_id
    """
)
def merge_reports(spark, sf):
    frames = [_per_user(spark, sf, "view"), _per_user(spark, sf, "purchase"), None, _per_user(spark, sf, "signup")]
    return reports.merge_reports(frames, "user_id", int_cols=["purchases", "absent"])


@query(
    _PER_USER
    + """
    , u AS (SELECT user_id FROM v UNION SELECT user_id FROM p UNION SELECT user_id FROM s)
    SELECT coalesce(u.user_id, -1) AS user_id, coalesce(views, -1) AS views, coalesce(purchases, -1) AS purchases, coalesce(signups, -1) AS signups
    FROM u LEFT JOIN v ON u.user_id IS NOT DISTINCT FROM v.user_id LEFT JOIN p ON u.user_id IS NOT DISTINCT FROM p.user_id
    LEFT JOIN s ON u.user_id IS NOT DISTINCT FROM s.user_id
    """
)
def outer_merge_reports(spark, sf):
    frames = [_per_user(spark, sf, kind) for kind in ("view", "purchase", "signup")]
    return reports.outer_merge_reports(frames, ["user_id"], fill=-1)


@query(
    """
    SELECT p_partkey AS id, p_name AS name FROM part
    WHERE regexp_matches(p_name, 'ring$') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)
    ORDER BY id LIMIT 30
    """
)
def resource_filter(spark, sf):
    items = read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    ids = read_table(spark, sf, "lineitem").filter("l_quantity > 49").select("l_partkey")
    return reports.resource_filter(items, name_regex="ring$", ids=ids, max_items=30)


@query(
    """
    SELECT o_orderkey AS id, o_orderpriority AS name, CAST(o_custkey AS VARCHAR) AS owner, o_orderstatus AS status,
           CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS updated
    FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderstatus IN ('F', 'P')
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 60
    """
)
def template_search(spark, sf):
    rows = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_custkey").cast("string").alias("owner"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("date").cast("string").alias("updated"),
    )
    return reports.template_search(rows, name_contains=" Urgent", status=["f", "p"], limit=60)


# ---------------------------------------------------------------- months and periods

_YM = """
    SELECT *, CASE WHEN month_text = 'bad' THEN NULL ELSE make_date(
        CAST(substr(month_text, 1, 4) AS BIGINT),
        CAST(regexp_extract(month_text, '^[0-9]{4}[/年]?([0-9]{1,2})', 1) AS BIGINT), 1) END AS ym FROM month_rows
"""


@query(f"SELECT o_orderkey, month_text, CAST(ym AS VARCHAR) AS month FROM ({_YM})", "month_rows")
def with_month(spark, sf):
    rows = views.month_rows(spark, sf).drop("o_totalprice")
    return periods.with_month(rows, "month_text").withColumn("month", F.col("month").cast("string"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def month_key(spark, sf):
    rows = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return periods.month_key(rows, "o_orderdate", fmt="yyyy-MM").drop("o_orderdate")


@query(f"SELECT o_orderkey, month_text FROM ({_YM}) WHERE ym IS NULL OR ym <> DATE '2001-05-01'", "month_rows")
def drop_current_month(spark, sf):
    rows = views.month_rows(spark, sf).drop("o_totalprice")
    return periods.drop_current_month(rows, "month_text", reference=date(2001, 5, 20))


@query(
    f"SELECT o_orderkey, month_text FROM ({_YM}) WHERE ym >= (SELECT max(ym) - INTERVAL 5 MONTH FROM ({_YM}))",
    "month_rows",
)
def recent_months(spark, sf):
    return periods.recent_months(views.month_rows(spark, sf).drop("o_totalprice"), "month_text", 6)


@query(
    """
    WITH m AS (SELECT strftime(o_orderdate, '%Y%m') AS month, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders),
    p AS (SELECT '2000' AS period, month, price FROM m WHERE month LIKE '2000%'
      UNION ALL SELECT '2001', month, price FROM m WHERE month LIKE '2001%'
      UNION ALL SELECT '1999Q3', month, price FROM m WHERE month IN ('199907', '199908', '199909')
      UNION ALL SELECT '200103', month, price FROM m WHERE month = '200103')
    SELECT period, CAST(sum(price) AS BIGINT) AS price, count(*) AS orders FROM p GROUP BY period
    """
)
def period_rollup(spark, sf):
    rows = read_table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyyMM").alias("month"), F.floor("o_totalprice").alias("price"), F.lit(1).alias("orders")
    )
    return periods.period_rollup(rows, "month", ["price", "orders"], "2000,this-year,1999q3,2", date(2001, 5, 20))


@query(
    """
    WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate + INTERVAL 75 DAY AS DATE) AS b FROM orders),
    m AS (SELECT o_orderkey, a, b, unnest(generate_series(date_trunc('month', a), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS s FROM r)
    SELECT o_orderkey, strftime(s, '%Y%m') AS month, CAST(greatest(CAST(s AS DATE), a) AS VARCHAR) AS range_start,
           CAST(least(last_day(s), b) AS VARCHAR) AS range_end FROM m
    """
)
def month_ranges(spark, sf):
    rows = read_table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("a"), F.date_add(F.col("o_orderdate").cast("date"), 75).alias("b")
    )
    out = periods.month_ranges(rows, "a", "b").drop("a", "b")
    return out.withColumns({c: F.col(c).cast("string") for c in ("range_start", "range_end")})


# ---------------------------------------------------------------- time limits


@query("SELECT event_id, strftime(time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 60 MINUTE, '%Y-%m-%d %H:%M:%S') AS available_at FROM events")
def reflection_time(spark, sf):
    rows = periods.with_reflection_time(_events(spark, sf).select("event_id", "ts"))
    return rows.select("event_id", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("available_at"))


@query(
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN false
      ELSE TIMESTAMP '2024-01-20 12:00:00' - (CASE WHEN event_type = 'view' THEN ts ELSE ts - INTERVAL 9 HOUR END) <= INTERVAL 240 HOUR END AS is_fresh
    FROM events
    """
)
def freshness(spark, sf):
    """Views carry an offset in the named field, errors are unreadable, the rest has a naive fallback time."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = _events(spark, sf).select(
        "event_id",
        F.when(F.col("event_type") == "view", F.concat(stamp, F.lit("Z"))).when(F.col("event_type") == "error", "soon").otherwise("").alias("checked_at"),
        stamp.alias("fetched_at"),
    )
    return periods.with_freshness(rows, 240, now=NOW, field="checked_at").select("event_id", "is_fresh")


@query(
    """
    SELECT event_id, event_type AS status, CAST(datediff('second', TIMESTAMP '1970-01-01', TIMESTAMP '2024-01-20 12:00:00')
             - datediff('second', TIMESTAMP '1970-01-01', due) AS BIGINT) // 60 AS overdue_minutes
    FROM (SELECT event_id, 'pending' AS event_type, date_trunc('second', ts) - INTERVAL 9 HOUR AS due FROM events WHERE event_type = 'click')
    WHERE due < TIMESTAMP '2024-01-20 12:00:00'
    """
)
def overdue(spark, sf):
    rows = _events(spark, sf).select(
        "event_id",
        F.when(F.col("event_type") == "click", "pending").otherwise("done").alias("status"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("due_at"),
    )
    return periods.overdue(rows, now=NOW).drop("due_at")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date FROM orders")
def to_datetime_col(spark, sf):
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = periods.to_datetime_col(read_table(spark, sf, "orders").select("o_orderkey", day.alias("date")))
    return rows.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
