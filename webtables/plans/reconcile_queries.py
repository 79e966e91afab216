"""Site mapping, expected against actual, snapshots, profiles and keyed merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P, reconcile
from ..sources import readers, sinks
from ..sources.readers import read_table
from . import views
from .registry import query, rounded

# ---------------------------------------------------------------- site mapping

_RULES = [("^/2", "S2"), ("^/3", "S3 "), ("^/4", "S4"), ("^/9", "S9"), ("^/33", "S3"), ("__default__", "S0")]


def _rules(spark):
    return readers.rule_table(spark, _RULES, "pattern string, label string")


@query("SELECT coalesce(site, '') AS site, CAST(sum(sessions) AS BIGINT) AS sessions FROM site_rows GROUP BY 1", "site_rows")
def site_sessions(spark, sf):
    return reconcile.site_sessions(views.site_rows(spark, sf))


@query(
    "SELECT host, CAST(sum(sessions) AS BIGINT) AS sessions FROM site_rows WHERE coalesce(site, '') IN ('', '(not set)') GROUP BY host",
    "site_rows",
)
def unclassified_hosts(spark, sf):
    return reconcile.unclassified_hosts(views.site_rows(spark, sf))


@query(
    """
    SELECT host, path, CAST(sum(sessions) AS BIGINT) AS sessions FROM site_rows WHERE site = '(not set)'
    GROUP BY host, path ORDER BY sessions DESC, host, path LIMIT 20
    """,
    "site_rows",
)
def unclassified_pages(spark, sf):
    return reconcile.unclassified_pages(views.site_rows(spark, sf), limit=20)


def _second_tool(spark, sf):
    return read_table(spark, sf, "events").selectExpr(
        "CASE event_type WHEN 'view' THEN 'S3' WHEN 'click' THEN 'S7' WHEN 'error' THEN '(none)' WHEN 'signup' THEN NULL ELSE 'S9' END AS site",
        "value AS metric_value",
    )


_SECOND = """
    SELECT CASE event_type WHEN 'view' THEN 'S3' WHEN 'click' THEN 'S7' WHEN 'error' THEN '(none)' WHEN 'signup' THEN NULL ELSE 'S9' END AS site,
           value AS metric_value FROM events
"""


@query(f"SELECT coalesce(site, '') AS site, round(sum(metric_value), 4) AS metric_value FROM ({_SECOND}) GROUP BY 1")
def metric_by_site(spark, sf):
    return rounded(reconcile.metric_by_site(_second_tool(spark, sf)), "metric_value", places=4)


@query(
    f"""
    WITH tag(site) AS (VALUES ('S2'), ('S3'), ('S4'), ('S9')),
    first AS (SELECT DISTINCT site FROM site_rows WHERE site NOT IN ('', '(not set)')),
    second AS (SELECT DISTINCT site FROM ({_SECOND}) WHERE site NOT IN ('', '(none)'))
    SELECT 'in_tag_no_first' AS gap, site FROM tag WHERE site NOT IN (SELECT site FROM first)
    UNION ALL SELECT 'in_first_no_tag', site FROM first WHERE site NOT IN (SELECT site FROM tag)
    UNION ALL SELECT 'in_tag_no_second', site FROM tag WHERE site NOT IN (SELECT site FROM second)
    UNION ALL SELECT 'in_second_no_tag', site FROM second WHERE site NOT IN (SELECT site FROM tag)
    UNION ALL SELECT 'in_first_no_second', site FROM first WHERE site NOT IN (SELECT site FROM second)
    UNION ALL SELECT 'in_second_no_first', site FROM second WHERE site NOT IN (SELECT site FROM first)
    """,
    "site_rows",
)
def coverage_gaps(spark, sf):
    return reconcile.coverage_gaps(_rules(spark), views.site_rows(spark, sf), _second_tool(spark, sf))


@query(
    """
    SELECT CAST(sum(sessions) AS BIGINT) AS total_sessions,
           CAST(sum(CASE WHEN coalesce(site, '') IN ('', '(not set)') THEN sessions ELSE 0 END) AS BIGINT) AS unclassified_sessions,
           CAST(6 AS BIGINT) AS mapping_count, CAST(4 AS BIGINT) AS tag_site_count,
           count(DISTINCT CASE WHEN coalesce(site, '') NOT IN ('', '(not set)') THEN site END) AS site_count,
           round(sum(CASE WHEN coalesce(site, '') IN ('', '(not set)') THEN sessions ELSE 0 END) / sum(sessions) * 100, 1) AS unclassified_pct
    FROM site_rows
    """,
    "site_rows",
)
def coverage_totals(spark, sf):
    return reconcile.coverage_totals(_rules(spark), views.site_rows(spark, sf))


# ---------------------------------------------------------------- expected against actual


@query(
    "SELECT key, expected, coalesce(actual, '') AS actual, coalesce(actual, '') = expected AS match FROM expected_rows",
    "expected_rows",
)
def verify_expected(spark, sf):
    rows = views.expected_rows(spark, sf)
    return reconcile.verify_expected(rows, rows.filter("actual IS NOT NULL").select("key", "actual"))


_DOMINANT = """
    WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
    d AS (SELECT user_id, event_type FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1),
    e AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'view' ELSE 'click' END AS expected FROM customer),
    r AS (SELECT key, expected, coalesce(event_type, '') AS actual, CASE WHEN event_type IS NOT NULL THEN event_type = expected END AS match,
                 CASE WHEN event_type IS NULL THEN 'no_traffic' ELSE 'report' END AS source
          FROM e LEFT JOIN d ON key = user_id)
"""


def _verdicts(spark, sf):
    expected = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, "view").otherwise("click").alias("expected")
    )
    traffic = read_table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"))
    return reconcile.verify_dominant(expected, traffic)


@query(_DOMINANT + "SELECT * FROM r")
def verify_dominant(spark, sf):
    return _verdicts(spark, sf)


@query(
    _DOMINANT
    + "SELECT count(*) FILTER (WHERE match) AS ok, count(*) FILTER (WHERE NOT match) AS ng, count(*) FILTER (WHERE match IS NULL) AS skip FROM r"
)
def verify_summary(spark, sf):
    return reconcile.verify_summary(_verdicts(spark, sf))


# ---------------------------------------------------------------- snapshots


def _sides(spark, sf):
    rows = views.snapshot_rows(spark, sf)
    old = rows.filter("local_text IS NOT NULL").select("id", F.col("local_text").alias("text"), "path")
    new = rows.filter("remote_text IS NOT NULL").select("id", F.col("remote_text").alias("text"), "path")
    return old, new


_STATUS = """
    SELECT id, CASE WHEN local_text IS NULL THEN 'added' WHEN remote_text IS NULL THEN 'deleted'
      WHEN local_text = remote_text THEN 'unchanged' ELSE 'updated' END AS status
    FROM snapshot_rows WHERE local_text IS NOT NULL OR remote_text IS NOT NULL
"""


@query(_STATUS, "snapshot_rows")
def snapshot_diff(spark, sf):
    return reconcile.snapshot_diff(*_sides(spark, sf), "id", ["path", "text"])


@query(f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY status", "snapshot_rows")
def snapshot_counts(spark, sf):
    return reconcile.snapshot_counts(reconcile.snapshot_diff(*_sides(spark, sf), "id", ["path", "text"]))


def _versions(spark, sf):
    rows = views.snapshot_rows(spark, sf)
    return [rows.select("path", F.col(f"{n}_text").alias("text")).filter("text IS NOT NULL") for n in ("base", "local", "remote")]


_ACTIONS = """
    WITH a AS (SELECT path, base_text, local_text, remote_text, CASE
        WHEN remote_text IS NULL AND local_text IS NULL THEN 'unchanged'
        WHEN remote_text IS NULL AND local_text = base_text THEN 'delete'
        WHEN remote_text IS NULL THEN 'kept-local-removed'
        WHEN local_text IS NULL THEN 'add'
        WHEN local_text = remote_text THEN 'unchanged'
        WHEN base_text IS NULL THEN 'conflict'
        WHEN local_text = base_text THEN 'update'
        WHEN remote_text = base_text THEN 'keep-local'
        ELSE 'conflict' END AS action
      FROM snapshot_rows WHERE base_text IS NOT NULL OR local_text IS NOT NULL OR remote_text IS NOT NULL)
"""


@query(_ACTIONS + "SELECT path, action FROM a", "snapshot_rows")
def three_way_compare(spark, sf):
    return reconcile.compare_versions(*_versions(spark, sf))


@query(
    _ACTIONS
    + """
    SELECT path, CASE WHEN base_text IS NULL THEN 'missing_baseline' ELSE 'local_remote_changed' END AS kind,
           'sha256:' || sha256(base_text) AS base_hash, 'sha256:' || sha256(local_text) AS local_hash, 'sha256:' || sha256(remote_text) AS remote_hash,
           base_text, local_text, remote_text FROM a WHERE action = 'conflict'
    """,
    "snapshot_rows",
)
def conflict_records(spark, sf):
    return reconcile.conflicts(*_versions(spark, sf))


@query(
    """
    SELECT CAST(o_custkey AS VARCHAR) AS uuid, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS updated, o_orderkey, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    """
)
def latest_per_key(spark, sf):
    """Two overlapping result pages of the same requests, one record per request kept."""
    rows = read_table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("uuid"),
        F.col("o_orderdate").cast("date").cast("string").alias("updated"),
        "o_orderkey",
        "o_orderstatus",
    )
    return sinks.latest_per_key(sinks.concat([rows, rows.filter("o_orderstatus = 'F'")]), "uuid", "updated")


def _resources(spark, sf):
    return read_table(spark, sf, "part").selectExpr(
        "CASE p_type WHEN 'PROMO' THEN 'rules' ELSE 'data_elements' END AS type",
        "p_partkey AS id",
        "CASE p_type WHEN 'PROMO' THEN concat('rules/', p_partkey) ELSE concat('data-elements/', p_brand, '/', p_partkey, '.json') END AS path",
    )


_SCOPE = "SELECT DISTINCT 'rules' AS type, l_partkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT 'data_elements', l_partkey FROM lineitem WHERE l_tax > 0.07"
_RESOURCES = """
    SELECT CASE p_type WHEN 'PROMO' THEN 'rules' ELSE 'data_elements' END AS type, p_partkey AS id,
           CASE p_type WHEN 'PROMO' THEN concat('rules/', p_partkey) ELSE concat('data-elements/', p_brand, '/', p_partkey, '.json') END AS path FROM part
"""
_OUTSIDE = f"""
    WITH scope AS ({_SCOPE}), res AS ({_RESOURCES}),
    outside AS (SELECT * FROM res r WHERE NOT EXISTS (SELECT 1 FROM scope s WHERE s.type = r.type AND s.id = r.id)),
    files AS (
      SELECT path FROM res WHERE type <> 'rules' UNION ALL SELECT replace(path, '.json', '.custom.js') FROM res WHERE type <> 'rules'
      UNION ALL SELECT path || '/rule.json' FROM res WHERE type = 'rules' UNION ALL SELECT path || '/code/a.js' FROM res WHERE type = 'rules'
      UNION ALL SELECT 'settings/' || id || '.json' FROM res)
"""


def _scope(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    rules = lines.filter("l_quantity > 45").select(F.lit("rules").alias("type"), F.col("l_partkey").alias("id"))
    elements = lines.filter("l_tax > 0.07").select(F.lit("data_elements").alias("type"), F.col("l_partkey").alias("id"))
    return rules.unionByName(elements).distinct()


def _files(spark, sf):
    paths = "CASE type WHEN 'rules' THEN array(concat(path, '/rule.json'), concat(path, '/code/a.js'), concat('settings/', id, '.json'))"
    paths += " ELSE array(path, replace(path, '.json', '.custom.js'), concat('settings/', id, '.json')) END"
    return _resources(spark, sf).select(F.explode(F.expr(paths)).alias("path"))


@query(_OUTSIDE + "SELECT type, id, path FROM outside")
def outside_scope(spark, sf):
    return reconcile.outside_scope(_resources(spark, sf), _scope(spark, sf))


_OUTSIDE_FILES = _OUTSIDE + """
    , owned AS (SELECT path FROM outside WHERE type <> 'rules' UNION SELECT replace(path, '.json', '.custom.js') FROM outside WHERE type <> 'rules'
      UNION SELECT path || '/rule.json' FROM outside WHERE type = 'rules' UNION SELECT path || '/code/a.js' FROM outside WHERE type = 'rules')
    , found AS (SELECT DISTINCT path FROM files WHERE path IN (SELECT path FROM owned))
"""


@query(_OUTSIDE_FILES + "SELECT path FROM found")
def outside_files(spark, sf):
    outside = reconcile.outside_scope(_resources(spark, sf), _scope(spark, sf))
    return reconcile.outside_files(outside, _files(spark, sf))


@query(
    _OUTSIDE_FILES
    + "SELECT CASE WHEN path LIKE 'rules/%' THEN 'rules' WHEN path LIKE 'data-elements/%' THEN 'data_elements' ELSE split_part(path, '/', 1) END AS folder, "
    "count(*) AS n FROM (SELECT path FROM found UNION ALL SELECT path FROM files WHERE path LIKE 'settings/%') GROUP BY 1"
)
def folder_counts(spark, sf):
    outside = reconcile.outside_scope(_resources(spark, sf), _scope(spark, sf))
    files = _files(spark, sf)
    found = reconcile.outside_files(outside, files).unionByName(files.filter("path LIKE 'settings/%'"))
    return reconcile.folder_counts(found)


# ---------------------------------------------------------------- profiles

_TYPES = (("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) - count({c}) AS null_count FROM events" for c, t in _TYPES))
def column_stats(spark, sf):
    return P.column_stats(read_table(spark, sf, "events"))


def _profile_sql(column):
    return (
        f"SELECT '{column}' AS column_name, count({column}) AS count, round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std, "
        f"CAST(min({column}) AS DOUBLE) AS min, round(quantile_cont({column}, 0.25), 6) AS p25, round(quantile_cont({column}, 0.5), 6) AS p50, "
        f"round(quantile_cont({column}, 0.75), 6) AS p75, CAST(max({column}) AS DOUBLE) AS max FROM lineitem"
    )


_PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query(" UNION ALL ".join(_profile_sql(c) for c in _PROFILED))
def numeric_profile(spark, sf):
    out = P.numeric_profile(read_table(spark, sf, "lineitem").select(*_PROFILED, "l_returnflag"))
    return rounded(out, "mean", "std", "p25", "p50", "p75")


@query(
    """
    WITH v AS (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders
      UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders
      UNION ALL SELECT 'o_orderdate', CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 00:00:00' FROM orders),
    n AS (SELECT column_name, coalesce(value, '<NA>') AS value, count(*) AS count FROM v GROUP BY ALL)
    SELECT column_name, value, count, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS value_rank FROM n
    QUALIFY value_rank <= 5
    """
)
def top_values(spark, sf):
    return P.top_values(read_table(spark, sf, "orders"), n=5)


@query(
    "SELECT count(*) AS row_count, 'month' AS date_column, min(month) AS min_value, max(month) AS max_value "
    "FROM (SELECT strftime(o_orderdate, '%Y%m') AS month FROM orders)"
)
def extent(spark, sf):
    return P.extent(read_table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("month")))


# ---------------------------------------------------------------- keyed merges


def _existing(spark, sf):
    return read_table(spark, sf, "orders").filter("o_orderstatus <> 'P'").selectExpr(
        "o_custkey % 500 AS key", "CAST(year(o_orderdate) AS BIGINT) AS year", "o_orderkey AS seq", "o_orderstatus AS status"
    )


def _incoming(spark, sf):
    return read_table(spark, sf, "orders").filter("o_orderstatus = 'P'").selectExpr(
        "o_custkey % 500 AS key", "CAST(year(o_orderdate) AS BIGINT) AS year", "o_orderkey AS seq", "o_orderstatus AS status", "o_orderpriority AS note"
    )


_MERGE = """
    WITH o AS (SELECT o_custkey % 500 AS key, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderkey AS seq, o_orderstatus AS status, o_orderpriority AS note, o_totalprice FROM orders),
    old AS (SELECT key, year, seq, status, CAST(NULL AS VARCHAR) AS note FROM o WHERE status <> 'P'),
    new AS (SELECT key, year, seq, status, note FROM o WHERE status = 'P'),
    one AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY key, year ORDER BY seq DESC) = 1)
"""


@query(_MERGE + "SELECT * FROM old WHERE (key, year) NOT IN (SELECT (key, year) FROM one) UNION ALL SELECT * FROM one")
def upsert(spark, sf):
    return sinks.upsert(_existing(spark, sf), _incoming(spark, sf), ["key", "year"], order="seq")


@query(_MERGE + "SELECT * FROM old UNION ALL SELECT * FROM one WHERE (key, year) NOT IN (SELECT (key, year) FROM old)")
def insert_new(spark, sf):
    return sinks.insert_new(_existing(spark, sf), _incoming(spark, sf), ["key", "year"])


@query(
    _MERGE
    + """
    SELECT CAST(year AS VARCHAR) AS year, CAST(key AS VARCHAR) AS key, seq, note FROM old WHERE (key, year) NOT IN (SELECT (key, year) FROM new)
    UNION ALL SELECT CAST(year AS VARCHAR), CAST(key AS VARCHAR), seq, note FROM new
    """
)
def replace_groups(spark, sf):
    existing = _existing(spark, sf).withColumn("key", F.concat(F.lit(" "), F.col("key").cast("string")))
    return sinks.replace_groups(
        existing, _incoming(spark, sf), ["key", "year"], columns=["year", "key", "seq", "note"], sort_by=["year", "key"]
    )


@query(_MERGE + "SELECT * FROM old UNION ALL SELECT * FROM new")
def align_schema(spark, sf):
    return sinks.align_schema(_existing(spark, sf), _incoming(spark, sf))


@query(
    "SELECT n_name AS name, CAST(NULL AS DOUBLE) AS s_acctbal, n_nationkey AS nation FROM nation "
    "UNION ALL SELECT s_name, s_acctbal, s_nationkey FROM supplier UNION ALL SELECT c_name, c_acctbal, c_nationkey FROM customer"
)
def concat(spark, sf):
    nations = read_table(spark, sf, "nation").selectExpr("n_name AS name", "n_nationkey AS nation")
    suppliers = read_table(spark, sf, "supplier").selectExpr("s_nationkey AS nation", "s_name AS name", "s_acctbal")
    customers = read_table(spark, sf, "customer").selectExpr("c_name AS name", "c_acctbal AS s_acctbal", "c_nationkey AS nation")
    return sinks.concat([nations, suppliers, customers])


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_keys(spark, sf):
    return sinks.distinct_keys(read_table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "SELECT event_type AS kind, label FROM (SELECT CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '  ' ELSE event_type END AS event_type, "
    "CASE WHEN user_id % 2 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS label FROM events) "
    "WHERE trim(coalesce(event_type, '')) <> '' OR trim(label) <> ''"
)
def clean_table(spark, sf):
    rows = read_table(spark, sf, "events").selectExpr(
        "CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '  ' ELSE event_type END AS ` kind `",
        "CASE WHEN user_id % 2 = 0 THEN '' ELSE CAST(user_id AS STRING) END AS `label `",
    )
    return sinks.clean_table(rows)


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_custkey > 30 GROUP BY o_orderpriority")
def sql_query(spark, sf):
    text = "SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_orderstatus = :status AND o_custkey > :low GROUP BY o_orderpriority"
    return readers.sql_query(spark, text, {"status": "O", "low": ("INT64", 30)}, orders=read_table(spark, sf, "orders"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 10 AND l_returnflag = 'A'")
def count_where(spark, sf):
    return readers.count_where(
        read_table(spark, sf, "lineitem"), "l_quantity > :q AND l_returnflag = :flag", {"q": ("FLOAT64", 10), "flag": "A"}
    )


@query("SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def read_head(spark, sf):
    return readers.read_head(read_table(spark, sf, "customer"), 15, F.desc("c_acctbal"), "c_custkey")
