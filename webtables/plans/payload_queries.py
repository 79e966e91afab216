"""Beacon requests, edge payloads, contracts and delivery calls."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import beacons, retention
from ..sources.readers import read_table
from . import views
from .registry import query

# ---------------------------------------------------------------- request logs


@query(
    """
    SELECT seq, regexp_extract(url, '/ss/([^/?]+)', 1) AS rsid,
           CASE WHEN body <> '' THEN regexp_extract(body, 'pageName=([^&]*)', 1) ELSE regexp_extract(url, 'pageName=([^&]*)', 1) END AS page_name,
           '1' AS a, '' AS blank, regexp_extract(url, '[&]v=([^&]*)', 1) AS v, CAST(5 AS BIGINT) AS names
    FROM request_rows
    """,
    "request_rows",
)
def parse_beacons(spark, sf):
    parsed = beacons.parse_beacons(views.request_rows(spark, sf).select("seq", "url", "body"))
    value = F.col("variables")
    return parsed.select(
        "seq", value["rsid"].alias("rsid"), value["pageName"].alias("page_name"), value["a"].alias("a"), value["blank"].alias("blank"),
        value["v"].alias("v"), F.size(value).cast("bigint").alias("names"),
    )


@query("SELECT seq, 'x' || seq AS request_id, CASE WHEN seq % 2 = 0 THEN 'json' END AS content_type, CAST(CASE WHEN seq % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS kept FROM request_rows", "request_rows")
def pick_headers(spark, sf):
    rows = views.request_rows(spark, sf).selectExpr(
        "seq",
        "CASE WHEN seq % 2 = 0 THEN map('x-request-id', concat('x', seq), 'content-type', 'json', 'cookie', url)"
        " ELSE map('x-request-id', concat('x', seq), 'etag', body) END AS headers",
    )
    headers = beacons.pick_headers(rows, "headers")
    return headers.select(
        "seq", F.col("headers")["x-request-id"].alias("request_id"), F.col("headers")["content-type"].alias("content_type"),
        F.size("headers").cast("bigint").alias("kept"),
    )


@query(
    """
    SELECT seq, replace(payload, '"s' || seq || '"', '"***REDACTED***"') AS payload FROM request_rows
    """,
    "request_rows",
)
def redact_json(spark, sf):
    return beacons.redact_json(views.request_rows(spark, sf).select("seq", "payload"), "payload")


# ---------------------------------------------------------------- edge payloads

_FIELDS = """
    SELECT seq, session_id, CAST(0 AS BIGINT) AS pos,
           json_extract_string(payload, '$.events[0].xdm.web.webPageDetails.name') AS "pageName",
           json_extract_string(payload, '$.events[0].xdm.eventType') AS "eventType",
           json_extract_string(payload, '$.events[0].xdm._experience.analytics.channel') AS channel,
           CAST(json_extract(payload, '$.events[0].xdm._experience.analytics.event1to100') AS VARCHAR) AS events,
           CAST(json_extract(payload, '$.events[0].xdm._experience.analytics.customDimensions.eVars') AS VARCHAR) AS "eVars",
           CAST(json_extract_string(payload, '$.events[0].xdm._experience.analytics.event1to100.event11.value') AS BIGINT) AS event11
    FROM request_rows
"""


def _requests(spark, sf):
    return views.request_rows(spark, sf).select("seq", "session_id", "payload")


@query(f'SELECT seq, pos, "pageName", "eventType", channel, events, "eVars" FROM ({_FIELDS})', "request_rows")
def extract_edge_events(spark, sf):
    out = beacons.as_json_text(beacons.extract_edge_events(_requests(spark, sf)))
    return out.select("seq", F.col("pos").cast("bigint").alias("pos"), "pageName", "eventType", "channel", "events", "eVars")


@query(f'SELECT seq, "pageName", "eventType", channel, events FROM ({_FIELDS})', "request_rows")
def extract_first_event(spark, sf):
    rows = views.request_rows(spark, sf).select("seq", "payload")
    out = beacons.as_json_text(beacons.extract_first_event(rows))
    return out.select("seq", "pageName", "eventType", "channel", "events")


_CHECKS = [
    {"key": "events.event11.value", "op": "equals", "value": 1},
    {"key": "eVars.eVar1", "op": "matches", "value": "^e[0-3]$"},
    {"key": "pageName", "op": "contains", "value": "1"},
    {"key": "commerce", "op": "empty"},
]


@query(
    """
    WITH f AS (SELECT seq, json_extract_string(payload, '$.events[0].xdm.eventType') AS kind, event % 3 = 1 AS a, contains(payload, '"auth_token"') AS b
               FROM (SELECT seq, payload, CAST(json_extract_string(payload, '$.events[0].xdm._experience.analytics.event1to100.event11.value') AS BIGINT) AS event FROM request_rows))
    SELECT seq, a AND kind = 'view' AS satisfied,
           concat_ws(';', CASE WHEN NOT a THEN 'events[0].xdm._experience.analytics.event1to100.event11.value equals' END,
                     CASE WHEN kind <> 'view' THEN 'events[0].xdm.eventType includes' END) AS failed FROM f
    """,
    "request_rows",
)
def requirement_check(spark, sf):
    checks = [
        {"key": "events[0].xdm._experience.analytics.event1to100.event11.value", "op": "equals", "value": 1},
        {"key": "events[0].xdm.eventType", "op": "includes", "value": "view"},
        {"key": "events", "op": "exists"},
        {"key": "missing", "op": "empty"},
    ]
    out = beacons.requirement_check(views.request_rows(spark, sf).select("seq", "payload"), "payload", checks)
    return out.select("seq", "satisfied", F.array_join("failed", ";").alias("failed"))


_SCORED = f"""
    WITH f AS ({_FIELDS}),
    s AS (SELECT *, CAST(2 + 2 + CASE WHEN event11 IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN "eVars" IS NOT NULL THEN 3 ELSE 0 END AS BIGINT) AS score FROM f)
"""


@query(
    _SCORED
    + """
    SELECT session_id, seq, "pageName", "eventType", score FROM s
    WHERE regexp_matches("pageName", '^p1') AND "eventType" = 'click' AND event11 = 1
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, seq DESC) = 1
    """,
    "request_rows",
)
def best_beacon(spark, sf):
    out = beacons.best_beacon(
        _requests(spark, sf), page_pattern="^p1", event_type="click",
        requirements=[{"key": "events.event11.value", "op": "equals", "value": 1}, {"key": "eVars.eVar1"}],
    )
    return out.select("session_id", "seq", "pageName", "eventType", "score")


@query(
    _SCORED
    + """
    , r AS (SELECT session_id, seq, concat_ws(';', CASE WHEN coalesce(event11, -1) <> 1 THEN 'events.event11.value equals' END,
              CASE WHEN NOT regexp_matches(json_extract_string("eVars", '$.eVar1'), '^e[0-3]$') THEN 'eVars.eVar1 matches' END,
              CASE WHEN NOT contains("pageName", '1') THEN 'pageName contains' END) AS failed FROM s)
    SELECT session_id, seq, failed, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS reject_rank FROM r WHERE failed <> ''
    QUALIFY reject_rank <= 20
    """,
    "request_rows",
)
def rejected_beacons(spark, sf):
    events = beacons.extract_edge_events(_requests(spark, sf), fields=["pageName", "events", "eVars", "commerce"])
    out = beacons.rejected_beacons(events, _CHECKS, limit=20)
    return out.select("session_id", "seq", F.array_join("failed", ";").alias("failed"), "reject_rank")


@query(
    f"""
    SELECT session_id, seq, "pageName" FROM ({_FIELDS}) WHERE regexp_matches("pageName", '[13579]$')
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) = 1
    """,
    "request_rows",
)
def first_page_match(spark, sf):
    return beacons.first_page_match(_requests(spark, sf), "[13579]$").select("session_id", "seq", "pageName")


@query(
    f"""
    SELECT seq, "pageName", channel FROM ({_FIELDS}) WHERE "eventType" = 'purchase' AND regexp_matches("pageName", '^p1')
      AND json_extract_string("eVars", '$.eVar1') = 'e2'
    """,
    "request_rows",
)
def match_request(spark, sf):
    out = beacons.match_request(
        views.request_rows(spark, sf).select("seq", "url", "payload"), hosts=["m.example.com"], page_pattern="^p1", event_type="purchase",
        requirements=[{"key": "eVars.eVar1", "op": "equals", "value": "e2"}],
    )
    return out.select("seq", "pageName", "channel")


@query(
    """
    SELECT session_id, seq, kind FROM (
      SELECT session_id, seq, kind, lag(kind) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM (
        SELECT user_id AS session_id, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS kind FROM events))
    WHERE before IS DISTINCT FROM kind OR seq = (SELECT min(e.event_id) FROM events e WHERE e.user_id = session_id)
    """
)
def drop_repeats(spark, sf):
    rows = read_table(spark, sf, "events").selectExpr(
        "user_id AS session_id", "event_id AS seq", "CASE WHEN event_type IN ('view', 'click') THEN event_type END AS kind"
    )
    return beacons.drop_repeats(rows, session="session_id", order="seq", compare=["kind"])


# ---------------------------------------------------------------- captures: several events, buckets, items, empty parts


def _filled(value: str) -> str:
    return f"CASE WHEN CAST({value} AS VARCHAR) NOT IN ('null', '\"\"', '[]', '{{}}') THEN CAST({value} AS VARCHAR) END"


def _capture_sql() -> str:
    json = lambda path: f"json_extract(e, '$.{path}')"
    text = lambda path: f"nullif(json_extract_string(e, '$.{path}'), '')"
    analytics = "xdm._experience.analytics"
    buckets = ", ".join(f"CASE WHEN CAST({json(f'{analytics}.{b}')} AS VARCHAR) LIKE '{{\"%' THEN CAST({json(f'{analytics}.{b}')} AS VARCHAR) END" for b in beacons.EVENT_BUCKETS)
    own = f"({_filled(json('data'))}) IS NOT NULL"
    item = "json_extract(i, '$._experience.analytics.customDimensions.eVars')"
    items = f"list_transform(json_extract(e, '$.xdm.productListItems[*]'), lambda i: CASE WHEN json_type({item}) = 'OBJECT' THEN CAST({item} AS VARCHAR) ELSE '{{}}' END)"
    return f"""
    WITH ev AS (SELECT seq, session_id, pos, json_extract(payload, '$.events[' || pos || ']') AS e
                FROM (SELECT *, unnest(range(CAST(json_array_length(payload, '$.events') AS BIGINT))) AS pos FROM capture_rows)),
    flat AS (SELECT seq, session_id, pos, coalesce({text('xdm.web.webPageDetails.name')}, '') AS "pageName", coalesce({text('xdm.eventType')}, '') AS "eventType",
      {text(analytics + '.channel')} AS channel, {text(analytics + '.productString')} AS products,
      CASE WHEN {own} THEN {text('data.currentTime')} ELSE {text('xdm.data.currentTime')} END AS "currentTime",
      CASE WHEN {own} THEN {text('data.currentDate')} ELSE {text('xdm.data.currentDate')} END AS "currentDate",
      {text('xdm.identityMap.renkeiid[0].id')} AS renkeiid, coalesce({buckets}) AS events,
      {_filled(json(analytics + '.customDimensions.eVars'))} AS "eVars", {_filled(json(analytics + '.customDimensions.props'))} AS props,
      coalesce({_filled(json('data'))}, {_filled(json('xdm.data'))}) AS data, {_filled(json('xdm.commerce'))} AS commerce,
      {_filled(json('xdm.productListItems'))} AS "productListItems",
      CASE WHEN len(list_filter({items}, lambda t: t <> '{{}}')) > 0 THEN concat('{{\"item\":[', array_to_string({items}, ','), ']}}') END AS "merchandisingEVars" FROM ev)
    """


_ALL = ", ".join(f'"{f}"' for f in beacons.FIELDS)


@query(f"{_capture_sql()} SELECT seq, pos, {_ALL} FROM flat", "capture_rows")
def extract_capture_events(spark, sf):
    out = beacons.as_json_text(beacons.extract_edge_events(views.capture_rows(spark, sf).select("seq", "payload")))
    return out.select("seq", F.col("pos").cast("bigint").alias("pos"), *beacons.FIELDS)


_CAPTURE_CHECKS = [
    {"key": "events.event11.value", "op": "equals", "value": 1},
    {"key": "commerce.purchases.value", "op": "exists"},
    {"key": "eVars.eVar1", "op": "matches", "value": "^e[0-3]$"},
]

_CAPTURE_JUDGED = f"""{_capture_sql()},
    judged AS (SELECT *, coalesce(json_extract_string(events, '$.event11.value') = '1', false) AS c0, json_extract_string(commerce, '$.purchases.value') IS NOT NULL AS c1,
      coalesce(regexp_matches(json_extract_string("eVars", '$.eVar1'), '^e[0-3]$'), false) AS c2 FROM flat),
    numbered AS (SELECT seq AS place_seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS place FROM capture_rows),
    later AS (SELECT * FROM judged JOIN numbered ON place_seq = seq WHERE place > 3)
"""


@query(
    _CAPTURE_JUDGED
    + """
    , scored AS (SELECT *, CAST(CASE WHEN "pageName" <> '' THEN 2 ELSE 0 END + CASE WHEN "eventType" <> '' THEN 2 ELSE 0 END
        + CASE WHEN products IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN renkeiid IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN c1 THEN 3 ELSE 0 END
        + CASE WHEN json_extract_string(commerce, '$.order.purchaseID') IS NOT NULL THEN 3 ELSE 0 END
        + CASE WHEN json_extract_string(events, '$.event11.value') IS NOT NULL THEN 3 ELSE 0 END
        + CASE WHEN json_extract_string(props, '$.prop5') IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN json_extract_string("eVars", '$.eVar1') IS NOT NULL THEN 3 ELSE 0 END
        + CASE WHEN json_extract_string("productListItems", '$[0].SKU') IS NOT NULL THEN 3 ELSE 0 END
        + CASE WHEN json_extract_string("merchandisingEVars", '$.item[0].eVar8') IS NOT NULL THEN 3 ELSE 0 END AS BIGINT) AS score FROM later)
    SELECT session_id, seq, pos, score, """
    + _ALL
    + """ FROM scored WHERE c1 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, seq DESC, pos DESC) = 1
    """,
    "capture_rows",
)
def best_capture(spark, sf):
    out = beacons.best_beacon(views.capture_rows(spark, sf), requirements=[_CAPTURE_CHECKS[1]], start_index=3)
    return out.select("session_id", "seq", F.col("pos").cast("bigint").alias("pos"), "score", *beacons.FIELDS)


@query(
    _CAPTURE_JUDGED
    + """
    SELECT session_id, seq, pos, "pageName", "eventType", "currentTime", events, commerce, "eVars", props, "merchandisingEVars",
      concat_ws(';', CASE WHEN NOT c0 THEN concat('events.event11.value equals 1 ', coalesce(json_extract_string(events, '$.event11.value'), '-')) END,
        CASE WHEN NOT c1 THEN 'commerce.purchases.value exists - -' END,
        CASE WHEN NOT c2 THEN concat('eVars.eVar1 matches "^e[0-3]$" ', coalesce(CAST(json_extract("eVars", '$.eVar1') AS VARCHAR), '-')) END) AS failures,
      row_number() OVER (PARTITION BY session_id ORDER BY seq DESC, pos DESC) AS reject_rank
    FROM later WHERE NOT (c0 AND c1 AND c2) AND regexp_matches("pageName", '^[pq]') QUALIFY reject_rank <= 20
    """,
    "capture_rows",
)
def rejected_captures(spark, sf):
    out = beacons.rejected_beacons(views.capture_rows(spark, sf), _CAPTURE_CHECKS, page_pattern="^[pq]", limit=20, start_index=3)
    line = lambda f: F.concat_ws(" ", f["key"], f["op"], *[F.coalesce(f[k], F.lit("-")) for k in ("expected", "actual")])
    shown = ("pageName", "eventType", "currentTime", "events", "commerce", "eVars", "props", "merchandisingEVars")
    return out.select("session_id", "seq", F.col("pos").cast("bigint").alias("pos"), *shown, F.array_join(F.transform("failures", line), ";").alias("failures"), "reject_rank")


@query(
    f"{_capture_sql()} SELECT session_id, seq, pos, {_ALL} FROM flat WHERE regexp_matches(\"pageName\", '[13579]$') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq, pos) = 1",
    "capture_rows",
)
def first_capture_page(spark, sf):
    out = beacons.first_page_match(views.capture_rows(spark, sf), "[13579]$")
    return out.select("session_id", "seq", F.col("pos").cast("bigint").alias("pos"), *beacons.FIELDS)


# ---------------------------------------------------------------- contracts

_CONTRACT = [
    {"path": "user.name", "type": "string", "nonEmpty": True, "usedBy": "report"},
    {"path": "user.id", "type": "number"},
    {"path": "items", "type": "array", "minItems": 2},
    {"path": "user.nick", "type": "object"},
]


_CONTRACT_DOC = (
    "CASE WHEN o_orderkey % 10 = 0 THEN 'not json' ELSE concat('{\"user\":{\"name\":\"', CASE o_orderkey % 3 WHEN 0 THEN '  ' ELSE o_orderpriority END,"
    " '\",\"id\":', CASE o_orderkey % 4 WHEN 0 THEN '\"x\"' WHEN 1 THEN 'true' WHEN 2 THEN '1.5' ELSE '7' END,"
    " '},\"items\":', CASE o_orderkey % 3 WHEN 0 THEN '[1]' WHEN 1 THEN '[1,2,3]' ELSE '{}' END, '}') END"
)

_CONTRACT_SQL = """
    WITH o AS (SELECT o_orderkey, o_orderkey % 10 = 0 AS broken, o_orderkey % 3 AS m, o_orderkey % 4 AS i FROM orders),
    c AS (
      SELECT o_orderkey, 'data' AS path, false AS "exists", 'data is undefined' AS reason, 'all contract checks' AS used_by FROM o WHERE broken
      UNION ALL SELECT o_orderkey, 'user.name', true, CASE WHEN m = 0 THEN 'empty string' ELSE 'ok' END, 'report' FROM o WHERE NOT broken
      UNION ALL SELECT o_orderkey, 'user.id', true, CASE WHEN i = 0 THEN 'type mismatch: expected number, got str' ELSE 'ok' END, '' FROM o WHERE NOT broken
      UNION ALL SELECT o_orderkey, 'items', true, CASE m WHEN 0 THEN 'array length 1 < minItems 2' WHEN 1 THEN 'ok' ELSE 'type mismatch: expected array, got dict' END, '' FROM o WHERE NOT broken
      UNION ALL SELECT o_orderkey, 'user.nick', false, 'missing path', '' FROM o WHERE NOT broken)
"""


def _checked(spark, sf, rules):
    rows = read_table(spark, sf, "orders").select("o_orderkey", F.expr(_CONTRACT_DOC).alias("doc"))
    return beacons.contract_check(rows, "doc", rules)


@query(_CONTRACT_SQL + "SELECT o_orderkey, path, \"exists\", reason = 'ok' AS ok, reason, used_by FROM c")
def contract_check(spark, sf):
    return _checked(spark, sf, _CONTRACT)


@query(_CONTRACT_SQL + "SELECT o_orderkey, bool_and(reason = 'ok') AS ok FROM c WHERE path <> 'user.nick' GROUP BY o_orderkey")
def contract_summary(spark, sf):
    return beacons.contract_summary(_checked(spark, sf, _CONTRACT[:3]), ["o_orderkey"])


# ---------------------------------------------------------------- delivery calls

_DELIVERY = (
    "concat('{\"calls\":[{\"response\":{\"body\":{\"prefetch\":{\"mboxes\":[{\"name\":\"', p_type, '\",\"options\":[{\"responseTokens\":{\"activity.id\":', p_size,"
    " ',\"recommendation.criteria.title\":\"', p_brand, '\"},\"content\":\"{\\\\\"recs\\\\\":{\\\\\"activity\\\\\":{\\\\\"criteria.title\\\\\":\\\\\"unused\\\\\",\\\\\"algorithm.name\\\\\":\\\\\"', p_type,"
    " '\\\\\"}}}\"}]}]}}}},{\"execute\":{\"mboxes\":[{\"name\":\"\"},{\"name\":\"side\",\"options\":[{\"content\":{\"recs\":{\"activity\":{\"design\":\"', p_name, '\",\"campaign.id\":\"x\"}}}}]}]}}]}')"
)


def _deliveries(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", F.expr(_DELIVERY.replace("\\\\\"", "\\\\\\\"")).alias("doc"))


@query(
    """
    SELECT p_partkey, p_brand AS criteria, p_type AS algorithm, CAST(NULL AS VARCHAR) AS design, CAST(p_size AS BIGINT) AS activity_id FROM part
    UNION ALL SELECT p_partkey, NULL, NULL, p_name, NULL FROM part
    """
)
def delivery_options(spark, sf):
    return beacons.delivery_options(_deliveries(spark, sf), "doc")


@query(
    """
    SELECT DISTINCT 'criteria' AS kind, p_brand AS value FROM part UNION SELECT 'criteria', p_type FROM part
    UNION SELECT 'design', p_name FROM part UNION SELECT 'activity', CAST(p_size AS VARCHAR) FROM part
    """
)
def delivery_scope(spark, sf):
    return beacons.delivery_scope(_deliveries(spark, sf), "doc")


@query(
    "SELECT p_partkey, CASE WHEN p_size = 1 THEN '' WHEN p_type = p_name THEN p_type || ';side' ELSE p_type || ';' || p_name || ';side' END AS mbox_names FROM part"
)
def mbox_names(spark, sf):
    docs = read_table(spark, sf, "part").selectExpr(
        "p_partkey",
        "CASE WHEN p_size = 1 THEN '[]' ELSE concat('{\"prefetch\":{\"mboxes\":[{\"name\":\"side\"},{\"name\":\"\"},{\"name\":\"', p_type, '\"},{\"name\":3}]},"
        "\"execute\":{\"mboxes\":[{\"name\":\"', p_type, '\"},{\"other\":1},{\"name\":\"', p_name, '\"}]}}') END AS doc",
    )
    return beacons.mbox_names(docs, "doc").select("p_partkey", F.array_join("mbox_names", ";").alias("mbox_names"))


@query(
    "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'u' || user_id WHEN event_type = 'signup' THEN '' ELSE '' END AS visitor_id FROM events"
)
def visitor_id(spark, sf):
    rows = read_table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE WHEN event_type = 'error' THEN 'https://edge.example.com/collect' WHEN event_type = 'purchase' THEN 'https://other.example.org/interact'"
        " ELSE 'https://edge.example.com/ee/v1/interact?x=1' END AS url",
        "concat('{\"handle\":[{\"type\":\"a\"},{\"payload\":[{\"id\":\"no\",\"namespace\":{\"code\":\"OTHER\"}},{\"id\":\"\",\"namespace\":{\"code\":\"ECID\"}}]},"
        "{\"payload\":[{\"id\":\"', CASE WHEN event_type = 'signup' THEN '' ELSE concat('u', user_id) END, '\",\"namespace\":{\"code\":\"ECID\"}}]}]}') AS body",
    )
    return beacons.visitor_id(rows, hosts=["edge.example.com"]).select("event_id", "visitor_id")


# ---------------------------------------------------------------- chunked payloads and retention

_WHOLE = """
    WITH w AS (SELECT run_id FROM journal_rows GROUP BY run_id
      HAVING count(*) = 4 AND count(DISTINCT part_index) = 4 AND min(part_index) = 0 AND max(part_index) = 3)
"""


@query(_WHOLE + "SELECT run_id, string_agg(part, '' ORDER BY part_index) AS payload FROM journal_rows WHERE run_id IN (SELECT run_id FROM w) GROUP BY run_id", "journal_rows")
def reassemble_chunks(spark, sf):
    return beacons.reassemble_chunks(views.journal_rows(spark, sf))


@query(
    _WHOLE
    + """
    SELECT run_id, part_index, part, CAST(coalesce(sum(length(part)) OVER (PARTITION BY run_id ORDER BY part_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
    FROM journal_rows WHERE run_id IN (SELECT run_id FROM w)
    """,
    "journal_rows",
)
def ordered_parts(spark, sf):
    return beacons.ordered_parts(views.journal_rows(spark, sf))


@query(_WHOLE + "SELECT run_id, part_index, part FROM journal_rows WHERE run_id = (SELECT max(run_id) FROM w)", "journal_rows")
def latest_complete_run(spark, sf):
    rows = views.journal_rows(spark, sf).withColumn("started_at", F.lpad(F.col("run_id").cast("string"), 20, "0"))
    return retention.latest_complete_run(rows).select("run_id", "part_index", "part")


@query(
    """
    WITH s AS (SELECT *, day = '' OR day >= '2024-01-20' AS stop FROM journal_rows)
    SELECT seq, day FROM s WHERE seq >= (SELECT min(seq) FROM s WHERE stop)
    """,
    "journal_rows",
)
def trim_older_than(spark, sf):
    rows = views.journal_rows(spark, sf).select("seq", "day")
    return retention.trim_older_than(rows, seq="seq", day="day", max_age_days=11, today=date(2024, 1, 31))


@query("SELECT seq, day FROM journal_rows ORDER BY seq DESC LIMIT 777", "journal_rows")
def keep_last(spark, sf):
    rows = views.journal_rows(spark, sf).select("seq", "day")
    return retention.keep_last(rows, seq="seq", max_rows=900, keep_rows=777)


@query("SELECT CAST(seq AS VARCHAR) AS number, day, part AS step, '' AS note FROM journal_rows", "journal_rows")
def migrate_rows(spark, sf):
    rows = views.journal_rows(spark, sf).select("day", F.col("seq").cast("string").alias("seq"), "part")
    return retention.migrate_rows(
        rows, ["number", "day", "step", "note"], [{"seq": "number", "part": "step"}, {"day": "day", "seq": "number", "part": "step"}]
    )


@query(
    """
    WITH c AS (SELECT run_id, seq, part, 'old' AS origin FROM journal_rows WHERE run_id NOT IN (SELECT run_id FROM journal_rows WHERE part = 'error')
      UNION ALL SELECT run_id, seq, part, 'new' FROM journal_rows WHERE part = 'error')
    SELECT run_id, seq, part, origin FROM c WHERE run_id IN (SELECT DISTINCT run_id FROM c ORDER BY run_id DESC LIMIT 60)
    """,
    "journal_rows",
)
def keep_latest_runs(spark, sf):
    rows = views.journal_rows(spark, sf).select("run_id", "seq", "part", F.lpad(F.col("run_id").cast("string"), 20, "0").alias("started_at"))
    incoming = rows.filter("part = 'error'").withColumn("origin", F.lit("new"))
    out = retention.keep_latest_runs(rows.withColumn("origin", F.lit("old")), incoming, max_runs=60)
    return out.drop("started_at")
