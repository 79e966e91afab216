"""Input views derived from the driver tables: one DataFrame builder and one SQL text each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.readers import read_table

# The expressions below are plain SQL that both engines read alike; every view keeps all rows of its table.
_SEARCH = (
    "concat('site', l_suppkey % 5) AS site",
    "CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS month",
    "concat('https://Shop.example.com/', p_type, '/', p_brand, '?id=', l_linenumber) AS page",
    "CASE l_linenumber % 3 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '') ELSE replace(p_name, ' ', '　') END AS query",
    "CAST(floor(l_quantity) AS BIGINT) AS impressions",
    "CAST(floor(l_quantity * l_discount) AS BIGINT) AS clicks",
    "1 + l_tax * 100 AS position",
)
_URLS = (
    "page_id",
    "url",
    "CASE page_id % 6 WHEN 0 THEN concat(url, '?utm_source=a&id=1&id=2&blank=')"
    " WHEN 1 THEN concat(url, '%E3%83%96?x=a+b%20c&id=%7E')"
    " WHEN 2 THEN concat(url, '/100%')"
    " WHEN 3 THEN concat(url, ';p=1?id=3#frag')"
    " WHEN 4 THEN 'https://root.example.com' ELSE url END AS dirty_url",
    "CASE page_id % 2 WHEN 0 THEN concat('2026010', page_id % 9 + 1) ELSE 'n/a' END AS day_text",
)
_TRAFFIC = (
    "event_id",
    "CASE user_id % 9 WHEN 0 THEN 'www.Google.Com' WHEN 1 THEN 'chatgpt.com'"
    " WHEN 2 THEN '192.168.10.20:8080' WHEN 3 THEN 'maps.example.com'"
    " WHEN 4 THEN 'search.example.jp' WHEN 5 THEN 'threads.net'"
    " WHEN 6 THEN 'shop.group.example' WHEN 7 THEN 't.co'"
    " ELSE 'https://www.Other.example/a' END AS source",
    "CASE event_id % 3 WHEN 0 THEN 'referral' WHEN 1 THEN 'organic' ELSE 'map' END AS medium",
    "CASE event_id % 2 WHEN 0 THEN 'Referral' ELSE 'Organic Search' END AS channel",
)
_MONTHS = (
    "o_orderkey",
    "o_totalprice",
    "CASE o_orderkey % 5"
    " WHEN 0 THEN concat(year(o_orderdate) * 100 + month(o_orderdate), '')"
    " WHEN 1 THEN concat(year(o_orderdate) * 100 + month(o_orderdate), '.0')"
    " WHEN 2 THEN concat(year(o_orderdate), '/', month(o_orderdate))"
    " WHEN 3 THEN concat(year(o_orderdate), '年', month(o_orderdate), '月')"
    " ELSE 'bad' END AS month_text",
)
_SITES = (
    "concat('h', user_id % 4, '.example.com') AS host",
    "concat('/p/', user_id % 40) AS path",
    "CASE user_id % 6 WHEN 0 THEN '' WHEN 1 THEN '(not set)' WHEN 2 THEN NULL ELSE concat('S', user_id % 6) END AS site",
    "event_id % 7 AS sessions",
)
_EXPECTED = (
    "c_custkey AS key",
    "c_mktsegment AS expected",
    "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'OTHER' ELSE c_mktsegment END AS actual",
)
_AMOUNTS = (
    "o_orderkey",
    "CASE o_orderkey % 6 WHEN 0 THEN concat('¥', CAST(floor(o_totalprice) AS BIGINT))"
    " WHEN 1 THEN concat('残高 1,', o_orderkey % 900 + 100, ' 円')"
    " WHEN 2 THEN '年 0.35％' WHEN 3 THEN '1,000,000円 0.35%'"
    " WHEN 4 THEN '--' ELSE '$2,720.39' END AS amount_text",
)
_SNAPSHOTS = (
    "p_partkey AS id",
    "concat(p_type, '/', p_brand, '/', p_partkey, '.json') AS path",
    "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS base_text",
    "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN concat(p_name, ' local') ELSE p_name END AS local_text",
    "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN concat(p_name, ' remote') ELSE p_name END AS remote_text",
)
_REQUESTS = (
    "event_id AS seq",
    "user_id AS session_id",
    "concat('https://m.example.com/b/ss/rs', user_id % 3, '/1/x?pageName=p', user_id % 20,"
    " '&a=1&a=2&blank=&v=', event_type) AS url",
    "CASE event_id % 4 WHEN 0 THEN concat('pageName=body', event_id % 5) ELSE '' END AS body",
    "concat('{\"events\":[{\"xdm\":{\"eventType\":\"', event_type,"
    " '\",\"web\":{\"webPageDetails\":{\"name\":\"p', user_id % 20,"
    " '\"}},\"_experience\":{\"analytics\":{\"channel\":\"c', user_id % 3,"
    " '\",\"event1to100\":{\"event11\":{\"value\":', event_id % 3,"
    " '}},\"customDimensions\":{\"eVars\":{\"eVar1\":\"e', user_id % 5,"
    " '\"}}}}},\"auth_token\":\"s', event_id, '\"}]}') AS payload",
)
_ITEM = '{"SKU":"s1","_experience":{"analytics":{"customDimensions":{"eVars":{"eVar8":"m"}}}}},{"SKU":"s2"}'
# requests with one or two events, all three buckets, commerce, items, identities, empty and null parts
_CAPTURES = (
    "event_id AS seq",
    "user_id % 50 AS session_id",
    "concat('{\"events\":[{\"data\":', CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '{}' ELSE concat('{\"currentTime\":\"t', event_id % 7, '\"}') END,"
    " ',\"xdm\":{\"eventType\":\"', event_type, '\",\"data\":', CASE event_id % 3 WHEN 0 THEN '{\"currentDate\":\"d\",\"currentTime\":\"own\"}' ELSE '[]' END,"
    " ',\"web\":{\"webPageDetails\":{\"name\":', CASE event_id % 8 WHEN 0 THEN 'null' ELSE concat('\"p', event_id % 20, '\"') END,"
    " '}},\"commerce\":', CASE event_id % 5 WHEN 0 THEN '{\"purchases\":{\"value\":1}}' WHEN 1 THEN '{}' ELSE 'null' END,"
    f" ',\"productListItems\":', CASE event_id % 3 WHEN 0 THEN '[{_ITEM}]' WHEN 1 THEN '[]' ELSE '[{{\"SKU\":\"s3\"}}]' END,"
    " ',\"identityMap\":{\"renkeiid\":[', CASE event_id % 3 WHEN 0 THEN '{\"id\":\"m1\"}' ELSE '' END,"
    " ']},\"_experience\":{\"analytics\":{\"channel\":\"', CASE event_id % 2 WHEN 0 THEN '' ELSE 'c' END, '\",\"productString\":\";s;', event_id % 3,"
    " '\",\"event1to100\":', CASE event_id % 3 WHEN 0 THEN '{}' ELSE concat('{\"event11\":{\"value\":', event_id % 4, '}}') END,"
    " ',\"event101to200\":', CASE event_id % 2 WHEN 0 THEN '{\"event101\":{\"value\":2}}' ELSE 'null' END,"
    " ',\"event201to300\":{\"event201\":{\"value\":3}},\"customDimensions\":{\"eVars\":', CASE event_id % 4 WHEN 0 THEN '{}' ELSE concat('{\"eVar1\":\"e', event_id % 5, '\"}') END,"
    " ',\"props\":{\"prop5\":\"x\"}}}}}}', CASE WHEN event_id % 2 = 0 THEN concat(',{\"xdm\":{\"eventType\":\"late\",\"web\":{\"webPageDetails\":{\"name\":\"q', event_id % 3,"
    " '\"}},\"commerce\":{\"order\":{\"purchaseID\":\"o', event_id % 9, '\"}}}}') ELSE '' END, ']}') AS payload",
)
_JOURNAL = (
    "event_id AS seq",
    "CAST(floor(event_id / 4) AS BIGINT) AS run_id",
    "CASE WHEN event_id = 4000 THEN '' ELSE CAST(CAST(ts AS DATE) AS VARCHAR(10)) END AS day",
    "CASE WHEN event_id % 37 = 0 THEN 9 ELSE event_id % 4 END AS part_index",
    "4 AS part_count",
    "event_type AS part",
)


def _sql(columns: tuple[str, ...], source: str) -> str:
    return "SELECT " + ", ".join(columns) + " FROM " + source


VIEW_SQL = {
    "search_rows": _sql(_SEARCH, "lineitem JOIN part ON l_partkey = p_partkey"),
    "url_rows": _sql(_URLS, "pages"),
    "traffic_rows": _sql(_TRAFFIC, "events"),
    "month_rows": _sql(_MONTHS, "orders"),
    "site_rows": _sql(_SITES, "events"),
    "expected_rows": _sql(_EXPECTED, "customer"),
    "amount_rows": _sql(_AMOUNTS, "orders"),
    "snapshot_rows": _sql(_SNAPSHOTS, "part"),
    "request_rows": _sql(_REQUESTS, "events"),
    "capture_rows": _sql(_CAPTURES, "events"),
    "journal_rows": _sql(_JOURNAL, "events"),
}


def search_rows(spark: SparkSession, sf: str) -> DataFrame:
    lines, parts = read_table(spark, sf, "lineitem"), read_table(spark, sf, "part")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "inner").selectExpr(*_SEARCH)


def _view(table: str, columns: tuple[str, ...]):
    def build(spark: SparkSession, sf: str) -> DataFrame:
        return read_table(spark, sf, table).selectExpr(*columns)

    return build


url_rows = _view("pages", _URLS)
traffic_rows = _view("events", _TRAFFIC)
month_rows = _view("orders", _MONTHS)
site_rows = _view("events", _SITES)
expected_rows = _view("customer", _EXPECTED)
amount_rows = _view("orders", _AMOUNTS)
snapshot_rows = _view("part", _SNAPSHOTS)
request_rows = _view("events", _REQUESTS)
capture_rows = _view("events", _CAPTURES)
journal_rows = _view("events", _JOURNAL)
