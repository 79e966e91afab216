"""Search, channels, numbers, periods, reports, reconciliation and keyed merges on small frames."""

import warnings
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from webtables.functions import dates, text
from webtables.operators import channels, display, numbers, periods, reconcile, reports, retention, search
from webtables.sources import readers, sinks


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v"))).first()[0]


# ---------------------------------------------------------------- search


def test_search_position_and_null_keys(spark, rows):
    df = spark.createDataFrame(
        [("/A%3Fx", "q", 1, 10, 2.0), ("/a?y#z", "q", 2, 30, 4.0), ("/a", "q", 0, 5, None), (None, "q", 9, 9, 9.0), ("/n", "z", 0, 0, 3.0)],
        "page string, query string, clicks int, impressions int, position double")
    assert rows(search.search_aggregate(df), F.asc_nulls_first("page")) == [(None, "q", 9, 9, 9.0), ("/a", "q", 45, 3, pytest.approx(140 / 45)), ("/n", "z", 0, 0, 0.0)]
    assert search.search_aggregate(df.drop("position")).columns == ["page", "query", "impressions", "clicks"]
    assert rows(search.search_aggregate(df.select("page")))[0] == ("/a",)
    withctr = df.withColumn("ctr", F.rand(1))
    assert search.search_aggregate(withctr).count() == 5
    assert search.search_aggregate(withctr, metrics=("ctr",)).count() == 3


def test_query_variants(spark, rows):
    df = spark.createDataFrame(
        [("202601", "s", "/p", "red ring", 5, 1, 2.0), ("202601", "s", "/p", "redring", 9, 0, 4.0), ("202601", "s", "/p", "red　ring", 9, 2, None), ("202602", "s", "/p", "x", None, 1, 1.0)],
        "month string, site string, page string, query string, impressions int, clicks int, position double")
    out = search.merge_query_variants(df)
    assert out.columns == ["month", "site", "query", "page", "impressions", "clicks", "position"]
    assert rows(out, "month") == [("202601", "s", "redring", "/p", 23, 3, pytest.approx(46 / 23)), ("202602", "s", "x", "/p", 0, 1, 0.0)]
    with pytest.raises(ValueError, match="missing"):
        search.merge_query_variants(df.drop("clicks"))


def test_thresholds(spark, rows):
    df = spark.createDataFrame([("a", 0, 9, 1.0), ("a", 1, 1, 99.0), ("b", 0, 50, 20.0), ("b", 0, 50, None), ("c", 5, 5, 5.0)], "site string, clicks int, impressions int, position double")
    rules = spark.createDataFrame([(" a ", "x", None), ("b", "5", "30"), ("b", "60", "30")], "site string, min_impressions string, max_position string")
    assert rows(search.threshold_filter(df, rules), "site", "clicks") == [("a", 1, 1, 99.0), ("b", 0, 50, 20.0)]
    assert search.threshold_filter(df, rules.limit(0)).count() == 5


def test_union_sites_keeps_a_site_listed_twice_apart(spark, rows):
    facts = spark.createDataFrame([("https://a.example", "q", 1, 2, 1.0), ("https://a.example/", "q", 1, 2, 1.0), ("https://b.example", "q", 9, 9, 9.0)], "url string, query string, clicks int, impressions int, position double")
    sites = spark.createDataFrame([("https://a.example/", " x "), ("https://a.example", "y"), (None, "z")], "url string, label string")
    assert rows(search.union_sites(facts, sites, label_col="label", constants={"m": "202601"}), "label") == [("q", 4, 2, 1.0, "x", "202601"), ("q", 4, 2, 1.0, "y", "202601")]


# ---------------------------------------------------------------- channels


@pytest.mark.parametrize("row,expected", [
    (("Referral", "referral", "gemini.example.com"), "AI"), (("Referral", "referral", "shop.corp.example"), "Group"),
    (("Organic Search", "organic", "bing"), "Organic Search"), (("Referral", "referral", "10.0.0.9:3000"), "Direct"),
    (("Referral", "MAP", "x"), "Map"), (("Referral", "referral", "www.maps.example"), "Map"), (("Referral", "referral", "websearch.example"), "Organic Search"),
    (("Direct", "none", "websearch.example"), "Direct"), (("Referral", "referral", "threads.example"), "Organic Social"), ((None, None, None), ""),
])
def test_channel_rules(spark, row, expected):
    df = spark.createDataFrame([row], "channel string, medium string, source string")
    assert channels.classify_channel(df, group_domains=["corp.example"]).first()["channel"] == expected


@pytest.mark.parametrize("row,expected", [
    (("Referral", "referral", "chat.openai.com"), ("ChatGPT", "AI")), (("Referral", "bard", "x.example"), ("Gemini", "AI")), (("Referral", "r", "www.teams.example"), ("teams.example", "Internal")),
    (("Email", "r", "Search.example"), ("search.example", "Organic Search")), (("Email", "r", "t.co"), ("Twitter", "Organic Social")), (("Referral", "r", "WWW.Plain.example"), ("WWW.Plain.example", "Referral")),
])
def test_source_and_channel(spark, row, expected):
    df = spark.createDataFrame([row], "channel string, medium string, source string")
    assert channels.reclassify_source_channel(df).select("source", "channel").first() == expected


def test_pattern_map_paths_agree_and_bad_patterns_are_skipped(spark, rows):
    df = spark.createDataFrame([("alpha",), ("beta",), ("Alpha",), (None,)], "v string")
    rules = [("(", "broken"), ("^al", "A"), ("ta$", "B")]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        direct = rows(channels.pattern_map(df, "v", rules, output="o"), "v")
        lookup = rows(channels.pattern_map_distinct(df, "v", rules, output="o"), "v")
    assert direct == lookup == [(None, None), ("Alpha", "Alpha"), ("alpha", "A"), ("beta", "B")]
    assert any("invalid pattern" in str(w.message) for w in seen)
    assert rows(channels.classify_by_pattern(df, {}, "v"), "v")[0] == (None, "other")


def test_rule_listed_twice(spark, rows):
    """First place, last label, as when a mapping is filled entry by entry."""
    df = spark.createDataFrame([('[{"key":"^/a","value":"one"},{"regex":"^/b","site":"two"},{"key":" ^/a ","value":"three"},{"key":"^/c"}]',), ("no",)], "doc string")
    assert rows(channels.list_rules(df, "doc").drop("doc")) == [(0, "^/a", "three"), (1, "^/b", "two")]


# ---------------------------------------------------------------- numbers


def test_number_text(spark):
    assert one(spark, "残高 -1,234.5株", text.parse_number) == -1234.5
    assert one(spark, "１２３円", text.parse_money) == 123.0
    assert one(spark, "なし", text.parse_number) is None
    assert one(spark, "年　0.40％", text.parse_year_rate) == 0.4
    assert one(spark, ",円", text.parse_money) is None
    assert tuple(one(spark, "2,000,000円 1.25％", text.parse_amount_rate)) == (2000000.0, 1.25)
    assert [one(spark, v, text.currency_to_double) for v in ("¥12,000", "$ 3,720.5", "€6.9", "0.350%", "", "12d", None)] == [12000.0, 3720.5, 6.9, 0.35, None, None, None]


def test_numeric_columns(spark, rows):
    df = spark.createDataFrame([("7", float("nan")), ("x", 2.9), (None, -2.9)], "a string, b double")
    assert rows(numbers.to_numeric_cols(df, ["a", "b", "c"], fill=0, as_int=True)) == [(7, 0), (0, 2), (0, -2)]


# ---------------------------------------------------------------- periods


def test_months(spark):
    texts = {"202412": date(2024, 12, 1), "202412.0": date(2024, 12, 1), "2024-07": date(2024, 7, 1), "2024/3": date(2024, 3, 1), "2024年9月": date(2024, 9, 1),
             "2024-07-30 10:00:00": date(2024, 7, 1), "202413": None, "soon": None, "20240": None}
    assert {t: one(spark, t, dates.parse_year_month) for t in texts} == texts


def test_month_filters(spark, rows):
    df = spark.createDataFrame([(202511,), (202512,), (202601,), (202602,)], "month int")
    assert rows(periods.recent_months(df, "month", 2), "month") == [(202601,), (202602,)]
    assert rows(periods.drop_current_month(df, "month", reference=date(2026, 2, 9)), "month") == [(202511,), (202512,), (202601,)]


def test_period_tokens():
    assert periods.parse_periods("1, 2024q2,this-year,", date(2025, 1, 31)) == [("202412", ["202412"]), ("2024Q2", ["202404", "202405", "202406"]), ("2025", [f"2025{m:02d}" for m in range(1, 13)])]
    for bad in ("", None, "x"):
        with pytest.raises(ValueError):
            periods.parse_periods(bad, date(2025, 1, 1))


def test_month_pieces(spark, rows):
    df = spark.createDataFrame([("2025-01-30", "2025-03-02"), ("bad", "2025-01-01"), ("2025-02-01", "2025-01-01")], "a string, b string")
    assert [tuple(map(str, r[2:])) for r in rows(periods.month_ranges(df, "a", "b"), "range_start")] == [
        ("202501", "2025-01-30", "2025-01-31"), ("202502", "2025-02-01", "2025-02-28"), ("202503", "2025-03-01", "2025-03-02")]


@pytest.mark.parametrize("word,expected", [("today-3d", "2024-02-26"), ("yesterday", "2024-02-28"), ("10daysAgo", "2024-02-19"), ("month-end", "2024-02-29"), ("prev-month-start", "2024-01-01"),
                                           ("prev-prev-month-end", "2023-12-31"), ("week-start", "2024-02-26"), ("year-end", "2024-12-31"), ("20240105", "2024-01-05")])
def test_date_words(word, expected):
    assert dates.resolve_date(word, date(2024, 2, 29)) == expected
    with pytest.raises(ValueError):
        dates.resolve_date("tomorrowish", date(2024, 2, 29))


def test_reflection_boundary(spark):
    df = spark.createDataFrame([(datetime(2025, 1, 1, 9, 29, 59),), (datetime(2025, 1, 1, 9, 30),)], "ts timestamp_ntz")
    assert [r["available_at"] for r in periods.with_reflection_time(df).collect()] == [datetime(2025, 1, 1, 10, 0), datetime(2025, 1, 1, 10, 30)]


def test_freshness_and_overdue(spark, rows):
    now = datetime(2025, 1, 1, 0, 0, tzinfo=timezone.utc)
    df = spark.createDataFrame([(1, "2025-01-01T08:00:00"), (2, "2024-12-31T22:59:59Z"), (3, "2024-12-31T23:00:00+00:00"), (4, "x"), (5, None)], "i int, fetched_at string")
    assert rows(periods.with_freshness(df, 1, now=now).select("is_fresh"), "i") == [(True,), (False,), (True,), (False,), (False,)]
    tasks = spark.createDataFrame([("pending", "2025-01-01T08:00:30"), ("pending", "2025-01-01T09:00:00"), ("done", "2024-01-01")], "status string, due_at string")
    assert [r[2] for r in rows(periods.overdue(tasks, now=now))] == [59]


# ---------------------------------------------------------------- reports


def test_filters(spark, rows):
    df = spark.createDataFrame([("a>b", 5), ("c", 7), (None, 9)], "name string, n int")
    assert rows(reports.report_filter(df, "name==a>b")) == [("a>b", 5)]
    assert rows(reports.report_filter(df, "name!=c; n>=5"), "n") == [("a>b", 5), (None, 9)]
    assert rows(reports.report_filter(df, {"or": ["n<6", {"and": ["n>8", "name!@x"]}]}), "n") == [("a>b", 5), (None, 9)]
    assert reports.join_filters(" a==1 ", None, "", "b!=2") == "a==1;b!=2"
    for bad in ("name", "nope==1", {"xor": []}):
        with pytest.raises((ValueError, TypeError)):
            reports.report_filter(df, bad)
    assert rows(reports.search_filter(df, ["name:equals:a>b"])) == [("a>b", 5)]
    with pytest.raises(ValueError):
        reports.search_filter(df, ["name:like:x"])


def test_filter_reaches_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = reports.report(events, ["event_type"], ["eventCount"], date_column="ts", start="2024-01-02", end="2024-01-03", filters="user_id==7")
    text_plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in text_plan and "EqualTo(user_id,7)" in text_plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text_plan


def test_outer_merge_matches_null_keys(spark, rows):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 5), ("b", 6)], "k string, y int")
    assert rows(reports.outer_merge_reports([left, right], "k"), F.asc_nulls_first("k")) == [(None, 1, 5), ("a", 2, None), ("b", None, 6)]
    assert rows(reports.merge_reports([left, None, right], "k", int_cols=["y"]), F.asc_nulls_first("k")) == [(None, 1, 5), ("a", 2, 0)]


# ---------------------------------------------------------------- reconciliation


@pytest.mark.parametrize("texts,action", [
    ((None, None, None), "unchanged"), (("b", "b ", None), "delete"), (("b", "c", None), "kept-local-removed"), ((None, "c", None), "kept-local-removed"), (("b", None, "b"), "add"),
    (("b", "x", "x"), "unchanged"), ((None, "x", "y"), "conflict"), (("b", "b", "y"), "update"), (("b", "x", "b"), "keep-local"), (("b", "x", "y"), "conflict"), (("b", "b\n", "　b"), "unchanged"),
])
def test_three_way_table(spark, texts, action):
    df = spark.createDataFrame([("p", *texts)], "path string, base_text string, local_text string, remote_text string")
    assert reconcile.three_way_compare(df).first()["action"] == action


def test_coverage_of_an_empty_table(spark, rows):
    rules = spark.createDataFrame([("^/a", "A"), ("__default__", "D")], "pattern string, label string")
    empty = spark.createDataFrame([], "host string, site string, sessions string")
    assert rows(reconcile.coverage_totals(rules, empty)) == [(0, 0, 2, 1, 0, 0.0)]
    assert rows(reconcile.coverage_gaps(rules, empty)) == [("in_tag_no_first", "A")]


def test_outside_files(spark, rows):
    resources = spark.createDataFrame([("rules", 1, "rules/r1/"), ("data_elements", 2, "data-elements/d2.json"), ("rules", 3, "rules/r3")], "type string, id int, path string")
    scope = spark.createDataFrame([("rules", 3)], "type string, id int")
    files = spark.createDataFrame([(p,) for p in ("rules/r1/x/y.json", "rules/r10/x.json", "data-elements/d2.json", "data-elements/d2.code.js", "data-elements/d20.json", "rules/r3/a.json")], "path string")
    outside = reconcile.outside_scope(resources, scope)
    found = reconcile.outside_files(outside, files)
    assert rows(found, "path") == [("data-elements/d2.code.js",), ("data-elements/d2.json",), ("rules/r1/x/y.json",)]
    assert rows(reconcile.folder_counts(found)) == [("data_elements", 2), ("rules", 1)]


def test_only_owners_of_many_files_are_copied(spark):
    """Rows that the join of files and owners sorts grow with the files, but for the copies of a hot folder's owner."""
    owned = spark.range(2000).select(F.lit("elements").alias("type"), F.col("id"), F.concat(F.lit("elements/"), "id", F.lit(".json")).alias("path"))
    hot = spark.createDataFrame([("rules", 0, "rules/hot/"), ("elements", 1, "plain")], "type string, id long, path string")
    found = owned.select("path").union(spark.range(3000).select(F.concat(F.lit("rules/hot/f"), "id"))).union(spark.range(500).select(F.concat(F.lit("other/x/y."), "id")))
    found = found.union(spark.createDataFrame([("plain",), ("plain.js",), (None,)], "path string"))
    offered, owners = reconcile.offers_and_owners(owned.union(hot), found)
    # one prefix of each file, and of the two that begin like the path without extension also "same" and "dotted"
    assert offered.count() <= 2000 + 3000 + 4
    assert 2003 + reconcile.SALTS - 1 <= owners.count() < 2 * 2003
    assert {r.salt for r in offered.where("prefix = 'rules/hot'").collect()} == set(range(reconcile.SALTS))
    kept = [r.path for r in reconcile.outside_files(owned.union(hot), found).collect()]
    assert len(kept) == 5002 and {"plain", "plain.js", "rules/hot/f7", "elements/9.json"} <= set(kept)


# ---------------------------------------------------------------- keyed merges and retention


def test_upsert(spark, rows):
    old = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "z", 1), (2, "y", 2), (None, "m", 1)], "k int, v string, at int")
    assert rows(sinks.upsert(old, new, ["k"], order="at", sort_by=["k"])) == [(1, "a", None), (2, "y", 2), (None, "m", 1)]
    assert rows(sinks.upsert(old, new.limit(0), ["k"]), F.asc_nulls_last("k")) == [(1, "a", None), (2, "b", None), (None, "n", None)]
    assert rows(sinks.insert_new(old, new.select("k", "v"), ["k"]), "v") == rows(old, "v")
    assert sinks.insert_new(old, new).count() == 6


def test_replace_groups(spark, rows):
    old = spark.createDataFrame([(" 202601 ", "a", 1), ("202602", "a", 2)], "month string, site string, n int")
    new = spark.createDataFrame([(202601, "a"), (202601, "b")], "month int, site string")
    out = sinks.replace_groups(old, new, ["month", "site"], columns=["month", "site", "n"], sort_by=["month", "site"])
    assert rows(out) == [("202601", "a", None), ("202601", "b", None), ("202602", "a", "2")] or rows(out) == [("202601", "a", None), ("202601", "b", None), ("202602", "a", 2)]


def test_retention(spark, rows):
    log = spark.createDataFrame([(1, "2025-01-01"), (2, "2025-01-02"), (3, ""), (4, "2024-01-01"), (5, "2025-02-01")], "seq int, day string")
    assert [r[0] for r in rows(retention.trim_older_than(log, seq="seq", day="day", max_age_days=3, today=date(2025, 2, 1)), "seq")] == [3, 4, 5]
    assert retention.trim_older_than(log.filter("seq < 3"), seq="seq", day="day", max_age_days=3, today=date(2025, 2, 1)).count() == 0
    assert [r[0] for r in rows(retention.keep_last(log, seq="seq", max_rows=5, keep_rows=2), "seq")] == [4, 5]
    assert retention.keep_last(log, seq="seq", max_rows=6, keep_rows=2).count() == 5
    sparse = spark.range(0, 3_000_000_000, 1_234_567).withColumnRenamed("id", "seq")
    assert retention.keep_last(sparse, seq="seq", max_rows=10, keep_rows=901).count() == 901
    with pytest.raises(ValueError, match="layout"):
        retention.migrate_rows(log, ["a", "b"], [{"x": "a"}])


# ---------------------------------------------------------------- display


def test_display(spark, rows):
    df = spark.createDataFrame([("2025-1-3", 1.0, 0.125, "7"), ("Jan 4, 2025", 2.0, 1.5, None), ("x", None, 2.0, "1234.5")], "d string, n double, p double, c string")
    out = display.format_table(df, hints={"p": "percent", "c": "currency", "d": "date"}, decimals=1)
    assert rows(out) == [("2025-01-03", "1", "12.5%", "7.0"), ("2025-01-04", "2", "150.0%", ""), ("x", "", "2.0%", "1,234.5")]
    assert rows(display.format_table(df.select("d")))[0] == ("2025-1-3",)
    assert display.time_axis(df) is None
    assert display.time_axis(df.select(F.lit("2025-01-01").alias("Weekday"), F.lit("2025-01-01").alias("a"))) == "Weekday"
    assert display.time_axis(df.select("n")) is None


# ---------------------------------------------------------------- files


def test_files(spark, rows, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([(1, 'a "x", b'), (2, None)], "i int, t string")
    assert sinks.write_result(df, path) == 2 and sinks.write_result(df, path, "append") == 2
    assert rows(readers.read_result(spark, path, "i int, t string"), "i")[0] == (1, 'a "x", b')
    with pytest.raises(ValueError):
        sinks.write_result(df, path, "replace")
    with pytest.raises(ValueError):
        sinks.write_table(df, path, "errorifexists")
    (tmp_path / "bom.csv").write_bytes("﻿i,t\n5,é\n".encode())
    assert rows(readers.read_result(spark, str(tmp_path / "bom.csv"), "i int, t string")) == [(5, "é")]
    (tmp_path / "skip.csv").write_text("note\nmore\n1,a\n2,b\n")
    assert sinks.load_delimited(spark, str(tmp_path / "skip.csv"), str(tmp_path / "t"), "i int, t string", skip_lines=2) == 2
    (tmp_path / "k.tsv").write_text("Key\tv\tn\n a \tx\t1\n\ty\t2\na\tz\t3\n")
    assert rows(readers.read_key_value_tsv(spark, str(tmp_path / "k.tsv"), ["v"], order="n")) == [("a", "z")]
    assert sinks.evolve_schema({"a": "int"}, {"a": "string", "b": "date"}) == {"a": "int", "b": "date"}
