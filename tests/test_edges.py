"""Inputs that regular tables do not hold: ties, nulls, empty frames, shared names, times without a unit, no limits."""

import json
import shutil
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from webtables.operators import beacons, chain, channels, display, profile, reconcile, reports, retention, search
from webtables.sources import readers, sinks
from webtables.streaming import jobs


def test_no_report_is_cut_unless_asked(spark):
    facts = spark.range(30_000).select(F.concat(F.lit("p"), "id").alias("page"), F.col("id").alias("clicks"), F.lit(1).alias("impressions"), F.lit(1.0).alias("position"))
    assert reports.report(facts, ["page"], {"n": "count:*"}).count() == 30_000
    assert reports.report_ranked(facts, "page", {"n": "sum:clicks"}).first().page == "p29999"
    assert reports.report_ranked(facts, "page", {"n": "sum:clicks"}).count() == 30_000
    assert reports.breakdown(facts, {"impressions": 1}, "page", {"n": "count:*"}).count() == 30_000
    assert reports.search_report(facts, ["page"]).count() == 30_000
    assert profile.top_values(facts.select("page")).count() == 30_000
    sites = facts.select(F.lit("h").alias("host"), F.col("page").alias("path"), F.lit("(not set)").alias("site"), F.lit(1).alias("sessions"))
    assert reconcile.unclassified_pages(sites).count() == 30_000
    cells = facts.select("page", F.lit(1).alias("x"), "clicks")
    assert display.series_totals(cells, "x", "clicks", "page").count() == 30_000 and display.series_totals(cells, "x", "clicks", "page", limit=7).count() == 7
    for wrong in (0, -1):
        with pytest.raises(ValueError):
            reports.report(facts, ["page"], {"n": "count:*"}, limit=wrong)
        with pytest.raises(ValueError):
            reports.template_search(facts, limit=wrong)


def test_template_search_windows(spark):
    rows = [(i, f"n{i}", "o", "s", datetime(2026, 1, i), date(2025, 12, i) if i != 4 else None) for i in range(1, 9)]
    items = spark.createDataFrame(rows, "id long, name string, owner string, status string, updated timestamp, created date")
    found = lambda **a: [r.id for r in reports.template_search(items, **a).collect()]
    assert found(updated_after="2026-01-03", updated_before="2026-01-05") == [5, 4, 3]
    assert found(created_after="2025-12-03", created_before="2025-12-05") == [5, 3] and len(found()) == 8 and found(limit=2) == [8, 7]


def test_merges_skip_empty_frames_and_suffix_shared_metrics(spark, rows):
    a = spark.createDataFrame([("p", 1), (None, 2)], "k string, n int")
    b = spark.createDataFrame([("p", 5)], "k string, n int")
    empty = b.filter("false")
    assert reports.merge_reports([a, empty], "k", how="inner").columns == ["k", "n"] and reports.merge_reports([a, empty], "k", how="inner").count() == 2
    assert reports.merge_reports([a, b], "k").columns == ["k", "n_x", "n_y"]
    assert rows(reports.outer_merge_reports([a, empty], "k"), "k") == [(None, 2, None), ("p", 1, None)]
    for missing in ([None, a], []):
        out = reports.merge_reports(missing, "k")
        assert out.columns == [] and out.count() == 0


def test_search_keeps_clicks_without_a_page(spark, rows):
    df = spark.createDataFrame([(None, "q", 3, 10), ("https://x/a", "q", 2, 5), (None, "q", 4, 1), ("https://x/a", None, 9, 9)], "page string, query string, clicks int, impressions int")
    assert rows(search.search_aggregate(df).select("page", "clicks"), F.asc_nulls_first("page"))[0] == (None, 7)


def test_threshold_rules_are_counted_when_the_query_runs(spark):
    df = spark.createDataFrame([("a", 0, 1, 60.0), ("b", 1, 1, 1.0)], "site string, clicks int, impressions int, position double")
    none = spark.createDataFrame([], "site string")
    assert search.threshold_filter(df, none).count() == 2 and search.threshold_filter(df, none).columns == df.columns
    assert [r.site for r in search.threshold_filter(df, spark.createDataFrame([("b",)], "site string")).collect()] == ["b"]


def test_keep_last_of_any_key(spark):
    times = spark.createDataFrame([(datetime(2026, 1, d), x) for d, x in ((1, "a"), (2, "b"), (2, "c"), (3, "d"))] + [(None, "e")], "at timestamp, x string")
    assert sorted(r.x for r in retention.keep_last(times, seq="at", max_rows=4, keep_rows=2).collect()) == ["c", "d"]
    texts = spark.createDataFrame([("b",), ("a",), (None,)], "k string")
    assert sorted(r.k for r in retention.keep_last(texts, seq="k", max_rows=2, keep_rows=2).collect()) == ["a", "b"]
    assert retention.keep_last(texts, seq="k", max_rows=9, keep_rows=1).count() == 3


def test_repeats_after_a_null_order_and_over_times(spark):
    df = spark.createDataFrame([("s", None, "x"), ("s", 5, "x"), ("s", 250_000, "x"), ("s", 250_001, "y"), ("s", 250_001, "y")], "s string, n long, v string")
    assert sorted(r.v for r in beacons.drop_repeats(df, session="s", order="n", compare=["v"]).collect()) == ["x", "y"]
    at = df.select("s", F.timestamp_seconds(F.col("n")).alias("n"), "v")
    assert sorted(r.v for r in beacons.drop_repeats(at, session="s", order="n", compare=["v"]).collect()) == ["x", "y"]


def test_numeric_date_is_the_axis(spark):
    saved = spark.createDataFrame([(20260101, "a"), (20260102, "b")], "date int, page string")
    assert display.time_axis(saved) == "date"
    assert display.time_axis(spark.createDataFrame([(7, "a")], "date int, page string")) is None


def test_late_record_does_not_replace_a_newer_one(spark, tmp_path):
    table = f"{tmp_path}/t"
    spark.createDataFrame([("k", 5, "new")], "k string, at int, v string").write.parquet(f"{table}/batch=0")
    spark.createDataFrame([("k", 2, "late")], "k string, at int, v string").write.parquet(f"{table}/batch=1")
    assert jobs.read_upserted(spark, table, ["k"], "at").first().v == "new"
    assert jobs.read_upserted(spark, table, ["k"]).first().v == "late"


def test_long_rule_lists_are_a_choice_by_name(spark):
    df = spark.createDataFrame([("a1",), ("b",)], "v string")
    rules = [(f"^a{i}$", str(i)) for i in range(300)]
    assert sorted(channels.pattern_map(df, "v", rules).collect()) == sorted(channels.pattern_map_distinct(df, "v", rules).collect())


def test_quoted_line_breaks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'two\nlines "quoted", and more'), (2, "plain"), (3, None)], "id int, t string")
    sinks.write_result(df, f"{tmp_path}/r")
    assert sorted(map(tuple, readers.read_result(spark, f"{tmp_path}/r", "id int, t string").collect())) == sorted(map(tuple, df.collect()))
    assert sinks.load_delimited(spark, f"{tmp_path}/r", f"{tmp_path}/loaded", "id int, t string") == 3
    (tmp_path / "k.tsv").write_text('Key\tlabel\na\t"one\ntwo"\nb\tx\n')
    assert sorted(map(tuple, readers.read_key_value_tsv(spark, f"{tmp_path}/k.tsv", ["label"]).collect())) == [("a", "one\ntwo"), ("b", "x")]


def test_chain_reads_only_what_it_sorts_by_or_shows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = chain.result_chain(df, order="value DESC", columns="event_type", rows=3)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_type:string,value:double>" in plan or "ReadSchema: struct<value:double,event_type:string>" in plan
    merged = sinks.upsert(df, df.limit(5), ["event_id"])
    assert "rangepartitioning" not in merged._jdf.queryExecution().toString()


@pytest.mark.parametrize("parse", [
    lambda df: chain.parse_transforms("id"), lambda df: chain.parse_transforms("id:what"), lambda df: chain.parse_transforms(" , "), lambda df: chain.parse_transforms(":url_decode"),
    lambda df: chain.sort_columns(df, "id up"), lambda df: chain.sort_columns(df, "no"), lambda df: chain.sort_columns(df, "id desc asc"),
    lambda df: chain.parse_aggregates(df, "sum:id,sum:id"), lambda df: chain.parse_aggregates(df, "sum:"), lambda df: chain.parse_aggregates(df, "sum:no"), lambda df: chain.parse_aggregates(df, "avg:id"),
])
def test_notations_refuse_what_they_cannot_read(spark, parse):
    with pytest.raises(ValueError):
        parse(spark.range(1))


def test_empty_key_is_the_whole_record(spark):
    payload = '{"events":[{"xdm":{"eventType":"view","_experience":{"analytics":{"channel":"c"}}}}]}'
    events = beacons.extract_edge_events(spark.createDataFrame([("s", 1, payload)], "session_id string, seq int, payload string"))
    assert beacons.best_beacon(events, requirements=[{"key": "", "op": "exists"}]).count() == 1
    assert beacons.best_beacon(events, requirements=[{"key": "", "op": "empty"}]).count() == 0


def test_rule_lists_need_a_list_and_text(spark, rows):
    docs = ['{"key":"a","value":"b"}', '[{"key":5,"value":"b"},{"key":"","pattern":" p ","value":0,"output":"x"},{"key":"q","value":["y"]},7,null]', "not json", None, "[]"]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    assert rows(channels.list_rules(df, "doc").select("pattern", "label")) == [("p", "x")]


def test_contract_paths_are_plain_keys_and_null_is_undefined(spark):
    df = spark.createDataFrame([(1, '{"a":[1],"a[0]":"x","b":{"c d":2}}'), (2, "null"), (3, "broken")], "i int, doc string")
    rules = [{"path": "a[0]", "type": "string"}, {"path": "b.c d", "type": "number"}, {"path": "a.0"}, {"path": ""}]
    found = beacons.contract_check(df, "doc", rules).collect()
    assert [r.reason for r in found if r.i == 1] == ["ok", "ok", "missing path", "missing path"]
    assert [r.reason for r in found if r.i != 1] == ["data is undefined"] * 2


def test_first_event_names_its_items(spark):
    item = '{"_experience":{"analytics":{"customDimensions":{"eVars":{"eVar8":"m"}}}}}'
    payload = f'{{"events":[{{"xdm":{{"commerce":{{"p":1}},"productListItems":[{{}},{item},{{"_experience":1}}]}}}},{{"xdm":{{"commerce":{{"p":2}}}}}}]}}'
    first = beacons.extract_first_event(spark.createDataFrame([(1, payload)], "seq int, payload string"))
    assert json.loads(first.select(F.to_json("merchandisingEVars")).first()[0]) == {"item[1]": {"eVar8": "m"}}
    bare = beacons.extract_first_event(spark.createDataFrame([(1, payload.replace("eVar8", "x").replace('"x":"m"', ""))], "seq int, payload string"))
    assert bare.select("merchandisingEVars").first()[0] is None


def test_a_fresh_checkpoint_keeps_stored_rows(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")

    def run(state, *rows):
        spark.createDataFrame(rows, "k int, v string, at int").coalesce(1).write.mode("overwrite").parquet(source)
        updates = spark.readStream.schema("k int, v string, at int").parquet(source)
        jobs.upsert_stream(updates, table, str(tmp_path / state), ["k"]).awaitTermination()

    run("one", (1, "a", 1), (2, "b", 1))
    run("two", (2, "c", 1), (3, "d", 1))
    assert sorted(tuple(r)[:2] for r in jobs.read_upserted(spark, table, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    shutil.rmtree(tmp_path / "two" / "commits")  # the last batch of the second query is done again
    run("two", (2, "c", 1), (3, "d", 1))
    assert len(list((tmp_path / "out").glob("query=*"))) == 2
    assert sorted(tuple(r)[:2] for r in jobs.read_upserted(spark, table, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


@pytest.mark.parametrize("line_breaks", [True, False])
def test_leading_lines_are_skipped_in_every_file(spark, tmp_path, line_breaks):
    cell = '"two\nlines"' if line_breaks else '"a ""quoted"" one"'
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(f"# made by, a tool, x\n\nid,t\n1,{cell}\n2,plain\n")
    loaded = str(tmp_path / "t")
    assert sinks.load_delimited(spark, f"{tmp_path}/*.csv", loaded, "id int, t string", skip_lines=3, line_breaks=line_breaks) == 4
    wanted = "two\nlines" if line_breaks else 'a "quoted" one'
    assert sorted(map(tuple, spark.read.parquet(loaded).collect())) == [(1, wanted), (1, wanted), (2, "plain"), (2, "plain")]


def test_key_values_without_line_breaks_can_be_split(spark, tmp_path):
    (tmp_path / "k.tsv").write_text("Key\tlabel\na\tone\nb\tx\n")
    plan = readers.read_key_value_tsv(spark, str(tmp_path / "k.tsv"), ["label"], line_breaks=False)
    assert sorted(map(tuple, plan.collect())) == [("a", "one"), ("b", "x")]


def test_versions_compare_as_their_texts(spark):
    texts = [None, "", "a", " a", "a ", "b"]
    rows = [(f"{i}-{j}-{k}", x, y, z) for i, x in enumerate(texts) for j, y in enumerate(texts) for k, z in enumerate(texts)]
    df = spark.createDataFrame(rows, "path string, base string, local string, remote string")
    sides = [df.select("path", df[n].alias("text")).where("text IS NOT NULL") for n in ("base", "local", "remote")]
    united = reconcile.three_way_compare(reconcile.unite_versions(*sides))
    wanted = {r.path: r.action for r in united.collect()}
    assert {r.path: r.action for r in reconcile.compare_versions(*sides).collect()} == wanted and len(set(wanted.values())) == 7
    assert sorted(map(tuple, reconcile.conflicts(*sides).collect())) == sorted(map(tuple, reconcile.conflict_records(united).collect()))


def test_first_requests_of_a_session_do_not_count(spark):
    payload = lambda name, n: f'{{"events":[{{"xdm":{{"eventType":"v","web":{{"webPageDetails":{{"name":"{name}"}}}},"commerce":{{"purchases":{{"value":{n}}}}}}}}}]}}'
    rows = [("s", k, payload(f"p{k}", k)) for k in range(5)] + [("t", 0, payload("p0", 1)), ("u", 0, "broken"), ("u", 1, payload("p1", 2))]
    df = spark.createDataFrame(rows, "session_id string, seq int, payload string")
    checks = [{"key": "commerce.purchases.value", "op": "equals", "value": 1}]
    assert [(r.session_id, r.seq) for r in beacons.best_beacon(df, requirements=checks).orderBy("session_id").collect()] == [("s", 1), ("t", 0)]
    assert beacons.best_beacon(df, requirements=checks, start_index=2).count() == 0
    rejected = beacons.rejected_beacons(df, checks, start_index=1).orderBy("session_id", "reject_rank").collect()
    assert [(r.session_id, r.seq) for r in rejected] == [("s", 4), ("s", 3), ("s", 2), ("u", 1)]
    assert [tuple(f) for f in rejected[0].failures] == [("commerce.purchases.value", "equals", "1", "4")]
    assert rejected[0].commerce == '{"purchases":{"value":4}}' and rejected[0].eVars is None
    with pytest.raises(ValueError):
        beacons.best_beacon(beacons.extract_edge_events(df), start_index=1)
