"""Beacon and JSON operators on small documents; hot sessions; streams."""

import json

import pytest

from webtables.operators import beacons, retention
from webtables.streaming import jobs


def event(**xdm):
    return {"xdm": xdm}


def payload_frame(spark, *bodies):
    return spark.createDataFrame([(i, 1, json.dumps(b) if not isinstance(b, str) else b) for i, b in enumerate(bodies)], "seq int, session_id int, payload string")


RICH = event(
    eventType="commerce.purchases",
    web={"webPageDetails": {"name": "Cart"}},
    _experience={"analytics": {"channel": "web", "productString": ";p1", "event1to100": {}, "event101to200": {"event150": {"value": 1}}, "event201to300": {"event250": {"value": 2}},
                               "customDimensions": {"eVars": {"eVar1": "x"}, "props": {}}}},
    productListItems=[{"SKU": "s1", "quantity": 2}, {"SKU": "s2", "_experience": {"analytics": {"customDimensions": {"eVars": {"eVar8": "m"}}}}}],
    identityMap={"renkeiid": [{"id": "me"}]},
    data={"currentTime": "09:00"},
)


def test_extract_variants(spark):
    df = payload_frame(spark, {"events": [event(eventType="plain"), RICH]}, "broken", {"events": []})
    found = beacons.as_json_text(beacons.extract_edge_events(df)).orderBy("seq", "pos").collect()
    assert [(r["seq"], r["pos"], r["eventType"]) for r in found] == [(0, 0, "plain"), (0, 1, "commerce.purchases")]
    rich = found[1]
    assert (rich["pageName"], rich["products"], rich["renkeiid"], rich["currentTime"]) == ("Cart", ";p1", "me", "09:00")
    assert json.loads(rich["events"]) == {"event150": {"value": 1}} and rich["props"] is None
    assert json.loads(rich["merchandisingEVars"]) == {"item": [{}, {"eVar8": "m"}]}
    first = beacons.as_json_text(beacons.extract_first_event(df)).collect()
    assert len(first) == 1 and json.loads(first[0]["events"]) == {"event250": {"value": 2}}
    few = beacons.extract_edge_events(df, fields=["pageName", "eVars"])
    assert few.columns == ["seq", "session_id", "pos", "pageName", "eVars"]


def test_best_beacon_prefers_rich_then_late(spark):
    poor = event(eventType="e", web={"webPageDetails": {"name": "Cart"}})
    df = payload_frame(spark, {"events": [RICH]}, {"events": [poor]}, {"events": [RICH, poor]})
    best = beacons.best_beacon(beacons.extract_edge_events(df), page_pattern="^Ca").collect()
    # 2 for name, type, products and identity; 3 for eVar1, SKU and quantity
    assert [(b["seq"], b["pos"], b["score"]) for b in best] == [(2, 0, 8 + 9)]
    rejected = beacons.rejected_beacons(beacons.extract_edge_events(df), [{"key": "productListItems[1].SKU", "op": "equals", "value": "s2"}], limit=1).collect()
    assert [(r["seq"], r["pos"], r["failed"]) for r in rejected] == [(2, 1, ["productListItems[1].SKU equals"])]


CHECKS = [
    ("exists", "a.b", None, True), ("exists", "e", None, False), ("empty", "e", None, True), ("empty", "no", None, True), ("equals", "n", 1, True), ("equals", "n", 1.0, True), ("equals", "n", "1", False),
    ("equals", "t", True, True), ("equals", "a.b", "x'y", True), ("contains", "l", "q", True), ("contains", "l", "Q", False), ("includes", "a.b", "'", True), ("includes", "n", 1, True),
    ("matches", "a.b", "^x.y$", True), ("matches", "no", ".", False), ("exists", "l[1]", None, True), ("exists", "l[5]", None, False), ("equals", "a", {"b": "x'y"}, True), ("nosuch", "n", 1, False),
    ("equals", "z", None, True),
]


@pytest.mark.parametrize("op,key,value,expected", CHECKS)
def test_requirements(spark, op, key, value, expected):
    df = spark.createDataFrame([(json.dumps({"a": {"b": "x'y"}, "e": [], "n": 1, "t": True, "l": ["p", "q"], "z": None}),)], "doc string")
    row = beacons.requirement_check(df, "doc", [{"key": key, "op": op, "value": value}]).first()
    assert row["satisfied"] is expected and (row["failed"] == []) is expected


def test_contract_reasons(spark):
    doc = {"s": "　", "n": 1, "f": 1.5, "b": True, "l": [1], "o": {}, "z": None}
    rules = [{"path": "s", "type": "string", "nonEmpty": True}, {"path": "n", "type": "number"}, {"path": "b", "type": "number"}, {"path": "f", "type": "string"}, {"path": "n", "type": "array"},
             {"path": "l", "minItems": 2}, {"path": "o", "minItems": 1}, {"path": "z", "type": "object"}, {"path": "o.x"}, {"path": "n", "type": "date"}, {"path": "l", "type": "array", "minItems": 1}]
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, None)], "i int, doc string")
    found = beacons.contract_check(df, "doc", rules).collect()
    assert [r["reason"] for r in found if r["i"] == 1] == [
        "empty string", "ok", "ok", "type mismatch: expected string, got float", "type mismatch: expected array, got int", "array length 1 < minItems 2",
        "minItems set but value is not an array", "type mismatch: expected object, got NoneType", "missing path", "unsupported contract type: date", "ok"]
    assert [(r["path"], r["reason"]) for r in found if r["i"] == 2] == [("data", "data is undefined")]
    summary = beacons.contract_summary(beacons.contract_check(df, "doc", rules[1:3]), ["i"])
    assert sorted((r["i"], r["ok"]) for r in summary.collect()) == [(1, True), (2, False)]


def test_parse_beacons(spark):
    df = spark.createDataFrame(
        [("https://x.example/b/ss/suite/1?v1=a&v1=b&v2=&v3=x+y%20z", "v1=body&bad"), ("https://x.example/b/ss/", None), ("https://x.example/other?a=1", None), ("https://x.example/b/ss/s2?novalue", "?v=1")],
        "url string, body string")
    found = [r["variables"] for r in beacons.parse_beacons(df).collect()]
    assert found == [{"v1": "body", "bad": "", "rsid": "suite", "v2": "", "v3": "x y z"}, {"rsid": ""}, {"v": "1", "rsid": "s2"}]


def test_redaction(spark):
    doc = {"auth": "a\"b", "list": [{"API_KEY": "k", "n": 1}], "token": 5, "note": "password", "inner": "{\"secret\": \"s\"}", "passwd": {"x": "y"}}
    df = spark.createDataFrame([(json.dumps(doc),)], "d string")
    found = json.loads(beacons.redact_json(df, "d").first()["d"])
    assert found == {**doc, "auth": "***REDACTED***", "list": [{"API_KEY": "***REDACTED***", "n": 1}]}


def test_delivery(spark):
    option = {"responseTokens": {"activity.id": "17", "recommendation.criteria.title": " Top "}, "content": json.dumps({"recs": {"activity": {"criteria.title": "no", "algorithm.name": "A"}}})}
    doc = {"deliveries": [{"prefetch": {"mboxes": [{"name": "m", "options": [option, {"content": {"recs": {"activity": {"design": "D", "campaign.id": "n/a"}}}}]}]}}]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps([{"execute": {"mboxes": [{"name": "e"}, {"name": ""}]}}])), (3, "no")], "i int, d string")
    assert sorted(tuple(r) for r in beacons.delivery_scope(df, "d").collect()) == [("activity", "17"), ("criteria", "A"), ("criteria", "Top"), ("design", "D")]
    flat = spark.createDataFrame([(json.dumps({"execute": {"mboxes": [{"name": "b"}, {"name": "a"}]}, "prefetch": {"mboxes": [{"name": "b"}, {"name": "c"}, {"name": 4}]}}),), ("[]",)], "d string")
    assert [r["mbox_names"] for r in beacons.mbox_names(flat, "d").collect()] == [["b", "a", "c"], []]


def test_chunks_drop_broken_runs(spark):
    parts = [("a", 1, 2, "y"), ("a", 0, 2, "x"), ("gap", 0, 3, "g"), ("gap", 2, 3, "g"), ("twice", 0, 2, "t"), ("twice", 0, 2, "t"), ("off", 1, 2, "o"), ("off", 2, 2, "o"), ("one", 0, 1, None)]
    df = spark.createDataFrame(parts, "run_id string, part_index int, part_count int, part string")
    assert sorted(tuple(r) for r in beacons.reassemble_chunks(df).collect()) == [("a", "xy"), ("one", "")]


@pytest.fixture(params=[1, 7, 60])
def many_ranges(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_keep_last_cuts_inside_any_range(spark, many_ranges):
    df = spark.createDataFrame([(i % 40, f"t{i}") for i in range(200)] + [(None, "n")], "seq int, t string").repartition(5)
    newest = sorted(((r.seq is not None, r.seq or 0, r.t) for r in df.collect()))
    for keep in (1, 2, 57, 199, 200):
        found = sorted(((r.seq is not None, r.seq or 0, r.t) for r in retention.keep_last(df, seq="seq", max_rows=100, keep_rows=keep).collect()))
        assert found == (newest[-keep:] if 202 - keep >= 2 else newest), keep


def test_parts_of_a_long_run_stay_rows(spark, many_ranges):
    parts = [("long", i, 300, "x" * (i % 7)) for i in range(300)] + [("one", 0, 1, None), ("gap", 1, 2, "g")]
    df = spark.createDataFrame(parts, "run_id string, part_index int, part_count int, part string").repartition(4)
    found = beacons.ordered_parts(df).orderBy("run_id", "part_index").collect()
    text, = [r.payload for r in beacons.reassemble_chunks(df).collect() if r.run_id == "long"]
    assert [r.run_id for r in found] == ["long"] * 300 + ["one"]
    assert all(text[r.offset : r.offset + len(r.part)] == r.part for r in found[:300]) and found[-1].offset == 0


def test_drop_repeats_equals_a_loop(spark, many_ranges):
    """A session holding most rows is cut into ranges without changing the result."""
    rows = [("hot", i * 3, (i // 2) % 3 if i % 5 else None) for i in range(300)] + [("cold", i, i % 2) for i in range(5)] + [(None, 1, 1), (None, 2, 1)]
    expected, last = [], {}
    for session, seq, value in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if session not in last or last[session] != value:
            expected.append((session, seq, value))
        last[session] = value
    df = spark.createDataFrame(rows, "s string, seq int, v int").repartition(5)
    found = beacons.drop_repeats(df, session="s", order="seq", compare=["v"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_upsert_stream_restart_and_compaction(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def add(*rows):
        spark.createDataFrame(rows, "k int, v string, at int").coalesce(1).write.mode("append").parquet(source)
        updates = spark.readStream.schema("k int, v string, at int").parquet(source)
        jobs.upsert_stream(updates, target, state, ["k"], "at").awaitTermination()

    add((1, "a", 1), (1, "b", 2), (2, "c", 1))
    add((2, "d", 0), (3, "e", 1))
    wanted = [(1, "b", 2), (2, "d", 0), (3, "e", 1)]
    assert sorted(map(tuple, jobs.read_upserted(spark, target, ["k"]).collect())) == wanted
    jobs.compact(spark, target, str(tmp_path / "compact"), ["k"])
    assert sorted(map(tuple, jobs.read_upserted(spark, str(tmp_path / "compact"), ["k"]).collect())) == wanted
