"""Beacon requests and JSON payload logs: extraction, checks and best matches."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules as R, text, urls, variants as V
from . import ranges

# Headers that are stable between runs.
STABLE_HEADERS = ("content-type", "x-request-id", "x-trace-id", "date")

# Words that mark a JSON key as sensitive, and the replacement of its text.
SENSITIVE_WORDS = "password|passwd|secret|token|api_key|apikey|auth|credential|username"
REDACTED = "***REDACTED***"

# Event buckets of an analytics payload, in the order in which they are looked at.
EVENT_BUCKETS = ("event1to100", "event101to200", "event201to300")

# Paths that add to the richness score of a beacon.
SCORE_PATHS = (
    "commerce.productViews.value",
    "commerce.productListAdds.value",
    "commerce.productListViews.value",
    "commerce.purchases.value",
    "commerce.order.purchaseID",
    "events.event11.value",
    "events.event12.value",
    "events.event13.value",
    "events.event14.value",
    "events.event15.value",
    "events.event16.value",
    "events.event17.value",
    "props.prop5",
    "props.prop6",
    "props.prop8",
    "props.prop9",
    "props.prop34",
    "props.prop74",
    "eVars.eVar1",
    "eVars.eVar55",
    "eVars.eVar61",
    "productListItems[0].SKU",
    "productListItems[0].quantity",
    "productListItems[0].priceTotal",
    "merchandisingEVars.item[0].eVar8",
    "merchandisingEVars.item[0].eVar9",
    "merchandisingEVars.item[0].eVar23",
    "merchandisingEVars.item[0].eVar24",
    "merchandisingEVars.item[0].eVar63",
    "merchandisingEVars.item[0].eVar64",
    "merchandisingEVars.item[0].eVar65",
    "merchandisingEVars.item[0].eVar68",
    "productListItems[0]._experience.analytics.customDimensions.eVars.eVar24",
    "productListItems[0]._experience.analytics.customDimensions.eVars.eVar68",
)
SCORE_FIELDS = ("pageName", "eventType", "products", "renkeiid")

IDENTITY_NAMESPACE = "renkeiid"
VISITOR_NAMESPACE = "ECID"


# ---------------------------------------------------------------- request logs


def parse_beacons(df: DataFrame, url: str = "url", body: str = "body", output: str = "variables") -> DataFrame:
    """Variables of ``b/ss`` requests as a map: report suite, then query, then body; the body wins.

    The first value of a repeated key counts, blank values are kept, other requests are dropped.
    """
    rows = df.filter(F.col(url).contains("b/ss/"))
    segments = F.split(urls.page_to_path(url), "/")
    place = F.array_position(segments, "ss")
    suite = F.when(place > 0, F.try_element_at(segments, (place + 1).cast("int")))
    suite_pair = F.when(
        suite.isNotNull(), F.array(F.struct(F.lit("rsid").alias("name"), suite.alias("value")))
    ).otherwise(F.array().cast("array<struct<name:string,value:string>>"))

    def pairs(form: Column) -> Column:
        plain = F.ltrim(F.coalesce(form, F.lit("")), F.lit("?"))
        return urls.form_pairs(F.when(plain.contains("="), plain).otherwise(""), with_position=False)

    rows = rows.withColumn("__all", F.concat(pairs(F.col(body)), pairs(urls.url_query(url)), suite_pair))
    firsts = F.filter("__all", lambda p, i: F.array_position(F.col("__all.name"), p["name"]) == i + 1)
    return rows.withColumn(output, F.map_from_entries(firsts)).drop("__all")


def pick_headers(df: DataFrame, column: str, names: Sequence[str] = STABLE_HEADERS) -> DataFrame:
    """Keep only stable keys of a header map."""
    return df.withColumn(column, F.map_filter(column, lambda k, _: k.isin(list(names))))


def redact_json(df: DataFrame, column: str) -> DataFrame:
    """Replace text under sensitive keys of a JSON text, at any depth, without parsing it."""
    key = rf'((?<!\\)"[^"\\]*(?i:{SENSITIVE_WORDS})[^"\\]*"\s*:\s*)"(?:[^"\\]|\\.)*"'
    return df.withColumn(column, F.regexp_replace(column, "(?s)" + key, rf'$1"{REDACTED}"'))


# ---------------------------------------------------------------- edge payloads

VARIANT_FIELDS = ("events", "eVars", "props", "data", "commerce", "productListItems", "merchandisingEVars")
TEXT_FIELDS = ("pageName", "eventType", "channel", "products", "currentTime", "currentDate", "renkeiid")
FIELDS = (*TEXT_FIELDS, *VARIANT_FIELDS)

_ANALYTICS = "xdm._experience.analytics"

# What is read of an event, in one pass over its document. Parts of unknown shape stay variants; a part of another type
# than declared is null and leaves the others as they are.
EVENT_TYPE = (
    "STRUCT<data:VARIANT,xdm:STRUCT<data:VARIANT,eventType:STRING,web:STRUCT<webPageDetails:STRUCT<name:STRING>>,commerce:VARIANT,"
    "productListItems:VARIANT,identityMap:VARIANT,_experience:STRUCT<analytics:STRUCT<channel:STRING,productString:STRING,"
    + "".join(f"{bucket}:VARIANT," for bucket in EVENT_BUCKETS)
    + "customDimensions:STRUCT<eVars:VARIANT,props:VARIANT>>>>>"
)


def _bucket(event: str, names: Sequence[str]) -> str:
    """First of the named event buckets that is a non-empty object."""
    values = [f"{event}.{_ANALYTICS}.{name}" for name in names]
    return "coalesce(" + ", ".join(f"if({V.filled_object(v)}, {v}, NULL)" for v in values) + ")"


def _merchandising(event: str, by_name: bool = False) -> str:
    """eVars of each product item, null when no item has any: a list with one place per item, or items by name."""
    items = V.members(f"{event}.xdm.productListItems")
    found = V.at("item", "_experience.analytics.customDimensions.eVars")
    if by_name:
        named = f"transform({items}, (item, i) -> named_struct('name', concat('item[', i, ']'), 'eVars', {found}))"
        filled = f"filter({named}, n -> {V.filled_object('n.eVars')})"
        return f"if(size({filled}) > 0, to_variant_object(map_from_entries({filled})), NULL)"
    listed = f"transform({items}, item -> if({V.kind(found)} = 'o', {found}, parse_json('{{}}')))"
    has_any = f"exists({items}, item -> {V.filled_object(found)})"
    return f"if({has_any}, to_variant_object(named_struct('item', {listed})), NULL)"


def _field_texts(event: str, identity: str, buckets: Sequence[str] = EVENT_BUCKETS) -> dict[str, str]:
    """SQL of every analytics field of an event of ``EVENT_TYPE``."""
    own, nested = f"{event}.data", f"{event}.xdm.data"

    def data_text(key: str) -> str:
        return f"if({V.filled(own)}, {V.filled_text(own, key)}, {V.filled_text(nested, key)})"

    analytics = f"{event}.{_ANALYTICS}"
    return {
        "pageName": f"coalesce({event}.xdm.web.webPageDetails.name, '')",
        "eventType": f"coalesce({event}.xdm.eventType, '')",
        "channel": f"nullif({analytics}.channel, '')",
        "products": f"nullif({analytics}.productString, '')",
        "currentTime": data_text("currentTime"),
        "currentDate": data_text("currentDate"),
        "renkeiid": V.filled_text(f"{event}.xdm.identityMap", f"{identity}[0].id"),
        "events": _bucket(event, buckets),
        "eVars": V.when_filled(f"{analytics}.customDimensions.eVars"),
        "props": V.when_filled(f"{analytics}.customDimensions.props"),
        "data": f"coalesce({V.when_filled(own)}, {V.when_filled(nested)})",
        "commerce": V.when_filled(f"{event}.xdm.commerce"),
        "productListItems": V.when_filled(f"{event}.xdm.productListItems"),
        "merchandisingEVars": _merchandising(event),
    }


def _events_of(payload: str) -> str:
    """SQL array of the events of a payload, as ``EVENT_TYPE``."""
    return V.at(V.document(V.name(payload)), "events", f"ARRAY<{EVENT_TYPE}>")


def _extract(event: str, fields: Sequence[str], identity: str) -> str:
    texts = _field_texts(event, identity)
    return "named_struct(" + ", ".join(f"'{name}', {texts[name]}" for name in fields) + ")"


def extract_edge_events(
    df: DataFrame, payload: str = "payload", *, fields: Sequence[str] = FIELDS, identity: str = IDENTITY_NAMESPACE
) -> DataFrame:
    """Analytics fields of every event of every payload; the first non-empty event bucket counts.

    Extraction runs inside the generator, so later filters and checks read finished columns instead of
    repeating it; name the ``fields`` a job needs and the others are never extracted.
    """
    keep = [c for c in df.columns if c != payload]
    found = F.expr(f"posexplode(transform({_events_of(payload)}, e -> {_extract('e', fields, identity)}))")
    return df.select(*keep, found.alias("pos", "__a")).select(*keep, "pos", "__a.*")


def extract_first_event(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Analytics fields of the first event of each payload that carries analytics or commerce data.

    Here the last non-empty event bucket counts. The event is picked inside the row, so nothing shuffles.
    """
    keep = [c for c in df.columns if c != payload]
    carries = f"{V.filled(V.at('e', _ANALYTICS))} OR {V.filled(V.at('e', 'xdm.commerce'))}"
    events = V.members(V.document(V.name(payload)), "events")
    first = F.expr(f"explode(transform(slice(filter({events}, e -> {carries}), 1, 1), e -> {V.at('e', '', EVENT_TYPE)}))")
    texts = _field_texts("event", IDENTITY_NAMESPACE, tuple(reversed(EVENT_BUCKETS)))
    texts["merchandisingEVars"] = _merchandising("event", by_name=True)
    fields = [f"{text} AS {name}" for name, text in texts.items() if name != "renkeiid"]
    return df.select(*keep, first.alias("event")).selectExpr(*map(V.name, keep), *fields)


def as_json_text(df: DataFrame) -> DataFrame:
    """Variant columns as JSON text, for sinks and for grouping."""
    values = {f.name: F.to_json(f.name) for f in df.schema if f.dataType.simpleString() == "variant"}
    return df.withColumns(values) if values else df


def analytics_value(path: str, prefix: str = "") -> str:
    """Value at a dotted path of the extracted fields (columns, or struct fields after ``prefix``) as a variant."""
    if not path:  # the whole record
        return "to_variant_object(named_struct(" + ", ".join(f"'{f}', {prefix}{f}" for f in FIELDS) + "))"
    name = path.split(".")[0].split("[")[0]
    if name not in FIELDS:
        return "CAST(NULL AS VARIANT)"
    value = prefix + name if name in VARIANT_FIELDS else f"CAST({prefix}{name} AS VARIANT)"
    rest = path[len(name):]
    return V.at(value, rest) if rest else value


# ---------------------------------------------------------------- requirements


def requirement(actual: str, op: str = "exists", value: object = None) -> str:
    """SQL of one check of a variant; an unknown operator never holds."""
    if op == "exists":
        return V.filled(actual)
    if op == "empty":
        return f"NOT {V.filled(actual)}"
    if op == "equals":
        return V.equals(actual, value)
    present = f"NOT is_variant_null({actual})"
    if op in ("contains", "includes"):
        in_list = f"exists({V.members(actual)}, m -> {V.equals('m', value)})"
        in_text = f"contains({V.words(actual)}, {V.literal(str(value))}) AND {present}"
        return f"coalesce(if({V.kind(actual)} = 'a', {in_list}, {in_text}), false)"
    if op == "matches":
        return f"coalesce({V.words(actual)} RLIKE {V.literal(R.unicode_pattern(str(value)))} AND {present}, false)"
    return "false"


Lookup = Callable[[str], str]


def _checks(lookup: Lookup, requirements: Sequence[Mapping]) -> list[tuple[str, str]]:
    found = []
    for r in requirements:
        key, op = str(r.get("key", "")), str(r.get("op", "exists"))
        found.append((f"{key} {op}", requirement(lookup(key), op, r.get("value"))))
    return found


def satisfies(lookup: Lookup, requirements: Sequence[Mapping]) -> str:
    """SQL that tells whether all checks hold for the values that ``lookup`` finds under their keys."""
    return " AND ".join(f"({hit})" for _, hit in _checks(lookup, requirements)) or "true"


def failed_checks(lookup: Lookup, requirements: Sequence[Mapping]) -> str:
    """SQL array of ``key op`` texts of the checks that do not hold."""
    texts = [f"if({hit}, NULL, {V.literal(label)})" for label, hit in _checks(lookup, requirements)]
    return f"array_compact(array({', '.join(texts)}))" if texts else "CAST(array() AS ARRAY<STRING>)"


def failures(lookup: Lookup, requirements: Sequence[Mapping]) -> str:
    """SQL array of (key, op, expected, actual) of the checks that do not hold; values as JSON text, null if there is none."""
    rows = []
    for r, (_, hit) in zip(requirements, _checks(lookup, requirements)):
        key, op, value = str(r.get("key", "")), str(r.get("op", "exists")), r.get("value")
        expected = "CAST(NULL AS STRING)" if value is None else V.literal(json.dumps(value, ensure_ascii=False, separators=(",", ":")))
        rows.append(f"if({hit}, NULL, named_struct('key', {V.literal(key)}, 'op', {V.literal(op)}, 'expected', {expected}, 'actual', to_json({lookup(key)})))")
    empty = "CAST(array() AS ARRAY<STRUCT<key:STRING,op:STRING,expected:STRING,actual:STRING>>)"
    return f"array_compact(array({', '.join(rows)}))" if rows else empty


def requirement_check(df: DataFrame, column: str, requirements: Sequence[Mapping]) -> DataFrame:
    """Add ``satisfied`` and ``failed`` for a JSON text column."""
    failed = failed_checks(lambda key: V.at("__doc", key), requirements)
    out = df.withColumn("__doc", F.expr(V.document(V.name(column)))).withColumn("failed", F.expr(failed))
    return out.withColumn("satisfied", F.size("failed") == 0).drop("__doc")


# ---------------------------------------------------------------- contracts

# The JSON types a contract may ask for, the names under which found types are reported, and the texts
# of the reasons in _contract_reason and contract_check.
_CONTRACT_TYPES = {"string": ("s",), "array": ("a",), "object": ("o",), "number": ("", "b"), "boolean": ("b",)}
_REPORTED = "map('s', 'str', 'a', 'list', 'o', 'dict', 'b', 'bool', 'z', 'NoneType')"


def _contract_reason(doc: str, rule: Mapping) -> str:
    """SQL of the first failing reason of a rule, ``ok`` when all its checks hold."""
    value = V.member(doc, str(rule.get("path", "")))
    cases = [f"WHEN {value} IS NULL THEN 'missing path'"]
    expected = rule.get("type")
    if expected and expected not in _CONTRACT_TYPES:
        cases.append(f"WHEN true THEN {V.literal(f'unsupported contract type: {expected}')}")
    elif expected:
        accepted = ", ".join(f"'{k}'" for k in _CONTRACT_TYPES[expected])
        number = f"if(to_json({value}) RLIKE '[.eE]', 'float', 'int')"
        found = f"coalesce({_REPORTED}[{V.kind(value)}], {number})"
        text = V.literal(f"type mismatch: expected {expected}, got ")
        cases.append(f"WHEN {V.kind(value)} NOT IN ({accepted}) THEN concat({text}, {found})")
    if rule.get("nonEmpty") is True:
        blank = f"{V.kind(value)} = 's' AND {V.at(value, '', 'string')} RLIKE '(?U)^\\\\s*$'"
        cases.append(f"WHEN {blank} THEN 'empty string'")
    if rule.get("minItems") is not None:
        least = int(rule["minItems"])
        length = f"size({V.members(value)})"
        cases.append(f"WHEN {V.kind(value)} <> 'a' THEN 'minItems set but value is not an array'")
        cases.append(f"WHEN {length} < {least} THEN concat('array length ', {length}, ' < minItems {least}')")
    return "CASE " + " ".join(cases) + " ELSE 'ok' END"


def contract_check(df: DataFrame, column: str, rules: Sequence[Mapping]) -> DataFrame:
    """One row per document and contract rule: ``path``, ``exists``, ``ok`` and the first failing reason.

    A missing or unreadable document fails with one row of its own.
    """
    def row(path: str, reason: str, used_by: str) -> str:
        return f"named_struct('path', {V.literal(path)}, 'reason', {reason}, 'used_by', {V.literal(used_by)})"

    checks = [
        row(str(r.get("path", "")), _contract_reason("__doc", r), str(r.get("usedBy", ""))) for r in rules
    ]
    undefined = row("data", "'data is undefined'", "all contract checks")
    listed = f"if(__doc IS NULL OR is_variant_null(__doc), array({undefined}), array({', '.join(checks)}))"
    keep = [c for c in df.columns if c != column]
    out = df.withColumn("__doc", F.expr(V.document(V.name(column))))
    out = out.select(*keep, F.expr(f"explode({listed})").alias("__c"))
    reason = F.col("__c.reason")
    return out.select(
        *keep,
        "__c.path",
        (~reason.isin("missing path", "data is undefined")).alias("exists"),
        (reason == "ok").alias("ok"),
        reason.alias("reason"),
        "__c.used_by",
    )


def contract_summary(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether every check of a document holds."""
    return checks.groupBy(*keys).agg(F.bool_and("ok").alias("ok"))


# ---------------------------------------------------------------- best matches


def _candidates(events: DataFrame, page_pattern: str, event_type: str) -> DataFrame:
    if page_pattern:
        events = events.filter(R.search(F.col("pageName"), page_pattern))
    return events.filter(F.col("eventType") == event_type) if event_type else events


def richness(paths: Sequence[str] = SCORE_PATHS) -> str:
    """SQL score: 2 for every filled page-level field, 3 for every filled score path.

    Paths are grouped by their field, so none is looked up in a field that is null.
    """
    terms = [f"if(coalesce({name}, '') <> '', 2, 0)" for name in SCORE_FIELDS]
    for field in FIELDS:
        inside = [p for p in paths if p.split(".")[0].split("[")[0] == field]
        if inside:
            score = " + ".join(f"if({V.filled(analytics_value(p))}, 3, 0)" for p in inside)
            terms.append(f"if({field} IS NULL, 0, {score})")
    return f"CAST({' + '.join(terms)} AS BIGINT)"


def candidates(
    df: DataFrame,
    fields: Sequence[str],
    *,
    payload: str,
    session: str,
    order: Sequence[str],
    page_pattern: str = "",
    event_type: str = "",
    start_index: int = 0,
) -> DataFrame:
    """Events of raw requests that pass page and type: the request's columns, ``pos``, the event ``__event`` and ``fields``.

    The first ``start_index`` requests of each session, by ``order`` without ``pos``, do not count. Of the others the
    events are read once, filtered, and only then have the named fields extracted.
    """
    keep = [c for c in df.columns if c != payload]
    if start_index:
        place = F.struct(*[F.col(c) for c in order if c != "pos"])
        narrow = df.select(F.col(session).alias("__session"), place.alias("__place"))
        early = narrow.withColumn("__rank", F.row_number().over(Window.partitionBy("__session").orderBy("__place"))).filter(F.col("__rank") <= start_index)
        cut = early.groupBy("__session").agg(F.max("__place").alias("__cut"))
        df = df.join(cut, F.col(session).eqNullSafe(F.col("__session"))).filter(place > F.col("__cut")).select(*keep, payload)
    rows = df.select(*keep, F.expr(f"posexplode({_events_of(payload)})").alias("pos", "__event"))
    texts = _field_texts("__event", IDENTITY_NAMESPACE)
    if page_pattern:
        rows = rows.filter(R.search(F.expr(texts["pageName"]), page_pattern))
    if event_type:
        rows = rows.filter(F.expr(texts["eventType"]) == event_type)
    return rows.select("*", *[F.expr(texts[f]).alias(f) for f in fields])


def _extracted(rows: DataFrame, *, also: Sequence[str] = ()) -> DataFrame:
    """All fields of the events that are left, variants as JSON text."""
    keep = [c for c in rows.columns if c not in (*FIELDS, "__event", *also)]
    texts = _field_texts("__event", IDENTITY_NAMESPACE)
    return as_json_text(rows.select(*keep, *[F.expr(texts[f]).alias(f) for f in FIELDS], *also))


def _named(paths: Sequence[str]) -> list[str]:
    """Fields that some paths read; the empty path reads all."""
    heads = [p.split(".")[0].split("[")[0] for p in paths]
    return list(FIELDS) if "" in heads else [f for f in FIELDS if f in heads]


def _one_per_session(rows: DataFrame, session: str, pick: Callable[[Column], Column]) -> DataFrame:
    """The row that ``pick`` (a ``max_by`` or ``min_by``) keeps per session; JSON text is made of the kept rows only."""
    fields = [c for c in rows.columns if c != session]
    kept = rows.groupBy(session).agg(pick(F.struct(*fields)).alias("__kept"))
    return as_json_text(kept.select(session, "__kept.*"))


def best_beacon(
    events: DataFrame,
    *,
    session: str = "session_id",
    order: Sequence[str] = ("seq", "pos"),
    page_pattern: str = "",
    event_type: str = "",
    requirements: Sequence[Mapping] = (),
    score_paths: Sequence[str] = SCORE_PATHS,
    payload: str = "payload",
    start_index: int = 0,
) -> DataFrame:
    """Richest matching event per session, ties to the latest.

    ``events`` are raw requests with a ``payload``, or events that are extracted already. ``max_by`` keeps one candidate
    per session and task before the shuffle, whatever a session holds. Of raw requests it carries the event as it was
    read, and only the winners are extracted; the first ``start_index`` requests of a session do not count.
    """
    if payload in events.columns:
        fields = _named([*SCORE_FIELDS, *score_paths, *[str(r.get("key", "")) for r in requirements]])
        rows = candidates(
            events, fields, payload=payload, session=session, order=order, page_pattern=page_pattern, event_type=event_type, start_index=start_index)
        rows = rows.filter(satisfies(analytics_value, requirements)).withColumn("score", F.expr(richness(score_paths)))
        kept = [c for c in rows.columns if c not in (*fields, session)]
        best = rows.groupBy(session).agg(F.max_by(F.struct(*kept), F.struct("score", *order)).alias("__kept"))
        return _extracted(best.select(session, "__kept.*"), also=["score"])
    if start_index:
        raise ValueError(f"start_index counts raw requests: {payload} is not among the columns")
    rows = _candidates(events, page_pattern, event_type).filter(satisfies(analytics_value, requirements))
    scored = rows.withColumn("score", F.expr(richness(score_paths)))
    return _one_per_session(scored, session, lambda row: F.max_by(row, F.struct("score", *order)))


def rejected_beacons(
    events: DataFrame,
    requirements: Sequence[Mapping],
    *,
    session: str = "session_id",
    order: Sequence[str] = ("seq", "pos"),
    page_pattern: str = "",
    event_type: str = "",
    limit: int | None = None,
    payload: str = "payload",
    start_index: int = 0,
) -> DataFrame:
    """The candidates that failed, ranked per session from the latest, with the failing checks; ``limit`` per session if given.

    ``failed`` names the checks, ``failures`` holds key, op, expected and actual value of each. With a limit, the rank
    filter limits each session inside every task before the shuffle; what failed is written out for the rows that
    remain. ``events`` are raw requests with a ``payload``, whose fields are extracted for these rows alone, or events
    that are extracted already; the first ``start_index`` requests of a session do not count.
    """
    latest = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    if payload in events.columns:
        fields = _named([str(r.get("key", "")) for r in requirements])
        rows = candidates(
            events, fields, payload=payload, session=session, order=order, page_pattern=page_pattern, event_type=event_type, start_index=start_index)
        rows = rows.filter(f"NOT ({satisfies(analytics_value, requirements)})")
        ranked = rows.drop(*fields).withColumn("reject_rank", F.row_number().over(latest).cast("bigint"))
        kept = ranked if limit is None else ranked.filter(F.col("reject_rank") <= limit)
        texts = _field_texts("__event", IDENTITY_NAMESPACE)
        kept = kept.select("*", *[F.expr(texts[f]).alias(f) for f in FIELDS]).drop("__event")
        kept = kept.withColumns({"failed": F.expr(failed_checks(analytics_value, requirements)), "failures": F.expr(failures(analytics_value, requirements))})
        return as_json_text(kept)
    if start_index:
        raise ValueError(f"start_index counts raw requests: {payload} is not among the columns")
    rows = _candidates(events, page_pattern, event_type).filter(f"NOT ({satisfies(analytics_value, requirements)})")
    ranked = rows.withColumn("reject_rank", F.row_number().over(latest).cast("bigint"))
    kept = ranked if limit is None else ranked.filter(F.col("reject_rank") <= limit)
    return as_json_text(kept.withColumns({
        "failed": F.expr(failed_checks(analytics_value, requirements)), "failures": F.expr(failures(analytics_value, requirements))}))


def first_page_match(
    events: DataFrame, page_pattern: str, *, session: str = "session_id", order: Sequence[str] = ("seq", "pos"), payload: str = "payload"
) -> DataFrame:
    """First event per session whose page name matches, of raw requests with a ``payload`` or of extracted events."""
    if payload in events.columns:
        rows = candidates(events, (), payload=payload, session=session, order=order, page_pattern=page_pattern).filter("__event.xdm.web.webPageDetails.name <> ''")
        kept = [c for c in rows.columns if c != session]
        first = rows.groupBy(session).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("__kept"))
        return _extracted(first.select(session, "__kept.*"))
    rows = events.filter((F.col("pageName") != "") & R.search(F.col("pageName"), page_pattern))
    return _one_per_session(rows, session, lambda row: F.min_by(row, F.struct(*order)))


def match_request(
    df: DataFrame,
    *,
    hosts: Sequence[str],
    url: str = "url",
    payload: str = "payload",
    page_pattern: str = "",
    event_type: str = "",
    requirements: Sequence[Mapping] = (),
    fields: Sequence[str] = FIELDS,
    identity: str = IDENTITY_NAMESPACE,
) -> DataFrame:
    """First event inside each request that passes host, page, event type and requirements.

    The search runs over the event array of the row itself, so no row leaves its task. ``fields`` must hold
    the fields that the requirements read.
    """
    texts = _field_texts("e", identity)
    admitted = ["true"]
    if page_pattern:
        admitted.append(f"{texts['pageName']} RLIKE {V.literal(R.unicode_pattern(page_pattern))}")
    if event_type:
        admitted.append(f"{texts['eventType']} = {V.literal(event_type)}")
    events = f"filter({_events_of(payload)}, e -> {' AND '.join(admitted)})"
    found = f"transform({events}, e -> {_extract('e', fields, identity)})"
    if requirements:
        found = f"filter({found}, a -> {satisfies(lambda key: analytics_value(key, 'a.'), requirements)})"
    keep = [c for c in df.columns if c != payload]
    rows = df.filter(R.contains_any(F.col(url), hosts))
    first = rows.select(*keep, F.expr(f"explode(slice({found}, 1, 1))").alias("__first"))
    return as_json_text(first.select(*keep, "__first.*"))


def drop_repeats(
    df: DataFrame, *, session: str, order: str, compare: Sequence[str]
) -> DataFrame:
    """Drop rows equal to the row right before them in their session; later repeats stay.

    A session may hold a large part of the table, so rows are sorted by ranges, which cut a session where its rows are
    many, and look back inside their range; the first of a range looks at the last of the range before. The order
    column is of any ordered type. Rows are in its order, null first, then in that of the compared values, so ties have
    one order, too. The sorted rows are written once while the plan is built.
    """
    rows, before = ranges.row_before(ranges.ranged(df, [session, order, *compare]), F.struct(session, *compare))
    repeat = F.coalesce(before.eqNullSafe(F.struct(session, *compare)), F.lit(False))
    return rows.filter(~repeat).select(*df.columns)


# ---------------------------------------------------------------- delivery calls


def _list(doc: str, path: str) -> str:
    """SQL of the list at a path, an empty one when the value is missing or no list."""
    return f"coalesce({V.members(doc, path)}, CAST(array() AS ARRAY<VARIANT>))"


def mbox_names(df: DataFrame, column: str, output: str = "mbox_names") -> DataFrame:
    """Names of execute then prefetch boxes, in order, unique, blank ones dropped."""
    doc = V.document(V.name(column))
    name = f"if({V.kind(V.at('m', 'name'))} = 's', {V.at('m', 'name', 'string')}, NULL)"
    both = f"concat({_list(doc, 'execute.mboxes')}, {_list(doc, 'prefetch.mboxes')})"
    return df.withColumn(output, F.expr(f"array_distinct(filter(transform({both}, m -> {name}), n -> n <> ''))"))


def _flat(doc: str, key: str) -> str:
    """SQL of the trimmed scalar under a literal key (dots are part of the key), null when blank."""
    value = f"try_variant_get({doc}, {V.literal(f"$['{key}']")}, 'string')"
    return f"nullif(regexp_replace({value}, '(?U)^\\\\s+|\\\\s+$', ''), '')"


# Keys under which an option names its criteria, algorithm, design and activity.
_TOKEN_KEYS = {
    "criteria": ("recommendation.criteria.title",),
    "algorithm": ("recommendation.algorithm.name",),
    "design": ("recommendation.design.name", "recommendation.template.name", "design.name", "template.name"),
    "activity_id": ("activity.id",),
}
_CONTENT_KEYS = {
    "criteria": ("criteria.title",),
    "algorithm": ("algorithm.name",),
    "design": ("design.name", "template.name", "design", "template"),
    "activity_id": ("campaign.id",),
}


def delivery_options(df: DataFrame, column: str) -> DataFrame:
    """One row per option of the delivery calls in a JSON column, with criteria, algorithm, design and activity.

    Token metadata comes first, the option content (JSON text or object) is the fallback.
    """
    keep = [c for c in df.columns if c != column]
    rows = df.select(*keep, F.expr(V.document(V.name(column))).alias("__doc"))
    called = f"coalesce({V.members('__doc', 'calls')}, {V.members('__doc', 'deliveries')}, array(__doc))"
    rows = rows.select(*keep, F.expr(f"explode(coalesce({V.members('__doc')}, {called}))").alias("__call"))
    nested = V.at("__call", "response.body")
    rows = rows.select(*keep, F.expr(f"if({V.kind(nested)} = 'o', {nested}, __call)").alias("__body"))
    boxes = f"concat({_list('__body', 'prefetch.mboxes')}, {_list('__body', 'execute.mboxes')})"
    options = f"flatten(transform({boxes}, b -> {_list('b', 'options')}))"
    rows = rows.select(*keep, F.expr(f"explode({options})").alias("__option"))
    content = V.at("__option", "content")
    parsed = f"if({V.kind(content)} = 's', try_parse_json({V.at('__option', 'content', 'string')}), {content})"
    rows = rows.select(
        *keep,
        F.expr(V.at("__option", "responseTokens")).alias("__tokens"),
        F.expr(V.at(parsed, "recs.activity")).alias("__activity"),
    )

    def named(role: str) -> str:
        texts = [_flat("__tokens", k) for k in _TOKEN_KEYS[role]] + [_flat("__activity", k) for k in _CONTENT_KEYS[role]]
        return f"coalesce({', '.join(texts)})"

    activity = f"try_cast({named('activity_id')} AS BIGINT) AS activity_id"
    return rows.selectExpr(*map(V.name, keep), *[f"{named(r)} AS {r}" for r in ("criteria", "algorithm", "design")], activity)


def delivery_scope(df: DataFrame, column: str) -> DataFrame:
    """Distinct (kind, value) rows of the criteria, designs and activities seen in delivery calls.

    Values stay rows: a set of any size is deduplicated with map-side combine and never held in one task.
    """
    options = delivery_options(df, column)
    pairs = F.array(
        F.struct(F.lit("criteria").alias("kind"), F.col("criteria").alias("value")),
        F.struct(F.lit("criteria").alias("kind"), F.col("algorithm").alias("value")),
        F.struct(F.lit("design").alias("kind"), F.col("design").alias("value")),
        F.struct(F.lit("activity").alias("kind"), F.col("activity_id").cast("string").alias("value")),
    )
    return options.select(F.explode(pairs).alias("p")).select("p.kind", "p.value").filter("value IS NOT NULL").distinct()


def visitor_id(
    df: DataFrame,
    *,
    hosts: Sequence[str],
    url: str = "url",
    body: str = "body",
    namespace: str = VISITOR_NAMESPACE,
    output: str = "visitor_id",
) -> DataFrame:
    """First non-empty id of the visitor namespace in an interact response, else empty text."""
    relevant = F.col(url).contains("/interact") & R.contains_any(F.col(url), hosts)
    doc = V.document(V.name(body))
    payloads = f"flatten(transform({_list(doc, 'handle')}, h -> {_list('h', 'payload')}))"
    named = f"{V.at('p', 'namespace.code', 'string')} = {V.literal(namespace)} AND {V.filled(V.at('p', 'id'))}"
    first = f"try_element_at(filter({payloads}, p -> {named}), 1)"
    found = F.expr(f"coalesce({V.at(first, 'id', 'string')}, '')")
    return df.withColumn(output, F.when(relevant, found).otherwise(""))


# ---------------------------------------------------------------- chunked payloads


def complete_runs(df: DataFrame, run: str = "run_id", index: str = "part_index", count: str = "part_count") -> DataFrame:
    """Runs whose part indexes are exactly 0 to count-1, each once."""
    state = df.groupBy(run).agg(
        F.count("*").alias("__rows"),
        F.count_distinct(index).alias("__indexes"),
        F.min(index).alias("__low"),
        F.max(index).alias("__high"),
        F.min(count).alias("__least"),
        F.max(count).alias("__most"),
    )
    whole = (
        "__least = __most AND __rows = __most AND __indexes = __most AND __low = 0 AND __high = __most - 1"
    )
    return state.filter(whole).select(run, F.col("__most").alias(count))


def ordered_parts(
    df: DataFrame, *, run: str = "run_id", index: str = "part_index", count: str = "part_count", part: str = "part"
) -> DataFrame:
    """Parts of complete runs with ``offset``, the characters of the run before them; a null part is empty.

    A run of any size stays in rows, in ranges of its order; written in the order of run and index they are its text.
    """
    whole = complete_runs(df, run, index, count).select(run)
    parts = df.join(whole, run, "left_semi").select(run, index, F.coalesce(F.col(part), F.lit("")).alias(part))
    return ranges.running_before(parts, [run], [index], F.length(part), "offset")


def reassemble_chunks(
    df: DataFrame, *, run: str = "run_id", index: str = "part_index", count: str = "part_count", part: str = "part"
) -> DataFrame:
    """Parts of complete runs joined in order, one text per run; for runs too large for a cell see :func:`ordered_parts`.

    Incomplete runs are dropped before any part is gathered, so a broken run that repeats one key without
    end is never collected; what is gathered is exactly the one text a complete run stands for.
    """
    whole = complete_runs(df, run, index, count).select(run)
    parts = df.join(whole, run, "left_semi").groupBy(run)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(index), F.coalesce(F.col(part), F.lit("")).alias("text"))))
    return parts.agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("payload"))
