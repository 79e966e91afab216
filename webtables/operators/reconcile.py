"""Reconciliation: mapping against observed, expected against actual, snapshot against snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from .channels import DEFAULT_RULE

# Fixed value: label of traffic that no rule classified.
NOT_SET = "(not set)"

SALTS = 16  # copies of the owners of many files, over which the files of one folder are spread
BEGINNINGS = 64  # told apart of owners' paths
BUCKETS, HOT_SHARE = 4096, 256  # of prefixes; a bucket with more than one part of so many is spread


# ---------------------------------------------------------------- site mapping


def _site(name: str = "site") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _whole(df: DataFrame, name: str) -> Column:
    return F.coalesce(text.to_double(df, name).try_cast("bigint"), F.lit(0))


def site_sessions(observed: DataFrame) -> DataFrame:
    """Sessions per site, null site as empty text, most first."""
    out = observed.groupBy(_site().alias("site")).agg(F.sum(_whole(observed, "sessions")).alias("sessions"))
    return out.orderBy(F.desc("sessions"), "site")


def unclassified_hosts(observed: DataFrame) -> DataFrame:
    """Sessions per host without a site."""
    rows = observed.filter(_site().isin("", NOT_SET))
    out = rows.groupBy("host").agg(F.sum(_whole(observed, "sessions")).alias("sessions"))
    return out.orderBy(F.desc("sessions"), F.asc_nulls_last("host"))


def unclassified_pages(observed: DataFrame, limit: int | None = None) -> DataFrame:
    """Host and path by sessions where the site is not set, most first; the top ``limit`` if given."""
    rows = observed.filter(F.col("site") == NOT_SET)
    out = rows.groupBy("host", "path").agg(F.sum(_whole(observed, "sessions")).alias("sessions"))
    out = out.orderBy(F.desc("sessions"), F.asc_nulls_last("host"), F.asc_nulls_last("path"))
    return out if limit is None else out.limit(limit)


def metric_by_site(observed: DataFrame, metric: str = "metric_value") -> DataFrame:
    """Metric per site of the second tool, most first."""
    value = F.coalesce(text.to_double(observed, metric), F.lit(0.0))
    out = observed.groupBy(_site().alias("site")).agg(F.sum(value).alias(metric))
    return out.orderBy(F.desc(metric), "site")


def tag_site_names(rules: DataFrame) -> DataFrame:
    """Distinct labels of a rule table (``pattern``, ``label``) without its default."""
    names = rules.filter(F.col("pattern") != DEFAULT_RULE).select(text.strip_blank("label").alias("site"))
    return names.filter("site <> ''").distinct()


def observed_site_names(observed: DataFrame, placeholder: str = NOT_SET) -> DataFrame:
    names = observed.filter(_site() != placeholder).select(text.strip_blank(_site()).alias("site"))
    return names.filter("site <> ''").distinct()


_GAPS = (
    ("in_tag_no_first", "tag", "first"),
    ("in_first_no_tag", "first", "tag"),
    ("in_tag_no_second", "tag", "second"),
    ("in_second_no_tag", "second", "tag"),
    ("in_first_no_second", "first", "second"),
    ("in_second_no_first", "second", "first"),
)


def coverage_gaps(rules: DataFrame, first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Set differences among tag rules and one or two observing tools as (gap, site) rows.

    The sides are united with presence flags and grouped once, so no side is read or shuffled twice.
    """
    sides = {"tag": tag_site_names(rules), "first": observed_site_names(first)}
    if second is not None:
        sides["second"] = observed_site_names(second, "(none)")
    marked = [df.withColumn("side", F.lit(name)) for name, df in sides.items()]
    united = marked[0]
    for part in marked[1:]:
        united = united.unionByName(part)
    flags = united.groupBy("site").agg(*[F.bool_or(F.col("side") == name).alias(name) for name in sides])
    gaps = [
        F.when(F.col(have) & ~F.col(lack), F.lit(gap))
        for gap, have, lack in _GAPS if have in sides and lack in sides
    ]
    return flags.select(F.explode(F.array_compact(F.array(*gaps))).alias("gap"), "site").orderBy("gap", "site")


def coverage_totals(rules: DataFrame, observed: DataFrame) -> DataFrame:
    """One row: total and unclassified sessions, their share, and the counts of rules and sites."""
    sessions = _whole(observed, "sessions")
    label = text.strip_blank("label")
    rule_side = rules.select(
        F.lit(0).cast("bigint").alias("sessions"),
        F.lit(0).cast("bigint").alias("unclassified"),
        F.col("pattern"),
        F.when((F.col("pattern") != DEFAULT_RULE) & (label != ""), label).alias("tag_site"),
        F.lit(None).cast("string").alias("seen_site"),
    )
    site = text.strip_blank(_site())
    seen_side = observed.groupBy(_site().alias("site")).agg(F.sum(sessions).alias("sessions")).select(
        "sessions",
        F.when(F.col("site").isin("", NOT_SET), F.col("sessions")).otherwise(F.lit(0)).alias("unclassified"),
        F.lit(None).cast("string").alias("pattern"),
        F.lit(None).cast("string").alias("tag_site"),
        F.when((site != "") & (F.col("site") != NOT_SET), site).alias("seen_site"),
    )
    totals = rule_side.unionByName(seen_side).agg(
        F.coalesce(F.sum("sessions"), F.lit(0)).alias("total_sessions"),
        F.coalesce(F.sum("unclassified"), F.lit(0)).alias("unclassified_sessions"),
        F.count_distinct("pattern").alias("mapping_count"),
        F.count_distinct("tag_site").alias("tag_site_count"),
        F.count_distinct("seen_site").alias("site_count"),
    )
    share = F.round(F.col("unclassified_sessions") / F.col("total_sessions") * 100, 1)
    return totals.withColumn(
        "unclassified_pct", F.when(F.col("total_sessions") != 0, share).otherwise(F.lit(0.0))
    )


# ---------------------------------------------------------------- expected against actual


def verify_expected(expected: DataFrame, actual: DataFrame, key: str = "key") -> DataFrame:
    """Expected against actual per key; a missing actual value is empty text."""
    found = actual.groupBy(F.col(key).alias("__key")).agg(F.max("actual").alias("actual"))
    joined = expected.select(key, "expected").join(found, expected[key] == found["__key"], "left")
    value = F.coalesce(F.col("actual"), F.lit(""))
    return joined.select(key, "expected", value.alias("actual"), value.eqNullSafe(F.col("expected")).alias("match"))


def dominant_value(traffic: DataFrame, key: str, value: str, occurrences: str | None = None) -> DataFrame:
    """Value with the most occurrences per key, ties to the smaller value."""
    weight = F.sum(occurrences) if occurrences else F.count(F.lit(1))
    counts = traffic.groupBy(key, value).agg(weight.alias("__n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias("actual"))


def verify_dominant(
    expected: DataFrame, traffic: DataFrame, *, key: str = "key", value: str = "value", occurrences: str | None = None
) -> DataFrame:
    """Expected value against the dominant value in traffic, for all keys in one pass.

    Keys without traffic have no verdict (match null, source ``no_traffic``).
    """
    found = dominant_value(traffic, key, value, occurrences)
    found = found.select(F.col(key).alias("__key"), text.strip_blank(F.coalesce("actual", F.lit(""))).alias("actual"))
    joined = expected.select(key, "expected").join(found, expected[key] == found["__key"], "left")
    seen = F.col("__key").isNotNull()
    return joined.select(
        key,
        "expected",
        F.coalesce("actual", F.lit("")).alias("actual"),
        F.when(seen, F.col("actual").eqNullSafe(F.col("expected"))).alias("match"),
        F.when(seen, "report").otherwise("no_traffic").alias("source"),
    )


def verify_summary(results: DataFrame) -> DataFrame:
    """Counts of right, wrong and skipped verdicts."""
    return results.agg(
        F.count_if(F.col("match")).alias("ok"),
        F.count_if(~F.col("match")).alias("ng"),
        F.count_if(F.col("match").isNull()).alias("skip"),
    )


# ---------------------------------------------------------------- snapshots


def _digest(value: Column) -> Column:
    return F.sha2(value, 256)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """Status of every id between two snapshots: added, updated, deleted or unchanged.

    Both sides are reduced to (id, digest) and united, so one shuffle with map-side combine replaces a
    full outer join.
    """
    def side(df: DataFrame, before: bool) -> DataFrame:
        digest = _digest(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}))
        none = F.lit(None).cast("string")
        return df.select(key, (digest if before else none).alias("old"), (none if before else digest).alias("new"))

    both = side(old, True).unionByName(side(new, False))
    pairs = both.groupBy(key).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    status = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "deleted")
        .when(F.col("old") == F.col("new"), "unchanged")
        .otherwise("updated")
    )
    return pairs.select(key, status.alias("status"))


def snapshot_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n"))


def text_hash(value: Column) -> Column:
    """Digest of a text without blanks at its ends."""
    return F.when(value.isNotNull(), F.concat(F.lit("sha256:"), _digest(text.strip_blank(value))))


_VERSIONS = ("base", "local", "remote")
_DIGESTS = tuple(f"{v}_{k}" for v in _VERSIONS for k in ("whole1", "whole2", "inner1", "inner2"))


def unite_digests(base: DataFrame, local: DataFrame, remote: DataFrame, key: str = "path", content: str = "text") -> DataFrame:
    """One row per path with two 128-bit digests of each version, of the whole text and of the text without blanks at its
    ends; null where a version is absent. No text is shuffled."""
    def side(df: DataFrame, which: str) -> DataFrame:
        text_, inner = F.col(content), text.strip_blank(F.col(content))
        own = {"whole1": F.xxhash64(text_), "whole2": F.xxhash64(text_, F.lit(1)), "inner1": F.xxhash64(inner), "inner2": F.xxhash64(inner, F.lit(1))}
        return df.select(F.col(key).alias("path"), *[
            (F.when(text_.isNotNull(), own[n.split("_")[1]]) if n.startswith(which) else F.lit(None)).cast("bigint").alias(n) for n in _DIGESTS])

    rows = side(base, "base").unionByName(side(local, "local")).unionByName(side(remote, "remote"))
    return rows.groupBy("path").agg(*[F.max(n).alias(n) for n in _DIGESTS])


def compare_versions(base: DataFrame, local: DataFrame, remote: DataFrame, key: str = "path", content: str = "text") -> DataFrame:
    """``path`` and ``action`` from the versions' digests; the same actions as :func:`three_way_compare` on their texts."""
    pair = lambda version, part: F.struct(F.col(f"{version}_{part}1"), F.col(f"{version}_{part}2"))
    there = {v: F.col(f"{v}_whole1").isNotNull() for v in _VERSIONS}
    action = _action(
        there, pair("local", "whole") == pair("remote", "whole"), pair("local", "inner") == pair("base", "inner"), pair("remote", "inner") == pair("base", "inner"))
    return unite_digests(base, local, remote, key, content).select("path", action.alias("action"))


def conflicts(base: DataFrame, local: DataFrame, remote: DataFrame, key: str = "path", content: str = "text") -> DataFrame:
    """Conflicts with their kind, hashes and texts; only the texts of paths in conflict are shuffled."""
    found = compare_versions(base, local, remote, key, content).filter("action = 'conflict'").select("path")
    sides = [df.withColumnRenamed(key, "path").join(found, "path", "left_semi") for df in (base, local, remote)]
    return conflict_records(three_way_compare(unite_versions(*sides, "path", content)))


def unite_versions(base: DataFrame, local: DataFrame, remote: DataFrame, key: str = "path", content: str = "text") -> DataFrame:
    """One row per path with the text of each version, null where absent, through one shuffle."""
    def side(df: DataFrame, which: str) -> DataFrame:
        return df.select(
            F.col(key).alias("path"),
            *[(F.col(content) if which == n else F.lit(None).cast("string")).alias(f"{n}_text")
              for n in ("base", "local", "remote")],
        )

    rows = side(base, "base").unionByName(side(local, "local")).unionByName(side(remote, "remote"))
    names = ("base_text", "local_text", "remote_text")
    return rows.groupBy("path").agg(*[F.max(n).alias(n) for n in names])


def three_way_compare(versions: DataFrame) -> DataFrame:
    """Action per path from base, local and remote text (null = absent)."""
    base, local, remote = F.col("base_text"), F.col("local_text"), F.col("remote_text")
    with_hash = versions.withColumns(
        {"base_hash": text_hash(base), "local_hash": text_hash(local), "remote_hash": text_hash(remote)}
    )
    there = {"base": base.isNotNull(), "local": local.isNotNull(), "remote": remote.isNotNull()}
    same_local, same_remote = (F.col(f"{v}_hash") == F.col("base_hash") for v in ("local", "remote"))
    return with_hash.withColumn("action", _action(there, local == remote, same_local, same_remote))


def _action(there: dict[str, Column], same: Column, same_local: Column, same_remote: Column) -> Column:
    """Action from which versions are there, whether local and remote are equal, and whether each is the base's."""
    removed = F.when(~there["local"], "unchanged").when(there["base"] & same_local, "delete").otherwise("kept-local-removed")
    return (
        F.when(~there["remote"], removed)
        .when(~there["local"], "add")
        .when(same, "unchanged")
        .when(~there["base"], "conflict")
        .when(same_local & ~same_remote, "update")
        .when(~same_local & same_remote, "keep-local")
        .when(~same_local & ~same_remote, "conflict")
        .otherwise("unchanged")
    )


def conflict_records(compared: DataFrame) -> DataFrame:
    """Conflicts with their kind, hashes and texts."""
    kind = F.when(F.col("base_hash").isNotNull(), "local_remote_changed").otherwise("missing_baseline")
    return compared.filter("action = 'conflict'").select(
        "path", kind.alias("kind"), "base_hash", "local_hash", "remote_hash", "base_text", "local_text", "remote_text"
    )


# ---------------------------------------------------------------- scope


def outside_scope(resources: DataFrame, scope: DataFrame) -> DataFrame:
    """Local resources (``type``, ``id``, ``path``) whose type and id are not in the scope."""
    return resources.join(scope.select("type", "id"), ["type", "id"], "left_anti")


def outside_files(resources: DataFrame, files: DataFrame) -> DataFrame:
    """Files that belong to out-of-scope resources.

    A ``rules`` resource owns every file below its path; any other resource owns the file of its path and
    the files whose path goes on with a dot after its extension-less path.  Instead of comparing prefixes,
    each file offers every prefix it could be owned by and these are matched by equality.
    """
    offered, owners = offers_and_owners(resources, files)
    # Spark's size statistics do not see how small a file holds the paths, so they would broadcast all owners
    return offered.join(owners.hint("merge"), ["kind", "prefix", "salt"], "left_semi").select("path").distinct()


def offers_and_owners(resources: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes (path, kind, prefix, salt) that files offer and those (kind, prefix, salt) that resources own."""
    folder = F.regexp_replace("path", r"/+$", "")
    bare = F.regexp_replace("path", r"(?<=[^/])\.[^./]*$", "")
    entry = lambda kind, prefix: F.struct(F.lit(kind).alias("kind"), prefix.alias("prefix"))
    # a path with an extension goes on with a dot after its bare one, so only one without owns "the same" beside it
    dotted = F.when(bare == F.col("path"), F.array(entry("same", F.col("path")), entry("dotted", bare))).otherwise(F.array(entry("dotted", bare)))
    owned = F.when(F.col("type") == "rules", F.array(entry("below", folder))).otherwise(dotted)
    owners = resources.select(F.explode(owned).alias("__p")).select("__p.kind", "__p.prefix").distinct()

    # a file offers only prefixes with as many parts and a beginning like some owner's of the kind; a prefix begins as its path does
    def shape(kind: Column, parts: Column, path: str) -> Column:
        begin = F.substring_index(F.substring_index(path, "/", 1), ".", 1)
        return F.struct(kind.alias("kind"), parts.alias("n"), F.pmod(F.xxhash64(begin), F.lit(BEGINNINGS)).alias("begin"))

    parts = F.size(F.split("prefix", F.when(F.col("kind") == "below", "[/]").otherwise("[.]")))
    shapes = owners.where("prefix IS NOT NULL").agg(F.collect_set(shape(F.col("kind"), parts, "prefix")).alias("shapes"))

    def prefixes(separator: str, kind: str, first: Column, last: int) -> Column:
        parts = F.split("path", "[" + separator + "]")
        count = F.size(parts) - last
        wanted = F.filter(F.sequence(first(count), count), lambda n: F.array_contains(F.col("__shapes"), shape(F.lit(kind), n, "path")))
        cut = F.transform(wanted, lambda n: entry(kind, F.array_join(F.slice(parts, 1, n), separator)))
        return F.when(count > 0, cut).otherwise(F.array().cast("array<struct<kind:string,prefix:string>>"))

    one = lambda count: F.lit(1)
    offers = F.concat(prefixes("/", "below", one, 0), prefixes(".", "dotted", one, 1), prefixes(".", "same", lambda count: count, 0))
    bucket = F.pmod(F.xxhash64("kind", "prefix"), F.lit(BUCKETS))
    offered = files.select("path").where("path IS NOT NULL").withColumn("__shapes", shapes.scalar())
    offered = offered.select("path", F.explode(offers).alias("__o")).select("path", "__o.kind", "__o.prefix").withColumn("bucket", bucket)
    # the owners of a bucket with far more offers than others stand in every one of the copies that files are dealt to by their
    # hash, so a folder of many files is spread; counts are exact, so both sides of the join see the same buckets
    dealt = offered.groupBy("bucket").count().agg(F.collect_list(F.struct("bucket", "count")).alias("all"), F.sum("count").alias("sum"))
    hot = dealt.select(F.transform(F.filter("all", lambda x: x["count"] * HOT_SHARE > F.col("sum")), lambda x: x["bucket"]).alias("hot"))
    copies = F.when(F.array_contains("__hot", F.col("bucket")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    owners = owners.withColumn("bucket", bucket).withColumn("__hot", hot.scalar()).select("kind", "prefix", F.explode(copies).alias("salt"))
    salt = F.when(F.array_contains("__hot", F.col("bucket")), F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    return offered.withColumn("__hot", hot.scalar()).select("path", "kind", "prefix", salt.alias("salt")), owners


def folder_counts(files: DataFrame) -> DataFrame:
    """Number of paths per top-level folder, most first."""
    top = F.substring_index("path", "/", 1)
    folder = (
        F.when(F.col("path").startswith("rules/"), "rules")
        .when(F.col("path").startswith("data-elements/"), "data_elements")
        .otherwise(F.when(top == "", "(root)").otherwise(top))
    )
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder")
