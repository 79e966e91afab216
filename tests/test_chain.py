import numpy as np
import pytest
from pyspark.sql import functions as F

from webtables.operators import chain, profile
from webtables.operators.quantiles import exact_percentiles


@pytest.fixture
def shop(spark):
    data = [("20260301", "/a?x=1&id=7", "blue", 4, 1.5), ("20260302", "/a", "red", None, float("nan")), ("later", "/b#t", None, 6, 2.5), ("20260302", "/b", None, 1, None)]
    return spark.createDataFrame(data, "day string, page string, color string, units int, rate double")


def test_transform_parses_arguments():
    assert chain.parse_transforms("page:strip_qs:id,ref, day:date_format") == [("page", "strip_qs", ["id", "ref"]), ("day", "date_format", [])]
    for bad in ("", "page", "page:", "page:upper", ":strip_qs", "day:date_format,ref"):
        with pytest.raises(ValueError):
            chain.parse_transforms(bad)


def test_transform(shop, rows):
    out = chain.transform(shop, "day:date_format,page:strip_qs:id").select("day", "page")
    assert rows(out) == [("2026-03-01", "/a?id=7"), ("2026-03-02", "/a"), ("later", "/b#t"), ("2026-03-02", "/b")]
    with pytest.raises(ValueError, match="column"):
        chain.transform(shop, "nope:date_format")


def test_where_reports_bad_text(shop, rows):
    assert rows(chain.where(shop, "units > 3").select("units"), "units") == [(4,), (6,)]
    for bad in ("units >", "missing = 1"):
        with pytest.raises(ValueError, match="Invalid where"):
            chain.where(shop, bad)


def test_group_keeps_null_keys_and_ignores_nan(shop, rows):
    out = chain.group_aggregate(shop, "color", "sum:units,mean:rate,count:rate,median:units,max:rate")
    assert rows(out, F.asc_nulls_last("color")) == [("blue", 4, 1.5, 1, 4.0, 1.5), ("red", 0, None, 0, None, None), (None, 7, 2.5, 1, 3.5, 2.5)]


@pytest.mark.parametrize("bad", ["sum", "sum:nope", "mode:units", "sum:units,sum:units", ""])
def test_group_rejects(shop, bad):
    with pytest.raises(ValueError):
        chain.group_aggregate(shop, "color", bad)


def test_sort_puts_nulls_last(shop, rows):
    assert [r[3] for r in rows(chain.sort(shop, "units DESC"))] == [6, 4, 1, None]
    assert [r[3] for r in rows(chain.sort(shop, "units"))] == [1, 4, 6, None]
    for bad in ("", "units DOWN", "nope", "units ASC x"):
        with pytest.raises(ValueError):
            chain.sort(shop, bad)


def test_chain_order(shop, rows):
    out = chain.result_chain(shop, transforms="page:path_only", predicate="page = '/a'", group_by="page", aggregate="sum:units", order="page", columns="sum_units", rows=1)
    assert rows(out) == [(4,)]
    with pytest.raises(ValueError):
        chain.result_chain(shop, group_by="page")
    with pytest.raises(ValueError):
        chain.head(shop, 0)


def test_group_sum_options(shop, rows):
    assert rows(chain.group_sum(shop, ["color"], ["units"]), "color") == [("blue", 4), ("red", 0)]
    out = chain.group_sum(shop, ["color"], dropna=False, min_count=1)
    assert rows(out, F.asc_nulls_last("color")) == [("blue", 4, 1.5), ("red", None, None), (None, 7, 2.5)]
    assert rows(chain.to_int(out, ["units", "rate"]), F.asc_nulls_last("color")) == [("blue", 4, 1), ("red", 0, 0), (None, 7, 2)]


def test_percentiles_of_a_large_group_use_narrow_brackets(spark):
    """200,000 distinct values in one group: the brackets hold few of them, the result is that of the sorted group."""
    df = spark.range(200_000).selectExpr("'hot' AS k", "pmod(xxhash64(id), 1000003) / 7.0D AS v")
    values = np.array([r[0] for r in df.select("v").collect()])
    found = exact_percentiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.999}).first()
    assert [found[n] for n in "abc"] == pytest.approx(list(np.percentile(values, [25, 50, 99.9])), abs=1e-9)


@pytest.mark.parametrize("heavy_rows,open_rows", [(5, 1_000_000), (100_000, 1_000_000), (1, 3)])
def test_percentiles_equal_sorting(spark, heavy_rows, open_rows):
    """Hot group, ties, tiny groups: the bracketed path must equal sorting the whole group."""
    rng = np.random.default_rng(3)
    groups = {"hot": np.round(rng.normal(size=6000), 3), "ties": np.repeat([1.0, 2.0, 9.0], 400), "two": np.array([4.0, 7.0]), None: np.array([5.0])}
    data = [(k, float(v)) for k, values in groups.items() for v in values] + [("hot", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    wanted = {"low": 0.1, "mid": 0.5, "p99": 0.99, "top": 1.0}
    found = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", wanted, heavy_rows=heavy_rows, open_rows=open_rows).collect()}
    assert set(found) == set(groups)
    for key, values in groups.items():
        for name, p in wanted.items():
            assert found[key][name] == pytest.approx(np.percentile(values, p * 100), abs=1e-12), (key, name)


def test_profile(shop, rows):
    assert rows(profile.column_stats(shop), "column_name") == [
        ("color", "string", 2), ("day", "string", 0), ("page", "string", 0), ("rate", "double", 2), ("units", "int", 1)]
    assert rows(profile.numeric_profile(shop.select("units")))[0][1:3] == (3, pytest.approx(11 / 3))
    assert rows(profile.top_values(shop.select("color"), 2), "value_rank") == [("color", "<NA>", 2, 1), ("color", "blue", 1, 2)]
    assert rows(profile.extent(shop.withColumnRenamed("day", "month"))) == [(4, "month", "20260301", "later")]
    assert rows(profile.extent(shop)) == [(4, "", "", "")]


def test_percentiles_of_columns_without_values(spark, rows):
    df = spark.range(30_000).selectExpr("id % 3 AS k", "CASE WHEN id % 3 = 1 THEN NULL ELSE id * 1.0D END AS v", "CAST(NULL AS DOUBLE) AS w", "id AS n")
    out = chain.group_aggregate(df, "k", "median:v,median:w,sum:v,count:v,median:n")
    assert rows(out, "k") == [(0, 14998.5, None, 149985000.0, 10000, 14998.5), (1, None, None, 0.0, 0, 14999.5), (2, 15000.5, None, 150005000.0, 10000, 15000.5)]
    shown = {r.column_name: (r["count"], r.p50, r["min"]) for r in profile.numeric_profile(df).collect()}
    assert shown == {"k": (30000, 1.0, 0.0), "v": (20000, 14999.5, 0.0), "w": (0, None, None), "n": (30000, 14999.5, 0.0)}
