"""Plans that must hold at scale: what is shuffled, pruned and broadcast."""

import pytest
from webtables.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(spark, name):
    if name.endswith("_stream"):
        pytest.skip("runs a stream when built")
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["breakdown_all", "rejected_beacons", "top_values"])
def test_rank_is_limited_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "WindowGroupLimit" in plan and ", Partial" in plan


@pytest.mark.parametrize("name", ["extract_edge_events", "extract_first_event", "match_request", "parse_beacons", "classify_channel", "contract_check", "keep_qs"])
def test_row_work_does_not_shuffle(spark, name):
    assert "Exchange" not in plan_of(QUERIES[name](spark, FOLDER))


@pytest.mark.parametrize("name", ["search_aggregate", "snapshot_diff", "three_way_compare", "site_sessions"])
def test_groups_are_combined_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "partial_" in plan and "OuterJoin" not in plan and "FullOuter" not in plan


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_medians_shuffle_counts_only(spark, no_broadcast):
    plan = plan_of(QUERIES["group_median"](spark, FOLDER))
    assert plan.count("FileScan") == 1 and "SortMergeJoin" not in plan
    # what is exchanged first is counts by group and value, added up in each task before
    first = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line][-1]
    assert first.count("#") >= 3 and "partial_count" in plan and "SortAggregate" not in plan


def test_profile_reads_the_table_twice(spark, no_broadcast):
    plan = plan_of(QUERIES["numeric_profile"](spark, FOLDER))  # the other scan was that of the sketches
    assert plan.count("FileScan") == 1 and "SortMergeJoin" not in plan and "Expand" not in plan


@pytest.mark.parametrize("name", ["three_way_compare", "conflict_records"])
def test_versions_are_compared_without_their_texts(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    if name == "three_way_compare":
        assert "SortAggregate" not in plan and "_text" not in plan.split("Exchange hashpartitioning")[0]
    else:
        assert "LeftSemi" in plan


@pytest.mark.parametrize("name", ["union_sites", "site_key_join"])
def test_sites_are_joined_on_the_stored_column(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    joins = [line for line in plan.splitlines() if "Join [url" in line or "Join [__url" in line]
    assert joins and not any("site_key" in line or "regexp" in line for line in joins)


def test_only_winners_are_extracted(spark, no_broadcast):
    """Above the aggregation stand the fields, below it the event as it was read."""
    plan = plan_of(QUERIES["first_capture_page"](spark, FOLDER))
    above, below = plan.split("SortAggregate", 1)
    assert "AS eventType" in above and "AS eventType" not in below and "__event" in below


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.endswith("_stream")))
def test_no_cross_join_without_broadcasts(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_files_of_a_hot_folder_are_spread(spark, no_broadcast):
    plan = plan_of(QUERIES["outside_files"](spark, FOLDER))
    assert any("salt" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


@pytest.mark.parametrize("name", ["outside_files", "folder_counts"])
def test_copies_of_owners_are_not_broadcast(spark, name):
    """Sixteen copies of each owner are far more than the size that Spark's statistics give them."""
    plan = plan_of(QUERIES[name](spark, FOLDER))
    joins = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
