"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from chartline.operators import bins, combine, select
from chartline.plans import event_queries as eq

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan_of(df).split("Initial Plan")[0]


@pytest.mark.parametrize("name", sorted(eq.QUERIES))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(driver.queries()[name](spark, SF))
    for banned in ("NestedLoop", "Cartesian", "Python", "Pandas", "ObjectHashAggregate", "SortAggregate"):
        assert banned not in plan, banned


def test_every_query_has_sql():
    assert set(eq.QUERIES) <= set(driver.queries()) and set(eq.QUERIES) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else the plan text is cut short
    df = select.filter_patient(eq.readings(spark, SF), 3, eq.USERS)
    df = select.filter_time_range(df, *eq.RANGE, layout=eq.USERS).select("ts", "click")
    plan = plan_of(df)
    assert "EqualTo(user_id,3)" in plan
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>", plan)


def test_mean_is_one_aggregate_over_rows_and_grid(spark):
    plan = final_plan(bins.resample(eq.readings(spark, SF), "1h", layout=eq.USERS))
    assert "Join" not in plan and "Sort" not in plan
    assert "partial_avg" in plan


def test_value_counts_of_medians_are_shuffled_once(spark):
    plan = final_plan(bins.resample(eq.readings(spark, SF), "6h", "median", layout=eq.USERS))
    # Nothing reads them twice at run time: where every band holds one value, the second division is dropped.
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*_value#", plan)) == 1
    assert plan.count("FileScan") == 2  # once for the values, once for the grid


def test_profile_scans_for_gaps_and_chunks_only(spark):
    plan = final_plan(driver.queries()["sampling_profile"](spark, SF))
    assert plan.count("FileScan") <= 2


def test_nearest_scans_readings_twice_and_events_once(spark):
    assert final_plan(driver.queries()["nearest_reading"](spark, SF)).count("FileScan") <= 3


def test_duplicates_are_cut_before_the_shuffle(spark):
    df = combine.dedupe_readings(eq.table(spark, SF), ["event_id"], eq.USERS)
    plan = plan_of(df)
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_windows_never_span_a_whole_series(spark):
    """Row-level windows are partitioned by entity and chunk; those by entity alone see summaries."""
    for name in ("nearest_reading", "event_context", "reading_gaps"):
        plan = plan_of(driver.queries()[name](spark, SF))
        for spec in re.findall(r"Window \[[^\n]*\], \[([^\]]*)\], \[[^\]]*\b_?(?:ts|at)#", plan):
            assert "_chunk" in spec or "_cell" in spec, (name, spec)


def test_grid_blocks_are_spread_over_tasks(spark):
    spans = spark.sql(
        "select 'p' as id, timestamp_ntz'2024-01-01' as a, timestamp_ntz'2024-01-02' as b"
    )
    grid = bins.bin_grid(spans, ["id"], "a", "b", F.lit(1_000_000), "bin")
    sizes = [r[1] for r in grid.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 86_401 and len(sizes) > 1


def test_building_queries_starts_no_job(spark):
    """Operators are lazy: besides reading the schema, nothing runs until a result is asked for."""
    from chartline.plans.event_queries import QUERIES

    tracker = spark.sparkContext.statusTracker()
    for name in ("flag_event_rows", "resample_raw", "resample_auto", "resample_custom_width", "event_context", "event_table", "nearest_reading"):
        spark.sparkContext.setJobGroup(f"build {name}", name)
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(tracker.getJobIdsForGroup(f"build {name}")) <= 4, name  # schemas of the reads
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def above(plan, pattern):
    """Names of all operators above the first one that matches."""
    lines = [(re.search(r"[*A-Z]", line).start(), line) for line in plan.splitlines() if re.search(r"[*A-Z]", line)]
    at = next(i for i, (_, line) in enumerate(lines) if re.search(pattern, line))
    depth, found = lines[at][0], []
    for indent, line in reversed(lines[:at]):
        if indent < depth:
            depth = indent
            found.append(re.search(r"[A-Z]\w+", line).group())
    return found


@pytest.mark.parametrize("name", ["resample_mean", "resample_two_signals", "resample_custom_width", "event_density_hour"])
def test_empty_bins_are_neither_shuffled_nor_hashed(spark, name):
    """A dense grid is many times its rows: a task that shuffles or hashes it bin by bin grows with the grid."""
    found = above(final_plan(driver.queries()[name](spark, SF)), r"Generate explode\(sequence\(.*\[_index#")
    assert found and not {"Exchange", "HashAggregate", "SortAggregate", "Sort"} & set(found), found
