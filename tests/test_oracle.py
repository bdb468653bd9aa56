"""Every registered query against its SQL, and under another session time zone."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from chartline.plans import event_queries
from check_queries import normal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(event_queries.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    ours = driver.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(driver.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


@pytest.mark.parametrize(
    "name", ["ingest_readings", "resample_median", "resample_custom_width", "event_density_hour", "event_context", "nearest_reading"]
)
def test_session_zone_changes_nothing(spark, name):
    query = driver.queries()[name]
    kept = spark.conf.get("spark.sql.session.timeZone")
    expected = normal(query(spark, SF).toPandas())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert normal(query(spark, SF).toPandas()) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)


def test_entry(spark):
    out = driver.entry(spark)
    assert out.columns == ["user_id", "ts", "click", "view", "purchase", "signup"]
    assert out.count() > 0
