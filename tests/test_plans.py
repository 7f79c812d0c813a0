"""Physical plans: no pair-forming joins, and filters and columns reach the files."""
import pytest

from __spark_entry__ import queries
from catalog.base import QUERIES
from soundings.operators import spatial, timejoin
from soundings.operators.clean import lonlat_box, time_window

FOLDER = "/root/testdata/sf0.001"
queries()  # registers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "headers")
    spark.range(10).selectExpr("id as profile_id", "timestamp_ntz'2004-01-05 00:00:00' as time", "id * 1.0D as lon", "50.0D as lat", "'x' as unused").write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        df = time_window(lonlat_box(spark.read.parquet(path)), "2004-01-01", "2004-02-01").select("profile_id")
        pushed = plan(df).split("PushedFilters: ")[1]
        assert "GreaterThanOrEqual(lon,-25.47)" in pushed and "LessThan(time," in pushed and "unused" not in pushed
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_search_shares_one_shuffle_of_its_input(spark):
    obs = spark.range(100).selectExpr("cast(id % 3 as int) as port", "timestamp_ntz'2004-01-05 00:00:00' + make_dt_interval(0, id) as time", "id * 1.0D as ssh")
    df = timejoin.interpolate_in_time(obs, obs, "ssh", ["port"])
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_positions_are_joined_by_box(spark):
    cells = spark.range(50).selectExpr("cast(id as int) as x", "0 as y", "id * 0.1D as lon", "id * 0.1D as lat", "1 as bottom_level")
    points = spark.range(50).selectExpr("id as profile_id", "id * 0.1D as lon", "id * 0.1D as lat")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spatial.nearest_cell(points, cells, 5.0))
        assert "SortMergeJoin [_band" in text and "_salt" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
