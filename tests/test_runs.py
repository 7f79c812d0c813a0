"""Two runs in one table stay apart or are refused; the CRPS reads only what it needs."""
import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from soundings.operators import matchup, spatial, surface
from soundings.plans import surface_crps
from soundings.schema import TABLES, one_run

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def field(spark):
    rows = [(run, 2024, 1, T0, 1, 1, 0, 1.0, value, 35.0) for run, value in (("a", 10.0), ("b", 20.0))]
    return spark.createDataFrame(rows, TABLES["grid_field"])


def test_surface_means_by_run(field):
    assert {r.run: r.temperature for r in surface.surface_mean(field, ["temperature"]).collect()} == {"a": 10.0, "b": 20.0}
    one = surface.surface_mean(field.filter("run = 'a'").drop("run"), ["temperature"]).collect()
    assert [r.temperature for r in one] == [10.0] and "run" not in one[0]


def test_model_columns_by_run(spark, field):
    plain = spark.createDataFrame([(5, 1, 1, T0)], "profile_id long, x int, y int, t timestamp_ntz")
    assert {(r.run, r.temperature) for r in matchup.model_columns(plain.withColumn("run", F.lit("b")), field, ["temperature"]).collect()} == {("b", 20.0)}
    assert one_run(field.filter("run = 'b'")).columns == [c for c in field.columns if c != "run"]
    assert matchup.model_columns(plain, one_run(field.filter("run = 'b'")), ["temperature"]).count() == 1
    with pytest.raises(PySparkException, match="several runs"):
        one_run(field).collect()


def test_crps_field_is_cut_before_its_mean(spark, field):
    obs = spark.createDataFrame([(1, -5.0, 50.0, T0)], "profile_id long, lon double, lat double, t timestamp_ntz")
    cells = spark.createDataFrame([(1, 1, -5.0, 50.0, 3), (9, 9, 20.0, 50.0, 3)], "x int, y int, lon double, lat double, bottom_level int")
    own = one_run(field.filter("run = 'a'"))
    far = own.withColumns({"x": F.lit(9), "y": F.lit(9)})
    later = own.withColumn("t", F.col("t") + F.expr("interval 1 day"))
    needed = surface_crps.needed_field(own.unionByName(far).unionByName(later), obs, spatial.neighbourhood(obs, cells, 20.0))
    assert [(r.x, r.t) for r in needed.collect()] == [(1, T0)]
    plan = surface.surface_mean(needed, ["temperature"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [x") < plan.index("LeftSemi")
