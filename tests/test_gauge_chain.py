"""From gauges and model field to extracted series, and on to published tables."""
import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from soundings.operators import tide
from soundings.plans import gauge_validation
from soundings.sources import sink

T0 = dt.datetime(2024, 1, 1)


def inputs(spark):
    cells = spark.createDataFrame([("a", 1, 1, 0.0, 50.0, 30.0, 3), ("a", 2, 1, 0.05, 50.0, 30.0, 0), ("a", 3, 1, 2.0, 52.0, 30.0, 3)],
                                  "run string, x int, y int, lon double, lat double, bathymetry double, bottom_level int")
    field = spark.createDataFrame([("a", x, 1, T0 + dt.timedelta(hours=h), float(10 * x + h)) for x in (1, 2, 3) for h in range(0, 10, 2)],
                                  "run string, x int, y int, t timestamp_ntz, ssh double")
    stations = spark.createDataFrame([(1, 0.03, 50.0), (2, 1.0, 51.0), (3, 9.0, 50.0), (4, 2.0, 52.0)], "port int, lon double, lat double")
    rows = [(p, T0 + dt.timedelta(minutes=m), None if (p, m) == (1, 90) else float(m)) for p in (1, 2, 3, 4) for m in (-30, 0, 90, 150, 480, 500)]
    return spark.createDataFrame(rows, "port int, time timestamp_ntz, ssh double"), stations, cells, field


def test_extract(spark):
    """Nearest sea cell within 5 km, linear in time, inside extent and period, one mask."""
    got = {(r.port, int((r.time - T0).total_seconds() // 60)): (r.ssh_obs, r.ssh_mod) for r in gauge_validation.gauge_extract(*inputs(spark)).collect()}
    assert got == {(1, 0): (0.0, 10.0), (1, 90): (None, None), (1, 150): (150.0, 12.5), (1, 480): (480.0, 18.0),
                   (4, 0): (0.0, 30.0), (4, 90): (90.0, 31.5), (4, 150): (150.0, 32.5), (4, 480): (480.0, 38.0)}


def test_a_second_run_is_refused_or_chosen(spark):
    series, stations, cells, field = inputs(spark)
    both = field.unionByName(field.withColumn("run", F.lit("b")).withColumn("ssh", F.col("ssh") + 100))
    with pytest.raises(PySparkException, match="several runs"):
        gauge_validation.gauge_extract(series, stations, cells.drop("run"), both).collect()
    chosen = gauge_validation.gauge_extract(series, stations, cells.drop("run"), both, run="b").filter("port = 4 and ssh_mod = 130.0")
    assert chosen.count() == 1


def test_published_tables(spark, tmp_path):
    planted = {"M2": (1.0, 30.0), "O1": (0.4, 200.0)}
    epoch = (T0 - dt.datetime(1970, 1, 1)).total_seconds() / 3600
    tides = lambda k: sum(a * math.cos(math.radians(tide.SPEEDS[c] * (epoch + k) - g)) for c, (a, g) in planted.items())
    rows = [(1, T0 + dt.timedelta(hours=k), tides(k), 1.2 * tides(k) + (0.5 if k == 100 else 0.0)) for k in range(24 * 40)]
    extract = spark.createDataFrame(rows, "port int, time timestamp_ntz, ssh_obs double, ssh_mod double")
    gauge_validation.publish_gauge_tables(extract, str(tmp_path), minimum=30, constituents=["M2", "O1"], nodal=False, levels=[0.1, 0.4])
    read = lambda name: sink.read_published(spark, str(tmp_path), name)
    assert set(sink.current_manifest(spark, str(tmp_path))) == {"constituents", "tides", "residuals", "scores", "threshold_hours", "threshold_days"}
    table = {r.constituent: r for r in read("constituents").collect()}
    assert table["M2"].a_obs == pytest.approx(1.0, abs=1e-3) and table["M2"].a_mod == pytest.approx(1.2, abs=5e-3) and table["O1"].a_err == pytest.approx(0.08, abs=5e-3)
    assert read("tides").count() == 3 * len(rows) and read("residuals").count() == len(rows)
    assert {(r.threshold, r.n_obs, r.n_mod) for r in read("threshold_hours").collect()} == {(0.1, 0, 1), (0.4, 0, 1)}
    assert {(r.threshold, r.n_mod) for r in read("threshold_days").collect()} == {(0.1, 1), (0.4, 1)}
    assert {r.season for r in read("scores").collect()} == {"All", "DJF"}


def test_tables_with_nodal_terms_and_latitude(spark):
    rows = [(1, T0 + dt.timedelta(hours=k), math.sin(k / 2.0), math.cos(k / 2.0)) for k in range(24 * 40)]
    extract = spark.createDataFrame(rows, "port int, time timestamp_ntz, ssh_obs double, ssh_mod double")
    latitudes = spark.createDataFrame([(1, 53.0)], "port int, lat double")
    tables = gauge_validation.gauge_tables(extract, minimum=30, constituents=["M2", "O1", "M4"], latitudes=latitudes)
    assert {r.constituent for r in tables["constituents"].collect()} == {"M2", "O1", "M4"}
    assert tables["residuals"].filter("ntr_obs is null").count() == 0
