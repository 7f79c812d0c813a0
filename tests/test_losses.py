"""Nothing drops out silently: short series, odd hours, stations without a tide, months without rows."""
import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from soundings import session
from soundings.operators import series, slots, tide
from soundings.plans import gauge_validation, profile_validation
from soundings.sources import write_replacing

T0 = dt.datetime(2024, 1, 1)


def gauges(spark, rows):
    return spark.createDataFrame(rows, "port int, time timestamp_ntz, ssh_obs double, ssh_mod double")


def hourly(port, n, value=lambda k: float(k % 7)):
    return [(port, T0 + dt.timedelta(hours=k), value(k), value(k + 1)) for k in range(n)]


def test_row_off_the_hour_is_an_error_or_is_resampled(spark):
    odd = gauges(spark, [*hourly(1, 3), (1, T0 + dt.timedelta(hours=1, minutes=30), 9.0, 9.0)])
    with pytest.raises(PySparkException, match="whole hour"):
        slots.regular_hours(odd).collect()
    got = {r.i: r.ssh_obs for r in slots.regular_hours(slots.to_hours(odd, ["ssh_obs", "ssh_mod"])).collect()}
    assert got == {0: 0.0, 1: 5.0, 2: 2.0}


def test_station_without_a_fit_keeps_its_rows(spark):
    both = gauges(spark, [*hourly(1, 60), *hourly(2, 60)])
    fits = spark.createDataFrame([(1, s, "M2", 1.0, 10.0) for s in ("obs", "mod")], "port int, source string, constituent string, a double, g double")
    tides = tide.reconstruct(both, fits)
    assert {r.port: r["n"] for r in tides.groupBy("port").agg(F.count("*").alias("n")).collect()} == {1: 60, 2: 60}
    assert tides.filter("port = 2 and tide_obs_all is not null").count() == 0
    one = tides.filter("port = 1").withColumnsRenamed({"tide_obs_all": "tide_obs", "tide_mod_all": "tide_mod"})
    left = series.residual(both, one)
    assert left.count() == 120 and left.filter("port = 2 and ntr_obs is null").count() == 60


@pytest.mark.parametrize("smoothed", [False, True])
def test_scores_name_every_station(spark, smoothed):
    rows = [*hourly(1, 400), *hourly(2, 20)]
    scores = gauge_validation.gauge_scores(gauges(spark, rows), minimum=5, smoothed=smoothed, constituents=["M2"])
    assert {r.port for r in scores.filter("season = 'All'").collect()} == {1, 2}


def test_rerun_month_without_rows_is_emptied(spark, tmp_path):
    path, both = str(tmp_path / "t"), [{"year": 2024, "month": m} for m in (1, 2)]
    rows = spark.createDataFrame([(2024, 1, 1.0), (2024, 2, 2.0), (2023, 1, 0.0)], "year int, month int, v double")
    write_replacing(rows, path, ("year", "month"))
    write_replacing(rows.filter("month = 2 and year = 2024"), path, ("year", "month"), both)
    assert sorted((r.year, r.month) for r in spark.read.parquet(path).collect()) == [(2023, 1), (2024, 2)]


def test_profile_tables(spark, tmp_path):
    variables = ["temperature"]
    rows = [(1, 3, 4, T0, z, d, 2, 10.0 + z, 11.0 + z, 1.0, 1.0, 1.0) for z, d in enumerate((0.5, 3.0, 40.0, 60.0))]
    errors = spark.createDataFrame(rows, "first_id long, x int, y int, t timestamp_ntz, z int, depth double, grid_n long, temperature_obs double, "
                                         "temperature_mod double, diff_temperature double, abs_diff_temperature double, square_diff_temperature double")
    bathymetry = spark.createDataFrame([(3, 4, 65.0)], "x int, y int, bathymetry double")
    column = spark.createDataFrame([(1, 3, 4, T0, 0, 0.5, 9.0)], "profile_id long, x int, y int, t timestamp_ntz, z int, depth double, temperature double")
    depths = [0.5, 3.0, 40.0, 60.0]
    paths = profile_validation.write_profile_tables(errors, bathymetry, variables, str(tmp_path), column, [{"year": 2024, "month": 1}], depths=depths)
    assert set(paths) == {"interpolated_profiles", "interpolated_obs", "profile_errors", "surface_data", "mid_data", "bottom_data", "extracted_profiles"}
    for name in ("interpolated_profiles", "interpolated_obs", "profile_errors"):
        assert spark.read.parquet(paths[name]).count() == 4
    assert spark.read.parquet(paths["extracted_profiles"]).count() == 1
    surface = spark.read.parquet(paths["surface_data"]).collect()
    assert len(surface) == 1 and surface[0]["diff_temperature"] == pytest.approx(1.0)


def test_stages_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "stage_path", lambda spark, name: f"{tmp_path}/stages/{name}")
    assert session.cut_lineage(spark.range(5)).count() == 5 and len(list(tmp_path.glob("stages/*"))) == 1
    session.remove_stages(spark)
    assert not (tmp_path / "stages").exists()


def test_many_constituents_are_recovered(spark):
    import math

    planted = {c.name: (0.02 + 0.9 / (k + 1), (37.0 * k) % 360) for k, c in enumerate(tide.KNOWN)}
    own = tide.Constituent("X5", 73.25, "shallow")
    planted["X5"] = (0.3, 123.0)
    hours = 24 * 380
    kept = tide.resolvable([*tide.ALL, own], hours)
    assert len(kept) >= 30 and "X5" in kept
    speeds = {**tide.SPEEDS, "X5": 73.25}
    epoch = (T0 - dt.datetime(1970, 1, 1)).total_seconds() / 3600
    rows = [(1, T0 + dt.timedelta(hours=k), 0.2 + sum(planted[c][0] * math.cos(math.radians(speeds[c] * (epoch + k) - planted[c][1])) for c in kept), None)
            for k in range(hours)]
    df = gauges(spark, rows)
    fits = tide.harmonic_fit(df, "ssh_obs", constituents=[own, *(c for c in kept if c != "X5")])
    got = {r.constituent: r for r in fits.collect()}
    assert set(got) == set(kept)
    for c in kept:
        assert got[c].a == pytest.approx(planted[c][0], abs=1e-5) and (got[c].g - planted[c][1] + 180) % 360 - 180 == pytest.approx(0, abs=1e-2)
    both = fits.withColumn("source", F.lit("obs"))
    back = tide.reconstruct(df, both, constituents=[own, *(c for c in kept if c != "X5")]).filter("abs(tide_obs_all + 0.2 - ssh_obs) > 1e-4 or tide_obs_all is null")
    assert back.count() == 0
    with pytest.raises(ValueError, match="unknown constituents"):
        tide.harmonic_fit(df, "ssh_obs", constituents=["M2", "ZZ9"])


def test_scores_solve_every_constituent_of_the_record(spark):
    import math

    planted = {"M2": 1.2, "S2": 0.4, "M4": 0.3, "MS4": 0.2, "MM": 0.25}
    tides = lambda k: sum(a * math.cos(math.radians(tide.SPEEDS[c] * k - 40 * a)) for c, a in planted.items())
    rows = [(1, T0 + dt.timedelta(hours=k), tides(k), 1.1 * tides(k)) for k in range(24 * 60)]
    one = gauge_validation.gauge_scores(gauges(spark, rows), minimum=30).filter("season = 'All'").first()
    assert one.ntr_std_obs < 1e-6 and one.ntr_std_mod < 1e-6


def test_reconstruction_keeps_every_fitted_constituent(spark):
    fits = spark.createDataFrame([(1, s, "M4", 1.0, 10.0) for s in ("obs", "mod")], "port int, source string, constituent string, a double, g double")
    assert tide.reconstruct(gauges(spark, hourly(1, 5)), fits).filter("tide_obs_all is null").count() == 0
