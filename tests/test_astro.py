"""Astronomical arguments and nodal factors, in formulas, fits and reconstruction."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from soundings.operators import astro, tide

EPOCH = dt.datetime(1970, 1, 1)
PLANTED = {"M2": (1.2, 40.0), "S2": (0.4, 300.0), "K2": (0.3, 10.0), "N2": (0.25, 200.0), "K1": (0.35, 120.0), "O1": (0.32, 330.0), "P1": (0.1, 77.0),
           "Q1": (0.09, 5.0), "M4": (0.15, 60.0), "MF": (0.06, 90.0)}


def record(port, start, n, latitude=None):
    hours = (start - EPOCH).total_seconds() / 3600 + np.arange(n, dtype=float)
    at, total = astro.sky(hours), np.zeros(n)
    for name, (a, g) in PLANTED.items():
        f, u = astro.nodal(name, at, np, latitude)
        total += a * f * np.cos(np.radians(astro.argument(name, at) + u - g))
    return pd.DataFrame({"port": port, "time": [start + dt.timedelta(hours=k) for k in range(n)], "ssh": total, "lat": latitude})


def table(spark, *records):
    return spark.createDataFrame(pd.concat(records), "port int, time timestamp_ntz, ssh double, lat double").repartition(6)


@pytest.mark.parametrize("one", tide.KNOWN, ids=lambda c: c.name)
def test_arguments_turn_with_the_tables_speeds(one):
    assert astro.known(one.name)
    a, b = astro.sky(240_000.0), astro.sky(240_876.6)
    a, b = a._replace(tau=a.h - a.s), b._replace(tau=876.6 * 15 + b.h - b.s)
    assert (astro.argument(one.name, b) - astro.argument(one.name, a)) / 876.6 == pytest.approx(one.speed, abs=2e-6)


def test_longitudes_at_a_known_time():
    """2000-01-01 12:00: the constants themselves; lunar time is solar time plus sun minus moon."""
    at = astro.sky(astro.J2000)
    assert (at.s, at.h, at.p, at.n) == (218.3164477, 280.46646, 83.3532465, 125.0445479)
    assert at.tau == pytest.approx(180 + at.h - at.s)


def test_factors_over_a_turn_of_the_node():
    at = astro.sky(np.arange(0, 18.613 * 8766, 50.0))
    swing = {"M2": (0.963, 1.037, 2.2), "O1": (0.81, 1.18, 11.1), "K1": (0.88, 1.115, 9.0), "K2": (0.75, 1.32, 18.0), "MF": (0.62, 1.46, 24.1), "S2": (1, 1, 0.01)}
    for name, (low, high, turn) in swing.items():
        f, u = astro.nodal(name, at, np)
        assert np.min(f) == pytest.approx(low, abs=0.01) and np.max(f) == pytest.approx(high, abs=0.01) and np.max(np.abs(u)) <= turn
    f, u = astro.nodal("M2", at, np)
    assert np.allclose(astro.nodal("M4", at, np), (f ** 2, 2 * u)) and np.allclose(astro.nodal("MSF", at, np), (f, -u))


def test_columns_and_arrays_give_the_same(spark):
    hours = np.array([0.0, 123456.0, 262980.0, 480000.5])
    df = spark.createDataFrame([(float(h), 52.0) for h in hours], "h double, lat double")
    for name in ("M2", "O1", "L2", "M1", "2MK3", "M3", "Q1"):
        at = astro.sky(F.col("h"))
        f, u = astro.nodal(name, at, F, astro.off_equator(F.col("lat")))
        rows = df.select("h", (F.lit(0.0) + f).alias("f"), (F.lit(0.0) + u).alias("u"), astro.argument(name, at).alias("v")).orderBy("h").collect()
        mine, theirs = astro.sky(hours), np.full(4, 52.0)
        want_f, want_u = astro.nodal(name, mine, np, theirs)
        assert [r.f for r in rows] == pytest.approx(list(want_f)) and [r.u for r in rows] == pytest.approx(list(want_u), abs=1e-9)
        assert [r.v for r in rows] == pytest.approx(list(astro.argument(name, mine)))


def test_fit_recovers_amplitudes_under_the_modulation_of_18_6_years(spark):
    """A year at each end of the node's turn: the same constants with nodal terms, others without."""
    df = table(spark, record(1, dt.datetime(1997, 3, 1), 8784), record(2, dt.datetime(2006, 6, 1), 8784))
    fits = tide.harmonic_fit(df, "ssh", constituents=list(PLANTED), nodal=True)
    rows = fits.collect()
    assert len(rows) == 2 * len(PLANTED)
    for r in rows:
        a, g = PLANTED[r.constituent]
        assert r.a == pytest.approx(a, abs=1e-6) and (r.g - g + 180) % 360 - 180 == pytest.approx(0, abs=1e-3)
    plain = {(r.port, r.constituent): r.a for r in tide.harmonic_fit(df, "ssh", constituents=list(PLANTED)).collect()}
    assert plain[1, "O1"] < 0.28 < 0.36 < plain[2, "O1"]
    sides = fits.withColumn("source", F.lit("obs"))
    back = tide.reconstruct(df, sides, constituents=list(PLANTED), nodal=True)
    assert back.filter("abs(tide_obs_all - ssh) > 1e-5 or tide_obs_all is null").count() == 0
    assert back.columns == [*df.columns, *(f"tide_{s}_{b}" for s in ("obs", "mod") for b in ("all", "semidiurnal", "diurnal"))]
    # constants of one year predict the other
    other = tide.reconstruct(df.filter("port = 2"), sides.filter("port = 1").withColumn("port", F.lit(2)), constituents=list(PLANTED), nodal=True, bands=("all",))
    assert other.filter("abs(tide_obs_all - ssh) > 1e-4").count() == 0


def test_one_record_of_a_whole_turn(spark):
    """19 years, every third hour: only factors by time can fit it."""
    hours = record(1, dt.datetime(1993, 1, 1), 19 * 8766).iloc[::3]
    df = spark.createDataFrame(hours, "port int, time timestamp_ntz, ssh double, lat double")
    got = {r.constituent: r.a for r in tide.harmonic_fit(df, "ssh", constituents=list(PLANTED), nodal=True).collect()}
    assert got == pytest.approx({c: a for c, (a, _) in PLANTED.items()}, abs=1e-5)


def test_latitude_lines(spark):
    df = table(spark, record(1, dt.datetime(2010, 1, 1), 8784, np.full(8784, 62.0)), record(2, dt.datetime(2010, 1, 1), 8784, np.full(8784, -15.0)),
               record(3, dt.datetime(2010, 1, 1), 8784).assign(lat=None))
    rows = tide.harmonic_fit(df, "ssh", constituents=list(PLANTED), nodal=True, latitude="lat")
    for r in rows.collect():
        assert r.a == pytest.approx(PLANTED[r.constituent][0], abs=1e-6), r
    without = {(r.port, r.constituent): r.a for r in tide.harmonic_fit(df, "ssh", constituents=list(PLANTED), nodal=True).collect()}
    assert abs(without[1, "Q1"] - PLANTED["Q1"][0]) > 1e-4 and without[3, "Q1"] == pytest.approx(PLANTED["Q1"][0], abs=1e-6)
    back = tide.reconstruct(df, rows.withColumn("source", F.lit("mod")), constituents=list(PLANTED), nodal=True, latitude="lat")
    assert back.filter("abs(tide_mod_all - ssh) > 1e-5 or tide_mod_all is null").count() == 0


def test_equator_has_finite_factors(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (None,), (60.0,)], "lat double").select(astro.off_equator(F.col("lat")).alias("x"))
    assert [r.x for r in df.collect()] == [5.0, -5.0, None, 60.0]


def test_own_constituents_keep_their_speed(spark):
    df = table(spark, record(1, dt.datetime(2010, 1, 1), 1000))
    own = tide.Constituent("X5", 73.25, "shallow")
    got = tide.harmonic_fit(df.withColumn("ssh", F.col("ssh") * 0 + F.cos(F.radians(F.unix_micros(F.col("time").cast("timestamp")) / 3.6e9 * 73.25))),
                            "ssh", constituents=[own], nodal=True).first()
    assert got.a == pytest.approx(1.0, abs=1e-6) and min(got.g, 360 - got.g) < 1e-3
