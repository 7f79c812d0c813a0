"""Small hand-made tables, brute force, and properties."""
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundings.functions import scalars as S
from soundings.operators import (bias, bracket, clean, compare, crps, error, matchup, peaks, quantiles, series, slots, spatial, surface,
                                 threshold, tide, timejoin, vertical)
from soundings.schema import TABLES, canonicalise
from soundings.sources import scan_months, scan_table, stack_tables, write_replacing

T0 = dt.datetime(2010, 1, 1)


def hour(k):
    return T0 + dt.timedelta(hours=k)


def km(lon1, lat1, lon2, lat2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


# ---- numbers and scalars ----------------------------------------------------------------
def test_fixed_lists():
    d = S.reference_depths()
    assert (len(d), d[0], d[49], d[50], d[-1]) == (134, 1.0, 99.0, 100.0, 3900.0)
    assert S.thresholds() == [round(-0.4 + 0.1 * k, 1) for k in range(24)]
    assert S.record_lengths()[:2] == [25, 1025] and S.record_lengths()[-1] < 8760
    assert S.layer_thickness([0.0, 2.0, 6.0, 8.0]) == [3.0, 3.0, 3.0, 3.0]


def test_angles(spark):
    rows = [(359.0, 1.0), (1.0, 359.0), (180.0, 0.0), (0.0, 180.0), (10.0, None)]
    got = [r.r for r in spark.createDataFrame(rows, "a double, b double").select(S.wrap_phase("a", "b").alias("r")).collect()]
    assert got == [-2.0, 2.0, -180.0, -180.0, None]
    pair = spark.createDataFrame([(5.0, 300.0), (340.0, 10.0), (100.0, 120.0)], "m double, o double")
    assert [r.r for r in pair.select(S.unwrap_pair("m", "o").alias("r")).collect()] == [365.0, -20.0, 100.0]
    bad = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0)], "a double, b double").select(S.bias_angle("a", "b").alias("r"))
    assert [r.r for r in bad.collect()] == [None, math.pi / 2]


def test_bins_are_closed_on_the_right_side(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,), (2.1,)], "x double")
    left = [r.b for r in df.select(S.histogram_bin("x", 0.0, 2.0, 2).alias("b")).collect()]
    right = [r.b for r in df.select(S.interval_bin("x", 0.0, 2.0, 2).alias("b")).collect()]
    assert left == [0, 0, 1, 1, None] and right == [None, 0, 0, 1, None]


def test_month_list(spark):
    df = spark.createDataFrame([(dt.datetime(2003, 11, 5), dt.datetime(2004, 2, 1))], "a timestamp_ntz, b timestamp_ntz")
    got = df.select(F.explode(S.month_list("a", "b")).alias("m")).select(S.month_key("m").alias("k")).collect()
    assert [r.k for r in got] == ["200311", "200312", "200401"]


# ---- schema, sources, filters -----------------------------------------------------------
def test_canonical_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan"), 3.0)], "profile_id long, temp double, depth double")
    row = canonicalise(df, "profile_level", {"temp": "temperature"}).first()
    assert row.temperature is None and row.salinity is None and row.depth == 3.0


def test_month_scan_prunes_folders(spark, tmp_path):
    rows = [("a", y, m, dt.datetime(y, m, 1), 0, 0, 0, 1.0, float(m), 35.0) for y in (2004, 2005) for m in range(1, 13)]
    write_replacing(spark.createDataFrame(rows, TABLES["grid_field"]), str(tmp_path / "f"), ("year", "month"))
    df = scan_months(spark, "grid_field", str(tmp_path / "f"), (2004, 11), (2005, 2))
    assert sorted((r.year, r.month) for r in df.collect()) == [(2004, 11), (2004, 12), (2005, 1), (2005, 2)]
    assert "PartitionFilters: [isnotnull" in df._jdf.queryExecution().executedPlan().toString()


def test_stack_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(1, 3)], "k int, y int")
    assert sorted(map(tuple, stack_tables([a, b]).collect()), key=str) == [(1, 2, None), (1, None, 3)]


def test_limits_are_inclusive(spark):
    m = spark.createDataFrame([(1, 5.0, 43200), (2, 5.0001, 0), (3, 1.0, -43201)], "profile_id long, interp_dist_km double, interp_lag_s long")
    assert [r.profile_id for r in clean.within_lag(clean.within_distance(m)).collect()] == [1]
    assert [r.profile_id for r in clean.within_distance(m, inclusive=False).collect()] == [3]
    assert tuple(clean.drop_audit(m).first()) == (3, 1, 1, 1)


def test_flags_and_neighbours(spark):
    lv = spark.createDataFrame([(1, z, float(z), 1) for z in range(5)] + [(2, 0, 1.0, 4)], "profile_id long, z int, temperature double, qc int")
    lv = lv.withColumn("qc", F.when((F.col("profile_id") == 1) & (F.col("z") == 2), 4).otherwise(F.col("qc")))
    plain = {r.z: r.temperature for r in clean.null_flagged(lv, ["temperature"], F.col("qc") == 4).collect()}
    wide = {r.z: r.temperature for r in clean.null_flagged(lv, ["temperature"], F.col("qc") == 4, neighbours=True).collect()}
    assert plain == {0: 0.0, 1: 1.0, 2: None, 3: 3.0, 4: 4.0} and wide == {0: 0.0, 1: None, 2: None, 3: None, 4: 4.0}


def test_empty_inputs(spark):
    lv = spark.createDataFrame([], "profile_id long, z int, depth double, temperature double")
    assert vertical.interpolate_to_depths(lv, ["temperature"]).count() == 0
    assert quantiles.exact_quantiles(lv, ["profile_id"], "temperature", [0.5]).count() == 0


# ---- spatial ----------------------------------------------------------------------------
@pytest.mark.parametrize("lon0,lat0,spread,radius", [(0.0, 55.0, 2.0, 20.0), (179.9, 10.0, 1.0, 30.0), (0.0, 89.5, 180.0, 40.0), (-60.0, -70.0, 3.0, 25.0)])
def test_pairs_equal_brute_force(spark, lon0, lat0, spread, radius):
    rng = random.Random(int(lat0))
    wrap = lambda v: (v + 180.0) % 360.0 - 180.0
    dlat = min(spread, 90.0 - abs(lat0))
    place = lambda: (wrap(lon0 + rng.uniform(-spread, spread)), lat0 + rng.uniform(-dlat, dlat))
    points, cells = [place() for _ in range(120)], [(k, 0, *place(), 1) for k in range(150)]
    got = spatial.pairs_within(
        spark.createDataFrame(points, "lon double, lat double"),
        spark.createDataFrame(cells, "x int, y int, lon double, lat double, bottom_level int"), radius, ["x", "y"])
    want = {(round(p[0], 9), c[0]) for p in points for c in cells if km(*p, c[2], c[3]) <= radius}
    found = [(round(r.lon, 9), r.x) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and want


def test_nearest_cell_ties_and_land(spark):
    cells = spark.createDataFrame([(2, 0, 0.1, 50.0, 1), (1, 0, -0.1, 50.0, 1), (0, 0, 0.0, 50.0, 0)], "x int, y int, lon double, lat double, bottom_level int")
    points = spark.createDataFrame([(7, 0.0, 50.0), (8, 3.0, 50.0)], "profile_id long, lon double, lat double")
    assert [(r.profile_id, r.x) for r in spatial.nearest_cell(points, cells, 20.0).collect()] == [(7, 1)]


def test_station_match_equals_brute_force(spark):
    rng = random.Random(5)
    a = [(k, rng.uniform(-20, 15), rng.uniform(44, 64)) for k in range(60)] + [(99, 170.0, -40.0)]
    b = [(k, rng.uniform(-20, 15), rng.uniform(44, 64)) for k in range(25)]
    make = lambda rows: spark.createDataFrame(rows, "port int, lon double, lat double")
    got = {r.left_key: r.right_key for r in spatial.match_stations(make(a), make(b)).collect()}
    assert got == {p[0]: min(b, key=lambda q: ((q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2, q[0]))[0] for p in a}


def test_region_parity_and_limits(spark):
    square = [("r", k, *p) for k, p in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])]
    poly = spark.createDataFrame(square, "region string, seq int, lon double, lat double")
    cells = spark.createDataFrame([(0, 0, 1.0, 1.0, 50.0), (1, 0, 5.0, 1.0, 50.0), (2, 0, 2.0, 2.0, 500.0)], "x int, y int, lon double, lat double, bathymetry double")
    limits = spark.createDataFrame([("r", None, 100.0)], "region string, min_depth double, max_depth double")
    assert [(r.region, r.x) for r in spatial.region_cells(cells, poly, limits).collect()] == [("r", 0)]
    assert sorted(r.x for r in spatial.region_cells(cells, poly).collect()) == [0, 2]
    assert spatial.region_cells(cells, poly, whole_domain="all").filter("region = 'all'").count() == 3


# ---- time and depth ---------------------------------------------------------------------
@pytest.mark.parametrize("width", [0.7, 3.0, 1000.0])
def test_bracket_equals_brute_force(spark, width):
    rng = random.Random(3)
    known = sorted({(k, round(rng.uniform(-20, 20), 1)) for k in (1, 2) for _ in range(30)})
    wanted = [(k, round(rng.uniform(-25, 25), 1)) for k in (1, 2, 3) for _ in range(60)] + known[:5]
    got = bracket.bracket(spark.createDataFrame(wanted, "k int, x double"),
                          spark.createDataFrame([(k, x, x * 10) for k, x in known], "k int, x double, v double"), ["k"], "x", ["v"], width)
    rows = got.collect()
    assert len(rows) == len(set(wanted))
    for r in rows:
        lower, upper = [x for k, x in known if k == r.k and x <= r.x], [x for k, x in known if k == r.k and x >= r.x]
        assert (r.before.x if r.before else None) == (max(lower) if lower else None)
        assert (r.after.x if r.after else None) == (min(upper) if upper else None)


def test_nearest_time_prefers_the_earlier(spark):
    obs = spark.createDataFrame([(1, hour(1)), (2, hour(13)), (3, dt.datetime(2010, 1, 1, 4, 0, 0, 5))], "profile_id long, time timestamp_ntz")
    model = spark.createDataFrame([(hour(0),), (hour(2),), (hour(14),)], "t timestamp_ntz")
    got = {r.profile_id: (r.t, r.interp_lag_s) for r in timejoin.nearest_time(obs, model).collect()}
    assert got[1] == (hour(0), -3600) and got[2] == (hour(14), 3600) and got[3] == (hour(2), -7200)


def test_interpolation_in_time_and_outside(spark):
    s = spark.createDataFrame([(1, hour(0), 0.0), (1, hour(2), None), (1, hour(4), 8.0)], "port int, time timestamp_ntz, ssh double")
    want = spark.createDataFrame([(1, hour(k)) for k in (-1, 0, 2, 4, 5)], "port int, time timestamp_ntz")
    got = {r.time: r.ssh for r in timejoin.interpolate_in_time(s, want, "ssh", ["port"]).collect()}
    assert got == {hour(-1): None, hour(0): 0.0, hour(2): 4.0, hour(4): 8.0, hour(5): None}


def test_depth_slots_match_counting(spark):
    depths = S.reference_depths()
    values = [0.0, 1.0, 1.5, 3.0, 98.0, 99.0, 99.5, 100.0, 102.0, 295.0, 297.5, 300.0, 949.0, 950.0, 975.0, 1000.0, 3899.0, 3900.0, 4100.0]
    got = spark.createDataFrame([(v,) for v in values], "d double").select("d", vertical.slot_of_depth(F.col("d"), depths).alias("s")).collect()
    assert all(r.s == sum(d < r.d for d in depths) for r in got)


def test_vertical_interpolation_equals_numpy(spark):
    rng = random.Random(11)
    rows = []
    for pid in range(6):
        for d in sorted(rng.sample(range(0, 700), rng.choice([1, 2, 40]))):
            rows.append((pid, float(d), rng.uniform(0, 20) if rng.random() > 0.2 else None, d * 0.01))
    rows += [(0, rows[0][1], 5.0, rows[0][3])]  # an equal depth
    got = vertical.interpolate_to_depths(spark.createDataFrame(rows, "profile_id long, depth double, temperature double, salinity double"), ["temperature", "salinity"]).collect()
    found = {(r.profile_id, r.depth): r for r in got}
    for pid in range(6):
        for v, k in (("temperature", 2), ("salinity", 3)):
            by_depth = {}
            for r in rows:
                if r[0] == pid and r[k] is not None:
                    by_depth.setdefault(r[1], []).append(r[k])
            xs = sorted(by_depth)
            for d in S.reference_depths():
                value = getattr(found[(pid, d)], v) if (pid, d) in found else None
                if not xs or d < xs[0] or d > xs[-1]:
                    assert value is None
                else:
                    assert value == pytest.approx(np.interp(d, xs, [np.mean(by_depth[x]) for x in xs]))


def test_depth_means(spark):
    lv = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 3.0, None), (1, 2, 5.0, 6.0), (1, 3, 7.0, 100.0)], "profile_id long, z int, depth double, temperature double")
    thick = vertical.with_thickness(lv)
    assert vertical.band_mean(thick, ["temperature"], 0.0, 5.0).first().temperature == 4.0
    bed = thick.withColumn("bathymetry", F.lit(7.0))
    assert vertical.bottom_mean(bed, ["temperature"], (3.0, 30.0), (100.0, float("inf"))).first().temperature == 53.0
    assert vertical.two_level_mean(lv, ["temperature"]).first().temperature == 4.0
    assert [r.thickness for r in vertical.own_thickness(lv).orderBy("z").collect()] == [2.0, 2.0, 2.0, 2.0]


def test_reduce_resolution(spark):
    m = spark.createDataFrame([(1, 0, 0, hour(0)), (2, 0, 0, hour(0)), (3, 1, 0, hour(0))], "profile_id long, x int, y int, t timestamp_ntz")
    make = lambda rows: spark.createDataFrame(rows, "profile_id long, z int, depth double, temperature double")
    obs = make([(1, 0, 1.0, 2.0), (2, 0, 1.0, 4.0), (2, 1, 3.0, 9.0), (3, 0, 1.0, 7.0)])
    mod = make([(1, 0, 1.0, 5.0), (2, 0, 1.0, 50.0), (3, 0, 1.0, 6.0)])
    got = {(r.first_id, r.z): (r.temperature_obs, r.temperature_mod, r.grid_n) for r in matchup.reduce_resolution(m, obs, mod, ["temperature"]).collect()}
    assert got == {(1, 0): (3.0, 5.0, 2), (1, 1): (9.0, None, 2), (3, 0): (7.0, 6.0, 1)}


# ---- statistics -------------------------------------------------------------------------
@pytest.mark.parametrize("bins", [4, 512])
def test_exact_quantiles_equal_numpy(spark, bins):
    rng = np.random.default_rng(1)
    groups = {"normal": rng.normal(size=400), "ties": np.repeat([1.0, 2.0, 7.0], [50, 1, 30]), "one": np.array([4.0]), "same": np.full(9, 3.5),
              "outlier": np.append(rng.uniform(size=200) * 1e-6, [1e9, -1e12]), "wide": np.exp(rng.normal(size=300) * 12)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("normal", None)]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", S.QUANTILES, bins=bins).collect()
    assert len(got) == len(groups) * len(S.QUANTILES)
    for r in got:
        assert r.v == pytest.approx(np.quantile(groups[r.g], r.q), rel=1e-12) and r.n == len(groups[r.g])


def test_weighted_ranks(spark):
    rows = [("a", 1.0, 3), ("a", 5.0, 0), ("a", 2.0, 2), ("a", 9.0, 1)]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double, w int"), ["g"], "v", [0.0, 0.5, 1.0], "w").collect()
    assert {r.q: r.v for r in got} == {0.0: 1.0, 0.5: 1.5, 1.0: 9.0} and got[0].n == 6


def test_std_from_moments_is_population_std(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 7, 7)], "v double").agg(
        S.std_from_moments(F.avg(F.col("v") * F.col("v")), F.avg("v")).alias("a"), F.stddev_pop("v").alias("b")).first()
    assert df.a == pytest.approx(df.b)


def test_seasonal_correlation_needs_more_than_100(spark):
    rows = [(1, s, float(k), float(k % 7), float(k), float(k % 5)) for s, n in (("DJF", 100), ("JJA", 101)) for k in range(n)]
    got = {r.season: r.ntr_corr for r in error.tide_gauge_stats(spark.createDataFrame(rows, "port int, season string, ssh_obs double, ssh_mod double, ntr_obs double, ntr_mod double")).collect()}
    assert got["DJF"] is None and got["JJA"] is not None and got["All"] is not None


def test_difference_sign(spark):
    df = spark.createDataFrame([(3.0, 1.0)], "t_mod double, t_obs double")
    assert tuple(error.difference(df, ["t"]).first())[2:] == (2.0, 2.0, 4.0)
    assert error.difference(df, ["t"], sign=-1).first().diff_t == -2.0


# ---- CRPS -------------------------------------------------------------------------------
def test_crps_equals_pairwise_form(spark):
    rng = random.Random(2)
    cells = [(x, y, x * 0.05, 55.0 + y * 0.05, 0 if (x, y) == (4, 4) else 1) for x in range(8) for y in range(8)]
    field = [(x, y, hour(0), rng.uniform(5, 15), 35.0 if (x + y) % 3 else None) for x, y, *_, b in cells if b]
    obs = [(k, rng.uniform(0, 0.35), 55.0 + rng.uniform(0, 0.35), hour(0), rng.uniform(5, 15), 34.0) for k in range(12)]
    obs.append((99, 0.2, 55.2, hour(0), 8.0, None))
    got = crps.neighbourhood_crps(
        spark.createDataFrame(obs, "profile_id long, lon double, lat double, t timestamp_ntz, temperature double, salinity double"),
        spark.createDataFrame(cells, "x int, y int, lon double, lat double, bottom_level int"),
        spark.createDataFrame(field, "x int, y int, t timestamp_ntz, temperature double, salinity double"), ["temperature", "salinity"]).collect()
    assert len(got) == 4 * (13 + 12)
    value = {(f[0], f[1]): f[3:] for f in field}
    for r in got:
        o = next(o for o in obs if o[0] == r.profile_id)
        k = 0 if r.variable == "temperature" else 1
        near = [(km(o[1], o[2], c[2], c[3]), c) for c in cells]
        if r.radius_km == 0:
            inside = [min((d, c) for d, c in near if c[4])]
        else:
            inside = [(d, c) for d, c in near if d <= r.radius_km]
            assert r.land == any(c[4] == 0 for _, c in inside)
        xs = [value[c[0], c[1]][k] for _, c in inside if c[4] and value[c[0], c[1]][k] is not None]
        assert r.n_points == len(xs)
        if xs:
            want = np.mean([abs(x - o[4 + k]) for x in xs]) - np.mean([[abs(a - b) for a in xs] for b in xs]) / 2
            assert r.crps == pytest.approx(want, abs=1e-9) and r.crps >= -1e-9
        else:
            assert r.crps is None


# ---- series, tides, peaks ---------------------------------------------------------------
def hourly(spark, values, port=1):
    return slots.regular_hours(spark.createDataFrame([(port, hour(k), v) for k, v in enumerate(values)], "port int, time timestamp_ntz, ssh double"))


def test_regular_hours_fills_gaps(spark):
    df = spark.createDataFrame([(1, hour(0), 1.0), (1, hour(50), 2.0), (2, hour(3), 3.0)], "port int, time timestamp_ntz, ssh double")
    got = slots.regular_hours(df).orderBy("port", "i").collect()
    assert [r.i for r in got] == [*range(51), 0] and got[50].ssh == 2.0 and got[7].ssh is None and got[50].time == hour(50)


@pytest.mark.parametrize("slot", [24, 4096])
def test_smoothing_keeps_cubics_also_at_the_ends(spark, slot):
    values = [0.5 + 0.1 * k - 0.02 * k ** 2 + 3e-4 * k ** 3 for k in range(120)]
    got = {r.i: r.ssh for r in series.smooth(hourly(spark, values), "ssh", slot_hours=slot).collect()}
    assert len(got) == 120 and all(got[k] == pytest.approx(values[k], rel=1e-8, abs=1e-8) for k in got)


def test_smoothing_missing_and_short(spark):
    values = [float(k) for k in range(80)]
    values[40] = None
    got = {r.i: r.ssh for r in series.smooth(hourly(spark, values), "ssh").collect()}
    assert [k for k in range(80) if got[k] is None] == list(range(28, 53))
    short = series.smooth(hourly(spark, [1.0] * 10), "ssh").collect()
    assert len(short) == 10 and all(r.ssh is None for r in short)
    with pytest.raises(ValueError):
        series.smoothing_weights(10, 2)


def test_harmonic_fit_recovers_planted_tide(spark):
    planted = {"M2": (1.2, 40.0), "S2": (0.4, 300.0), "K2": (0.1, 10.0), "N2": (0.25, 200.0), "K1": (0.15, 120.0), "O1": (0.12, 330.0), "P1": (0.05, 77.0), "Q1": (0.03, 5.0)}
    epoch = (T0 - dt.datetime(1970, 1, 1)).total_seconds() / 3600
    values = [0.3 + 1e-5 * k + sum(a * math.cos(math.radians(tide.SPEEDS[c] * (epoch + k) - g)) for c, (a, g) in planted.items()) for k in range(4400)]
    df = hourly(spark, values).withColumn("ssh", F.when(F.col("i") % 11 != 3, F.col("ssh")))
    got = {r.constituent: r for r in tide.harmonic_fit(df, "ssh", constituents=tide.CONSTITUENTS).collect()}
    assert set(got) == set(planted)
    for c, (a, g) in planted.items():
        assert got[c].a == pytest.approx(a, abs=1e-6) and (got[c].g - g + 180) % 360 - 180 == pytest.approx(0, abs=1e-3)
    fits = tide.harmonic_fit(df, "ssh", constituents=tide.CONSTITUENTS).select("port", F.lit("obs").alias("source"), "constituent", "a", "g")
    back = tide.reconstruct(df, fits).select("i", "tide_obs_all").collect()
    assert all(r.tide_obs_all == pytest.approx(values[r.i] - 0.3 - 1e-5 * r.i, abs=1e-4) for r in back)
    sweep = {(r.length, r.constituent): r.a for r in tide.record_length_sweep(df, "ssh", [25, 1025, 4400]).collect()}
    assert sweep[4400, "M2"] == pytest.approx(1.2, abs=1e-6) and (25, "S2") not in sweep and (1025, "K2") not in sweep


def test_rayleigh_rule():
    assert tide.resolvable(tide.CONSTITUENTS, 720) == ["M2", "S2", "K1", "O1", "N2", "Q1"]
    assert set(tide.resolvable(tide.CONSTITUENTS, 4383)) == set(tide.CONSTITUENTS)
    assert tide.resolvable(tide.CONSTITUENTS, 4380) and "K2" not in tide.resolvable(tide.CONSTITUENTS, 4380)


def greedy(tops, values, distance):
    kept = []
    for i in sorted(tops, key=lambda k: (-values[k], k)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("shape", ["noise", "rising"])
def test_peaks_equal_greedy_over_the_whole_series(spark, shape):
    rng = random.Random(7)
    n = 600
    values = [round(rng.uniform(0, 1), 2) for _ in range(n)] if shape == "noise" else [k * 0.01 + (k % 2) for k in range(n)]
    tops = [k for k in range(1, n - 1) if values[k] > values[k - 1] and values[k] > values[k + 1]]
    k = 1
    while k < n - 1:  # flat tops
        e = k
        while e < n - 1 and values[e + 1] == values[k]:
            e += 1
        if e > k and e < n - 1 and values[k - 1] < values[k] > values[e + 1]:
            tops.append((k + e) // 2)
        k = e + 1
    found = peaks.local_maxima(hourly(spark, values), "ssh", slot_hours=32)
    assert sorted(r.i for r in found.collect()) == sorted(tops)
    # slots far shorter than the chains of the rising series: several rounds
    got = peaks.separated(found, "ssh", 5, slot_hours=64, reach=16).collect()
    assert sorted(r.i for r in got) == greedy(tops, values, 5)


def test_peaks_break_at_missing_values(spark):
    assert [r.i for r in peaks.find_peaks(hourly(spark, [0.0, 2.0, None, 1.0, 3.0, 3.0, 3.0, 1.0]), "ssh", 2).collect()] == [5]


def test_skew_surge(spark):
    tide_peaks = spark.createDataFrame([(1, "obs", hour(10), 1.0), (1, "mod", hour(11), 1.5), (1, "mod", hour(0), 9.0), (1, "obs", hour(40), 1.0)], "port int, source string, time timestamp_ntz, tide double")
    sea = spark.createDataFrame([(1, "obs", hour(15), 1.4), (1, "obs", hour(16), 5.0), (1, "mod", hour(12), 1.6)], "port int, source string, time timestamp_ntz, ssh double")
    got = {r.time: (r.skew_obs, r.skew_mod) for r in peaks.skew_surge(tide_peaks, sea).collect()}
    assert got[hour(10)] == (pytest.approx(0.4), pytest.approx(0.1)) and got[hour(40)] == (None, None)


def test_thresholds(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.4), (1, None), (2, None)], "port int, ntr double")
    got = {(r.port, r.threshold): r.n for r in threshold.exceedance(df, {"n": "ntr"}, [0.4, 0.5, 0.6]).collect()}
    assert got == {(1, 0.4): 2, (1, 0.5): 1, (1, 0.6): 0, (2, 0.4): 0, (2, 0.5): 0, (2, 0.6): 0}
    assert {r.threshold: r.n for r in threshold.exceedance(df, {"n": "ntr"}, [0.4], strict=True).filter("port = 1").collect()} == {0.4: 1}
    day = spark.createDataFrame([(1, hour(1), 1.0), (1, hour(23), 2.0), (1, hour(24 * 31), 5.0)], "port int, time timestamp_ntz, ntr double")
    assert sorted(r.ntr for r in threshold.period_maxima(day, ["ntr"], "day").collect()) == [2.0, 5.0]


def test_taylor_cosine_rule(spark):
    rng = random.Random(9)
    rows = [(p, "M2", rng.uniform(0, 2), rng.uniform(0, 360), rng.uniform(0, 2), rng.uniform(0, 360)) for p in range(20)]
    r = tide.taylor_stats(spark.createDataFrame(rows, "port int, constituent string, a_obs double, g_obs double, a_mod double, g_mod double")).first()
    assert r.rms_err ** 2 == pytest.approx(r.rms_obs ** 2 + r.rms_mod ** 2 - 2 * r.rms_obs * r.rms_mod * r.r)


# ---- two runs ---------------------------------------------------------------------------
def test_alignment_keeps_the_smallest_id(spark):
    make = lambda rows: spark.createDataFrame(rows, "k int, profile_id long, v double")
    got = bias.align_runs(make([(1, 5, 1.0), (1, 4, 2.0), (2, 6, None)]), make([(1, 9, 3.0), (2, 8, 4.0)]), ["v"], ("k",)).collect()
    assert [tuple(r) for r in got] == [(1, 4, 2.0, 3.0)]


def test_bootstrap_draws_and_median(spark):
    rng = random.Random(4)
    rows = [("r", "DJF", p, rng.uniform(0, 1.5)) for p in range(60) for _ in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "region string, season string, profile_id long, angle double")
    m = bias.MultinomialDraws(df, 8, 3, ["region", "season"], slots=4)
    w = m.table
    assert {r.n for r in w.groupBy("rep").agg(F.sum("weight").alias("n")).collect()} == {60}
    p = bias.PoissonDraws(200, 3).spread(df.select("profile_id").distinct()).agg((F.sum("weight") / 200 / 60).alias("m")).first().m
    assert p == pytest.approx(1.0, abs=0.05)
    draws = {}
    for r in w.collect():
        draws.setdefault(r.rep, {})[r.profile_id] = r.weight
    got = {r.rep: r.median for r in bias.bootstrap_median(df, "angle", m, bins=8).collect()}
    for rep, weights in draws.items():
        assert got[rep] == pytest.approx(np.median([v for *_, pid, v in rows for _ in range(weights.get(pid, 0))]))
    hist = bias.bootstrap_histogram(df, "angle", m).groupBy("rep").agg(F.sum("frequency").alias("n")).collect()
    assert {r.rep: r.n for r in hist} == {rep: sum(weights.get(pid, 0) for *_, pid, _ in rows) for rep, weights in draws.items()}


def test_bootstrap_products_equal_repeated_profiles(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["r", None]), "DJF", rng.choice([*range(40), None]), rng.uniform(-1.5, 1.5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "region string, season string, profile_id long, angle double")
    draws = bias.PoissonDraws(30, 3)
    cells = df.groupBy("region", "season", "profile_id", F.floor(F.col("angle") * 4).alias("_cell")).agg(F.count(F.lit(1)).alias("_x"))
    told = {(r.region, r.rep, r._cell): r.n for r in draws.spread(cells).groupBy("region", "rep", "_cell").agg(F.sum(F.col("_x") * F.col("weight")).alias("n")).collect()}
    got = {(r.region, r.rep, r._cell): r._w for r in draws.add_up(cells, ["region", "season"], unit=7).collect()}
    assert got == told


def test_registered_bootstrap_has_the_default_replicates():
    import inspect

    from catalog import runs
    from soundings.plans import bias_angle
    assert runs.N_BOOT == inspect.signature(bias_angle.draws_of).parameters["n_boot"].default == 1000


def test_absent_replicates_count_as_zero(spark):
    df = spark.createDataFrame([(0, 0, 4), (0, 1, 2)], "bin int, rep int, frequency long")
    every = spark.createDataFrame([(0,), (1,)], "bin int")
    got = {r.bin: (r.mean, r.q[3]) for r in bias.summarise_replicates(df, "frequency", ["bin"], 4, every).collect()}
    assert got == {0: (1.5, 1.0), 1: (0.0, 0.0)}


def test_histogram_counts_everything_once(spark):
    df = spark.createDataFrame([("a", v) for v in (-math.pi / 2, 0.3, 0.3, math.pi / 2, None)], "g string, angle double")
    got = bias.histogram(df, "angle", ["g"]).collect()
    assert len(got) == 100 and sum(r.frequency for r in got) == 4 and max(got, key=lambda r: r.bin).frequency == 1


def test_worst_run_skips_missing(spark):
    df = spark.createDataFrame([("DJF", "a", 1.0), ("DJF", "b", 3.0), ("JJA", "a", None), ("JJA", "b", 0.5)], "season string, run string, v double")
    assert {r.season: r.worst_run for r in compare.worst_run(df, "v").collect()} == {"DJF": "b", "JJA": "b"}


def test_profile_bins_average_in_stages(spark):
    lv = spark.createDataFrame([(1, hour(0), 0.1, 50.1, 1.0, 2.0), (1, hour(0), 0.1, 50.1, 4.0, 4.0), (2, hour(0), 0.1, 50.1, 1.0, 9.0), (3, hour(9), 0.1, 50.1, 1.0, 12.0), (4, hour(9), 0.1, 50.1, 5.0, 99.0)],
                               "profile_id long, time timestamp_ntz, lon double, lat double, depth double, temperature double")
    assert surface.monthly_profile_bins(lv, ["temperature"]).first().temperature == 9.0


def test_times_do_not_depend_on_the_session_zone(spark):
    moments = [dt.datetime(2010, 3, 14, 2, 30), dt.datetime(2010, 11, 7, 1, 30, 0, 7), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2100, 7, 1)]
    df = spark.createDataFrame([(m,) for m in moments], "time timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        rows = df.select("time", S.epoch_micros("time").alias("u"), S.from_epoch_micros(S.epoch_micros("time")).alias("back")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for r in rows:
        assert r.back == r.time and r.u == (r.time - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


# ---- crowded groups ---------------------------------------------------------------------
def test_crowded_profile_is_reduced_exactly(spark):
    rng = np.random.default_rng(8)
    hot = sorted(set(np.round(rng.uniform(0, 600, 5000), 3).tolist()))
    rows = [(1, d, float(np.sin(d / 30))) for d in hot] + [(p, float(d), float(d + p)) for p in range(2, 40) for d in (3, 50, 120)]
    got = vertical.interpolate_to_depths(spark.createDataFrame(rows, "profile_id long, depth double, temperature double"), ["temperature"])
    found = {r.depth: r.temperature for r in got.filter("profile_id = 1").collect()}
    want = [d for d in S.reference_depths() if hot[0] <= d <= hot[-1]]
    assert sorted(found) == want
    assert all(found[d] == pytest.approx(np.interp(d, hot, np.sin(np.array(hot) / 30))) for d in want)


def test_crowded_box_keeps_every_point(spark):
    rng = random.Random(6)
    points = [(k, rng.uniform(0.0, 0.04), 55.0 + rng.uniform(0.0, 0.04)) for k in range(1500)] + [(k, 0.01, 55.01) for k in range(1500, 3000)] + [(9999, 3.0, 57.0)]
    cells = [(x, y, x * 0.02, 55.0 + y * 0.02, 1) for x in range(4) for y in range(4)]
    got = spatial.nearest_cell(spark.createDataFrame(points, "profile_id long, lon double, lat double"),
                               spark.createDataFrame(cells, "x int, y int, lon double, lat double, bottom_level int"), 5.0).collect()
    assert len(got) == 3000
    for r in got[::37]:
        best = min((km(r.lon, r.lat, c[2], c[3]), c[0], c[1]) for c in cells)
        assert (r.x, r.y) == best[1:] and r.interp_dist_km == pytest.approx(best[0])
