"""The CRPS sends and writes observations and values, not their pairs; tiles send a cell a few times."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundings.functions.scalars import great_circle_km
from soundings.operators import crps, matchup, spatial

T0, T1 = dt.datetime(2010, 1, 1), dt.datetime(2010, 2, 1)
OBS = "profile_id long, lon double, lat double, t timestamp_ntz, temperature double"
CELLS = "x int, y int, lon double, lat double, bottom_level int"
FIELD = "x int, y int, t timestamp_ntz, temperature double"


def shuffled_rows(df):
    """Rows written to shuffles by the query itself, once it has run."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "ShuffleExchangeExec":
            total += node.metrics().get("shuffleRecordsWritten").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def tables(spark, n_obs, n_cells, seed=1):
    rng = random.Random(seed)
    obs = [(k, rng.uniform(0, 0.2), 55 + rng.uniform(0, 0.2), T0 if k % 3 else T1, rng.uniform(5, 15)) for k in range(n_obs)]
    cells = [(k % 50, k // 50, rng.uniform(-0.3, 0.5), 55 + rng.uniform(-0.3, 0.5), 0 if k % 97 == 5 else 1) for k in range(n_cells)]
    field = [(c[0], c[1], t, rng.uniform(5, 15)) for c in cells if c[4] for t in (T0, T1)]
    return obs, cells, field


def frames(spark, obs, cells, field):
    return spark.createDataFrame(obs, OBS), spark.createDataFrame(cells, CELLS), spark.createDataFrame(field, FIELD)


def test_pairs_are_not_sent(spark):
    obs, cells, field = tables(spark, 300, 1500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a large field
    try:
        df = crps.neighbourhood_crps(*frames(spark, obs, cells, field), ["temperature"])
        pairs = spatial.neighbourhood(*frames(spark, obs, cells, field)[:2], 20.0).count()
        assert pairs > 50_000 and 0 < shuffled_rows(df) < 40_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def by_pairs(spark, obs, cells, field, radii):
    """{(key, radius): (crps, n, land)}, from all pairs of an observation and a cell."""
    o, c, f = frames(spark, obs, cells, field)
    near = o.withColumn("row", F.monotonically_increasing_id()).crossJoin(c.withColumnsRenamed({"lon": "clon", "lat": "clat"})).withColumn(
        "d", great_circle_km("lon", "lat", "clon", "clat")).filter(F.col("d") <= max(radii))
    near = near.join(f.withColumnRenamed("temperature", "v"), ["x", "y", "t"], "left").toPandas()
    out = {}
    for key, rows in near.groupby("profile_id", dropna=False):
        best = {r: (s.x, s.y) for r, part in rows[rows.bottom_level != 0].groupby("row") for s in [min(part.itertuples(), key=lambda s: (s.d, s.x, s.y))]}
        for radius in radii:
            inside = rows[[(s.x, s.y) == best.get(s.row) for s in rows.itertuples()]] if radius == 0 else rows[rows.d <= radius]
            xs = inside[(inside.bottom_level != 0) & inside.v.notna()].v.to_numpy()
            score = np.abs(xs - rows.temperature.iloc[0]).mean() - np.abs(xs[:, None] - xs).mean() / 2 if len(xs) else None
            out[key, radius] = score, len(xs), bool(radius and (inside.bottom_level == 0).any())
    return out


@pytest.mark.parametrize("crowded,values", [(65536, 1 << 21), (5, 100)])
def test_repeated_rows_and_small_units(spark, monkeypatch, crowded, values):
    monkeypatch.setattr(crps, "CROWDED", crowded)
    monkeypatch.setattr(crps, "VALUES", values)
    obs, cells, field = tables(spark, 25, 120, 2)
    obs = [*obs, obs[3], obs[3], (7, 0.01, 55.01, T0, obs[7][4]), (200, 0.1, 55.1, None, 8.0), (201, 30.0, 55.0, T0, 8.0), (202, None, 55.0, T0, 8.0), (203, 0.1, 55.1, T0, None)]
    cells, field = [*cells, cells[10], (cells[11][0], cells[11][1], 0.1, 55.1, 1)], [*field, (*field[4][:3], 9.5)]
    got = crps.neighbourhood_crps(*frames(spark, obs, cells, field), ["temperature"]).collect()
    want = by_pairs(spark, [o for o in obs if o[4] is not None and o[1] is not None], cells, field, (0, 8, 14, 20))
    assert {(r.profile_id, r.radius_km) for r in got} == set(want) and len(got) == len(want) and (200, 8) in want and (201, 8) not in want
    for r in got:
        score, n, land = want[r.profile_id, r.radius_km]
        assert (r.n_points, r.crps is None) == (n, score is None) and (r.profile_id == 7 or r.land == land)
        assert score is None or r.crps == pytest.approx(score, abs=1e-9)


def test_a_cell_is_sent_to_few_tiles(spark):
    _, cells, _ = tables(spark, 0, 2000)
    sent = spark.createDataFrame(cells, CELLS).withColumnsRenamed({"lon": "_clon", "lat": "_clat"})
    assert spatial.in_reach(sent, 5.0, 1).count() <= 9 * 2000 and spatial.in_reach(sent, 5.0, 2).count() < 4.5 * 2000


def test_crowded_tiles_are_split(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CROWDED", 20)
    obs, cells, _ = tables(spark, 100, 60)
    points, grid = spark.createDataFrame(obs, OBS), spark.createDataFrame(cells, CELLS)
    got = sorted(map(tuple, spatial.neighbourhood(points, grid, 20.0).select("lon", "lat", "x", "y").collect()))
    pairs = points.crossJoin(grid.withColumnsRenamed({"lon": "clon", "lat": "clat"})).filter(great_circle_km("lon", "lat", "clon", "clat") <= 20.0)
    assert got == sorted(map(tuple, pairs.select("lon", "lat", "x", "y").collect())) and got


def levels_of(spark, n):
    rng = random.Random(6)
    rows = [(p, z, 1.0 + 2 * z, rng.uniform(5, 15) if rng.random() < 0.9 else None) for p in range(n) for z in range(20)]
    return rows, spark.createDataFrame(rows, "profile_id long, z int, depth double, temperature double")


@pytest.mark.parametrize("crowded", [3, 4096])
def test_levels_go_to_their_cell_by_profile(spark, monkeypatch, crowded):
    monkeypatch.setattr(matchup, "CROWDED", crowded)
    obs_rows, obs = levels_of(spark, 400)
    mod_rows, mod = levels_of(spark, 390)
    place = {p: (min(p, 350), 0, T0) for p in range(400)}
    m = spark.createDataFrame([(p, *c) for p, c in place.items()], "profile_id long, x int, y int, t timestamp_ntz")
    df = matchup.reduce_resolution(m, obs, mod, ["temperature"])
    if crowded == 4096:  # 400 + 351 profiles in one row each, once more where they meet their cell
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            assert 0 < shuffled_rows(matchup.reduce_resolution(m, obs.repartition(3, "profile_id"), mod.repartition(3, "profile_id"), ["temperature"])) < 2 * 400 * 20 + 5000
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    value = {(p, z): v for p, z, _, v in mod_rows}
    cells = {}
    for p, z, _, v in obs_rows:
        cells.setdefault((place[p][0], z), []).append(v)
    got = df.collect()
    assert len(got) == len(cells) == 351 * 20
    for r in got:
        vs = [v for v in cells[r.x, r.z] if v is not None]
        assert (r.first_id, r.grid_n, r.depth, r.temperature_mod) == (r.x, 50 if r.x == 350 else 1, 1.0 + 2 * r.z, value.get((r.x, r.z)))
        assert r.temperature_obs == (pytest.approx(sum(vs) / len(vs)) if vs else None)
