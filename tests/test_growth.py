"""Tables that explode has multiplied stay out of broadcasts, and dense grids are searched in growing radii."""
import random

from catalog.base import Tables
from soundings.functions.scalars import great_circle_km
from soundings.operators import spatial
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exploded_broadcasts(df):
    """Broadcasts in the plan whose child is built with explode."""
    out, lines = 0, plan(df).split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[i + 1:]:
                if depth(below) <= depth(line):
                    break
                out += "Generate" in below
    return out


def grid(spark, n, seed):
    rng = random.Random(seed)
    rows = [(k % 50, k // 50, rng.uniform(-5, 5), rng.uniform(48, 53), 100.0 + k, k % 7) for k in range(n)]
    return spark.createDataFrame(rows, "x int, y int, lon double, lat double, bathymetry double, bottom_level int")


def test_copied_cells_are_not_broadcast(spark):
    points = spark.createDataFrame([(1, 0.1, 50.0)], "profile_id long, lon double, lat double")
    assert exploded_broadcasts(spatial.nearest_cell(points, grid(spark, 50, 1), 5.0)) == 0
    assert exploded_broadcasts(spatial.neighbourhood(points, grid(spark, 50, 1), 5.0)) == 0


def test_the_field_is_not_broadcast(spark):
    field = Tables(spark, FOLDER)("grid_field")
    cells = field.select("x", "y", "t").distinct()
    assert exploded_broadcasts(Tables(spark, FOLDER)("grid_surface")) == 0
    assert exploded_broadcasts(field.join(cells, ["x", "y", "t"])) == 0


def test_dense_grid_finds_the_nearest_cell(spark):
    cells = grid(spark, 3000, 2)
    rng = random.Random(3)
    rows = [(k, rng.uniform(-6, 6), rng.uniform(47.5, 53.5)) for k in range(60)] + [(100, None, 50.0), (101, 40.0, 50.0)]
    points = spark.createDataFrame(rows, "profile_id long, lon double, lat double")
    assert len(spatial.search_radii(cells.filter("bottom_level <> 0"), 60.0)) > 1
    found = {tuple(r) for r in spatial.nearest_cell(points, cells, 60.0, ("bathymetry",)).select("profile_id", "x", "y", "bathymetry").collect()}
    sea = cells.filter("bottom_level <> 0").withColumnsRenamed({"lon": "clon", "lat": "clat"})
    best = points.crossJoin(sea).withColumn("d", great_circle_km("lon", "lat", "clon", "clat")).filter("d <= 60").groupBy("profile_id").agg(
        F.min(F.struct("d", "x", "y", "bathymetry")).alias("b")).select("profile_id", "b.x", "b.y", "b.bathymetry")
    assert found == {tuple(r) for r in best.collect()} and len(found) > 40


def test_crowded_stations_get_small_boxes(spark):
    rng = random.Random(4)
    rows = [(k, rng.uniform(0, 1), rng.uniform(50, 51)) for k in range(4000)]
    places = spark.createDataFrame(rows, "right_key int, _rlon double, _rlat double")
    widths = spatial.search_widths(places, (0.5, 4.0))
    assert widths[0] < 0.1 and widths[-1] == 4.0 and all(b <= 4 * a for a, b in zip(widths, widths[1:]))


def test_lines_of_a_profile_are_dealt_once(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 9)], "o_orderkey long, o_custkey long").withColumn(
        "o_orderdate", F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")).write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(1, 1.2, 100.0), (1, 1.7, 200.0), (1, 3.0, 300.0), (2, 1.2, 400.0), (None, 1.0, 1.0), (2, None, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_extendedprice double").withColumns(
        {"l_discount": F.lit(0.01), "l_tax": F.lit(0.02), "l_returnflag": F.lit("N")}).write.parquet(str(tmp_path / "lineitem.parquet"))
    pairs = Tables(spark, str(tmp_path))("profile_pair_a")
    shuffles = [line for line in plan(pairs).split("\n") if "Exchange hashpartitioning(" in line]
    got = sorted((r.profile_id, r.z, r.depth, round(r.temperature_obs * 5003), round((r.temperature_mod + 0.01) / 1.02 * 5003)) for r in pairs.collect())
    # levels that share z meet crosswise
    assert got == [(1, 1, 1.2, 100, 100), (1, 1, 1.2, 100, 200), (1, 1, 1.7, 200, 100), (1, 1, 1.7, 200, 200), (1, 3, 3.0, 300, 300), (2, 1, 1.2, 400, 400)]
    assert len([line for line in shuffles if "(l_orderkey" in line]) == 1 and not any("l_quantity" in line or "(z" in line for line in shuffles)


def test_many_cells_are_dealt_to_tasks(spark, tmp_path):
    spark.range(20_000).selectExpr("id as c_custkey", "cast(id % 25 as int) as c_nationkey", "100.0D as c_acctbal").coalesce(1).write.parquet(
        str(tmp_path / "customer.parquet"))
    assert Tables(spark, str(tmp_path))("grid_field").rdd.getNumPartitions() == 3
