"""Bounds that reach the files, the clustered layout, and publication of several tables at once."""
import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from soundings.operators.clean import extent, lonlat_box
from soundings.plans import profile_validation
from soundings.schema import TABLES, one_run
from soundings.sources import clustered, scan, sink

T0 = dt.datetime(2024, 1, 1)
NAN = float("nan")


@pytest.fixture
def long_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def pushed(df):
    return df._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1].split("ReadSchema")[0]


def read_schema(df):
    return df._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]


# -------------------------------------------------------------------------------- bounds

HEADERS = [(1, T0, -5.0, 50.0), (2, T0, NAN, 50.0), (3, T0, None, 50.0), (4, T0 + dt.timedelta(days=40), 3.0, 55.0), (5, T0, 30.0, 50.0), (6, None, 0.0, 50.0)]


def headers(spark, path):
    spark.createDataFrame(HEADERS, TABLES["profile_header"]).write.parquet(path)
    return path


def test_bounds_reach_the_files_through_scan_table(spark, tmp_path, long_plans):
    path = headers(spark, str(tmp_path / "h"))
    df = scan.scan_table(spark, "profile_header", path, bounds={"lon": (-25.47, 16.25), "time": ("2024-01-01", "2024-02-01")}).select("profile_id")
    text = pushed(df)
    assert "GreaterThanOrEqual(lon,-25.47)" in text and "LessThanOrEqual(lon,16.25)" in text and "LessThan(time," in text
    assert "lat" not in read_schema(df)
    assert [r[0] for r in df.collect()] == [1]
    # the same rows as the filter on the canonical columns, which reaches nothing
    later = lonlat_box(scan.scan_table(spark, "profile_header", path), (-25.47, 16.25), (40, 60))
    early = scan.scan_table(spark, "profile_header", path, bounds={"lon": (-25.47, 16.25), "lat": (40, 60)})
    assert "GreaterThanOrEqual" not in pushed(later) and sorted(later.collect()) == sorted(early.collect())


@pytest.mark.parametrize("bounds, ids", [({"lon": (0.0, None)}, [4, 5, 6]), ({"lon": (None, 0.0)}, [1, 6]), ({"time": ("2024-01-02", None)}, [4]), ({"profile_id": (3, 4)}, [3, 4]), ({}, [1, 2, 3, 4, 5, 6])])
def test_open_sides_and_missing_values(spark, tmp_path, bounds, ids):
    path = headers(spark, str(tmp_path / "h"))
    assert sorted(r.profile_id for r in scan.scan_table(spark, "profile_header", path, bounds=bounds).collect()) == ids


def test_bounds_are_put_to_renamed_columns(spark, tmp_path, long_plans):
    path = str(tmp_path / "h")
    spark.createDataFrame([(1, T0, 5.0), (2, T0, 9.0)], "id long, juld timestamp, longitude float").write.parquet(path)
    df = scan.scan_table(spark, "profile_header", path, renames={"id": "profile_id", "juld": "time", "longitude": "lon"},
                         bounds={"lon": (None, 6.5), "time": ("2024-01-01 00:00:00", "2024-01-01 01:00:00")})
    assert "LessThanOrEqual(longitude,6.5)" in pushed(df) and "LessThan(juld," in pushed(df)
    assert [r.profile_id for r in df.collect()] == [1]


def field_rows(months=((2023, 12), (2024, 1), (2024, 2)), side=8, runs=("a",)):
    return [(run, y, m, dt.datetime(y, m, 15), x, k, z, float(z * 10), float(x + k), 35.0)
            for run in runs for y, m in months for x in range(side) for k in range(side) for z in range(2)]


def test_bounds_reach_the_files_through_scan_months(spark, tmp_path, long_plans):
    path = str(tmp_path / "f")
    sink.write_replacing(spark.createDataFrame(field_rows(runs=("a", "b")), TABLES["grid_field"]), path, ("year", "month"))
    df = scan.scan_months(spark, "grid_field", path, (2024, 1), (2024, 2), run="a", bounds={"depth": (0.0, 5.0), "t": ("2024-01-01", "2024-02-01")})
    text = pushed(df)
    assert "LessThanOrEqual(depth,5.0)" in text and "EqualTo(run,a)" in text and "LessThan(t," in text
    assert "PartitionFilters: [isnotnull(year" in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.month, r.z, r.run) for r in df.collect()} == {(1, 0, "a")}


def test_extent_is_a_filter_of_the_scan_at_run_time(spark, tmp_path):
    path = headers(spark, str(tmp_path / "h"))
    grid = spark.createDataFrame([(-6.0, 49.0), (4.0, 56.0)], "lon double, lat double")
    df = scan.scan_table(spark, "profile_header", path, bounds=scan.extent_bounds(grid))
    assert sorted(r.profile_id for r in df.collect()) == [1, 4, 6]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lon#" in plan and "ubquery" in plan.split("DataFilters: ")[1].split("Format")[0]
    assert extent(grid, 1.0).first().lon_min == -7.0


def test_naming_the_run_spares_the_pass_over_it(spark, tmp_path):
    path = str(tmp_path / "f")
    sink.write_replacing(spark.createDataFrame(field_rows(runs=("a", "b")), TABLES["grid_field"]), path, ("year", "month"))
    df = one_run(scan.scan_months(spark, "grid_field", path, (2024, 1), (2024, 1)), "b")
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert df.count() == 128 and "run" not in df.columns


# ---------------------------------------------------------------------- clustered layout

def test_cell_keys_interleave_bits(spark):
    pairs = [(0, 0), (1, 0), (0, 1), (3, 5), (1000, 77), (2 ** 31 - 1, 2 ** 31 - 1)]
    want = [sum(((x >> b & 1) << 2 * b) | ((y >> b & 1) << (2 * b + 1)) for b in range(31)) for x, y in pairs]
    assert [r[0] for r in spark.createDataFrame(pairs, "x int, y int").select(clustered.cell_key()).collect()] == want
    with pytest.raises(PySparkException, match="between 0 and"):
        spark.createDataFrame([(-1, 0)], "x int, y int").select(clustered.cell_key()).collect()


@pytest.mark.parametrize("most", [1, 4, 16, 128])
def test_key_ranges_hold_all_cells_and_stay_few(spark, most):
    cells = spark.createDataFrame([(x, y) for x in range(0, 200, 7) for y in range(0, 90, 11)], "x int, y int")
    ranges = clustered.key_ranges(cells, most)
    assert 1 <= len(ranges) <= most and all(a <= b for a, b in ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
    keys = [r[0] for r in cells.select(clustered.cell_key()).collect()]
    assert all(any(a <= k <= b for a, b in ranges) for k in keys)


def scanned_rows(spark, df):
    """Rows that the file scan hands on."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        rows = df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles")]
        return rows, sum(s.metrics().apply("numOutputRows").value() for s in scans)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_stations_read_a_fraction_of_a_clustered_field(spark, tmp_path):
    rows = field_rows(months=((2024, 1),), side=96)
    field = spark.createDataFrame(rows, TABLES["grid_field"]).repartition(4)
    stations = spark.createDataFrame([(3, 4), (90, 91), (50, 8), (50, 8)], "x int, y int")
    clustered.write_clustered(field, str(tmp_path / "c"), tasks=16, row_group_bytes=4096)
    sink.write_replacing(field, str(tmp_path / "p"), ("year", "month"))
    got, read = scanned_rows(spark, clustered.scan_cells(spark, "grid_field", str(tmp_path / "c"), stations, (2024, 1), (2024, 1)))
    plain = scan.keep_station_cells(scan.scan_months(spark, "grid_field", str(tmp_path / "p"), (2024, 1), (2024, 1)), stations)
    want, whole = scanned_rows(spark, plain.select(*TABLES["grid_field"].names))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 6
    assert whole == len(rows) and read <= len(rows) // 4


def test_clustered_field_keeps_other_months_and_takes_no_cells(spark, tmp_path):
    path = str(tmp_path / "c")
    clustered.write_clustered(spark.createDataFrame(field_rows(), TABLES["grid_field"]), path)
    clustered.write_clustered(spark.createDataFrame(field_rows(months=((2024, 1),), side=4), TABLES["grid_field"]), path)
    assert {(r.month, r["n"]) for r in spark.read.parquet(path).groupBy("month").agg(F.count("*").alias("n")).collect()} == {(12, 128), (1, 32), (2, 128)}
    none = spark.createDataFrame([], "x int, y int")
    assert clustered.scan_cells(spark, "grid_field", path, none, (2023, 1), (2024, 12)).count() == 0


# --------------------------------------------------------------------------- publication

def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "year int, month int, v double")


def failing(spark):
    return rows_of(spark, (2024, 1, 1.0)).withColumn("v", F.raise_error(F.lit("broken")).cast("double"))


def test_a_failing_write_keeps_the_month(spark, tmp_path):
    path, both = str(tmp_path / "t"), [{"year": 2024, "month": m} for m in (1, 2)]
    sink.write_replacing(rows_of(spark, (2024, 1, 1.0), (2024, 2, 2.0)), path, ("year", "month"))
    with pytest.raises(PySparkException, match="broken"):
        sink.write_replacing(failing(spark), path, ("year", "month"), both)
    assert spark.read.parquet(path).count() == 2
    sink.write_replacing(rows_of(spark, (2024, 2, 3.0)), path, ("year", "month"), both)
    assert [(r.month, r.v) for r in spark.read.parquet(path).collect()] == [(2, 3.0)]


BY = ("year", "month")


def seen(spark, base, name):
    return sorted((r.month, r.v) for r in sink.read_published(spark, base, name).collect())


def test_readers_see_all_tables_of_a_publication_or_none(spark, tmp_path):
    base = str(tmp_path / "out")
    sink.publish({"a": (rows_of(spark, (2024, 1, 1.0), (2024, 2, 2.0)), BY), "b": (rows_of(spark, (2024, 1, 10.0)), BY)}, base)
    with pytest.raises(PySparkException, match="broken"):
        sink.publish({"a": (rows_of(spark, (2024, 1, 5.0)), BY), "b": (failing(spark), BY)}, base)
    assert seen(spark, base, "a") == [(1, 1.0), (2, 2.0)] and seen(spark, base, "b") == [(1, 10.0)]
    sink.publish({"a": (rows_of(spark, (2024, 1, 5.0)), BY), "b": (rows_of(spark, (2024, 1, 50.0), (2024, 3, 51.0)), BY)}, base)
    assert seen(spark, base, "a") == [(1, 5.0), (2, 2.0)] and seen(spark, base, "b") == [(1, 50.0), (3, 51.0)]
    assert sink.read_published(spark, base, "a").columns == ["year", "month", "v"]
    removed = sink.vacuum(spark, base)
    assert len(removed) == 3  # what failed of both, and b's first; a's first still holds February
    assert seen(spark, base, "a") == [(1, 5.0), (2, 2.0)]


def test_covered_partitions_without_rows_are_emptied_with_the_publication(spark, tmp_path):
    base = str(tmp_path / "out")
    sink.publish({"a": (rows_of(spark, (2024, 1, 1.0), (2024, 2, 2.0)), BY)}, base)
    sink.publish({"a": (rows_of(spark, (2024, 1, 3.0)).limit(0), BY)}, base, covers=[{"year": 2024, "month": 1}])
    assert seen(spark, base, "a") == [(2, 2.0)]
    sink.publish({"a": (rows_of(spark).limit(0), BY)}, base, covers=[{"year": 2024, "month": 2}])
    assert seen(spark, base, "a") == [] and sink.read_published(spark, base, "a").columns == ["year", "month", "v"]


def test_rows_may_come_from_the_published_table(spark, tmp_path):
    base = str(tmp_path / "out")
    sink.publish({"a": (rows_of(spark, (2024, 1, 1.0), (2024, 2, 2.0)), BY)}, base)
    sink.publish({"a": (sink.read_published(spark, base, "a").filter("month = 1").withColumn("v", F.col("v") + 1), BY)}, base)
    assert seen(spark, base, "a") == [(1, 2.0), (2, 2.0)]


def test_tables_without_partitions_and_odd_values(spark, tmp_path):
    base = str(tmp_path / "out")
    sink.publish({"plain": (rows_of(spark, (1, 1, 1.0)), ())}, base)
    sink.publish({"plain": (rows_of(spark, (1, 1, 2.0)), ()), "odd": (spark.createDataFrame([("a b", 1), (None, 2)], "k string, v int"), ("k",))}, base)
    assert seen(spark, base, "plain") == [(1, 2.0)]
    assert {(r.k, r.v) for r in sink.read_published(spark, base, "odd").collect()} == {("a b", 1), (None, 2)}
    with pytest.raises(ValueError, match="not been published"):
        sink.read_published(spark, base, "nothing")


def test_a_faster_publication_is_noticed(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "out")
    sink.publish({"a": (rows_of(spark, (2024, 1, 1.0)), BY)}, base)
    monkeypatch.setattr(sink, "_manifests", lambda spark, base: [])
    with pytest.raises(RuntimeError, match="came first"):
        sink.publish({"a": (rows_of(spark, (2024, 1, 9.0)), BY)}, base)
    monkeypatch.undo()
    assert seen(spark, base, "a") == [(1, 1.0)]


def test_monthly_job_publishes_seven_tables(spark, tmp_path):
    header = spark.createDataFrame([(7, T0 + dt.timedelta(hours=2), 1.0, 50.0)], TABLES["profile_header"])
    level = spark.createDataFrame([(7, z, d, 10.0 + z, 35.0, 0) for z, d in enumerate((0.5, 3.0, 40.0))], TABLES["profile_level"])
    cell = spark.createDataFrame([("a", 1, 1, 1.0, 50.0, 45.0, 3)], TABLES["grid_cell"])
    runs = [(run, 2024, 1, T0, 1, 1, z, d, value + z, 35.0) for run, value in (("a", 11.0), ("b", 99.0)) for z, d in enumerate((0.0, 5.0, 45.0))]
    field = spark.createDataFrame(runs, TABLES["grid_field"])
    job = lambda **choices: profile_validation.publish_profile_tables(
        header, level, cell, field, cell.select("x", "y", "bathymetry"), ["temperature"], str(tmp_path / "out"), [{"year": 2024, "month": 1}],
        depths=[1.0, 2.0, 10.0, 40.0], **choices)
    with pytest.raises(PySparkException, match="several runs"):
        job()
    assert sink.current_manifest(spark, str(tmp_path / "out")) == {}
    job(run="a", model_times=spark.createDataFrame([(T0,)], "t timestamp_ntz"))
    tables = sink.current_manifest(spark, str(tmp_path / "out"))
    assert set(tables) == {"profile_errors", "interpolated_profiles", "interpolated_obs", "surface_data", "mid_data", "bottom_data", "extracted_profiles"}
    assert sink.read_published(spark, str(tmp_path / "out"), "extracted_profiles").count() == 3
    errors = sink.read_published(spark, str(tmp_path / "out"), "profile_errors").collect()
    assert len(errors) == 4 and all(0 < r.diff_temperature < 2 for r in errors)
