"""Polygon covers, the descent to the nearest station, and observed counts."""
import math
import random

import pytest
from pyspark.sql import functions as F

from soundings.operators import clean, spatial


def crossing_parity(polygon, lon, lat):
    inside = False
    for (lon1, lat1), (lon2, lat2) in zip(polygon, [*polygon[1:], polygon[0]]):
        if min(lat1, lat2) <= lat < max(lat1, lat2) and lon < lon1 + (lat - lat1) * ((lon2 - lon1) / (lat2 - lat1)):
            inside = not inside
    return inside


def star(r, n, lon, lat, size):
    return [(lon + size * r.uniform(0.2, 1) * math.cos(2 * math.pi * k / n), lat + size * r.uniform(0.2, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def polygons():
    r = random.Random(3)
    return {
        "square": [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)],  # edges along box borders, two of them horizontal
        "shifted": [(-3.1, -2.2), (1.3, -2.2), (1.3, 1.9), (-3.1, 1.9)],
        "steps": [(0.0, 0.0), (6.0, 0.0), (6.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 6.0), (0.0, 6.0)],
        "star": star(r, 40, -4.0, 3.0, 5.0), "fine_star": star(r, 400, 2.0, -3.0, 6.0), "tiny": [(1.01, 1.01), (1.06, 1.02), (1.03, 1.09)],
        "crossed": [(-5.0, -5.0), (5.0, 5.0), (5.0, -5.0), (-5.0, 5.0)], "far_south": star(r, 12, 170.0, -70.0, 9.0),
    }


def cell_table(spark, points):
    return spark.createDataFrame([(k, 0, lon, lat, 50.0) for k, (lon, lat) in enumerate(points)], "x int, y int, lon double, lat double, bathymetry double").repartition(4)


def polygon_table(spark, known):
    return spark.createDataFrame([(name, k, *p) for name, points in known.items() for k, p in enumerate(points)], "region string, seq int, lon double, lat double")


@pytest.mark.parametrize("leaf", [0.25, 1.0, 0.1])
def test_cover_equals_parity(spark, leaf):
    known, r = polygons(), random.Random(8)
    points = [(r.uniform(-10, 10), r.uniform(-10, 10)) for _ in range(1500)] + [(x / 2, y / 2) for x in range(-14, 15) for y in range(-14, 15)]
    points += [(170 + r.uniform(-9, 9), -70 + r.uniform(-9, 9)) for _ in range(200)] + [p for polygon in known.values() for p in polygon]
    got = {(g.region, g.x) for g in spatial.region_cells(cell_table(spark, points), polygon_table(spark, known), leaf_degrees=leaf).collect()}
    want = {(name, k) for name, polygon in known.items() for k, p in enumerate(points) if crossing_parity(polygon, *p)}
    assert got == want and len(want) > 500


def test_cover_follows_the_edge(spark):
    """A box of 40 by 20 degrees: halving the leaf doubles the boxes, though it quadruples the leaves inside."""
    one = polygon_table(spark, {"box": [(-20.03, 40.02), (20.05, 40.02), (20.05, 60.07), (-20.03, 60.07)]})
    sizes = {}
    for leaf in (0.5, 0.25, 0.125):
        inside, on_edge = spatial.polygon_cover(one, leaf)
        sizes[leaf] = (inside.count(), on_edge.count())
        area = inside.select(F.sum(F.pow(F.lit(leaf) * F.pow(F.lit(2.0), F.col("_level")), F.lit(2.0)))).first()[0]
        assert 0.9 * 40 * 20 < area < 40.08 * 20.05
    for coarse, fine in ((0.5, 0.25), (0.25, 0.125)):
        assert sizes[fine][1] < 2.3 * sizes[coarse][1] and sizes[fine][0] < 3 * sizes[coarse][0]
    assert sizes[0.25][0] < 800 * 16 / 10  # of 12800 leaves


def test_boxes_inside_are_disjoint_and_off_the_edge(spark):
    inside, on_edge = spatial.polygon_cover(polygon_table(spark, {"star": polygons()["star"]}), 0.25)
    edge = {(b["_bx"], b["_by"]) for b in on_edge.collect()}
    seen = set()
    for b in inside.collect():
        width = 1 << b["_level"]
        leaves = {(x, y) for x in range(b["_bx"] * width, (b["_bx"] + 1) * width) for y in range(b["_by"] * width, (b["_by"] + 1) * width)}
        assert not leaves & edge and not leaves & seen
        seen |= leaves


def test_empty_polygons_and_cells(spark):
    none = polygon_table(spark, {"square": polygons()["square"]}).limit(0)
    cells = cell_table(spark, [(1.0, 1.0)])
    assert spatial.region_cells(cells, none).count() == 0
    assert spatial.region_cells(cells.limit(0), polygon_table(spark, polygons())).count() == 0


def stations(spark, rows):
    return spark.createDataFrame(rows, "port int, lon double, lat double")


def nearest(p, others):
    return min(others, key=lambda q: ((q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2, q[0]))[0]


@pytest.mark.parametrize("spread", [0.01, 0.5, 30.0])
def test_far_cluster_is_found_by_descent(spark, spread):
    """All partners in one far cluster, of many places, some of them equally near."""
    r = random.Random(int(spread * 100))
    right = [(k, -150.0 + r.uniform(-spread, spread), -40.0 + r.uniform(-spread, spread)) for k in range(400)]
    right += [(500 + k, *p[1:]) for k, p in enumerate(right[:20])] + [(-1, None, 1.0)]
    left = [(k, r.uniform(-20, 15), r.uniform(44, 64)) for k in range(60)] + [(900, 179.9, 89.0), (901, -179.9, -89.0), (902, -150.0, 60.0)]
    got = {m.left_key: m.right_key for m in spatial.match_stations(stations(spark, left), stations(spark, right)).collect()}
    assert got == {p[0]: nearest(p, right[:-1]) for p in left}


def test_near_and_far_together(spark):
    r = random.Random(4)
    right = [(k, r.uniform(-1, 1), r.uniform(50, 51)) for k in range(30)] + [(100, 60.0, 10.0), (101, 60.0, 10.0)]
    left = [(k, r.uniform(-1, 1), r.uniform(50, 51)) for k in range(20)] + [(50, -120.0, 0.0), (51, 100.0, -5.0), (52, None, 3.0), (53, 59.0, 11.0)]
    got = {m.left_key: m.right_key for m in spatial.match_stations(stations(spark, left), stations(spark, right)).collect()}
    assert got == {p[0]: nearest(p, right) for p in left if p[1] is not None}


def test_descent_keeps_few_boxes(spark, monkeypatch):
    """Rows of a round: open places times a few boxes, not times places."""
    rows = []
    real = spatial.cut_lineage

    def counting(df):
        out = real(df)
        if "_n" in out.columns and "_lon" in out.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(spatial, "cut_lineage", counting)
    r = random.Random(6)
    right = [(k, 100.0 + r.uniform(-3, 3), 10.0 + r.uniform(-3, 3)) for k in range(2000)]
    left = [(k, r.uniform(-20, 15), r.uniform(44, 64)) for k in range(50)]
    got = {m.left_key: m.right_key for m in spatial.match_stations(stations(spark, left), stations(spark, right)).collect()}
    assert got == {p[0]: nearest(p, right) for p in left}
    assert rows and max(rows) <= 50 * 40


def test_observed_counts_need_no_pass_of_their_own(spark, tmp_path):
    rows = [(d, s) for d in (1.0, 5.0, 5.1) for s in (0, 43_200, -43_201)]
    matchup = spark.createDataFrame(rows, "interp_dist_km double, interp_lag_s long").repartition(3)
    kept, audit = clean.observe_audit(matchup)
    kept.write.parquet(str(tmp_path / "m"))
    assert audit.get == clean.drop_audit(matchup).first().asDict()
    assert spark.read.parquet(str(tmp_path / "m")).count() == audit.get["n_kept"] == 4
