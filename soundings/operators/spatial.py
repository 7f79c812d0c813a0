"""Spatial joins: nearest sea cell, radius neighbourhood, regions, stations."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from soundings.functions.scalars import KM_PER_DEGREE, great_circle_km
from soundings.session import cut_lineage

# ---- lon/lat tiles as join keys ---------------------------------------------------------
#
# Latitude is cut into bands ``side`` times the radius high.  Each band is cut into an integer
# number of longitude boxes at least ``side`` times as wide as the radius reaches from any point
# of the band.  A position lies in one tile; a cell is sent to the tiles that its radius touches,
# also across the date line and (with one box per band) at the poles: its own and, near an edge,
# its neighbours, (1 + 2 / side) squared of them on average.


def _lon_reach(band: Column, height: float, side: int) -> tuple[Column, Column]:
    """Degrees of longitude that the radius reaches from a point of the band, and whether that comes near a pole."""
    pole = F.greatest(F.abs(band.cast("double")), F.abs(band.cast("double") + 1)) * (height * side) + height
    return F.lit(height) / F.cos(F.radians(F.least(pole, F.lit(89.0)))), pole >= 89.0


def _boxes_in_band(band: Column, height: float, side: int) -> Column:
    reach, polar = _lon_reach(band, height, side)
    n = F.floor(F.lit(360.0) / (reach * side))
    return F.when(polar | (n < 3), F.lit(1)).otherwise(n).cast("long")


def _lon_box(lon: Column, n: Column) -> Column:
    return F.least(F.floor(F.pmod(lon, F.lit(360.0)) / (F.lit(360.0) / n)), n - 1).cast("long")


def degrees_of(radius_km: float) -> float:
    """Degrees of latitude of a radius, and a little more."""
    return radius_km / KM_PER_DEGREE * 1.001


def in_tile(places: DataFrame, radius_km: float, side: int) -> DataFrame:
    """``places`` (lon, lat) with their tile (_band, _box)."""
    height = degrees_of(radius_km)
    banded = places.withColumn("_band", F.floor(F.col("lat") / (height * side)).cast("long"))
    return banded.withColumn("_box", _lon_box(F.col("lon"), _boxes_in_band(F.col("_band"), height, side)))


def in_reach(cells: DataFrame, radius_km: float, side: int) -> DataFrame:
    """``cells`` (_clon, _clat), once for each tile (_band, _box) that their radius touches."""
    height = degrees_of(radius_km)
    band = lambda lat: F.floor(lat / (height * side)).cast("long")
    known = cells.filter(F.col("_clon").isNotNull() & F.col("_clat").isNotNull())
    banded = known.withColumn("_band", F.explode(F.sequence(band(F.col("_clat") - height), band(F.col("_clat") + height))))
    east, n = F.pmod(F.col("_clon"), F.lit(360.0)), F.col("_n")
    box = lambda lon: F.floor(lon / (F.lit(360.0) / n)).cast("long")
    reach = _lon_reach(F.col("_band"), height, side)[0]
    boxes = F.transform(F.sequence(box(east - reach), box(east + reach)), lambda b: F.pmod(b, n))
    return banded.withColumn("_n", _boxes_in_band(F.col("_band"), height, side)).withColumn(
        "_box", F.explode(F.array_distinct(boxes))).drop("_n")


def copied(df: DataFrame) -> DataFrame:
    """``df``, which holds copies made by ``explode``, for a join that does not broadcast it.

    Spark takes the size of an exploded table for that before, so a table of many times the limit would go through the driver.
    """
    return df.hint("merge")


#: Side of a tile in radii where positions meet cells in a join: each cell is sent to four tiles.
SIDE = 2
#: Positions of a tile that one task takes; the cells of a tile with more are repeated.
CROWDED = 16384


def pairs_within(points: DataFrame, cells: DataFrame, radius_km: float,
                 cell_columns: list[str], salts: int = 4, few: bool = False, many: bool = False) -> DataFrame:
    """Every (position, cell) no further apart than ``radius_km``, with ``dist_km``.

    ``points`` needs lon, lat; only its distinct positions are joined, so many profiles
    at one place count once.  With ``salts`` above 1, a tile of more than ``CROWDED`` positions is split over
    as many tasks as that takes, by a hash of the position, at least ``salts``; its cells are repeated for each.
    ``few`` tells that the positions lie in few tiles: other cells then go before they are sent.  ``many`` tells that there are
    many pairs to a position: tasks are then not merged by the bytes they read.
    """
    height, by = degrees_of(radius_km), ["_band", "_box"]
    left = in_tile(points.select("lon", "lat").dropna().distinct(), radius_km, SIDE)
    right = in_reach(cells.select(F.col("lon").alias("_clon"), F.col("lat").alias("_clat"), *cell_columns), radius_km, SIDE)
    if few:
        right = right.join(left.select(*by).distinct(), by, "left_semi")
    if salts > 1:
        left = cut_lineage(left)
        sizes = left.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CROWDED)
        sizes = cut_lineage(sizes.select(*by, F.greatest(F.ceil(F.col("_n") / CROWDED), F.lit(salts)).cast("int").alias("_units")))
        if sizes.isEmpty():
            units = F.lit(1)
        else:
            units = F.coalesce("_units", F.lit(1))
            left, right = left.join(sizes, by, "left"), right.join(sizes, by, "left")
        left = left.withColumn("_salt", F.pmod(F.xxhash64("lon", "lat"), units).cast("int")).drop("_units")
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), units - 1))).drop("_units")
        by = [*by, "_salt"]
    if many:
        tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = left.repartition(tasks, *by), right.repartition(tasks, *by)
    # a cheap bound first
    near = F.abs(F.col("lat") - F.col("_clat")) <= height
    return (
        left.join(copied(right), by).filter(near)
        .withColumn("dist_km", great_circle_km("lon", "lat", "_clon", "_clat"))
        .filter(F.col("dist_km") <= radius_km)
        .select("lon", "lat", *cell_columns, "dist_km")
    )


#: Cells expected within the first radius searched; a grid with ten times as many within the whole radius is dense.
EXPECTED = 6


def cells_per_box(cells: DataFrame, radius_km: float) -> float:
    """Cells in an occupied box as wide and high as the radius, about."""
    height = radius_km / KM_PER_DEGREE
    east = F.col("lon") * F.cos(F.radians("lat"))
    boxes = F.approx_count_distinct(F.struct(F.floor(east / height), F.floor(F.col("lat") / height)))
    n, occupied = cells.select("lon", "lat").dropna().agg(F.count(F.lit(1)), boxes).first()
    return n / max(occupied, 1)


def search_radii(cells: DataFrame, radius_km: float, step: float = 4.0) -> list[float]:
    """Growing radii for a nearest search, the last one ``radius_km``: the first holds a few cells, by their number per occupied box."""
    around = math.pi * cells_per_box(cells, radius_km)
    if around <= 10 * EXPECTED:
        return [radius_km]
    out, radius = [], radius_km * math.sqrt(EXPECTED / around)
    while radius < radius_km / 2:
        out.append(radius)
        radius *= step
    return [*out, radius_km]


def _nearest_within(points: DataFrame, sea: DataFrame, radius_km: float, keep_columns: tuple[str, ...], salts: int, few: bool) -> DataFrame:
    return (
        pairs_within(points, sea, radius_km, ["x", "y", *keep_columns], salts, few)
        .groupBy("lon", "lat")
        .agg(F.min(F.struct("dist_km", "x", "y", *keep_columns)).alias("_best"))
        .select("lon", "lat", "_best.x", "_best.y", *[f"_best.{c}" for c in keep_columns],
                F.col("_best.dist_km").alias("interp_dist_km"))
    )


def nearest_cell(points: DataFrame, cells: DataFrame, radius_km: float = 5.0,
                 keep_columns: tuple[str, ...] = (), salts: int = 4) -> DataFrame:
    """``points`` with x, y and ``interp_dist_km`` of the nearest sea cell.

    Points with no sea cell within ``radius_km`` are dropped: that equals taking the
    nearest cell anywhere and then dropping the distant ones.  Ties take the smallest
    (x, y).  ``keep_columns`` brings further cell columns along.  On a dense grid, radii that grow to
    ``radius_km`` are searched in turn for the positions still open, so a position meets a few cells, not all within ``radius_km``.
    """
    sea = cells.filter(F.col("bottom_level") != 0)
    *rungs, last = search_radii(sea, radius_km)
    todo, near = points.select("lon", "lat"), None
    for radius in rungs:
        found = cut_lineage(_nearest_within(todo, sea, radius, keep_columns, 1, near is not None))
        todo = cut_lineage(todo.dropna().distinct().join(found, ["lon", "lat"], "left_anti"))
        near = found if near is None else near.unionByName(found)
        if todo.isEmpty():
            return points.join(near, ["lon", "lat"])
    found = _nearest_within(todo, sea, last, keep_columns, salts, near is not None)
    near = found if near is None else near.unionByName(found)
    return points.join(near, ["lon", "lat"])


def neighbourhood(points: DataFrame, cells: DataFrame, radius_km: float, salts: int = 4) -> DataFrame:
    """All cells, land included and flagged, within the radius of each position."""
    flagged = cells.withColumn("land", F.col("bottom_level") == 0)
    return pairs_within(points, flagged, radius_km, ["x", "y", "land"], salts, many=True)


# ---- regions ----------------------------------------------------------------------------

def polygon_edges(polygons: DataFrame, horizontal: bool = False) -> DataFrame:
    """Closed polygons (region, seq, lon, lat) to edges, the last joined to the first; horizontal ones, which no parity counts, on demand."""
    w = Window.partitionBy("region").orderBy("seq")
    first = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.first(F.struct("lon", "lat")).over(first)
    following = F.coalesce(F.lead(F.struct("lon", "lat")).over(w), start)
    edges = (
        polygons.withColumn("_to", following)
        .select("region", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"),
                F.col("_to.lon").alias("lon2"), F.col("_to.lat").alias("lat2"))
    )
    return edges if horizontal else edges.filter(F.col("lat1") != F.col("lat2"))


def _inside_by_parity(points: DataFrame, edges: DataFrame, keys: list[str], band_degrees: float, salts: int) -> DataFrame:
    """``points`` (region, keys, lon, lat) that lie inside their region.

    Edge-crossing parity: an edge counts when it spans the point's latitude (lower end
    included, upper end not) and crosses east of the point.  Edges and points meet in latitude bands,
    so this is an equi-join; a band's points are dealt to ``salts`` tasks, to which its edges are copied.
    """
    band = lambda c: F.floor(F.col(c) / band_degrees).cast("long")
    spans = (
        edges.withColumn("_lo", F.least("lat1", "lat2")).withColumn("_hi", F.greatest("lat1", "lat2"))
        .withColumn("_band", F.explode(F.sequence(band("_lo"), band("_hi"))))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    here = points.select("region", *keys, "lon", "lat").withColumn("_band", band("lat")).withColumn(
        "_salt", F.pmod(F.hash(*keys), F.lit(salts)))
    crossing = F.col("lon1") + (F.col("lat") - F.col("lat1")) * F.try_divide(
        F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1")
    )
    return (
        here.join(spans, ["region", "_band", "_salt"])
        .filter((F.col("lat") >= F.col("_lo")) & (F.col("lat") < F.col("_hi")) & (F.col("lon") < crossing))
        .groupBy("region", *keys).agg(F.count(F.lit(1)).alias("_crossings"))
        .filter(F.col("_crossings") % 2 == 1).select("region", *keys)
    )


#: A cover's largest boxes are this many times halved to its smallest.
COVER_LEVELS = 8


def polygon_cover(polygons: DataFrame, leaf_degrees: float = 0.25, salts: int = 8) -> tuple[DataFrame, DataFrame]:
    """A quadtree cover of each polygon: boxes wholly inside, and the smallest boxes that its edge touches.

    Both have (region, _level, _bx, _by); a box of level k is ``leaf_degrees * 2**k`` wide.  Boxes in
    neither are wholly outside.  The smallest boxes along each edge are listed, row by row; all
    their ancestors are on the edge, too, and a child of such an ancestor that is not has one side throughout,
    which the parity of its centre tells.  So the number of boxes follows the length of the edge, not the area.
    """
    w, margin = leaf_degrees, leaf_degrees * 1e-6
    box = lambda c: F.floor(c / w).cast("long")
    edges = cut_lineage(polygon_edges(polygons, horizontal=True))
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    rows = edges.withColumn("_by", F.explode(F.sequence(box(low - margin), box(high + margin))))
    lon_at = lambda lat: F.coalesce(F.col("lon1") + (lat - F.col("lat1")) * F.try_divide(
        F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1")), F.col("lon1"))
    at = [lon_at(F.least(F.greatest(F.col("_by") * w - margin, low), high)), lon_at(F.least(F.greatest((F.col("_by") + 1) * w + margin, low), high))]
    ends = [F.when(F.col("lat1") == F.col("lat2"), side).otherwise(f(*at)) for f, side in ((F.least, F.least("lon1", "lon2")), (F.greatest, F.greatest("lon1", "lon2")))]
    leaves = rows.withColumn("_bx", F.explode(F.sequence(box(ends[0] - margin), box(ends[1] + margin)))).select("region", "_bx", "_by").distinct()
    levels = F.explode(F.sequence(F.lit(0), F.lit(COVER_LEVELS)))
    on_edge = cut_lineage(leaves.withColumn("_level", levels).select(
        "region", "_level", F.expr("shiftright(_bx, _level)").alias("_bx"), F.expr("shiftright(_by, _level)").alias("_by")).distinct())
    child = lambda axis: F.explode(F.array(F.col(axis) * 2, F.col(axis) * 2 + 1))
    clean = on_edge.filter("_level > 0").select("region", (F.col("_level") - 1).alias("_level"), child("_bx").alias("_bx"), "_by").withColumn(
        "_by", child("_by")).join(on_edge, ["region", "_level", "_bx", "_by"], "left_anti")
    width = F.lit(w) * F.pow(F.lit(2.0), F.col("_level"))
    centres = clean.withColumn("lon", (F.col("_bx") + 0.5) * width).withColumn("lat", (F.col("_by") + 0.5) * width)
    inside = _inside_by_parity(centres, edges.filter("lat1 <> lat2"), ["_level", "_bx", "_by"], w, salts)
    return cut_lineage(inside), on_edge.filter("_level = 0")


def region_cells(cells: DataFrame, polygons: DataFrame, limits: DataFrame | None = None,
                 whole_domain: str | None = None, leaf_degrees: float = 0.25, salts: int = 8) -> DataFrame:
    """(region, x, y) of the cells inside each polygon and its bathymetry limits.

    Cells in boxes wholly inside a polygon belong to it, those in boxes wholly outside do not; only cells in the smallest
    boxes along its edge meet edges, by crossing parity (see ``_inside_by_parity``).  The boxes
    are matched by key, and those of a level are copied to ``salts`` tasks to which its cells are dealt.
    """
    inside, on_edge = polygon_cover(polygons, leaf_degrees, salts)
    edges = polygon_edges(polygons)
    leaf = lambda c: F.floor(F.col(c) / leaf_degrees).cast("long")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    here = cells.select("x", "y", "lon", "lat", "bathymetry").withColumn("_salt", F.pmod(F.hash("x", "y"), F.lit(salts)))
    placed = here.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(COVER_LEVELS)))).withColumns({"_bx": leaf("lon"), "_by": leaf("lat")})
    placed = placed.withColumns({axis: F.expr(f"shiftright({axis}, _level)") for axis in ("_bx", "_by")})
    by = ["_level", "_bx", "_by", "_salt"]
    sure = placed.join(inside.withColumn("_salt", copies), by).select("region", "x", "y", "bathymetry")
    near = placed.filter("_level = 0").join(on_edge.withColumn("_salt", copies), by).select("region", "x", "y", "lon", "lat", "bathymetry")
    found = sure.unionByName(_inside_by_parity(near, edges, ["x", "y", "bathymetry"], leaf_degrees, salts))
    if limits is not None:
        found = found.join(limits, "region", "left").filter(
            (F.col("min_depth").isNull() | (F.col("bathymetry") >= F.col("min_depth")))
            & (F.col("max_depth").isNull() | (F.col("bathymetry") < F.col("max_depth")))
        )
    out = found.select("region", "x", "y")
    if whole_domain is not None:
        out = out.unionByName(cells.select(F.lit(whole_domain).alias("region"), "x", "y"))
    return out


def region_membership(matched: DataFrame, members: DataFrame) -> DataFrame:
    """One row per region a matched profile's cell belongs to (possibly several)."""
    return matched.join(members.select("region", "x", "y"), ["x", "y"])


# ---- stations of two runs ---------------------------------------------------------------

def match_stations(left: DataFrame, right: DataFrame, key="port",
                   widths: tuple[float, ...] = (0.03125, 0.5, 4.0), salts: int = 16) -> DataFrame:
    """For each left station the right one nearest in squared degrees (tie: smallest key).

    Square boxes of growing width: whatever is found closer than one box width is
    certainly the nearest, and only places still open go on to the next width, so crowded
    areas are settled in small boxes.  Places without any station within the last width descend a
    pyramid of occupied boxes instead (``_nearest_by_descent``), so no width pairs all with all, and every
    station ends with a partner.  Stations sharing a place are searched for, and found, once.
    """
    places = cut_lineage(right.groupBy(F.col("lon").alias("_rlon"), F.col("lat").alias("_rlat")).agg(F.min(key).alias("right_key")).dropna())
    todo = left.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).dropna().distinct()
    done = None
    for width in search_widths(places, widths):
        box = lambda c, w=width: F.floor(F.col(c) / w).cast("long")
        ring = (
            places.withColumn("_bx", F.explode(F.array(*[box("_rlon") + d for d in (-1, 0, 1)])))
            .withColumn("_by", F.explode(F.array(*[box("_rlat") + d for d in (-1, 0, 1)])))
        )
        open_ = todo.withColumn("_bx", box("_lon")).withColumn("_by", box("_lat"))
        near = _nearest_of(open_.join(copied(ring), ["_bx", "_by"]))
        near = cut_lineage(near.filter(F.col("distance_sq") <= width * width))
        todo = cut_lineage(todo.join(near, ["_lon", "_lat"], "left_anti"))
        done = near if done is None else done.unionByName(near)
        if todo.isEmpty():
            break
    if not todo.isEmpty():
        done = done.unionByName(_nearest_by_descent(todo, places, salts))
    stations = left.select(F.col(key).alias("left_key"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    return stations.join(done, ["_lon", "_lat"]).select("left_key", "right_key", "distance_sq")


def search_widths(places: DataFrame, widths: tuple[float, ...], most: int = 8, step: int = 4) -> list[float]:
    """``widths`` with smaller ones before them where places are crowded, and steps between, so that no box holds many more places than the one before."""
    box = [F.floor(F.col(c) / widths[0]) for c in ("_rlon", "_rlat")]
    n, occupied = places.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*box))).first()
    held, wanted = n / max(occupied, 1), list(widths)
    while held > most:
        held, wanted = held / step ** 2, [wanted[0] / step, *wanted]
    out = wanted[:1]
    for width in wanted[1:]:
        while out[-1] * step < width:
            out.append(out[-1] * step)
        out.append(width)
    return out


def _nearest_of(pairs: DataFrame) -> DataFrame:
    square = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    return (
        pairs.withColumn("distance_sq", square("_rlon", "_lon") + square("_rlat", "_lat"))
        .groupBy("_lon", "_lat").agg(F.min(F.struct("distance_sq", "right_key")).alias("_best"))
        .select("_lon", "_lat", "_best.right_key", "_best.distance_sq")
    )


#: Widths of the pyramid's boxes, each a quarter of the one before.
PYRAMID = tuple(512.0 / 4 ** k for k in range(11))
#: Boxes with no more places are not divided further.
FEW = 32


def _nearest_by_descent(todo: DataFrame, places: DataFrame, salts: int) -> DataFrame:
    """(_lon, _lat, right_key, distance_sq) by descent through boxes that hold places.

    From the largest boxes down, each open place keeps the boxes that may hold its nearest: those no
    farther, at their nearest point, than the farthest point of some other box.  That leaves a few boxes
    at every width, wherever the places lie.  The descent ends when all boxes left hold few places.
    """
    occupied = cut_lineage(places.withColumn("_width", F.explode(F.array(*[F.lit(w) for w in PYRAMID]))).groupBy(
        "_width", F.floor(F.col("_rlon") / F.col("_width")).cast("long").alias("_bx"), F.floor(F.col("_rlat") / F.col("_width")).cast("long").alias("_by")
    ).agg(F.count(F.lit(1)).alias("_n")))
    salt = F.pmod(F.hash("_lon", "_lat"), F.lit(salts)).alias("_salt")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    roots = F.explode(F.array(F.lit(-1).cast("long"), F.lit(0).cast("long")))
    state = todo.select("_lon", "_lat", salt, roots.alias("_bx")).withColumn("_by", roots)
    for k, width in enumerate(PYRAMID):
        if k:
            quarter = lambda axis: F.explode(F.array(*[F.col(axis) * 4 + d for d in range(4)]))
            state = state.select("_lon", "_lat", "_salt", quarter("_bx").alias("_bx"), "_by").withColumn("_by", quarter("_by"))
        boxes = occupied.filter(F.col("_width") == width).select("_bx", "_by", "_n", copies)
        nearest, farthest = F.lit(0.0), F.lit(0.0)
        for place, axis in (("_lon", "_bx"), ("_lat", "_by")):
            low, high = F.col(axis) * width, (F.col(axis) + 1) * width
            nearest = nearest + F.pow(F.greatest(low - F.col(place), F.col(place) - high, F.lit(0.0)), F.lit(2.0))
            farthest = farthest + F.pow(F.greatest(F.abs(low - F.col(place)), F.abs(high - F.col(place))), F.lit(2.0))
        met = state.join(boxes, ["_bx", "_by", "_salt"]).withColumns({"_near": nearest, "_far": farthest})
        # at most sixteen children of a few boxes come together here
        kept = met.groupBy("_lon", "_lat", "_salt").agg(F.min("_far").alias("_bound"), F.collect_list(F.struct("_bx", "_by", "_n", "_near")).alias("_boxes"))
        kept = kept.select("_lon", "_lat", "_salt", F.inline(F.filter("_boxes", lambda b: b["_near"] <= F.col("_bound") * (1 + 1e-9))))
        state = cut_lineage(kept.select("_lon", "_lat", "_salt", "_bx", "_by", "_n"))
        if width == PYRAMID[-1] or (state.agg(F.max("_n")).first()[0] or 0) <= FEW:
            break
        state = state.drop("_n")
    inside = places.select("*", F.floor(F.col("_rlon") / width).cast("long").alias("_bx"), F.floor(F.col("_rlat") / width).cast("long").alias("_by"), copies)
    return _nearest_of(state.drop("_n").join(inside, ["_bx", "_by", "_salt"]))


def unique_stations(stations: DataFrame, key="port") -> DataFrame:
    """Distinct coordinates with the first station there and how many share them."""
    return stations.groupBy("lon", "lat").agg(F.min(key).alias("first_" + key), F.count(F.lit(1)).alias("n"))
