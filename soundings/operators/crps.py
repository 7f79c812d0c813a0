"""Neighbourhood CRPS of surface observations."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from soundings.functions.scalars import CRPS_RADII_KM, EARTH_RADIUS_KM
from soundings.operators.spatial import cells_per_box, degrees_of, in_reach, in_tile
from soundings.session import cut_lineage

#: Side of a tile in radii: a cell's values are sent to two or three tiles.
SIDE = 4
#: Values of one variable that a task holds at a time, about: cells around a tile by model times.
VALUES = 1 << 21
#: Model times of a tile that are handled together, at most.
TIMES = 64
#: Observations of a tile at those times that one task takes; the cells of a tile with more are repeated.
CROWDED = 65536


def neighbourhood_crps(obs: DataFrame, cells: DataFrame, field: DataFrame, variables,
                       radii=CRPS_RADII_KM, key="profile_id") -> DataFrame:
    """(key, variable, radius_km, crps, n_points, land) for every observation and radius.

    ``obs`` has lon, lat, the model time ``t`` nearest to it and the observed variables;
    ``field`` has x, y, t and the model's.  Radius 0 stands for the nearest sea cell.  The spread term
    mean|xi - xj| / 2 comes from the ranks within the neighbourhood.  ``land`` tells that a land cell lies within the radius.

    Observations and cells meet in tiles a few radii wide, for some model times at once, and a score is
    made where they meet: a pair of an observation and a model value is neither a row nor sent nor written.
    A task holds the values of the cells around one tile.  Only what a key with several different
    observations meets is sent on, as their values make one ensemble.
    """
    variables, radii = list(variables), sorted(int(r) for r in radii)
    largest = max(radii)
    around = cells_per_box(cells, largest) * (SIDE + 2) ** 2
    span = int(min(TIMES, max(1, VALUES // max(around, 1))))
    times = cut_lineage(obs.select("t").dropna().distinct().withColumn("_n", F.row_number().over(Window.orderBy("t")) - 1).select(
        "t", F.expr(f"cast(_n div {span} as int)").alias("_chunk"), F.expr(f"cast(_n % {span} as int)").alias("_time")))

    # An observation given several times counts as often; ``_alone`` tells that its key has no other.
    known = obs.select(key, "lon", "lat", "t", *variables).filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    known = known.repartition(key).groupBy(key, "lon", "lat", "t", *variables).agg(F.count(F.lit(1)).alias("_times"))
    known = known.withColumn("_alone", F.count(F.lit(1)).over(Window.partitionBy(key)) == 1)
    timed = known.join(times, "t", "left").drop("t").withColumn("_chunk", F.coalesce("_chunk", F.lit(0)))
    placed = cut_lineage(in_tile(timed, largest, SIDE))

    by = ["_band", "_box", "_chunk"]
    sizes = cut_lineage(placed.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / CROWDED).cast("int").alias("_units")))
    near = in_reach(cells.select(F.col("lon").alias("_clon"), F.col("lat").alias("_clat"), "x", "y", (F.col("bottom_level") == 0).alias("land")), largest, SIDE)
    near = near.join(sizes, by[:2]).withColumn("_unit", F.explode(F.sequence(F.lit(0), F.col("_units") - 1))).drop("_units")
    # The values of a cell by place in their chunk: time by variable.
    column = F.col("_time") * len(variables)
    values = F.array_compact(F.array(*[F.when(F.col(v).isNotNull(), F.struct((column + i).alias("at"), F.col(v).cast("double").alias("v")))
                                       for i, v in enumerate(variables)]))
    packed = field.join(times, "t").select("x", "y", F.col("_chunk").alias("_of"), F.inline(values)).groupBy("x", "y", "_of").agg(
        F.collect_list(F.struct("at", "v")).alias("_values")).withColumnsRenamed({"x": "_x", "y": "_y"})
    # The chunk is compared by two bounds, so that the join is by cell alone: a field that is dealt by cell then stays where it is.
    same = (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.col("_of") >= F.col("_chunk")) & (F.col("_of") <= F.col("_chunk"))
    near = near.join(packed, same, "left").select(*by, "_unit", "_clon", "_clat", "x", "y", "land", F.col("_values.at").alias("_at"), F.col("_values.v").alias("_v"))

    def scored(some: DataFrame) -> DataFrame:
        """(key, _found) of the observations: for each variable what ``_Neighbourhoods`` finds."""
        unit = F.pmod(F.xxhash64(key, "lon", "lat"), F.col("_units")).cast("int")
        dealt = some.join(sizes, by).withColumn("_unit", unit).drop("_units")
        # Much arithmetic for few bytes: a fixed number of tasks, which are not merged by size.
        here = _Neighbourhoods(key, variables, radii, span)
        tasks, to = int(some.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*by, "_unit"]
        kind = some.schema[key].dataType.simpleString()
        return dealt.repartition(tasks, *to).groupBy(*to).cogroup(near.repartition(tasks, *to).groupBy(*to)).applyInArrow(
            lambda some, around: here.meet(some, around), f"`{key}` {kind}, {FOUND}")

    alone = placed.filter("_alone")
    found = scored(alone).drop("land_within", "xs", "ring", "y")
    several = placed.filter("not _alone")
    if not several.isEmpty():
        found = found.unionByName(scored(several).groupBy(key, "variable").applyInArrow(
            _merged(key, radii), f"`{key}` {placed.schema[key].dataType.simpleString()}, {SCORES}"))
    each = F.inline(F.arrays_zip(F.array(*[F.lit(r) for r in radii]).alias("radius_km"), F.col("crps"), F.col("n_points"), F.col("land")))
    out = found.select(key, "variable", each)
    # no value: NULL; a value that is no number: NaN
    score = F.when(F.col("n_points") > 0, F.coalesce("crps", F.lit(float("nan"))))
    return out.select(key, "variable", "radius_km", score.alias("crps"), "n_points", "land")


SCORES = "variable string, crps array<double>, n_points array<bigint>, land array<boolean>"
FOUND = SCORES + ", y double, xs array<double>, ring array<int>, land_within array<boolean>"
_SCORE_TYPES = [pa.string(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
_FOUND_TYPES = [*_SCORE_TYPES, pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.bool_())]


def _score(xs: np.ndarray, y: float) -> float:
    """CRPS of an ensemble: mean distance to ``y`` less half the mean distance of its members."""
    n = len(xs)
    if n == 0:
        return math.nan
    xs = np.sort(xs)
    spread = (2 * np.dot(xs, np.arange(1, n + 1)) - (n + 1) * xs.sum()) / (n * n)
    return float(np.abs(xs - y).mean() - spread)


def _of_radius(ring: np.ndarray, k: int, radius: int) -> np.ndarray:
    """Which members belong to radius ``k``; bit 0 of ``ring`` marks the nearest cell, the rest is the first radius reached."""
    return ring & 1 == 1 if radius == 0 else ring >> 1 <= k


def _list_column(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column, NULL as an empty list."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lengths.astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _great_circle_km(lon1, lat1, lon2, lat2):
    """As ``scalars.great_circle_km``."""
    s_lat, s_lon = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    h = s_lat * s_lat + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * s_lon * s_lon
    return 2.0 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


class _Cells:
    """Cells around a tile, by latitude, and their values."""

    def __init__(self, table: pa.Table, columns: int):
        lon, lat = (table.column(c).to_numpy() for c in ("_clon", "_clat"))
        order = np.argsort(lat, kind="stable")
        self.lon, self.lat = lon[order], lat[order]
        flag = table.column("land").combine_chunks()
        self.land = flag.fill_null(False).to_numpy(zero_copy_only=False)[order]
        self.sea = ~flag.fill_null(True).to_numpy(zero_copy_only=False)[order]
        # NULL sorts before any number and equals nothing
        self.name = [table.column(c).fill_null(0).to_numpy()[order] for c in ("x", "y")]
        self.named = [table.column(c).is_valid().to_numpy()[order] for c in ("x", "y")]
        up, east = np.radians(self.lat), np.radians(self.lon)
        self.point = np.stack([np.cos(up) * np.cos(east), np.cos(up) * np.sin(east), np.sin(up)], axis=1)
        self.n = n = len(lat)
        lengths, at = _list_column(table.column("_at"))
        _, v = _list_column(table.column("_v"))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        cell = np.repeat(place, lengths)
        # A cell that has several values at a time is there as often.
        by = np.lexsort((cell, at))
        cell, at, v = cell[by], at[by], v[by]
        new = np.r_[True, (cell[1:] != cell[:-1]) | (at[1:] != at[:-1])][:len(cell)]
        start = np.flatnonzero(new)
        layer = np.arange(len(cell)) - np.repeat(start, np.diff(np.r_[start, len(cell)]))
        self.layers = int(layer.max()) + 1 if len(layer) else 1
        self.v, self.has = np.zeros((columns, self.layers * n)), np.zeros((columns, self.layers * n), bool)
        self.v[at, layer * n + cell], self.has[at, layer * n + cell] = v, True

    def within(self, lon: float, lat: float, radius: float):
        """Cells no further than the radius, and their distances."""
        height = degrees_of(radius)
        low, high = np.searchsorted(self.lat, [lat - height, lat + height])
        up, east = math.radians(lat), math.radians(lon)
        here = np.array([math.cos(up) * math.cos(east), math.cos(up) * math.sin(east), math.sin(up)])
        # the angle's cosine, with room for rounding, before the distance itself
        some = low + np.flatnonzero(self.point[low:high] @ here >= math.cos(min(math.pi, math.radians(height))) - 1e-12)
        km = _great_circle_km(lon, lat, self.lon[some], self.lat[some])
        inside = km <= radius
        return some[inside], km[inside]

    def nearest(self, some: np.ndarray, km: np.ndarray) -> np.ndarray:
        """Which of the cells is, or shares its name with, the nearest sea cell (tie: smallest x, y)."""
        sea = np.flatnonzero(self.sea[some])
        if not len(sea):
            return np.zeros(len(some), bool)
        sea = sea[km[sea] == km[sea].min()]
        at = some[sea]
        (x, y), (has_x, has_y) = self.name, self.named
        best = at[np.lexsort((y[at], has_y[at], x[at], has_x[at]))[0]]
        if not (has_x[best] and has_y[best]):
            return np.zeros(len(some), bool)
        return (x[some] == x[best]) & has_x[some] & (y[some] == y[best]) & has_y[some]


class _Neighbourhoods:
    """Meets the observations of a tile with the cells around it."""

    def __init__(self, key: str, variables: list[str], radii: list[int], span: int):
        self.key, self.variables, self.radii, self.span = key, variables, radii, span

    def meet(self, obs: pa.Table, table: pa.Table) -> pa.Table:
        names, radii = self.variables, np.array(self.radii)
        rows = []
        if obs.num_rows and table.num_rows:
            cells = _Cells(table, self.span * len(names))
            lon, lat = obs.column("lon").to_numpy(), obs.column("lat").to_numpy()
            time = obs.column("_time").fill_null(-1).to_numpy()
            times, alone = obs.column("_times").to_numpy(), obs.column("_alone").to_numpy()
            values = [obs.column(v).cast(pa.float64()).combine_chunks() for v in names]
            has = [v.is_valid().to_numpy(zero_copy_only=False) for v in values]
            values = [v.to_numpy(zero_copy_only=False) for v in values]
            order = np.lexsort((lat, lon))
            edges = np.flatnonzero(np.r_[True, (np.diff(lon[order]) != 0) | (np.diff(lat[order]) != 0), True])
            for first, last in zip(edges[:-1], edges[1:]):
                here = order[first:last]
                some, km = cells.within(lon[here[0]], lat[here[0]], float(radii[-1]))
                if not len(some):
                    continue
                shore = km[cells.land[some]]
                land = [bool(r > 0 and (shore <= r).any()) for r in radii]
                nearest, sea = cells.nearest(some, km), cells.sea[some]
                rings = np.searchsorted(radii, km, side="left")
                # at distance 0 the first positive radius is reached
                ring = (np.maximum(rings, int(radii[0] == 0)) * 2 + nearest)[sea]
                member = some[sea]
                if cells.layers > 1:
                    member = np.concatenate([member + k * cells.n for k in range(cells.layers)])
                    ring = np.tile(ring, cells.layers)
                for row in here:
                    for i, name in enumerate(names):
                        if has[i][row]:
                            rows.append((row, name, *self._found(cells, member, ring, land, time[row] * len(names) + i, values[i][row], int(times[row]), alone[row])))
        columns = list(zip(*rows)) or [[] for _ in range(1 + len(_FOUND_TYPES))]
        keys = obs.column(self.key).take(pa.array(columns[0], pa.int64()))
        return pa.table([keys, *[pa.array(c, t) for c, t in zip(columns[1:], _FOUND_TYPES)]],
                        [self.key, *[part.split()[0] for part in FOUND.split(", ")]])

    def _found(self, cells, member, ring, land, column, y, times, alone):
        if column < 0:
            xs, ring = np.empty(0), ring[:0]
        else:
            has = cells.has[column, member]
            xs, ring = cells.v[column, member[has]], ring[has]
        if not alone:
            return None, None, None, y, np.tile(xs, times), np.tile(ring, times).astype(np.int32), land
        crps, n = _scores(xs, ring, y, self.radii)
        return crps, [k * times for k in n], land, None, None, None, None


def _scores(xs: np.ndarray, ring: np.ndarray, y: float, radii) -> tuple[list, list]:
    parts = [xs[_of_radius(ring, k, r)] for k, r in enumerate(radii)]
    return [_score(part, y) for part in parts], [len(part) for part in parts]


def _merged(key: str, radii: list[int]):
    """Scores of one key, whose observations' values make one ensemble."""
    def merge(rows: pa.Table) -> pa.Table:
        y, land = rows.column("y")[0].as_py(), rows.column("land_within")[0].as_py()
        xs, ring = (_list_column(rows.column(c))[1] for c in ("xs", "ring"))
        crps, n = _scores(xs, ring, math.nan if y is None else y, radii)
        return pa.table([rows.column(key)[:1], rows.column("variable")[:1], *[pa.array([c], t) for c, t in zip((crps, n, land), _SCORE_TYPES[1:])]],
                        [key, *[part.split()[0] for part in SCORES.split(", ")]])
    return merge


def regional_crps(crps: DataFrame, membership: DataFrame, errors: DataFrame, key="profile_id") -> DataFrame:
    """(region, variable, radius_km): mean CRPS over all and over land-free neighbourhoods.

    At radius 0 the absolute error (key, variable, abs_diff) takes the place of the CRPS.
    """
    patched = crps.join(errors.select(key, "variable", "abs_diff"), [key, "variable"], "left").withColumn(
        "_s", F.when(F.col("radius_km") == 0, F.col("abs_diff")).otherwise(F.col("crps")))
    return patched.join(membership.select(key, "region"), key).groupBy("region", "variable", "radius_km").agg(
        F.avg("_s").alias("crps"), F.avg(F.when(~F.col("land"), F.col("_s"))).alias("crps_no_land"),
        F.avg("n_points").alias("n_points"), F.count("_s").alias("n"))
