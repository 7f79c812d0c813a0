"""Filters, masks and projections."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from soundings.functions.scalars import DOMAIN_LAT, DOMAIN_LON, season


def lonlat_box(df: DataFrame, lon_bounds=DOMAIN_LON, lat_bounds=DOMAIN_LAT,
               lon="lon", lat="lat") -> DataFrame:
    """Rows inside the box, edges included."""
    return df.filter(F.col(lon).between(*lon_bounds) & F.col(lat).between(*lat_bounds))


def extent(df: DataFrame, margin: float = 0.0, lon="lon", lat="lat") -> DataFrame:
    """One row: smallest and largest longitude and latitude, widened by ``margin``."""
    return df.agg(
        (F.min(lon) - margin).alias("lon_min"), (F.max(lon) + margin).alias("lon_max"),
        (F.min(lat) - margin).alias("lat_min"), (F.max(lat) + margin).alias("lat_max"),
    )


def within_extent_of(df: DataFrame, grid: DataFrame, lon="lon", lat="lat") -> DataFrame:
    """Rows inside the grid's own extent (edges included), which is worked out once."""
    box = extent(grid)
    edge = lambda name: box.select(name).scalar()
    return df.filter(F.col(lon).between(edge("lon_min"), edge("lon_max"))
                     & F.col(lat).between(edge("lat_min"), edge("lat_max")))


def null_flagged(levels: DataFrame, variables, flag: Column, neighbours: bool = False,
                 key="profile_id", z="z") -> DataFrame:
    """Flagged levels become NULL, optionally with z-1 and z+1; empty profiles go.

    Neighbours are reached by sending each flagged level to the three levels it spoils
    and joining on (profile, level), so a profile is never gathered in one task.
    """
    if neighbours:
        spoiled = (
            levels.filter(flag).select(key, F.explode(F.array(*[F.col(z) + d for d in (-1, 0, 1)])).alias(z))
            .distinct().withColumn("_bad", F.lit(True))
        )
        levels, bad = levels.join(spoiled, [key, z], "left"), F.coalesce(F.col("_bad"), F.lit(False))
    else:
        bad = F.coalesce(flag, F.lit(False))
    cleaned = levels.withColumns({v: F.when(~bad, F.col(v)) for v in variables}).drop("_bad")
    alive = cleaned.dropna(how="all", subset=list(variables)).select(key).distinct()
    return cleaned.join(alive, key, "left_semi")


def time_window(df: DataFrame, start: str, end: str, time="time", closed: bool = False) -> DataFrame:
    """``[start, end)``, or ``[start, end]`` when ``closed``."""
    t = F.col(time)
    low, high = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return df.filter((t >= low) & ((t <= high) if closed else (t < high)))


def cut_to_model_period(obs: DataFrame, model: DataFrame, time="time", model_time="t") -> DataFrame:
    """Rows between the model's first and last time, both included."""
    span = model.agg(F.min(model_time).alias("first"), F.max(model_time).alias("last"))
    return obs.filter(F.col(time).between(span.select("first").scalar(), span.select("last").scalar()))


def land_flag(cells: DataFrame, level="bottom_level") -> DataFrame:
    return cells.withColumn("land", F.col(level) == 0)


def within_distance(matchup: DataFrame, max_km: float = 5.0, inclusive: bool = True,
                    distance="interp_dist_km") -> DataFrame:
    d = F.col(distance)
    return matchup.filter(d <= max_km if inclusive else d < max_km)


def within_lag(matchup: DataFrame, max_seconds: int = 43_200, lag="interp_lag_s") -> DataFrame:
    return matchup.filter(F.abs(F.col(lag)) <= max_seconds)


def drop_audit(matchup: DataFrame, max_km: float = 5.0, max_seconds: int = 43_200) -> DataFrame:
    """How many matchups each filter removes, in the order they are applied."""
    far = F.col("interp_dist_km") > max_km
    late = F.abs(F.col("interp_lag_s")) > max_seconds
    return matchup.agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(far).alias("n_too_far"),
        F.count_if(~far & late).alias("n_too_late"), F.count_if(~far & ~late).alias("n_kept"),
    )


def observe_audit(matchup: DataFrame, max_km: float = 5.0, max_seconds: int = 43_200) -> tuple[DataFrame, Observation]:
    """The matchups that pass both filters, and ``drop_audit``'s counts, taken while they are computed.

    The observation has them (n_all, n_too_far, n_too_late, n_kept) once the result has been written or
    collected; no pass of its own is made.
    """
    audit = Observation()
    far, late = F.col("interp_dist_km") > max_km, F.abs(F.col("interp_lag_s")) > max_seconds
    seen = matchup.observe(audit, F.count(F.lit(1)).alias("n_all"), F.count_if(far).alias("n_too_far"),
                           F.count_if(~far & late).alias("n_too_late"), F.count_if(~far & ~late).alias("n_kept"))
    return seen.filter(~far & ~late), audit


def with_season(df: DataFrame, time="time") -> DataFrame:
    return df.withColumn("season", season(time))


def only_label(df: DataFrame, **labels) -> DataFrame:
    """Rows whose columns equal the given season, region, constituent, ..."""
    for name, value in labels.items():
        df = df.filter(F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return df


def enough_data(series: DataFrame, columns, minimum: int = 4380, keys=("port",)) -> DataFrame:
    """Series of the groups with at least ``minimum`` values in every one of ``columns``."""
    counts = series.groupBy(*keys).agg(*[F.count(c).alias(f"_n_{c}") for c in columns])
    for c in columns:
        counts = counts.filter(F.col(f"_n_{c}") >= minimum)
    return series.join(counts.select(*keys), list(keys), "left_semi")


def null_bad_stations(series: DataFrame, bad: DataFrame, columns, key="port") -> DataFrame:
    """Values of flagged stations become NULL; their rows stay."""
    flagged = bad.select(key).distinct().withColumn("_bad", F.lit(True))
    return (
        series.join(flagged, key, "left")
        .withColumns({c: F.when(F.col("_bad").isNull(), F.col(c)) for c in columns}).drop("_bad")
    )


def shared_missing(df: DataFrame, first="ssh_obs", second="ssh_mod") -> DataFrame:
    """Missing on either side means missing on both."""
    both = F.col(first).isNotNull() & F.col(second).isNotNull()
    return df.withColumns({c: F.when(both, F.col(c)) for c in (first, second)})


def mask_where_missing(df: DataFrame, columns, present: str) -> DataFrame:
    """Reconstructed values are kept only where the measured value exists."""
    return df.withColumns({c: F.when(F.col(present).isNotNull(), F.col(c)) for c in columns})


def plausible_amplitude(df: DataFrame, columns, largest: float = 20.0) -> DataFrame:
    return df.withColumns(
        {c: F.when((F.col(c) != 0) & (F.col(c) <= largest), F.col(c)) for c in columns}
    )


def near_surface(df: DataFrame, depth: float = 5.0, inclusive: bool = True, column="depth") -> DataFrame:
    d = F.col(column)
    return df.filter(d <= depth if inclusive else d < depth)


def drop_empty(df: DataFrame, variables) -> DataFrame:
    return df.dropna(how="all", subset=list(variables))


def first_levels(df: DataFrame, k: int, z="z") -> DataFrame:
    return df.filter(F.col(z) < k)


def flatten_levels(df: DataFrame, arrays, keys) -> DataFrame:
    """Array columns of equal length to one row per level."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    return df.select(*keys, F.posexplode(zipped).alias("z", "_level")).select(
        *keys, "z", *[F.col("_level").getField(a).alias(a) for a in arrays]
    )


def to_long(df: DataFrame, keys, variables, name="variable", value="value") -> DataFrame:
    """One row per variable."""
    return df.unpivot(list(keys), list(variables), name, value)


