"""Neighbourhood CRPS of near-surface observations, and its means by region."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from soundings.functions.scalars import CRPS_RADII_KM
from soundings.operators.clean import near_surface
from soundings.operators.crps import SIDE, neighbourhood_crps, regional_crps
from soundings.operators.spatial import in_reach, in_tile
from soundings.operators.surface import surface_mean
from soundings.operators.timejoin import nearest_time
from soundings.schema import one_run
from soundings.session import cut_lineage


def surface_crps(headers: DataFrame, levels: DataFrame, cells: DataFrame, field: DataFrame, variables,
                 radii=CRPS_RADII_KM, depth: float = 5.0, run: str | None = None, model_times: DataFrame | None = None) -> DataFrame:
    """CRPS of each profile's near-surface mean against the model's at the nearest time.

    The field is read for the months and cells needed; ``run`` names the run to take from it (without it, a
    second run at the times of observations is an error), and ``model_times`` (t) spares a pass over it for its times.
    """
    variables = list(variables)
    cells = one_run(cells, run)
    if run is not None:
        field = one_run(field, run)
    top = near_surface(levels, depth).groupBy("profile_id").agg(*[F.avg(v).alias(v) for v in variables])
    timed = nearest_time(headers, field.select("t").distinct() if model_times is None else model_times.select("t").distinct())
    # Read several times: for its times, its positions and its values.
    obs = cut_lineage(timed.join(top, "profile_id").select("profile_id", "lon", "lat", "t", *variables))
    places = in_tile(obs.select("lon", "lat").dropna().distinct(), max(radii), SIDE)
    own = cells.select(F.col("lon").alias("_clon"), F.col("lat").alias("_clat"), "x", "y")
    around = in_reach(own, max(radii), SIDE).join(places.select("_band", "_box").distinct(), ["_band", "_box"], "left_semi")
    field = one_run(near_surface(at_times(field, obs), depth))
    return neighbourhood_crps(obs, cells, surface_mean(needed_field(field, obs, around), variables, depth), variables, radii)


def _months(field: DataFrame) -> dict:
    """Year and month of ``t``, where the field is stored by them."""
    return {"year": F.year("t"), "month": F.month("t")} if {"year", "month"} <= set(field.columns) else {}


def at_times(field: DataFrame, obs: DataFrame) -> DataFrame:
    """The field's rows at the times of observations.

    Where the field is stored by year and month, those of the times join as well, so that only their folders are read.
    """
    months, wanted = _months(field), obs.select("t").distinct()
    return field.join(wanted.withColumns(months) if months else wanted, ["t", *months], "left_semi")


def needed_field(field: DataFrame, obs: DataFrame, around: DataFrame) -> DataFrame:
    """The field's rows at the times of observations and in the cells ``around`` (x, y) any of them.

    By cell, not by cell and time: that list would be as long as the field where observations are many.
    """
    return at_times(field, obs).join(around.select("x", "y").distinct(), ["x", "y"], "left_semi")


def crps_by_region(crps: DataFrame, membership: DataFrame, pairs: DataFrame, variables, depth: float = 5.0) -> DataFrame:
    """Regional means by radius; radius 0 shows the absolute error of the near-surface means.

    ``pairs`` holds profile_id, depth and both sides of each variable.
    """
    means = near_surface(pairs, depth).groupBy("profile_id").agg(
        *[F.abs(F.avg(F.col(f"{v}_mod") - F.col(f"{v}_obs"))).alias(v) for v in variables])
    return regional_crps(crps, membership, means.unpivot(["profile_id"], list(variables), "variable", "abs_diff"))
