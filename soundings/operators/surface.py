"""Surface fields: monthly means, lon/lat bins, seasonal climatology."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from soundings.functions.scalars import DOMAIN_LAT, DOMAIN_LON, bin_centre, interval_bin, season_of_month
from soundings.operators.clean import near_surface
from soundings.schema import run_key


def surface_mean(field: DataFrame, variables, depth: float = 5.0, keys=("x", "y", "t")) -> DataFrame:
    """Plain mean of the levels no deeper than ``depth``; runs, where the field names them, stay apart."""
    return near_surface(field, depth).groupBy(*run_key(field), *keys).agg(*[F.avg(v).alias(v) for v in variables])


def with_bins(df: DataFrame, cells: int = 20, lon_bounds=DOMAIN_LON, lat_bounds=DOMAIN_LAT) -> DataFrame:
    """lon_bin and lat_bin (bin centres); rows outside the box are dropped."""
    return (
        df.withColumn("_bx", interval_bin("lon", *lon_bounds, cells)).withColumn("_by", interval_bin("lat", *lat_bounds, cells))
        .filter(F.col("_bx").isNotNull() & F.col("_by").isNotNull())
        .withColumn("lon_bin", bin_centre("_bx", *lon_bounds, cells))
        .withColumn("lat_bin", bin_centre("_by", *lat_bounds, cells)).drop("_bx", "_by")
    )


def bin_mean(df: DataFrame, variables, keys=(), cells: int = 20, lon_bounds=DOMAIN_LON, lat_bounds=DOMAIN_LAT) -> DataFrame:
    return with_bins(df, cells, lon_bounds, lat_bounds).groupBy(*keys, "lon_bin", "lat_bin").agg(
        *[F.avg(v).alias(v) for v in variables])


def monthly_model_bins(surface: DataFrame, variables, cells: int = 20) -> DataFrame:
    """Monthly mean of each grid cell, then its mean over the cells of a bin."""
    per_cell = surface.groupBy(F.year("t").alias("year"), F.month("t").alias("month"), "x", "y", "lon", "lat").agg(
        *[F.avg(v).alias(v) for v in variables])
    return bin_mean(per_cell, variables, ("year", "month"), cells)


def monthly_profile_bins(levels: DataFrame, variables, depth: float = 5.0, cells: int = 20) -> DataFrame:
    """Mean over the top levels of a profile, then over a bin at one time, then over times.

    ``levels`` carries profile_id, time, lon, lat.
    """
    top = near_surface(levels, depth, inclusive=False).groupBy("profile_id", "time", "lon", "lat").agg(
        *[F.avg(v).alias(v) for v in variables]).dropna(how="all", subset=list(variables))
    at_once = bin_mean(top, variables, ("time",), cells)
    return at_once.groupBy(F.year("time").alias("year"), F.month("time").alias("month"), "lon_bin", "lat_bin").agg(
        *[F.avg(v).alias(v) for v in variables])


def seasonal_climatology(monthly: DataFrame, variables, keys=("lon_bin", "lat_bin"), month="month") -> DataFrame:
    """Mean over the records of a season, on bins or on the native grid."""
    return monthly.withColumn("season", season_of_month(month)).groupBy("season", *keys).agg(
        *[F.avg(v).alias(v) for v in variables])


def climatology_difference(model: DataFrame, obs: DataFrame, variables, keys=("season", "lon_bin", "lat_bin")) -> DataFrame:
    """Model minus observations on the bins both have."""
    left = model.select(*keys, *[F.col(v).alias(f"{v}_mod") for v in variables])
    right = obs.select(*keys, *[F.col(v).alias(f"{v}_obs") for v in variables])
    return left.join(right, list(keys)).withColumns(
        {f"diff_{v}": F.col(f"{v}_mod") - F.col(f"{v}_obs") for v in variables})
