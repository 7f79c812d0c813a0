"""Differences and their statistics by region, season, station and depth."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from soundings.operators.vertical import depth_mean

FIVE = ("mean", "std", "count", "min", "max")


def difference(df: DataFrame, variables, sign: int = 1, mod_suffix="_mod", obs_suffix="_obs") -> DataFrame:
    """Adds diff_, abs_diff_, square_diff_ per variable: ``sign`` * (model - obs)."""
    if sign not in (1, -1):
        raise ValueError("sign is 1 (model - obs) or -1 (obs - model)")
    new = {}
    for v in variables:
        d = F.col(v + mod_suffix) - F.col(v + obs_suffix)
        d = d if sign == 1 else -d
        new |= {f"diff_{v}": d, f"abs_diff_{v}": F.abs(d), f"square_diff_{v}": d * d}
    return df.withColumns(new)


def region_means(df: DataFrame, variables, keys=("region", "season"), z="z") -> DataFrame:
    """Means per level and over all levels in one pass; z is NULL for "all"."""
    grouped = df.groupingSets([[*map(F.col, keys), F.col(z)], [*map(F.col, keys)]], *keys, z)
    return grouped.agg(
        *[F.avg(v).alias(f"mean_{v}") for v in variables], F.count(F.lit(1)).alias("n"),
        F.when(F.grouping(z) == 0, "profile").otherwise("all").alias("level_set"))


def region_stats(df: DataFrame, variables, keys=("region", "season", "z")) -> DataFrame:
    """Mean, standard deviation, count, smallest and largest of each variable."""
    aggs = []
    for v in variables:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"), F.count(v).alias(f"{v}_count"),
                 F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    return df.groupBy(*keys).agg(*aggs)


def obs_std(levels: DataFrame, variables, keys=("region", "season"), z="z") -> DataFrame:
    """Standard deviation per level, then its thickness-weighted mean over depth."""
    per_level = levels.groupBy(*keys, z).agg(
        F.max("thickness").alias("thickness"), *[F.stddev_pop(v).alias(v) for v in variables])
    return depth_mean(per_level, variables, keys).withColumnsRenamed({v: f"{v}_std" for v in variables})


def tide_gauge_stats(df: DataFrame, keys=("port",)) -> DataFrame:
    """Error statistics per station for each season and for all of them together.

    Needs season, ssh_obs, ssh_mod, ntr_obs, ntr_mod.  A seasonal correlation needs more
    than 100 points.
    """
    k = [F.col(c) for c in keys]
    d = F.col("ntr_mod") - F.col("ntr_obs")
    both = F.count_if(F.col("ntr_obs").isNotNull() & F.col("ntr_mod").isNotNull())
    out = df.groupingSets([[*k, F.col("season")], k], *keys, "season").agg(
        F.grouping("season").alias("_all"),
        F.stddev_pop("ssh_obs").alias("ssh_std_obs"), F.stddev_pop("ssh_mod").alias("ssh_std_mod"),
        F.stddev_pop("ntr_obs").alias("ntr_std_obs"), F.stddev_pop("ntr_mod").alias("ntr_std_mod"),
        F.stddev_pop(d).alias("ntr_err_std"), F.avg(d).alias("ntr_me"), F.avg(F.abs(d)).alias("ntr_mae"),
        F.sqrt(F.avg(d * d)).alias("ntr_rmse"), F.corr("ntr_obs", "ntr_mod").alias("_corr"), both.alias("n"))
    return out.select(
        *keys, F.when(F.col("_all") == 1, "All").otherwise(F.col("season")).alias("season"),
        "ssh_std_obs", "ssh_std_mod", (F.col("ssh_std_mod") - F.col("ssh_std_obs")).alias("ssh_std_err"),
        "ntr_std_obs", "ntr_std_mod", "ntr_err_std", "ntr_me", "ntr_mae", "ntr_rmse",
        F.when((F.col("_all") == 1) | (F.col("n") > 100), F.col("_corr")).alias("ntr_corr"), "n")


def month_climatology(df: DataFrame, variables, keys=("port",), time="time") -> DataFrame:
    """Mean and standard deviation by month of the year."""
    aggs = [f(v).alias(f"{v}_{n}") for v in variables for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return df.groupBy(*keys, F.month(time).alias("month")).agg(*aggs)


def calendar_months(df: DataFrame, variables, keys=("port",), time="time") -> DataFrame:
    """Mean, standard deviation and largest value of each calendar month."""
    aggs = [f(v).alias(f"{v}_{n}") for v in variables
            for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max))]
    return df.groupBy(*keys, F.date_trunc("month", time).cast("timestamp_ntz").alias("month_start")).agg(*aggs)


def climatology_error(clim: DataFrame, variable="ntr") -> DataFrame:
    """Model minus observed standard deviation per month of the year."""
    return clim.withColumn("std_err", F.col(f"{variable}_mod_std") - F.col(f"{variable}_obs_std"))


def demean(df: DataFrame, columns, keys=("port",)) -> DataFrame:
    """Subtract each group's mean.  Means are aggregated and joined, not windowed, so that
    a long series is not gathered in one task."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    return df.join(means, list(keys)).withColumns(
        {c: F.col(c) - F.col(f"_mean_{c}") for c in columns}).drop(*[f"_mean_{c}" for c in columns])
