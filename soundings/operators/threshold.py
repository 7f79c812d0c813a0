"""Counts over thresholds, and ratios of them."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from soundings.functions.scalars import ratio, thresholds


def exceedance(df: DataFrame, values: dict[str, str], levels=None, keys=("port",), strict: bool = False) -> DataFrame:
    """(keys, threshold, counts): how many values reach each threshold.

    ``values`` maps an output name to a column.  All thresholds are counted in one pass
    with one row per group; the thresholds become rows only after the aggregate.
    ``strict`` counts values above the threshold instead of at or above it.
    """
    levels = thresholds() if levels is None else levels
    reach = lambda c, t: F.col(c) > t if strict else F.col(c) >= t
    arrays = [F.array(*[F.count_if(reach(c, float(t))) for t in levels]).alias(f"_{name}") for name, c in values.items()]
    counted = df.groupBy(*keys).agg(*arrays)
    level = F.array(*[F.lit(float(t)) for t in levels])
    rows = F.arrays_zip(level.alias("threshold"), *[F.col(f"_{n}").alias(n) for n in values])
    return counted.select(*keys, F.explode(rows).alias("_r")).select(
        *keys, F.col("_r.threshold").alias("threshold"), *[F.col(f"_r.{n}").alias(n) for n in values])


def period_maxima(df: DataFrame, columns, unit: str, keys=("port",), time="time") -> DataFrame:
    """Largest value of each calendar ``day`` or ``month``."""
    return df.groupBy(*keys, F.date_trunc(unit, time).cast("timestamp_ntz").alias("period")).agg(
        *[F.max(c).alias(c) for c in columns])


def threshold_ratios(counts: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Model count over observed count per station; NULL where nothing was observed."""
    return counts.withColumns({name: ratio(mod, obs) for name, (mod, obs) in pairs.items()})


def threshold_curves(counts: DataFrame, columns, pairs: dict[str, tuple[str, str]], keys=()) -> DataFrame:
    """Over all stations: mean counts per threshold, and ratios of the summed counts."""
    aggs = [F.avg(c).alias(f"mean_{c}") for c in columns]
    aggs += [ratio(F.sum(mod), F.sum(obs)).alias(name) for name, (mod, obs) in pairs.items()]
    return counts.groupBy(*keys, "threshold").agg(*aggs)
