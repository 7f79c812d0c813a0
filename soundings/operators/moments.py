"""Statistics that are kept month by month and merged: moments, extremes and quantile sketches.

A month's rows become one state per group: count, mean, sum of squared deviations, smallest
and largest value, and, if wanted, a quantile sketch.  States are stored by year and month; a
new or corrected month replaces its own states and no archive is read again.  Merging states,
over months, seasons or levels, gives what the rows together would give, and the result is a
state again.  Every step is an aggregate with partial sums, so a group may have any number of states.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from soundings.functions.scalars import ratio
from soundings.sources.sink import publish, read_published

MONTH = ("year", "month")
#: Size parameter of quantile sketches; see ``rank_error``.
SKETCH = 1024


def rank_error(k: int = SKETCH) -> float:
    """Share of a group by which the rank of a sketch's quantile may be off, with 99 % confidence.

    Groups of fewer than ``k`` values are kept whole, so their quantiles are exact.  Published
    fit for these sketches; merging does not add to it.
    """
    return 2.296 / k ** 0.9723


def month_states(df: DataFrame, variables, keys=("region", "season", "z"), time="time", sketch: int | None = None) -> DataFrame:
    """States by calendar month: (year, month, keys, and for each variable n_, mean_, m2_, min_, max_ and sketch_).

    ``sketch`` is the size parameter of quantile sketches; without it there are none.  Missing values do not count.
    """
    aggs = []
    for v in variables:
        x = F.col(v).cast("double")
        aggs += [F.count(x).alias(f"n_{v}"), F.avg(x).alias(f"mean_{v}"), (F.var_pop(x) * F.count(x)).alias(f"m2_{v}"),
                 F.min(x).alias(f"min_{v}"), F.max(x).alias(f"max_{v}")]
        if sketch:
            aggs.append(F.kll_sketch_agg_double(x, sketch).alias(f"sketch_{v}"))
    return df.groupBy(F.year(time).alias("year"), F.month(time).alias("month"), *keys).agg(*aggs)


def store_months(states: DataFrame, base_path: str, name: str, covers: list[dict] | None = None) -> str:
    """Store states; the months present, and those in ``covers`` ({year, month}), are replaced, others stay."""
    return publish({name: (states, MONTH)}, base_path, covers)


def stored_months(spark: SparkSession, base_path: str, name: str) -> DataFrame:
    return read_published(spark, base_path, name)


def _same(keys, left: str = "", right: str = "_k_") -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}")) for k in keys], F.lit(True))


def merge_states(states: DataFrame, variables, keys, sketch: bool = False) -> DataFrame:
    """States of the rows of several states, by ``keys``.

    Counts and means are summed first, deviations then about the common mean, so no precision is lost
    to differences of large squares.
    """
    keys, aggs = list(keys), []
    for v in variables:
        n, mean = F.col(f"n_{v}"), F.col(f"mean_{v}")
        aggs += [F.sum(n).alias(f"n_{v}"), ratio(F.sum(n * mean), F.sum(n)).alias(f"mean_{v}"),
                 F.min(f"min_{v}").alias(f"min_{v}"), F.max(f"max_{v}").alias(f"max_{v}")]
        if sketch:
            aggs.append(F.kll_merge_agg_double(F.when(n > 0, F.col(f"sketch_{v}"))).alias(f"sketch_{v}"))
    total = states.groupBy(*keys).agg(*aggs)
    common = total.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(f"mean_{v}").alias(f"_mean_{v}") for v in variables])
    apart = states.join(common, _same(keys)).groupBy(*keys).agg(*[
        F.sum(F.col(f"m2_{v}") + F.col(f"n_{v}") * (F.col(f"mean_{v}") - F.col(f"_mean_{v}")) ** 2).alias(f"m2_{v}") for v in variables])
    apart = apart.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    columns = [f"{part}_{v}" for v in variables for part in ("n", "mean", "m2", "min", "max", *(["sketch"] if sketch else []))]
    return total.join(apart, _same(keys)).select(*keys, *columns)


def stats_of(states: DataFrame, variables, keys) -> DataFrame:
    """Mean, standard deviation, count, smallest and largest, named as by ``error.region_stats``."""
    out = []
    for v in variables:
        out += [F.col(f"mean_{v}").alias(f"{v}_mean"), F.sqrt(ratio(F.col(f"m2_{v}"), F.col(f"n_{v}"))).alias(f"{v}_std"),
                F.col(f"n_{v}").alias(f"{v}_count"), F.col(f"min_{v}").alias(f"{v}_min"), F.col(f"max_{v}").alias(f"{v}_max")]
    return states.select(*keys, *out)


def merged_stats(states: DataFrame, variables, keys=("region", "season", "z")) -> DataFrame:
    """``error.region_stats`` of all rows behind the states."""
    return stats_of(merge_states(states, variables, keys), variables, keys)


def merged_climatology(states: DataFrame, variables, season_of, keys=("x", "y")) -> DataFrame:
    """Seasonal means over all rows behind monthly states; ``season_of`` gives a month's season."""
    by = ["season", *keys]
    merged = merge_states(states.withColumn("season", season_of("month")), variables, by)
    return merged.select(*by, *[F.col(f"mean_{v}").alias(v) for v in variables])


def sketch_quantiles(states: DataFrame, variable: str, probabilities, keys=("region", "season", "z")) -> DataFrame:
    """(keys, q, value, n): approximate quantiles of all rows behind the states.

    The rank of a value in its group is within ``rank_error`` of q.  The value is one of the
    group's, not an interpolation; ``quantiles.exact_quantiles`` is the exact form.
    """
    merged = states.filter(F.col(f"n_{variable}") > 0).groupBy(*keys).agg(
        F.sum(f"n_{variable}").alias("n"), F.kll_merge_agg_double(f"sketch_{variable}").alias("_sketch"))
    found = F.array(*[F.struct(F.lit(float(p)).alias("q"), F.kll_sketch_get_quantile_double("_sketch", F.lit(float(p))).alias(variable)) for p in probabilities])
    return merged.select(*keys, F.inline(found), "n")
