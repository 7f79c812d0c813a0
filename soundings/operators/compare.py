"""Comparing two model runs."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def score_change(first: DataFrame, second: DataFrame, keys=("port", "season")) -> DataFrame:
    """Change of the station scores; positive correlation change favours the first run."""
    names = ["ntr_corr", "ssh_std_err", "ntr_err_std", "ntr_mae"]
    one = first.select(*keys, *[F.col(c).alias(c + "_1") for c in names])
    two = second.select(*keys, *[F.col(c).alias(c + "_2") for c in names])
    return one.join(two, list(keys)).select(
        *keys, (F.col("ntr_corr_1") - F.col("ntr_corr_2")).alias("corr_change"),
        (F.abs("ssh_std_err_2") - F.abs("ssh_std_err_1")).alias("abs_std_err_change"),
        (F.col("ntr_err_std_2") - F.col("ntr_err_std_1")).alias("err_std_change"),
        (F.col("ntr_mae_2") - F.col("ntr_mae_1")).alias("mae_change"))


def amplitude_change(first: DataFrame, second: DataFrame, keys=("port", "constituent")) -> DataFrame:
    """|amplitude error| of the second run minus that of the first."""
    return first.select(*keys, F.col("a_err").alias("_1")).join(
        second.select(*keys, F.col("a_err").alias("_2")), list(keys)).select(
        *keys, (F.abs("_2") - F.abs("_1")).alias("abs_a_err_change"))


def worst_run(scores: DataFrame, value: str, keys=("season",), run="run") -> DataFrame:
    """The run with the largest value per key (tie: first by name); NULL is skipped."""
    best = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col(value)).alias("_v"), F.col(run).alias("_r"))))
    return scores.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b._r").alias("worst_run"), (-F.col("_b._v")).alias("value"))


def linear_fit(df: DataFrame, x: str, y: str, keys=()) -> DataFrame:
    """Least-squares line of y on x."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
