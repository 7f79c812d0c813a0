"""Bias angle of two runs, bootstrapped by profile, with its summary."""
from __future__ import annotations

from pyspark.sql import DataFrame

from soundings.operators.bias import (MultinomialDraws, PoissonDraws, align_runs, all_bins, bootstrap_histogram,
                                      summarise_replicates, with_bias_angle)
from soundings.session import cut_lineage

GROUP = ["region", "season"]


def bias_angles(first: DataFrame, second: DataFrame, variable: str) -> DataFrame:
    """The angle of every record both runs have, written once: the bootstrap reads it often."""
    aligned = with_bias_angle(align_runs(first, second, [variable]), variable)
    return cut_lineage(aligned.select(*GROUP, "profile_id", "z", "angle"))


def draws_of(angles: DataFrame, n_boot: int = 1000, seed: int = 0, method: str = "poisson"):
    if method == "poisson":
        return PoissonDraws(n_boot, seed)
    if method == "multinomial":
        return MultinomialDraws(angles, n_boot, seed, GROUP)
    raise ValueError(f"unknown method {method!r}")


def bootstrapped_histogram(first: DataFrame, second: DataFrame, variable: str, n_boot: int = 1000, seed: int = 0,
                           bins: int = 100, method: str = "poisson") -> DataFrame:
    """Mean and quantiles over the replicates of the frequency of each angle bin."""
    angles = bias_angles(first, second, variable)
    per_rep = cut_lineage(bootstrap_histogram(angles, "angle", draws_of(angles, n_boot, seed, method), GROUP, n=bins))  # read twice below
    return summarise_replicates(per_rep, "frequency", [*GROUP, "bin"], n_boot, all_bins(angles, GROUP, bins))
