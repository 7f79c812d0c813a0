"""Smoothing and residuals of hourly series."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from soundings.functions.scalars import epoch_micros, from_epoch_micros
from soundings.operators.slots import HOUR_MICROS, with_margin

SLOT_HOURS = 4096


def smoothing_weights(window: int, order: int) -> tuple[list[float], list[list[float]]]:
    """Least-squares polynomial weights: for the centre, and for each leading position.

    The second list gives, for positions 0 .. window//2 - 1, the weights on the first
    ``window`` samples; the trailing positions are its mirror image.
    """
    if window % 2 == 0 or window <= order:
        raise ValueError("window must be odd and larger than the order")
    half = window // 2
    x = np.arange(-half, half + 1, dtype=float) / half
    basis = np.vander(x, order + 1, increasing=True)
    hat = basis @ np.linalg.pinv(basis)
    return hat[half].tolist(), hat[:half].tolist()


def smooth(series: DataFrame, value: str, keys=("port",), window: int = 25, order: int = 3,
           time="time", slot_hours: int = SLOT_HOURS) -> DataFrame:
    """(keys, time, i, value) smoothed by a moving polynomial of ``order``.

    ``series`` comes from ``regular_hours``.  A missing value in the frame gives NULL; the
    first and last half windows are read off the polynomial of the first and last frame.  A
    series shorter than the window keeps its rows, with NULL values.
    """
    keys = list(keys)
    half = window // 2
    centre, leading = smoothing_weights(window, order)
    rows = series.select(*keys, time, "i", "n", F.col(value).alias("_v"))

    w = Window.partitionBy(*keys, "_slot").orderBy("i")
    total = None
    for k, c in enumerate(centre):
        step = k - half
        at = F.col("_v") if step == 0 else (F.lead("_v", step) if step > 0 else F.lag("_v", -step)).over(w)
        total = at * F.lit(c) if total is None else total + at * F.lit(c)
    inner = (
        with_margin(rows, "i", slot_hours, half).withColumn("_s", total)
        .filter(F.col("_own") & (F.col("i") >= half) & (F.col("i") < F.col("n") - half))
        .select(*keys, time, "i", F.col("_s").alias(value))
    )

    # The ends: at most ``window`` rows per series and end, summed against each position's weights.
    micros = epoch_micros(time)
    ends = []
    for name, place in (("head", F.col("i")), ("tail", F.col("n") - 1 - F.col("i"))):
        end = rows.withColumn("_p", place).filter((F.col("_p") < window) & (F.col("n") >= window))
        sums = [F.sum(F.element_at(F.array(*[F.lit(c) for c in row]), F.col("_p").cast("int") + 1) * F.col("_v")) for row in leading]
        fitted = F.when(F.count("_v") == window, F.array(*sums)).otherwise(
            F.array_repeat(F.lit(None).cast("double"), half))
        start = F.min(micros) if name == "head" else F.max(micros)
        step = 1 if name == "head" else -1
        ends.append(
            end.groupBy(*keys).agg(fitted.alias("_fit"), start.alias("_t"), F.max("n").alias("n"))
            .select(*keys, "_t", "n", F.posexplode("_fit").alias("_p", value))
            .select(*keys, from_epoch_micros(F.col("_t") + F.lit(step * HOUR_MICROS) * F.col("_p")).alias(time),
                    (F.col("_p").cast("long") if step == 1 else F.col("n") - 1 - F.col("_p")).alias("i"), value)
        )
    short = rows.filter(F.col("n") < window).select(*keys, time, "i", F.lit(None).cast("double").alias(value))
    return inner.unionByName(ends[0]).unionByName(ends[1]).unionByName(short)


def residual(series: DataFrame, tide: DataFrame, keys=("port",), time="time") -> DataFrame:
    """Non-tidal residual of both sides and its error: ssh - tide, model - observation.

    ``tide`` has tide_obs and tide_mod of the full band on the same times; a time without
    a tide keeps its row, with NULL residuals.
    """
    joined = series.join(tide.select(*keys, time, "tide_obs", "tide_mod"), [*keys, time], "left")
    return with_residual(joined)


def with_residual(df: DataFrame) -> DataFrame:
    """As ``residual`` where tide and sea level already share a row."""
    out = df.withColumn("ntr_obs", F.col("ssh_obs") - F.col("tide_obs")).withColumn(
        "ntr_mod", F.col("ssh_mod") - F.col("tide_mod"))
    return residual_error(out)


def residual_error(df: DataFrame) -> DataFrame:
    d = F.col("ntr_mod") - F.col("ntr_obs")
    return df.withColumns({"ntr_err": d, "ntr_abs_err": F.abs(d), "ntr_square_err": d * d})


def smooth_residual(residuals: DataFrame, keys=("port",), window: int = 25, order: int = 3,
                    time="time") -> DataFrame:
    """Both residuals smoothed alike, with their errors recomputed."""
    both = [smooth(residuals, c, keys, window, order, time) for c in ("ntr_obs", "ntr_mod")]
    return residual_error(both[0].join(both[1].drop("i"), [*keys, time], "left"))
