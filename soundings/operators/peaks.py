"""Peaks with a minimum separation, and skew surges."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from soundings.operators.bracket import bracket
from soundings.operators.slots import with_margin
from soundings.operators.timejoin import highest_within, transfer_nearest
from soundings.session import cut_lineage

SLOT_HOURS = 2048


def local_maxima(series: DataFrame, value: str, keys=("port",), time="time", slot_hours: int = SLOT_HOURS) -> DataFrame:
    """(keys, i, time, value) of samples higher than both neighbours.

    A flat top counts once, at its middle (rounded down).  A missing neighbour is no
    neighbour: the sample beside it is not a peak.  ``series`` comes from ``regular_hours``.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys, "_slot").orderBy("i")
    rows = (
        with_margin(series.select(*keys, time, "i", F.col(value).alias("_v")), "i", slot_hours, 1)
        .withColumn("_before", F.lag("_v").over(w)).withColumn("_after", F.lead("_v").over(w))
        .filter("_own").drop("_own", "_slot")
    )
    rises, falls = F.col("_v") > F.col("_before"), F.col("_v") > F.col("_after")
    sharp = rows.filter(rises & falls).select(*keys, "i", time, F.col("_v").alias(value))

    flat_starts = rows.filter(rises & (F.col("_v") == F.col("_after")))
    ends = rows.filter((F.col("_v") == F.col("_before")) & ~F.col("_v").eqNullSafe(F.col("_after"))).select(
        *keys, "i", F.coalesce(falls, F.lit(False)).alias("falls"))
    tops = (
        bracket(flat_starts, ends, keys, "i", ["falls"], slot_hours).filter(F.col("after.falls"))
        .select(*keys, F.floor((F.col("i") + F.col("after.i")) / 2).cast("long").alias("i"))
    )
    flat = series.join(tops, [*keys, "i"]).select(*keys, "i", time, value)
    return sharp.unionByName(flat)


def _settle(columns: list[str], distance: int, slot_hours: int, reach: int):
    """Decide the peaks of one slot, highest first, as far as its margin allows."""

    def settle(batch: pd.DataFrame) -> pd.DataFrame:
        low = int(batch["_slot"].iloc[0]) * slot_hours - reach
        high = low + slot_hours + 2 * reach
        # 0 nothing there, 1 kept, 2 not decidable from here
        state = np.zeros(high - low, dtype=np.int8)
        batch = batch.sort_values(["_v", "i"], ascending=[False, True], kind="stable")
        verdicts = []
        for i, known in zip(batch["i"].to_numpy(), batch["_kept"].to_numpy()):
            at = int(i) - low
            near = state[max(0, at - distance + 1): at + distance]
            if known == 1 or not near.any():
                sure = known == 1 or (at >= distance - 1 and at + distance <= high - low)
                verdict = 1 if sure else 2
            else:
                verdict = 0 if (near == 1).any() else 2
            state[at] = verdict
            verdicts.append(verdict)
        batch["_kept"] = np.array(verdicts, dtype=np.int32)
        return batch.loc[batch["_own"], columns]

    return settle


def separated(peaks: DataFrame, value: str, distance: int, keys=("port",), slot_hours: int = SLOT_HOURS,
              reach: int | None = None) -> DataFrame:
    """Of peaks closer than ``distance`` hours only the highest stay (tie: the earlier).

    Taken from the highest down: a peak stays unless a higher peak that stays is too near.
    The series is cut into slots with a margin of ``reach`` hours.  A verdict that depends
    on something beyond the margin is left open and taken up in a further round, in which
    the peaks already kept count from the start, so the result is the one of the whole
    series.  Each round is written to the shared folder; nearly always there is one.
    """
    keys = list(keys)
    reach = min(slot_hours, 16 * distance) if reach is None else reach
    if reach < distance or slot_hours < reach:
        raise ValueError("need distance <= reach <= slot_hours")
    open_rows = peaks.withColumn("_v", F.col(value).cast("double")).withColumn("_kept", F.lit(2))
    columns = open_rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in open_rows.schema.fields)
    while True:
        settled = cut_lineage(
            with_margin(open_rows, "i", slot_hours, reach).groupBy(*keys, "_slot")
            .applyInPandas(_settle(columns, distance, slot_hours, reach), schema).filter("_kept > 0"))
        if settled.filter("_kept = 2").isEmpty():
            return settled.drop("_v", "_kept")
        open_rows = settled


def find_peaks(series: DataFrame, value: str, distance: int, keys=("port",), time="time") -> DataFrame:
    """Local maxima of a regular series at least ``distance`` hours apart."""
    return separated(local_maxima(series, value, keys, time), value, distance, keys)


def skew_surge(tide_peaks: DataFrame, sea_peaks: DataFrame, keys=("port",), time="time",
               reach_seconds: int = 6 * 3600) -> DataFrame:
    """(keys, time, skew_obs, skew_mod, skew_err) at the observed tidal peaks.

    Skew surge is the highest sea-level peak strictly within ``reach_seconds`` of a tidal
    peak minus that peak.  The model's are carried to the nearest observed peak.  Inputs
    hold both sides: ``source`` (obs, mod), ``time`` and ``tide`` or ``ssh``.
    """
    by = [*keys, "source"]
    both = highest_within(tide_peaks.select(*by, time, "tide"), sea_peaks.select(*by, time, "ssh"), "ssh", by,
                          time, reach_seconds).withColumn("skew", F.col("ssh") - F.col("tide"))
    obs = both.filter("source = 'obs'").select(*keys, time, F.col("skew").alias("skew_obs"))
    mod = both.filter("source = 'mod'").select(*keys, time, F.col("skew").alias("skew_mod"))
    carried = transfer_nearest(mod, obs, "skew_mod", list(keys), time)
    return obs.join(carried, [*keys, time], "left").withColumn("skew_err", F.col("skew_mod") - F.col("skew_obs"))
