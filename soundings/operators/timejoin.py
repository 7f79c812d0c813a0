"""Joins on time: nearest, linear, transfer to other times, and a range maximum."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from soundings.functions.scalars import epoch_micros, from_epoch_micros
from soundings.operators.bracket import bracket, linear, nearest_is_before

DAY = 86_400
MICROS = 1_000_000


def nearest_time(obs: DataFrame, model_times: DataFrame, time="time", model_time="t",
                 keys: list[str] | None = None, slot_seconds: int | None = None) -> DataFrame:
    """``obs`` with the nearest model time and ``interp_lag_s`` = model time - obs time.

    Ties take the earlier time.  Only the distinct times take part in the search, in slots of
    a month for each of ``keys``, or of a day where all share one axis.
    """
    by = keys or ["_all"]
    slot_seconds = slot_seconds or (30 * DAY if keys else DAY)
    one = {} if keys else {"_all": F.lit(0)}
    wanted = obs.select(*(keys or []), time).distinct().withColumns(one).withColumn("s", epoch_micros(time))
    known = (
        model_times.select(*(keys or []), model_time).distinct().withColumns(one)
        .withColumn("s", epoch_micros(model_time)).select(*by, "s")
    )
    found = (
        bracket(wanted, known, by, "s", [], slot_seconds * MICROS)
        .withColumn("_m", F.when(nearest_is_before("s"), F.col("before.s")).otherwise(F.col("after.s")))
        .select(*(keys or []), from_epoch_micros("s").alias(time),
                from_epoch_micros("_m").alias(model_time), F.expr("(_m - s) div 1000000").alias("interp_lag_s"))
    )
    return obs.join(found, [*(keys or []), time], "left")


def interpolate_in_time(series: DataFrame, targets: DataFrame, value: str, keys: list[str],
                        time="time", slot_seconds: int = 30 * DAY) -> DataFrame:
    """``value`` at the target times, linear between neighbours, NULL outside the range.

    ``targets`` has the keys and ``time``; missing values of the series are skipped.
    """
    known = (
        series.filter(F.col(value).isNotNull()).groupBy(*keys, time).agg(F.avg(value).alias(value))
        .withColumn("s", epoch_micros(time))
    )
    wanted = targets.select(*keys, time).distinct().withColumn("s", epoch_micros(time))
    return bracket(wanted, known, keys, "s", [value], slot_seconds * MICROS).select(
        *keys, from_epoch_micros("s").alias(time), linear("s", value).alias(value)
    )


def transfer_nearest(source: DataFrame, targets: DataFrame, value: str, keys: list[str],
                     time="time", slot_seconds: int = 30 * DAY) -> DataFrame:
    """``value`` of the nearest source time (tie: earlier); NULL outside the source's range."""
    known = source.withColumn("s", epoch_micros(time)).groupBy(*keys, "s").agg(F.max(value).alias(value))
    wanted = targets.select(*keys, time).distinct().withColumn("s", epoch_micros(time))
    inside = F.col("before").isNotNull() & F.col("after").isNotNull()
    near = F.when(nearest_is_before("s"), F.col("before").getField(value)).otherwise(
        F.col("after").getField(value)
    )
    return bracket(wanted, known, keys, "s", [value], slot_seconds * MICROS).select(
        *keys, from_epoch_micros("s").alias(time), F.when(inside, near).alias(value)
    )


def highest_within(anchors: DataFrame, others: DataFrame, value: str, keys: list[str],
                   time="time", reach_seconds: int = 6 * 3600) -> DataFrame:
    """Largest ``value`` of ``others`` strictly less than ``reach_seconds`` from each anchor.

    An equi-join on time slots as wide as the reach; an anchor looks into three of them.
    """
    reach = reach_seconds * MICROS
    left = (
        anchors.select(*keys, time).distinct().withColumn("_s", epoch_micros(time))
        .withColumn("_slot", F.explode(F.array(*[F.floor(F.col("_s") / reach) + d for d in (-1, 0, 1)])))
    )
    right = (
        others.select(*keys, F.col(time).alias("_t"), F.col(value)).withColumn("_o", epoch_micros("_t"))
        .withColumn("_slot", F.floor(F.col("_o") / reach)).drop("_t")
    )
    best = (
        left.join(right, [*keys, "_slot"])
        .filter(F.abs(F.col("_s") - F.col("_o")) < reach)
        .groupBy(*keys, time).agg(F.max(value).alias(value))
    )
    return anchors.join(best, [*keys, time], "left")
