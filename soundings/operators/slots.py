"""Cut a long regular series into pieces that carry a margin from their neighbours."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from soundings.functions.scalars import epoch_micros, from_epoch_micros

HOUR_MICROS = 3_600_000_000


def with_margin(df: DataFrame, position: str, width: int, reach: int) -> DataFrame:
    """Adds ``_slot`` and ``_own``; rows within ``reach`` of a slot's edge are copied over.

    A window or a group over (keys, _slot) then sees everything within ``reach`` of its
    own rows and holds at most ``width + 2 * reach`` positions.
    """
    if reach > width:
        raise ValueError("reach must not exceed width")
    slot = F.floor(F.col(position) / F.lit(width)).cast("long")
    offset = F.col(position) - slot * width
    copies = F.array(
        F.struct(slot.alias("_slot"), F.lit(True).alias("_own")),
        F.when(offset < reach, F.struct((slot - 1).alias("_slot"), F.lit(False).alias("_own"))),
        F.when(offset >= width - reach, F.struct((slot + 1).alias("_slot"), F.lit(False).alias("_own"))),
    )
    return (
        df.withColumn("_copy", F.explode(F.array_compact(copies)))
        .withColumn("_slot", F.col("_copy._slot")).withColumn("_own", F.col("_copy._own")).drop("_copy")
    )


def regular_hours(series: DataFrame, keys=("port",), time="time") -> DataFrame:
    """The series on every hour from its first to its last, with its position.

    Adds ``i`` (hours since the first) and ``n`` (hours in all); hours without a row have
    NULL values.  Needs one row per (keys, hour).  A row that is not a whole number of hours after its
    series' first raises an error, as nothing may drop out silently; ``to_hours`` resamples such a series.
    """
    keys = list(keys)
    span = series.groupBy(*keys).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    hours = (
        span.withColumn("_a", epoch_micros("_t0")).withColumn("_b", epoch_micros("_t1"))
        .withColumn("n", F.expr(f"(_b - _a) div {HOUR_MICROS} + 1"))
        # days first, then hours, so that no long array is built
        .withColumn("_day", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 24"))))
        .withColumn("i", F.explode(F.sequence(F.col("_day") * 24, F.least(F.col("_day") * 24 + 23, F.col("n") - 1))))
        .withColumn(time, from_epoch_micros(F.col("_a") + F.col("i") * HOUR_MICROS))
        .select(*keys, time, "i", "n")
    )
    since = epoch_micros(time) - F.col("_a")
    placed = (
        series.join(span.select(*keys, epoch_micros("_t0").alias("_a")), keys)
        .withColumn("i", F.when(since % HOUR_MICROS == 0, F.floor(since / HOUR_MICROS))
                    .otherwise(F.raise_error(F.concat(F.lit("not on a whole hour of its series: "), F.col(time).cast("string"))).cast("long")))
        .drop("_a", time)
    )
    return hours.join(placed, [*keys, "i"], "left").select(*keys, time, "i", "n", *[c for c in series.columns if c not in (*keys, time)])


def to_hours(series: DataFrame, values, keys=("port",), time="time") -> DataFrame:
    """Values averaged over each clock hour (keys, time, values); the hour's beginning is its time."""
    hour = F.date_trunc("hour", time).cast("timestamp_ntz").alias(time)
    return series.groupBy(*keys, hour).agg(*[F.avg(v).alias(v) for v in values])
