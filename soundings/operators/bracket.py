"""The neighbours of a position on an axis, for time and for depth.

``bracket`` finds, for every wanted position, the nearest known point at or before it and
at or after it.  The axis is cut into slots, so a long series is spread over many tasks;
each slot receives the last point before it and the first point after it from a summary
with one row per (key, slot).  No pairs are formed and no series is gathered whole.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def bracket(wanted: DataFrame, known: DataFrame, keys: list[str], axis: str, values: list[str],
            slot_width: float) -> DataFrame:
    """Distinct ``keys + [axis]`` of ``wanted`` with structs ``before`` and ``after``.

    ``known`` has one row per (keys, axis).  Both structs hold ``axis`` and ``values``; a
    point exactly at the position is both.  NULL where no such point exists.  Rows
    with NULL keys are left out.

    Wanted and known points travel in one column, so that the slot summary and the search
    need the same columns and share one shuffle: the inputs are computed once.
    """
    slot = F.floor(F.col(axis) / F.lit(slot_width)).cast("long")
    types = {f.name: f.dataType for f in known.schema.fields}
    asked = (
        wanted.filter(F.col(axis).isNotNull()).select(*keys, F.col(axis).cast(types[axis]).alias(axis)).distinct()
        .select(*keys, slot.alias("_slot"), F.struct(
            F.col(axis), *[F.lit(None).cast(types[v]).alias(v) for v in values], F.lit(True).alias("_asked")).alias("_p"))
    )
    given = known.filter(F.col(axis).isNotNull()).select(
        *keys, slot.alias("_slot"), F.struct(F.col(axis), *[F.col(v) for v in values], F.lit(False).alias("_asked")).alias("_p"))
    # Stated here, the filters need not be inferred for the join below on one side only.
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "_slot"]])
    rows = asked.unionByName(given).filter(present).repartition(*keys, "_slot")
    point = F.when(~F.col("_p._asked"), F.col("_p"))

    edges = rows.groupBy(*keys, "_slot").agg(F.min(point).alias("_first"), F.max(point).alias("_last"))
    up = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *keys, "_slot", F.last("_last", ignorenulls=True).over(up).alias("_left"),
        F.last("_first", ignorenulls=True).over(down).alias("_right"))

    here = Window.partitionBy(*keys, "_slot")
    # A descending sort with a growing frame is linear; a frame up to the end of the
    # partition would be quadratic.
    back = here.orderBy("_x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    forth = here.orderBy(F.desc("_x")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("_x", F.col(f"_p.`{axis}`"))
        .withColumn("_b", F.last(point, ignorenulls=True).over(back))
        .withColumn("_a", F.last(point, ignorenulls=True).over(forth))
        .filter("_p._asked").join(carried, [*keys, "_slot"])
        .select(*keys, F.col("_x").alias(axis), F.coalesce("_b", "_left").alias("before"),
                F.coalesce("_a", "_right").alias("after"))
    )


def linear(axis, value: str, before="before", after="after") -> Column:
    """Linear interpolation between the two neighbours; NULL outside their range."""
    x = F.col(axis) if isinstance(axis, str) else axis
    b, a = F.col(before), F.col(after)
    xb, xa = b.getField(axis), a.getField(axis)
    vb, va = b.getField(value), a.getField(value)
    return F.when(xb == xa, vb).otherwise(vb + (va - vb) * F.try_divide((x - xb).cast("double"), (xa - xb).cast("double")))


def nearest_is_before(axis: str, before="before", after="after") -> Column:
    """True where the earlier neighbour is at least as near as the later one."""
    gap_back = F.col(axis) - F.col(before).getField(axis)
    gap_forth = F.col(after).getField(axis) - F.col(axis)
    return F.col(before).isNotNull() & (F.col(after).isNull() | (gap_back <= gap_forth))
