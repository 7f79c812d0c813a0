"""Exact quantiles and weighted order statistics without gathering a group.

Spark's exact ``percentile`` keeps every distinct value of a group in one task.  Here the
range of each group is cut into equal bins, the bin of every wanted rank is found from the
bin counts, and only those bins are looked at more closely, twice; the few values left are
ranked directly.  Each step is an ordinary aggregate with partial sums before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from soundings.session import cut_lineage

BINS = 512


def _bin(value: Column, low: Column, high: Column, n: int) -> Column:
    part = F.try_divide(value - low, high - low) * n
    return F.coalesce(F.least(F.floor(part), F.lit(n - 1)), F.lit(0)).cast("int")


def _locate(binned: DataFrame, by: list[str], targets: DataFrame, on: list[str], part: str) -> DataFrame:
    """The part holding each wanted rank, with the rank left to find inside it."""
    w = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = binned.withColumn("_upto", F.sum("_w").over(w)).withColumn("_before", F.col("_upto") - F.col("_w"))
    return (
        targets.join(upto, on)
        .filter((F.col("_rest") >= F.col("_before")) & (F.col("_rest") < F.col("_upto")))
        .withColumn("_rest", F.col("_rest") - F.col("_before")).drop("_before", "_upto", "_w")
    )


def select_ranks(df: DataFrame, keys: list[str], value: str, ranks: DataFrame, weight: str | None = None,
                 bins: int = BINS) -> DataFrame:
    """(keys, rank, value): the value at each 0-based rank of its group.

    ``ranks`` has the keys and ``rank`` (BIGINT), at most a handful per group.  With
    ``weight`` (a whole number) a value counts that many times.
    """
    w = F.col(weight) if weight else F.lit(1)
    rows = df.select(*keys, F.col(value).alias("_v"), w.cast("long").alias("_wt")).filter(
        F.col("_v").isNotNull() & (F.col("_wt") > 0))

    def count_parts(data, by, part):
        return data.groupBy(*by, part).agg(
            F.sum("_wt").alias("_w"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))

    def place(data, part):
        return data.withColumn(part, _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins)).drop("_lo", "_hi")

    # Ranges and hits hold a few rows per group; written, they keep the input at four readings.
    ends = cut_lineage(rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    level1 = place(rows.join(ends, keys), "_b1")
    todo = ranks.select(*keys, "rank").distinct().withColumn("_rest", F.col("rank"))
    hit1 = cut_lineage(_locate(count_parts(level1, keys, "_b1"), keys, todo, keys, "_b1"))

    by1 = [*keys, "_b1"]
    level2 = place(level1.join(hit1.select(*by1, "_lo", "_hi").distinct(), by1), "_b2")
    hit2 = cut_lineage(_locate(count_parts(level2, by1, "_b2"), by1, hit1.drop("_lo", "_hi"), by1, "_b2").drop("_lo", "_hi"))

    by2 = [*by1, "_b2"]
    last = level2.join(hit2.select(*by2).distinct(), by2).groupBy(*by2, "_v").agg(F.sum("_wt").alias("_w"))
    hit3 = _locate(last, by2, hit2, by2, "_v")
    return hit3.select(*keys, "rank", F.col("_v").alias(value))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities, weight: str | None = None,
                    bins: int = BINS) -> DataFrame:
    """(keys, q, value, n): linear interpolation between order statistics, NULL skipped.

    ``n`` is the number (weight) of values in the group.  The input is read once per step,
    so one that is costly to derive is better written (or ``cut_lineage``) first.
    """
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    counted = df.filter(F.col(value).isNotNull() & (w > 0)).groupBy(*keys).agg(F.sum(w).alias("n"))
    position = (F.col("n") - 1) * F.col("q")
    asked = (
        counted.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("_k", F.floor(position).cast("long")).withColumn("_part", position - F.col("_k"))
    )
    pair = asked.select(*keys, "q", "n", "_part", F.inline(F.array(
        F.struct(F.col("_k").alias("rank"), F.lit(False).alias("upper")),
        F.struct(F.least(F.col("_k") + 1, F.col("n") - 1).alias("rank"), F.lit(True).alias("upper")))))
    got = select_ranks(df, keys, value, pair.select(*keys, "rank"), weight, bins)
    low = F.max(F.when(~F.col("upper"), F.col(value)))
    high = F.max(F.when(F.col("upper"), F.col(value)))
    return (
        pair.join(got, [*keys, "rank"]).groupBy(*keys, "q", "n")
        .agg(low.alias("_low"), high.alias("_high"), F.max("_part").alias("_part"))
        .select(*keys, "q", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(value), "n")
    )


def region_quantiles(df: DataFrame, variable: str, probabilities, keys=("region", "season"), z="z") -> DataFrame:
    """Quantiles per level and over all levels (z NULL): (keys, z, variable, q, value, n).

    Every value counts for its level and for "all"; both are found in the same passes over
    the three columns needed, which are written once.
    """
    every = -1  # levels are numbered from 0
    narrow = cut_lineage(df.filter(F.col(variable).isNotNull()).select(*keys, z, variable))
    twice = narrow.withColumn(z, F.explode(F.array(F.col(z).cast("int"), F.lit(every))))
    return exact_quantiles(twice, [*keys, z], variable, probabilities).select(
        *keys, F.when(F.col(z) != every, F.col(z)).alias(z), F.lit(variable).alias("variable"), "q",
        F.col(variable).alias("value"), "n")
