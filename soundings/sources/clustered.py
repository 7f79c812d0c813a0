"""A layout of model fields in which the cells of stations are read without the rest.

Within each month rows are ranged and sorted by a key that runs through the grid along a
space-filling curve (the bits of x and y in turn), so neighbouring cells lie together and a row
group holds a compact patch of the grid.  Cells asked for become a bounded number of key
ranges; statistics of row groups and pages then rule out the patches that hold none of them.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from soundings.schema import TABLES, canonicalise
from soundings.sources.scan import _months

KEY = "cell_key"
#: Bits of x and of y in a key.
BITS = 31


def cell_key(x="x", y="y") -> Column:
    """The bits of x and y (0 to 2**31 - 1) in turn; an error for a cell outside that."""
    def spread(name: str) -> Column:
        v = F.col(name).cast("long")
        v = F.when(v.between(0, 2 ** BITS - 1), v).otherwise(F.raise_error(F.lit(f"{name} has to lie between 0 and 2**31 - 1")).cast("long"))
        for shift in (16, 8, 4, 2, 1):
            # bits move apart by ``shift``; the mask keeps runs of that many, with as many zeros between them
            mask = sum(((1 << shift) - 1) << at for at in range(0, 64, 2 * shift))
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def write_clustered(field: DataFrame, path: str, tasks: int | None = None, row_group_bytes: int = 16 << 20) -> None:
    """Write a field (year, month, x, y, t, ...) in the clustered layout; months present are replaced.

    A month is dealt to as many tasks as its share of the rows asks for, cut by key, so that a file
    holds a range of the curve.  ``tasks`` is the number of files, by default Spark's own choice.
    """
    order = ["year", "month", KEY]
    keyed = field.withColumn(KEY, cell_key())
    ranged = keyed.repartitionByRange(tasks, *order) if tasks else keyed.repartitionByRange(*order)
    (ranged.sortWithinPartitions(*order, "t").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("parquet.block.size", str(row_group_bytes)).partitionBy("year", "month").parquet(path))


def key_ranges(cells: DataFrame, most: int = 128) -> list[tuple[int, int]]:
    """At most ``most`` ranges of keys that together hold the keys of all ``cells`` (x, y).

    Keys are cut to blocks of the curve, as fine as leaves no more than ``most`` of them; only
    their numbers come to the driver.
    """
    keys = cells.select(cell_key().alias(KEY)).distinct()
    steps = list(range(0, 2 * BITS + 1, 2))
    counts = keys.agg(*[F.approx_count_distinct(F.shiftright(KEY, b), 0.02).alias(f"n{b}") for b in steps]).first()
    for b in steps:
        if counts[f"n{b}"] > 1.1 * most:
            continue
        blocks = [r[0] for r in keys.select(F.shiftright(KEY, b)).distinct().limit(most + 1).collect()]
        if len(blocks) <= most:
            break
    ranges: list[list[int]] = []
    for block in sorted(blocks):
        low, high = block << b, ((block + 1) << b) - 1
        if ranges and ranges[-1][1] + 1 == low:
            ranges[-1][1] = high
        else:
            ranges.append([low, high])
    return [tuple(r) for r in ranges]


def scan_cells(spark: SparkSession, table: str, path: str, cells: DataFrame, first: tuple[int, int], last: tuple[int, int],
               run: str | None = None, most: int = 128) -> DataFrame:
    """Rows of a clustered field in the given cells (x, y) and months, as a canonical table.

    The key ranges only spare reading; the cells themselves are matched exactly afterwards.  Without cells there are no rows.
    """
    wanted = cells.select("x", "y").distinct()
    inside = [F.col(KEY).between(a, b) for a, b in key_ranges(wanted, most)]
    df = spark.read.schema(T.StructType([*TABLES[table].fields, T.StructField(KEY, T.LongType())])).parquet(path).filter(_months(first, last))
    df = df.filter(reduce(lambda a, b: a | b, inside, F.lit(False)))
    if run is not None:
        df = df.filter(F.col("run") == run)
    return canonicalise(df.join(wanted, ["x", "y"], "left_semi"), table)
