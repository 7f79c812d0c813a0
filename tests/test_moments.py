"""Monthly states merge to what the rows together give; sketches stay within their rank error."""
import datetime as dt
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from soundings.functions.scalars import season_of_month
from soundings.operators import error, moments, surface

KEYS = ("region", "season", "z")


def rows(spark, n=4000, seed=1):
    r = random.Random(seed)
    data = [(r.choice(["north", "south", None]), r.choice(["DJF", "JJA"]), r.choice([0, 1, None]), dt.datetime(2003 + r.randint(0, 2), r.randint(1, 12), r.randint(1, 28)),
             None if r.random() < 0.1 else 1e6 + r.gauss(0, 1), r.paretovariate(1.1)) for _ in range(n)]
    data.append(("empty", "DJF", 0, dt.datetime(2003, 1, 1), None, None))
    return spark.createDataFrame(data, "region string, season string, z int, time timestamp_ntz, v double, w double").repartition(6)


def near(got, want, keys):
    index = lambda df: {tuple(r[k] for k in keys): r for r in df.collect()}
    a, b = index(got), index(want)
    assert a.keys() == b.keys()
    for key, row in b.items():
        for name, value in row.asDict().items():
            if name not in keys:
                assert a[key][name] is None if value is None else a[key][name] == pytest.approx(value, rel=1e-9, abs=1e-7), (key, name)


@pytest.mark.parametrize("keys", [KEYS, ("region", "season"), ("region",)])
def test_merged_states_are_the_direct_result(spark, keys):
    """A mean of a million and a deviation of one: large squares would leave no digits."""
    df = rows(spark)
    states = moments.month_states(df, ["v", "w"])
    near(moments.merged_stats(states, ["v", "w"], keys), error.region_stats(df, ["v", "w"], keys), keys)


def test_merging_may_be_done_in_any_steps(spark):
    df = rows(spark)
    states = moments.month_states(df, ["v"], KEYS)
    once = moments.merge_states(states, ["v"], KEYS)
    halves = reduce(lambda a, b: a.unionByName(b), [moments.merge_states(states.filter(c), ["v"], KEYS) for c in ("month <= 6", "month > 6")])
    near(moments.stats_of(moments.merge_states(halves, ["v"], ("region",)), ["v"], ("region",)), error.region_stats(df, ["v"], ("region",)), ("region",))
    assert once.columns == [*KEYS, "n_v", "mean_v", "m2_v", "min_v", "max_v"]


def test_new_and_corrected_months_replace_their_own_states(spark, tmp_path):
    df, base = rows(spark), str(tmp_path / "store")
    first = df.filter("time < '2005-01-01'").withColumn("v", F.when(F.month("time") == 3, -F.col("v")).otherwise(F.col("v")))
    moments.store_months(moments.month_states(first, ["v"]), base, "errors")
    moments.store_months(moments.month_states(df.filter("time >= '2005-01-01' or month(time) = 3"), ["v"]), base, "errors")
    near(moments.merged_stats(moments.stored_months(spark, base, "errors"), ["v"]), error.region_stats(df, ["v"]), KEYS)
    # a month that has no rows any more
    moments.store_months(moments.month_states(df.filter("false"), ["v"]), base, "errors", covers=[{"year": 2003, "month": 3}])
    left = df.filter("not (year(time) = 2003 and month(time) = 3)")
    near(moments.merged_stats(moments.stored_months(spark, base, "errors"), ["v"], ("season",)), error.region_stats(left, ["v"], ("season",)), ("season",))


def test_a_new_month_reads_no_archive(spark, tmp_path):
    """The states of a month come from that month's rows alone."""
    path = str(tmp_path / "archive")
    rows(spark).withColumns({"year": F.year("time"), "month": F.month("time")}).write.partitionBy("year", "month").parquet(path)
    month = spark.read.parquet(path).filter("year = 2004 and month = 5")
    plan = moments.month_states(month.drop("year", "month"), ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(year" in plan


def test_climatology_from_states(spark):
    df = rows(spark).withColumns({"x": F.col("z"), "y": F.lit(1), "month": F.month("time")})
    states = moments.month_states(df, ["v", "w"], ("x", "y"))
    near(moments.merged_climatology(states, ["v", "w"], season_of_month), surface.seasonal_climatology(df, ["v", "w"], ("x", "y")), ("season", "x", "y"))


def test_empty_table(spark):
    states = moments.month_states(rows(spark).filter("false"), ["v"], sketch=64)
    assert moments.merged_stats(states, ["v"]).count() == 0 and moments.sketch_quantiles(states, "v", [0.5]).count() == 0


@pytest.mark.parametrize("k", [200, 1024])
def test_sketch_rank_error_of_a_heavy_tailed_group(spark, k):
    """100,000 values of a Pareto law, a fifth of them equal, dealt to 36 months and merged."""
    r = random.Random(7)
    values = [1.5 if r.random() < 0.2 else r.paretovariate(0.7) for _ in range(100_000)]
    df = spark.createDataFrame([("all", dt.datetime(2003 + i % 3, 1 + i % 12, 1), v) for i, v in enumerate(values)], "region string, time timestamp_ntz, v double")
    states = moments.month_states(df.repartition(8), ["v"], ("region",), sketch=k)
    asked = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    got = moments.sketch_quantiles(states, "v", asked, ("region",)).collect()
    assert len(got) == len(asked) and {x.n for x in got} == {len(values)}
    members = set(values)
    for x in got:
        below, upto = sum(v < x.v for v in values) / len(values), sum(v <= x.v for v in values) / len(values)
        assert below - 2 * moments.rank_error(k) <= x.q <= upto + 2 * moments.rank_error(k) and x.v in members


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([("a", dt.datetime(2003, 1 + i % 12, 1), float(i)) for i in range(101)], "region string, time timestamp_ntz, v double")
    states = moments.month_states(df, ["v"], ("region",), sketch=moments.SKETCH)
    got = {x.q: x.v for x in moments.sketch_quantiles(states, "v", [0.0, 0.5, 1.0], ("region",)).collect()}
    assert got == {0.0: 0.0, 0.5: 50.0, 1.0: 100.0}
    merged = moments.merge_states(states, ["v"], ("region",), sketch=True)
    assert moments.sketch_quantiles(merged, "v", [0.5], ("region",)).first().v == 50.0
