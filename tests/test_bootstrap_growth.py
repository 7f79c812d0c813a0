"""The bootstrap's rows per task, and what a task holds of the lines, do not grow with the tables."""
import random

import numpy as np
import pandas as pd
import pytest
from catalog import profiles
from catalog.base import Tables
from pyspark.sql import functions as F
from soundings.operators import bias


def angles(spark, n=60):
    rng = random.Random(7)
    rows = [("r" if p % 3 else "s", "DJF", p, rng.uniform(0, 1.5)) for p in range(n) for _ in range(rng.randint(1, 4))]
    return rows, spark.createDataFrame(rows, "region string, season string, profile_id long, angle double")


def test_totals_of_multinomial_draws(spark):
    _, df = angles(spark)
    m = bias.MultinomialDraws(df, 130, 3, ["region", "season"], slots=4)  # more than one chunk of replicates
    told = m.table.groupBy("region", "season", "rep").agg(F.sum("weight").alias("d"), F.count(F.lit(1)).alias("p"), F.sum(F.col("weight") * F.col("profile_id")).alias("t"))
    got = {tuple(r) for r in m.totals("profile_id").select("region", "season", "rep", "draws", "profiles", "total").collect()}
    assert got == {tuple(r) for r in told.collect()} and len(got) == 260
    assert all(r[3] == (40 if r[0] == "r" else 20) for r in got)


def test_totals_send_no_draws(spark, monkeypatch):
    _, df = angles(spark)
    df = df.unionByName(df.limit(1).withColumn("profile_id", F.lit(None).cast("long")))
    m = bias.MultinomialDraws(df, 130, 3, ["region", "season"], slots=4)
    told = lambda: {tuple(r) for r in m.totals("profile_id").select("region", "season", "rep", "draws", "profiles", "total").collect()}
    monkeypatch.setattr(bias, "WHOLE", 30)  # one of the two groups is larger
    between = told()
    monkeypatch.setattr(bias, "WHOLE", 1000)
    monkeypatch.setattr(bias, "PIECE", 7)

    def sent(*args):
        raise AssertionError("draws are sent")
    monkeypatch.setattr(bias, "_numbers_drawn", sent)
    assert told() == between and len(between) == 260 and sum(r[3] for r in between) == 61 * 130


@pytest.mark.parametrize("block", [7, 64, 500])
def test_draws_between_blocks(monkeypatch, block):
    monkeypatch.setattr(bias, "BLOCK", block)
    n, n_boot = 70, 130
    words = np.random.default_rng(1).integers(0, 2 ** 32, (n, 2))
    rows = pd.DataFrame({"_a": words[:, 0], "_b": words[:, 1], "_n": n})
    sent = [bias._numbers_drawn(["g"], n_boot)(("x", b, c), rows[b * block:(b + 1) * block]) for b in range(-(-n // block)) for c in range(2)]
    sent = pd.concat(sent)
    want = np.floor(bias._uniform_numbers(words, n_boot) * n).astype(int)
    got = np.zeros((n_boot, -(-n // block) * block), int)
    for (b, c), part in sent.groupby(["_block", "_chunk"]):
        for rep, weights in bias._weights_drawn(n_boot, part, c):
            got[rep, b * block:(b + 1) * block] += weights
    assert all((got[rep, :n] == np.bincount(want[:, rep], minlength=n)).all() for rep in range(n_boot)) and not got[:, n:].any()


def test_large_units_give_the_same_sums(spark):
    _, df = angles(spark)
    cells = df.groupBy("region", "season", "profile_id", F.floor(F.col("angle") * 4).alias("_cell")).agg(F.count(F.lit(1)).alias("_x"))
    draws = bias.PoissonDraws(30, 3)
    sums = [{tuple(r) for r in draws.add_up(cells, ["region", "season"], unit=1, large=k).collect()} for k in (1, 1000)]
    assert sums[0] == sums[1] and sums[0]


def test_many_cells_are_added_up_in_columns(monkeypatch):
    monkeypatch.setattr(bias, "COLUMNS", 5)
    monkeypatch.setattr(bias, "UNIT", 16)
    rng = np.random.default_rng(2)
    cells = pd.DataFrame({"_id": rng.integers(0, 100, 400), "_cell": rng.integers(0, 23, 400), "_x": rng.integers(1, 9, 400).astype(float)})
    cells[["_a", "_b"]] = np.stack([cells["_id"] * 7919, cells["_id"] * 104729], axis=1)
    got = bias._products(["g"], 20)(("x",), cells)
    weights = bias.poisson_weights(cells[["_a", "_b"]].to_numpy(), 20)
    want = np.zeros((20, 23))
    for k in range(len(cells)):
        want[:, cells["_cell"][k]] += weights[k] * cells["_x"][k]
    assert len(got) == np.count_nonzero(want)
    assert all(want[rep, cell] == w for rep, cell, w in zip(got["rep"], got["_cell"], got["_w"])) and list(got["g"].unique()) == ["x"]


def test_median_repeats_few_values(spark):
    rng = random.Random(8)
    rows = [("r", "DJF", p, rng.uniform(0, 1)) for p in range(1500)] + [("r", "DJF", 2000, 1e6)]  # all but one in one bin
    df = spark.createDataFrame(rows, "region string, season string, profile_id long, angle double")

    class Counted(bias.PoissonDraws):
        def weigh(self, df):
            self.rows = df.count()
            return super().weigh(df)

    draws = Counted(20, 3)
    got = {r.rep: r.median for r in bias.bootstrap_median(df, "angle", draws).collect()}
    weights = bias.PoissonDraws(20, 3).spread(df.select("profile_id")).collect()
    value = {p: v for *_, p, v in rows}
    for rep in range(20):
        assert got[rep] == pytest.approx(np.median([value[r.profile_id] for r in weights if r.rep == rep for _ in range(r.weight)]))
    assert draws.rows < 2000


def test_lines_are_dealt_by_their_number(spark, tmp_path):
    spark.range(600_000).selectExpr("id div 4 as l_orderkey", "cast(id % 4 as double) as l_quantity").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    dealt = Tables(spark, str(tmp_path))("lineitem_dealt")
    assert dealt.rdd.getNumPartitions() == 3 and dealt.count() == 600_000


def test_errors_are_derived_once(spark):
    asked = []

    class Asked(Tables):
        def __call__(self, name):
            asked.append(name)
            return super().__call__(name)

    t = Asked(spark, "/root/testdata/sf0.001")
    errors = profiles.written_errors(t)
    profiles.stored_errors(t, errors=errors)
    assert asked.count("profile_error_a") == 1
