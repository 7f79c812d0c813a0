"""Two runs: alignment, bias angle, histograms, bootstrap, score changes, stations."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalog.base import query
from catalog.gauges import stats_sql
from soundings.operators import bias as B, compare as P, error as E, spatial as G, tide as A
from soundings.functions import scalars as S
from soundings.plans import bias_angle

KEYS = ("region", "season", "time", "lat", "lon", "z")
N_BOOT, SEED = 1000, 42


def aligned_sql(variable: str) -> str:
    one = lambda r: (f"select region, season, time, lat, lon, z, min(profile_id) as profile_id, arg_min({variable}, profile_id) as v "  # noqa: E731
                     f"from {{profile_error_{r}}} where {variable} is not null group by region, season, time, lat, lon, z")
    return f"select a.region, a.season, a.time, a.lat, a.lon, a.z, a.profile_id, a.v as v0, b.v as v1 from ({one('a')}) a join ({one('b')}) b using (region, season, time, lat, lon, z)"


def aligned(t, variable):
    return B.align_runs(t("profile_error_a"), t("profile_error_b"), [variable], KEYS)


T_DIFF = "diff_temperature"
ALIGNED = aligned_sql(T_DIFF)
ANGLES = f"select *, case when v0 = 0 and v1 = 0 then null else atan2(abs(v0), abs(v1)) end as angle from ({ALIGNED})"


def angles(t):
    return B.with_bias_angle(aligned(t, T_DIFF), T_DIFF)


@query("align_runs_J10", "region:s season:s time:t lat:d lon:d z:int profile_id:long first:d second:d",
       f"select region, season, time, lat, lon, z, profile_id, v0 as first, v1 as second from ({ALIGNED})")
def _(t):
    return aligned(t, T_DIFF).withColumnsRenamed({T_DIFF + "_0": "first", T_DIFF + "_1": "second"})


@query("bias_difference_C03", "region:s season:s n:long change:d", f"""
select region, season, count(*) as n, avg(v0 - v1) as change from ({ALIGNED}) group by region, season""")
def _(t):
    return B.run_difference(aligned(t, T_DIFF), [T_DIFF]).groupBy("region", "season").agg(
        F.count(F.lit(1)).alias("n"), F.avg(T_DIFF + "_change").alias("change"))


W = repr(math.pi / 100)
HALF = repr(math.pi / 2)
BIN = f"cast(least(floor((angle + {HALF}::double) / {W}::double), 99) as int)"


@query("histogram_A29", "region:s season:s bin:int centre:d frequency:long", f"""
select k.region, k.season, k.bin, -{HALF}::double + (k.bin + 0.5E0) * {W}::double as centre, coalesce(h.f, 0) as frequency from
(select region, season, unnest(range(0, 100)) as bin from (select distinct region, season from ({ALIGNED}))) k left join
(select region, season, {BIN} as bin, count(*) as f from ({ANGLES}) where angle is not null group by 1, 2, 3) h on h.region = k.region and h.season = k.season and h.bin = k.bin""")
def _(t):
    return B.histogram(angles(t), "angle", ["region", "season"])


@query("histogram_2d_A30", "region:s season:s bin_0:int bin_1:int frequency:long", f"""
select region, season, cast(least(floor(abs(v0) / 0.05E0), 99) as int) as bin_0, cast(least(floor(abs(v1) / 0.05E0), 99) as int) as bin_1, count(*) as frequency
from ({ALIGNED}) where abs(v0) <= 5 and abs(v1) <= 5 group by 1, 2, 3, 4""")
def _(t):
    return B.histogram_2d(aligned(t, T_DIFF), T_DIFF + "_0", T_DIFF + "_1", ["region", "season"])


def cdf() -> list[float]:
    out, total, p = [], 0.0, math.exp(-1.0)
    for k in range(12):
        total += p
        out.append(total)
        p /= k + 1
    return out


POISSON = " + ".join(f"case when u >= {c!r}::double then 1 else 0 end" for c in cdf())


def mixed(x: str) -> list[str]:
    """Steps that mix a 32-bit word in column ``x`` (a UBIGINT), each from the one before."""
    return [f"(xor({x}, {x} >> 16) * 2246822507) & 4294967295", f"(xor({x}, {x} >> 13) * 3266489909) & 4294967295", f"xor({x}, {x} >> 16)"]


def through(source: str, column: str, *steps: str) -> str:
    """``source`` with ``column`` taken through steps that are written over it."""
    for step in steps:
        source = f"select * replace (cast({step} as ubigint) as {column}) from ({source})"
    return source


def words_sql(source: str) -> str:
    """``source`` (with profile_id) and its words a and b; ids are whole numbers below 2**32."""
    first = f"select *, cast(xor(cast(profile_id as ubigint), {SEED}) as ubigint) as a, cast(profile_id as ubigint) as b from ({source})"
    return through(through(first, "a", *mixed("a")), "b", *mixed("b"))


def uniform_sql(source: str, rep: bool) -> str:
    """``source`` with the words a and b (and rep) and the number u."""
    turned = through(source, "b", "xor(b, ((rep + 1) * 2654435769) & 4294967295)") if rep else source
    turned = through(turned, "b", *mixed("b"))
    turned = through(turned, "a", "xor(a, b)", *mixed("a"))
    return f"select *, cast(a as double) / 4294967296.0E0 as u from ({turned})"


PROFILES = f"select distinct region, season, profile_id from ({ALIGNED})"
REPS = f"(select unnest(range(0, {N_BOOT})) as rep)"
DRAWN = f"select region, season, profile_id, rep, {POISSON} as weight from ({uniform_sql(f'select * from ({words_sql(PROFILES)}) cross join {REPS}', True)})"
MULTI = f"""select a.region, a.season, a.rep, a.angle, d.weight from
(select p.*, q.rep from ({ANGLES}) p cross join (select unnest(range(0, {N_BOOT})) as rep) q where angle is not null) a
join ({DRAWN}) d on d.region = a.region and d.season = a.season and d.profile_id = a.profile_id and d.rep = a.rep where d.weight > 0"""


def drawn(t, method="poisson"):
    a = bias_angle.bias_angles(t("profile_error_a"), t("profile_error_b"), T_DIFF)
    return a, bias_angle.draws_of(a, N_BOOT, SEED, method)


@query("bootstrap_histogram_A31", "region:s season:s rep:int bin:int frequency:long",
       f"select region, season, rep, {BIN} as bin, sum(weight) as frequency from ({MULTI}) group by 1, 2, 3, 4")
def _(t):
    a, w = drawn(t)
    return B.bootstrap_histogram(a, "angle", w)


@query("bootstrap_mean_A31", "region:s season:s rep:int mean:d",
       f"select region, season, rep, sum(angle * weight) / sum(weight) as mean from ({MULTI}) group by 1, 2, 3")
def _(t):
    a, w = drawn(t)
    return B.bootstrap_mean(a, "angle", w)


MEDIAN = f"select region, season, rep, quantile_cont(angle, 0.5) as median from (select region, season, rep, angle, unnest(range(0, cast(weight as bigint))) as k from ({MULTI})) group by 1, 2, 3"


@query("bootstrap_median_A31", "region:s season:s rep:int median:d", MEDIAN)
def _(t):
    a, w = drawn(t)
    return B.bootstrap_median(a, "angle", w)


@query("bootstrap_multinomial_A31", "region:s season:s rep:int draws:long profiles:long checksum:long", f"""
with worded as ({words_sql(PROFILES)}),
numbered as (select w.region, w.season, w.profile_id, w.a, w.b, count(*) over (partition by w.region, w.season) as n,
 row_number() over (partition by w.region, w.season order by cast(floor(u.u * 256) as int), w.profile_id) - 1 as k
 from worded w join ({uniform_sql('select * from worded', False)}) u on u.region = w.region and u.season = w.season and u.profile_id = w.profile_id),
draws as (select region, season, rep, cast(floor(u * n) as bigint) as k from ({uniform_sql(f'select * from numbered cross join {REPS}', True)}))
select d.region, d.season, d.rep, count(*) as draws, count(distinct p.profile_id) as profiles, sum(p.profile_id) as checksum
from draws d join numbered p on p.region = d.region and p.season = d.season and p.k = d.k group by d.region, d.season, d.rep""")
def _(t):
    _, m = drawn(t, "multinomial")
    return m.totals("profile_id").withColumnRenamed("total", "checksum")


QS = "[" + ", ".join(str(q) for q in S.QUANTILES) + "]"
SUMMARY = f"""
select region, season, bin, avg(f) as mean, quantile_cont(f, {QS}) as q from
(select k.region, k.season, k.bin, k.rep, cast(coalesce(h.f, 0) as double) as f from
 (select region, season, bin, rep from (select region, season, unnest(range(0, 100)) as bin from (select distinct region, season from ({ALIGNED}))) cross join (select unnest(range(0, {N_BOOT})) as rep)) k
 left join (select region, season, rep, {BIN} as bin, sum(weight) as f from ({MULTI}) group by 1, 2, 3, 4) h
 on h.region = k.region and h.season = k.season and h.bin = k.bin and h.rep = k.rep) group by region, season, bin"""


@query("bootstrap_summary_A32", "region:s season:s bin:int mean:d q02:d q05:d q25:d q50:d q75:d q95:d q98:d",
       "select region, season, bin, mean, " + ", ".join(f"q[{i + 1}] as {n}" for i, n in enumerate(("q02", "q05", "q25", "q50", "q75", "q95", "q98")))
       + f" from ({SUMMARY})")
def _(t):
    s = bias_angle.bootstrapped_histogram(t("profile_error_a"), t("profile_error_b"), T_DIFF, N_BOOT, SEED)
    return s.select("region", "season", "bin", "mean", *[F.element_at("q", i + 1).alias(n) for i, n in enumerate(("q02", "q05", "q25", "q50", "q75", "q95", "q98"))])


@query("box_summary_A38", "region:s season:s whisker_low:d q1:d median:d q3:d whisker_high:d", f"""
select region, season, quantile_cont(median, 0.02) as whisker_low, quantile_cont(median, 0.25) as q1, quantile_cont(median, 0.5) as median,
       quantile_cont(median, 0.75) as q3, quantile_cont(median, 0.98) as whisker_high from ({MEDIAN}) group by region, season""")
def _(t):
    a, w = drawn(t)
    return B.box_summary(B.summarise_replicates(B.bootstrap_median(a, "angle", w), "median", ["region", "season"], N_BOOT), ["region", "season"])


# ---- scores of two runs -----------------------------------------------------------------
@query("score_change_C01", "port:int season:s corr_change:d abs_std_err_change:d err_std_change:d mae_change:d", f"""
select a.port, a.season, a.ntr_corr - b.ntr_corr as corr_change, abs(b.ssh_std_err) - abs(a.ssh_std_err) as abs_std_err_change,
       b.ntr_err_std - a.ntr_err_std as err_std_change, b.ntr_mae - a.ntr_mae as mae_change
from ({stats_sql('tg_daily_ntr')}) a join ({stats_sql('tg_daily_ntr_b')}) b on a.port = b.port and a.season = b.season""")
def _(t):
    return P.score_change(E.tide_gauge_stats(t("tg_daily_ntr")), E.tide_gauge_stats(t("tg_daily_ntr_b")))


@query("amplitude_change_C02", "port:int constituent:s abs_a_err_change:d", """
select a.port, a.constituent, abs(b.a_err) - abs(a.a_err) as abs_a_err_change from {tide_pair_a} a join {tide_pair_b} b on a.port = b.port and a.constituent = b.constituent""")
def _(t):
    return P.amplitude_change(A.constituent_table(t("tide_fit_a")), A.constituent_table(t("tide_fit_b")))


@query("worst_run_A36", "season:s worst_run:s value:d", """
select season, arg_max(run, m) as worst_run, max(m) as value from
(select 'a' as run, season, avg(abs_diff_temperature) as m from {profile_error_a} group by season union all
 select 'b' as run, season, avg(abs_diff_temperature) as m from {profile_error_b} group by season) group by season""")
def _(t):
    scores = None
    for r in "ab":
        one = t(f"profile_error_{r}").groupBy("season").agg(F.avg("abs_diff_temperature").alias("m")).withColumn("run", F.lit(r))
        scores = one if scores is None else scores.unionByName(one)
    return P.worst_run(scores, "m")


@query("regression_fit_A37", "region:s slope:d intercept:d r2:d n:long", """
select region, regr_slope(temperature_obs, temperature_mod) as slope, regr_intercept(temperature_obs, temperature_mod) as intercept,
       regr_r2(temperature_obs, temperature_mod) as r2, regr_count(temperature_obs, temperature_mod) as n from {profile_pair_a} group by region""")
def _(t):
    return P.linear_fit(t("profile_pair_a"), "temperature_mod", "temperature_obs", ["region"])


@query("unique_stations_A34", "lon:d lat:d first_profile_id:long n:long",
       "select lon, lat, min(profile_id) as first_profile_id, count(*) as n from {profile_header} group by lon, lat")
def _(t):
    return G.unique_stations(t("profile_header"), "profile_id")


DEG = "(pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2))"
MATCHED = f"""select a.port as left_key, first(b.port order by {DEG}, b.port) as right_key, min({DEG}) as distance_sq
from {{station_first}} a cross join {{station_second}} b group by a.port"""


@query("station_matching_J17", "left_key:long right_key:long distance_sq:d", MATCHED)
def _(t):
    return G.match_stations(t("station_first"), t("station_second"))


@query("nearest_station_T03", "right_key:long n:long distance_sq:d",
       f"select right_key, count(*) as n, min(distance_sq) as distance_sq from ({MATCHED}) group by right_key")
def _(t):
    return G.match_stations(t("station_first"), t("station_second")).groupBy("right_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("distance_sq").alias("distance_sq"))
