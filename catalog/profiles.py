"""Matchup, interpolation, depth averages, regions and their statistics, surface maps."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import query, season_sql
from catalog.cleaning import HAVERSINE, nearest_sql
from soundings.functions import scalars as S
from soundings.operators import (clean as C, error as E, matchup as M, moments as N, quantiles as Q, spatial as G,
                                 surface as U, timejoin as T, vertical as V)
from soundings.plans import profile_validation, surface_crps
from soundings.session import cut_lineage, stage_path
from soundings.sources import scan, sink

VARS = ["temperature", "salinity"]
RADIUS = 60.0
LAG = 16 * 86400
MATCH_SQL = f"""
select h.profile_id, h.time, n.x, n.y, n.dist as interp_dist_km, m.t, cast((epoch_us(m.t) - epoch_us(h.time)) // 1000000 as bigint) as interp_lag_s
from {{profile_header}} h join ({nearest_sql('profile_header', RADIUS)}) n on h.lon = n.lon and h.lat = n.lat
join (select d.time, first(f.t order by abs(epoch_us(f.t) - epoch_us(d.time)), f.t) as t from (select distinct time from {{profile_header}}) d
      cross join (select distinct t from {{grid_field}}) f group by d.time) m on m.time = h.time
where abs(epoch_us(m.t) - epoch_us(h.time)) <= {LAG}000000"""


def matchup(t):
    return cut_lineage(
        M.match_profiles(t("profile_header"), t("grid_cell"), t("grid_field").select("t").distinct(), RADIUS, LAG))


# ---- matchup ----------------------------------------------------------------------------
@query("nearest_sea_cell_J01", "profile_id:long x:int y:int interp_dist_km:d", f"""
select h.profile_id, n.x, n.y, n.dist as interp_dist_km from {{profile_header}} h
join ({nearest_sql('profile_header', RADIUS)}) n on h.lon = n.lon and h.lat = n.lat""")
def _(t):
    return G.nearest_cell(t("profile_header"), t("grid_cell"), RADIUS)


@query("great_circle_distance_J02", "profile_id:long km:d", """
select profile_id, 2 * 6371.0E0 * asin(sqrt(least(1.0E0, pow(sin(radians(52.0E0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(52.0E0))
* pow(sin(radians(-4.0E0 - lon) / 2), 2)))) as km from {profile_header}""")
def _(t):
    return t("profile_header").withColumn("km", S.great_circle_km("lon", "lat", F.lit(-4.0), F.lit(52.0)))


@query("nearest_time_J03", "profile_id:long t:t interp_lag_s:long", """
select h.profile_id, m.t, cast((epoch_us(m.t) - epoch_us(h.time)) // 1000000 as bigint) as interp_lag_s from {profile_header} h
join (select d.time, first(f.t order by abs(epoch_us(f.t) - epoch_us(d.time)), f.t) as t from (select distinct time from {profile_header}) d
      cross join (select distinct t from {grid_field}) f group by d.time) m on m.time = h.time""")
def _(t):
    return T.nearest_time(t("profile_header"), t("grid_field").select("t").distinct())


@query("linear_time_interpolation_J04", "port:int time:t ssh:d", """
with k as (select port, time, ssh_obs as v from {tg_extract} where ssh_obs is not null),
g as (select port, unnest(generate_series(min(time) - interval 90 minute, max(time) + interval 1 hour, interval 90 minute)) as time from {tg_extract} group by port),
b as (select g.port, g.time, p.time as tb, p.v as vb, n.time as ta, n.v as va from g asof left join k p on g.port = p.port and g.time >= p.time
      asof left join k n on g.port = n.port and g.time <= n.time)
select port, time, case when ta = tb then vb else vb + (va - vb) * (cast(epoch_us(time) - epoch_us(tb) as double) / cast(epoch_us(ta) - epoch_us(tb) as double)) end as ssh from b""")
def _(t):
    e = t("tg_extract")
    targets = e.groupBy("port").agg(F.min("time").alias("a"), F.max("time").alias("b")).select(
        "port", F.explode(F.expr("sequence(a - interval 90 minute, b + interval 1 hour, interval 90 minute)")).alias("time"))
    return T.interpolate_in_time(e.withColumnRenamed("ssh_obs", "ssh"), targets, "ssh", ["port"])


@query("model_column_J05", "profile_id:long z:int depth:d temperature:d salinity:d", f"""
select m.profile_id, f.z, f.depth, f.temperature, f.salinity from ({MATCH_SQL}) m join {{grid_field}} f on f.x = m.x and f.y = m.y and f.t = m.t""")
def _(t):
    return M.model_columns(matchup(t), t("grid_field"), VARS)


@query("model_ssh_series_J05", "port:int time:t ssh:d", f"""
select s.port, g.t as time, g.ssh from (select s.port, n.x, n.y from {{tg_station}} s join ({nearest_sql('tg_station', RADIUS)}) n on s.lon = n.lon and s.lat = n.lat) s
join {{grid_ssh}} g on g.x = s.x and g.y = s.y""")
def _(t):
    return M.model_series(G.nearest_cell(t("tg_station"), t("grid_cell"), RADIUS), t("grid_ssh"))


@query("distance_filter_P06", "profile_id:long interp_dist_km:d", f"""
select h.profile_id, n.dist as interp_dist_km from {{profile_header}} h join ({nearest_sql('profile_header', RADIUS)}) n on h.lon = n.lon and h.lat = n.lat where n.dist < 25""")
def _(t):
    return C.within_distance(G.nearest_cell(t("profile_header"), t("grid_cell"), RADIUS), 25.0, inclusive=False)


@query("lag_filter_P07", "profile_id:long interp_lag_s:long", f"select profile_id, interp_lag_s from ({MATCH_SQL}) where abs(interp_lag_s) <= 432000")
def _(t):
    return C.within_lag(matchup(t), 432_000)


@query("drop_audit_A39", "n_all:long n_too_far:long n_too_late:long n_kept:long", f"""
select count(*) as n_all, count(*) filter (interp_dist_km > 30) as n_too_far, count(*) filter (interp_dist_km <= 30 and abs(interp_lag_s) > 432000) as n_too_late,
       count(*) filter (interp_dist_km <= 30 and abs(interp_lag_s) <= 432000) as n_kept from ({MATCH_SQL})""")
def _(t):
    return C.drop_audit(matchup(t), 30.0, 432_000)


@query("observed_audit_A39", "n_all:long n_too_far:long n_too_late:long n_kept:long n_rows:long", f"""
select count(*) as n_all, count(*) filter (interp_dist_km > 30) as n_too_far, count(*) filter (interp_dist_km <= 30 and abs(interp_lag_s) > 432000) as n_too_late,
       count(*) filter (interp_dist_km <= 30 and abs(interp_lag_s) <= 432000) as n_kept, count(*) filter (interp_dist_km <= 30 and abs(interp_lag_s) <= 432000) as n_rows from ({MATCH_SQL})""")
def _(t):
    near = G.nearest_cell(t("profile_header"), t("grid_cell"), RADIUS)
    timed = T.nearest_time(near, t("grid_field").select("t").distinct())
    kept, audit = C.observe_audit(timed.filter(F.abs(F.col("interp_lag_s")) <= LAG), 30.0, 432_000)
    kept = cut_lineage(kept)  # the write that a chain makes anyway; its counts come along
    return kept.agg(F.count(F.lit(1)).alias("n_rows")).withColumns({name: F.lit(n) for name, n in audit.get.items()})


@query("radius_neighbourhood_J07", "lon:d lat:d x:int y:int land:b dist_km:d", f"""
select p.lon, p.lat, c.x, c.y, c.bottom_level = 0 as land, {HAVERSINE} as dist_km from (select distinct lon, lat from {{profile_header}}) p
join {{grid_cell}} c on abs(p.lat - c.lat) < 0.6 where {HAVERSINE} <= {RADIUS}""")
def _(t):
    return G.neighbourhood(t("profile_header"), t("grid_cell"), RADIUS)


# ---- vertical ---------------------------------------------------------------------------
def interp_sql(source: str, variable: str, extra: str = "") -> str:
    return f"""
select profile_id, z, depth, case when da = depth then va else va + (vb - va) * ((depth - da) / nullif(db - da, 0)) end as {variable} from
(select s.profile_id, r.z, r.depth, max(s.depth) filter (s.depth <= r.depth) as da, arg_max(s.{variable}, s.depth) filter (s.depth <= r.depth) as va,
        min(s.depth) filter (s.depth >= r.depth) as db, arg_min(s.{variable}, s.depth) filter (s.depth >= r.depth) as vb
 from {{{source}}} s cross join (select * from {{ref_depth}} where depth <= 50) r where s.{variable} is not null {extra} group by s.profile_id, r.z, r.depth)
where da is not null and db is not null"""


def interp_both(source: str) -> str:
    return (f"select coalesce(a.profile_id, b.profile_id) as profile_id, coalesce(a.z, b.z) as z, coalesce(a.depth, b.depth) as depth, a.temperature, b.salinity "
            f"from ({interp_sql(source, 'temperature')}) a full join ({interp_sql(source, 'salinity')}) b on a.profile_id = b.profile_id and a.z = b.z")


@query("vertical_interpolation_W01", "profile_id:long z:int depth:d temperature:d salinity:d", interp_both("profile_level"))
def _(t):
    return V.interpolate_to_depths(t("profile_level"), VARS)


@query("model_to_obs_depths_W01", "profile_id:long depth:d temperature:d", f"""
with f as (select m.profile_id, f.depth, f.temperature from ({MATCH_SQL}) m join {{grid_field}} f on f.x = m.x and f.y = m.y and f.t = m.t where f.temperature is not null)
select profile_id, depth, case when da = depth then va else va + (vb - va) * ((depth - da) / nullif(db - da, 0)) end as temperature from
(select r.profile_id, r.depth, max(f.depth) filter (f.depth <= r.depth) as da, arg_max(f.temperature, f.depth) filter (f.depth <= r.depth) as va,
        min(f.depth) filter (f.depth >= r.depth) as db, arg_min(f.temperature, f.depth) filter (f.depth >= r.depth) as vb
 from {{profile_level}} r join ({MATCH_SQL}) m on m.profile_id = r.profile_id left join f on f.profile_id = r.profile_id group by r.profile_id, r.depth)""")
def _(t):
    m = matchup(t)
    targets = t("profile_level").join(m.select("profile_id"), "profile_id", "left_semi")
    return V.interpolate_to_levels(M.model_columns(m, t("grid_field"), VARS), targets, ["temperature"])


REF = f"({interp_both('profile_level')})"
REF_W = f"(select i.*, r.thickness from {REF} i join {{ref_depth}} r on r.z = i.z)"


def ref_levels(t):
    return V.with_thickness(V.interpolate_to_depths(t("profile_level"), VARS))


@query("layer_thickness_W10", "profile_id:long z:int depth:d thickness:d", f"""
select profile_id, z, depth, coalesce((n1 - p1) / 2, case when p1 is null then (n2 - depth) / 2 else (depth - p2) / 2 end) as thickness from
(select profile_id, z, depth, lag(depth) over w as p1, lag(depth, 2) over w as p2, lead(depth) over w as n1, lead(depth, 2) over w as n2
 from {REF} window w as (partition by profile_id order by depth))""")
def _(t):
    return V.own_thickness(V.interpolate_to_depths(t("profile_level"), VARS))


def wmean(v: str) -> str:
    return f"sum({v} * thickness) / nullif(sum(case when {v} is not null then thickness end), 0) as {v}"


@query("depth_band_mean_A03", "band:s profile_id:long temperature:d salinity:d", " union all ".join(
    f"select '{b}' as band, profile_id, {wmean('temperature')}, {wmean('salinity')} from {REF_W} where depth between {lo} and {hi} group by profile_id"
    for b, lo, hi in (("surface", 0, 5), ("mid", 20, 35))))
def _(t):
    levels = ref_levels(t)
    return V.band_mean(levels, VARS, 0.0, 5.0).withColumn("band", F.lit("surface")).unionByName(
        V.band_mean(levels, VARS, 20.0, 35.0).withColumn("band", F.lit("mid")))


@query("bottom_mean_A04", "profile_id:long temperature:d salinity:d bathymetry:d", f"""
select profile_id, {wmean('temperature')}, {wmean('salinity')}, max(bathymetry) as bathymetry from
(select i.*, 20.0E0 + h.lat / 3.0E0 as bathymetry, case when 20.0E0 + h.lat / 3.0E0 < 37.0E0 then 5.0E0 when 20.0E0 + h.lat / 3.0E0 < 39.0E0 then 8.0E0 else 12.0E0 end as hh
 from {REF_W} i join {{profile_header}} h on h.profile_id = i.profile_id) where depth between bathymetry - hh and bathymetry group by profile_id""")
def _(t):
    bed = t("profile_header").withColumn("bathymetry", F.lit(20.0) + F.col("lat") / 3.0).select("profile_id", "bathymetry")
    return V.bottom_mean(ref_levels(t).join(bed, "profile_id"), VARS, (5.0, 8.0, 12.0), (37.0, 39.0, float("inf")))


@query("surface_field_mean_A05", "x:int y:int t:t temperature:d salinity:d", """
select x, y, t, avg(temperature) as temperature, avg(salinity) as salinity from {grid_field} where depth <= 5 group by x, y, t""")
def _(t):
    return U.surface_mean(t("grid_field"), VARS)


@query("thickness_weighted_mean_A06", "profile_id:long temperature:d salinity:d",
       f"select profile_id, {wmean('temperature')}, {wmean('salinity')} from {REF_W} group by profile_id")
def _(t):
    return V.depth_mean(ref_levels(t), VARS)


@query("two_level_mean_A28", "profile_id:long temperature:d", """
with p as (select profile_id, arg_min(temperature, abs(depth - 0) * 1000 - depth / 1000) as a, arg_min(temperature, abs(depth - 5) * 1000 - depth / 1000) as b
           from (select profile_id, depth, temperature from {profile_model_a}) group by profile_id)
select profile_id, (a + b) / 2 as temperature from p""")
def _(t):
    return V.two_level_mean(t("profile_model_a"), ["temperature"])


REDUCED = f"""
select c.first_id, c.x, c.y, c.t, coalesce(o.z, m.z) as z, c.grid_n, o.temperature_obs, m.temperature as temperature_mod from
(select x, y, t, min(profile_id) as first_id, count(distinct profile_id) as grid_n from mm group by x, y, t) c join
((select mm.x, mm.y, mm.t, o.z, avg(o.temperature) as temperature_obs from {{profile_level}} o join mm on mm.profile_id = o.profile_id group by mm.x, mm.y, mm.t, o.z) o
 full join (select mm.x, mm.y, mm.t, a.z, a.temperature from {{profile_model_a}} a join mm on mm.profile_id = a.profile_id
            where a.profile_id in (select min(profile_id) from mm group by x, y, t)) m on o.x = m.x and o.y = m.y and o.t = m.t and o.z = m.z)
on c.x = coalesce(o.x, m.x) and c.y = coalesce(o.y, m.y) and c.t = coalesce(o.t, m.t)"""


@query("reduce_resolution_A01", "first_id:long x:int y:int t:t z:int grid_n:long temperature_obs:d temperature_mod:d",
       f"with mm as ({MATCH_SQL}) {REDUCED}")
def _(t):
    return M.reduce_resolution(matchup(t), t("profile_level"), t("profile_model_a"), ["temperature"])


# ---- errors and regions -----------------------------------------------------------------
@query("difference_A02", "profile_id:long z:int diff_temperature:d abs_diff_temperature:d square_diff_temperature:d diff_salinity:d", """
select profile_id, z, temperature_obs - temperature_mod as diff_temperature, abs(temperature_obs - temperature_mod) as abs_diff_temperature,
       pow(temperature_obs - temperature_mod, 2) as square_diff_temperature, salinity_obs - salinity_mod as diff_salinity from {profile_pair_a}""")
def _(t):
    return E.difference(t("profile_pair_a"), VARS, sign=-1)


@query("region_means_A07", "region:s season:s z:int level_set:s mean_diff_temperature:d mean_abs_diff_salinity:d mean_bathymetry:d n:long", """
select region, season, z, case when grouping(z) = 0 then 'profile' else 'all' end as level_set, avg(diff_temperature) as mean_diff_temperature,
       avg(abs_diff_salinity) as mean_abs_diff_salinity, avg(bathymetry) as mean_bathymetry, count(*) as n
from {profile_error_a} group by grouping sets ((region, season, z), (region, season))""")
def _(t):
    return E.region_means(t("profile_error_a"), ["diff_temperature", "abs_diff_salinity", "bathymetry"])


@query("region_stats_A08", "region:s season:s z:int diff_temperature_mean:d diff_temperature_std:d diff_temperature_count:long diff_temperature_min:d diff_temperature_max:d", """
select region, season, z, avg(diff_temperature) as diff_temperature_mean, stddev_pop(diff_temperature) as diff_temperature_std, count(diff_temperature) as diff_temperature_count,
       min(diff_temperature) as diff_temperature_min, max(diff_temperature) as diff_temperature_max from {profile_error_a} group by region, season, z""")
def _(t):
    return E.region_stats(t("profile_error_a"), ["diff_temperature"])


def written_errors(t):
    """Errors by time and place of a profile, written once for those who read them several times."""
    return cut_lineage(t("profile_error_a").select("region", "season", "z", "time", "diff_temperature", "diff_salinity"))


def stored_errors(t, sketch=None, errors=None):
    """Monthly states of the errors: all but the last year in one publication, the last year and a correction in another."""
    errors = written_errors(t) if errors is None else errors
    base, late = stage_path(t.spark, uuid.uuid4().hex), F.col("time") >= F.lit("1998-01-01").cast("timestamp_ntz")
    states = lambda rows: N.month_states(rows, ["diff_temperature", "diff_salinity"], sketch=sketch)
    early = errors.filter(~late)
    # a month stored with wrong values first, and put right by the second publication
    wrong = early.withColumn("diff_temperature", F.when((F.year("time") == 1997) & (F.month("time") == 5), 1e6).otherwise(F.col("diff_temperature")))
    N.store_months(states(wrong), base, "errors")
    N.store_months(states(errors.filter(late | ((F.year("time") == 1997) & (F.month("time") == 5)))), base, "errors")
    return N.stored_months(t.spark, base, "errors")


@query("incremental_region_stats_A08", "region:s season:s z:int diff_temperature_mean:d diff_temperature_std:d diff_temperature_count:long diff_temperature_min:d diff_temperature_max:d", """
select region, season, z, avg(diff_temperature) as diff_temperature_mean, stddev_pop(diff_temperature) as diff_temperature_std, count(diff_temperature) as diff_temperature_count,
       min(diff_temperature) as diff_temperature_min, max(diff_temperature) as diff_temperature_max from {profile_error_a} group by region, season, z""")
def _(t):
    return N.merged_stats(stored_errors(t), ["diff_temperature"])


@query("incremental_std_A09", "region:s season:s std:d", """
select region, season, stddev_pop(diff_temperature) as std from {profile_error_a} group by region, season""")
def _(t):
    return N.merged_stats(stored_errors(t), ["diff_temperature"], ("region", "season")).withColumnRenamed("diff_temperature_std", "std")


@query("incremental_seasons_A12", "region:s season:s mean:d std:d", """
select region, season, avg(diff_salinity) as mean, stddev_pop(diff_salinity) as std from {profile_error_a} group by region, season""")
def _(t):
    levels = N.merge_states(stored_errors(t), ["diff_salinity"], ("region", "season", "z"))  # a state again, merged once more
    return N.merged_stats(levels, ["diff_salinity"], ("region", "season")).withColumnsRenamed({"diff_salinity_mean": "mean", "diff_salinity_std": "std"})


@query("sketch_quantiles_A10", "region:s season:s q:d n:long within:b", """
select region, season, unnest([0.1, 0.25, 0.5, 0.75, 0.9]) as q, n, true as within from
(select region, season, count(diff_temperature) as n from {profile_error_a} where diff_temperature is not null group by region, season)""")
def _(t):
    errors = written_errors(t)
    found = N.sketch_quantiles(stored_errors(t, sketch=N.SKETCH, errors=errors), "diff_temperature", [0.1, 0.25, 0.5, 0.75, 0.9], ("region", "season"))
    rows = errors.select("region", "season", F.col("diff_temperature").alias("v")).filter("v is not null")
    ranks = found.join(rows, ["region", "season"]).groupBy("region", "season", "q", "n").agg(
        F.count_if(F.col("v") < F.col("diff_temperature")).alias("below"), F.count_if(F.col("v") <= F.col("diff_temperature")).alias("upto"))
    # the value's ranks are an interval where it occurs more than once; three times the error of 99 % confidence
    slack = F.col("n") * 3 * N.rank_error() + 1
    return ranks.withColumn("within", (F.col("below") - slack <= F.col("q") * F.col("n")) & (F.col("q") * F.col("n") <= F.col("upto") + slack))


@query("std_from_moments_A09", "region:s season:s std:d", """
select region, season, stddev_pop(diff_temperature) as std from {profile_error_a} group by region, season""")
def _(t):
    d = F.col("diff_temperature")
    return t("profile_error_a").groupBy("region", "season").agg(F.avg(d * d).alias("sq"), F.avg(d).alias("m")).withColumn(
        "std", S.std_from_moments("sq", "m"))


QS = "[" + ", ".join(f"{q}" for q in S.QUANTILES) + "]"


@query("region_quantiles_A10", "region:s season:s z:int variable:s q:d value:d n:long", f"""
select region, season, z, 'diff_temperature' as variable, unnest({QS}) as q, unnest(v) as value, n from
(select region, season, z, quantile_cont(diff_temperature, {QS}) as v, count(diff_temperature) as n from {{profile_error_a}} where diff_temperature is not null group by region, season, z
 union all select region, season, null as z, quantile_cont(diff_temperature, {QS}) as v, count(diff_temperature) as n from {{profile_error_a}} where diff_temperature is not null group by region, season)""")
def _(t):
    return Q.region_quantiles(t("profile_error_a"), "diff_temperature", S.QUANTILES)


@query("observed_std_A11", "region:s season:s temperature_std:d salinity_std:d", f"""
select region, season, sum(ts * thickness) / sum(case when ts is not null then thickness end) as temperature_std,
       sum(ss * thickness) / sum(case when ss is not null then thickness end) as salinity_std from
(select case when h.lon < -10.0E0 then 'west' when h.lat > 55.0E0 then 'north' else 'south' end as region, {season_sql('month(h.time)')} as season, i.z,
        max(i.thickness) as thickness, stddev_pop(i.temperature) as ts, stddev_pop(i.salinity) as ss from {REF_W} i join {{profile_header}} h on h.profile_id = i.profile_id group by 1, 2, 3)
group by region, season""")
def _(t):
    h = C.with_season(t("profile_header")).withColumn(
        "region", F.when(F.col("lon") < -10, "west").when(F.col("lat") > 55, "north").otherwise("south"))
    return E.obs_std(ref_levels(t).join(h.select("profile_id", "region", "season"), "profile_id"), VARS)


@query("seasons_stacked_A12", "region:s season:s mean:d std:d", """
select region, season, avg(diff_salinity) as mean, stddev_pop(diff_salinity) as std from {profile_error_a} group by region, season""")
def _(t):
    s = E.region_stats(t("profile_error_a"), ["diff_salinity"], ("region", "season"))
    return s.withColumnsRenamed({"diff_salinity_mean": "mean", "diff_salinity_std": "std"})


INSIDE = """
select e.region, c.x, c.y from {grid_cell} c join
(select region, lon as lon1, lat as lat1, coalesce(lead(lon) over w, first(lon) over w) as lon2, coalesce(lead(lat) over w, first(lat) over w) as lat2
 from {region_polygon} window w as (partition by region order by seq rows between unbounded preceding and unbounded following)) e
on (e.lat1 > c.lat) <> (e.lat2 > c.lat) and c.lon < e.lon1 + (c.lat - e.lat1) * (e.lon2 - e.lon1) / (e.lat2 - e.lat1)
left join {region_limits} l on l.region = e.region
where (l.min_depth is null or c.bathymetry >= l.min_depth) and (l.max_depth is null or c.bathymetry < l.max_depth)
group by e.region, c.x, c.y having count(*) % 2 = 1"""


def regions(t, whole=None):
    return G.region_cells(t("grid_cell"), t("region_polygon"), t("region_limits"), whole)


@query("region_mask_J08", "region:s x:int y:int", f"{INSIDE} union all select 'whole_domain' as region, x, y from {{grid_cell}}")
def _(t):
    return regions(t, "whole_domain")


@query("region_membership_J09", "profile_id:long region:s", f"""
select h.profile_id, r.region from {{profile_header}} h join ({nearest_sql('profile_header', RADIUS)}) n on h.lon = n.lon and h.lat = n.lat
join ({INSIDE}) r on r.x = n.x and r.y = n.y""")
def _(t):
    return G.region_membership(G.nearest_cell(t("profile_header"), t("grid_cell"), RADIUS), regions(t))


# ---- surface maps -----------------------------------------------------------------------
BIN = "-25.47E0 + (cast(least(greatest(ceil((lon + 25.47E0) / ((16.25E0 + 25.47E0) / 20)), 1), 20) as double) - 0.5E0) * ((16.25E0 + 25.47E0) / 20)"
LATBIN = "43.0E0 + (cast(least(greatest(ceil((lat - 43.0E0) / (21.5E0 / 20)), 1), 20) as double) - 0.5E0) * (21.5E0 / 20)"
IN_BOX = "lon > -25.47E0 and lon <= 16.25E0 and lat > 43.0E0 and lat <= 64.5E0"


@query("bin_mean_A25", "lon_bin:d lat_bin:d temperature_obs:d salinity_obs:d", f"""
select {BIN} as lon_bin, {LATBIN} as lat_bin, avg(temperature_obs) as temperature_obs, avg(salinity_obs) as salinity_obs from {{profile_pair_a}} where {IN_BOX} group by 1, 2""")
def _(t):
    return U.bin_mean(t("profile_pair_a"), ["temperature_obs", "salinity_obs"])


MODEL_BINS = f"""
select year, month, {BIN} as lon_bin, {LATBIN} as lat_bin, avg(temperature) as temperature, avg(salinity) as salinity from
(select year, month, x, y, lon, lat, avg(temperature) as temperature, avg(salinity) as salinity from {{grid_surface}} group by all) where {IN_BOX} group by 1, 2, 3, 4"""
OBS_BINS = f"""
select year(time) as year, month(time) as month, lon_bin, lat_bin, avg(temperature) as temperature, avg(salinity) as salinity from
(select time, {BIN} as lon_bin, {LATBIN} as lat_bin, avg(temperature) as temperature, avg(salinity) as salinity from
 (select h.profile_id, h.time, h.lon, h.lat, avg(temperature) as temperature, avg(salinity) as salinity from {{profile_level}} l join {{profile_header}} h on h.profile_id = l.profile_id
  where depth < 5 group by h.profile_id, h.time, h.lon, h.lat having avg(temperature) is not null or avg(salinity) is not null) where {IN_BOX} group by 1, 2, 3) group by 1, 2, 3, 4"""


def model_bins(t):
    return U.monthly_model_bins(t("grid_surface"), VARS)


def obs_bins(t):
    return U.monthly_profile_bins(t("profile_level").join(t("profile_header"), "profile_id"), VARS)


@query("monthly_binned_model_A26", "year:int month:int lon_bin:d lat_bin:d temperature:d salinity:d", MODEL_BINS)
def _(t):
    return model_bins(t)


@query("monthly_binned_profiles_A26", "year:int month:int lon_bin:d lat_bin:d temperature:d salinity:d", OBS_BINS)
def _(t):
    return obs_bins(t)


def clim_sql(inner: str) -> str:
    return f"select {season_sql('month')} as season, lon_bin, lat_bin, avg(temperature) as temperature, avg(salinity) as salinity from ({inner}) group by 1, 2, 3"


@query("seasonal_climatology_A27", "season:s x:int y:int temperature:d salinity:d", f"""
select {season_sql('month')} as season, x, y, avg(temperature) as temperature, avg(salinity) as salinity from {{grid_surface}} group by 1, 2, 3""")
def _(t):
    return U.seasonal_climatology(t("grid_surface"), VARS, ("x", "y"))


@query("incremental_climatology_A27", "season:s x:int y:int temperature:d salinity:d", f"""
select {season_sql('month')} as season, x, y, avg(temperature) as temperature, avg(salinity) as salinity from {{grid_surface}} group by 1, 2, 3""")
def _(t):
    base, surface = stage_path(t.spark, uuid.uuid4().hex), t("grid_surface")
    for part in (surface.filter("year < 2000"), surface.filter("year >= 2000")):
        N.store_months(N.month_states(part, VARS, ("x", "y"), "t"), base, "surface")
    return N.merged_climatology(N.stored_months(t.spark, base, "surface"), VARS, S.season_of_month)


@query("climatology_difference_J11", "season:s lon_bin:d lat_bin:d diff_temperature:d diff_salinity:d", f"""
select m.season, m.lon_bin, m.lat_bin, m.temperature - o.temperature as diff_temperature, m.salinity - o.salinity as diff_salinity
from ({clim_sql(MODEL_BINS)}) m join ({clim_sql(OBS_BINS)}) o on m.season = o.season and m.lon_bin = o.lon_bin and m.lat_bin = o.lat_bin""")
def _(t):
    return U.climatology_difference(U.seasonal_climatology(model_bins(t), VARS), U.seasonal_climatology(obs_bins(t), VARS), VARS)


@query("extent_A35", "lon_min:d lon_max:d lat_min:d lat_max:d", """
select min(lon) - 4 as lon_min, max(lon) + 4 as lon_max, min(lat) - 4 as lat_min, max(lat) + 4 as lat_max from
(select (lon + 180.0E0) % 360.0E0 - 180.0E0 as lon, lat from {profile_header})""")
def _(t):
    return C.extent(t("profile_header").withColumn("lon", S.recentre_longitude("lon")), 4.0)


# ---- CRPS -------------------------------------------------------------------------------
RADII = (0, 24, 42, 60)
NEAR_SQL = f"""
select p.lon, p.lat, c.x, c.y, c.bottom_level = 0 as land, {HAVERSINE} as dist from (select distinct lon, lat from {{profile_header}}) p
join {{grid_cell}} c on abs(p.lat - c.lat) < 0.6 where {HAVERSINE} <= 60.0"""
CRPS_SQL = f"""
with near as ({NEAR_SQL}),
best as (select lon, lat, first(x order by dist, x, y) as x, first(y order by dist, x, y) as y from near where not land group by lon, lat),
surface as (select x, y, t, temperature from {{grid_surface}} where temperature is not null),
top as (select profile_id, avg(temperature) as y0 from {{profile_level}} where depth <= 5 group by profile_id having avg(temperature) is not null),
obs as (select h.profile_id, h.lon, h.lat, m.t, top.y0 from {{profile_header}} h join top on top.profile_id = h.profile_id
        join (select d.time, first(f.t order by abs(epoch_us(f.t) - epoch_us(d.time)), f.t) as t from (select distinct time from {{profile_header}}) d
              cross join (select distinct t from {{grid_field}}) f group by d.time) m on m.time = h.time),
reach as (select lon, lat, r, case when r = 0 then false else coalesce(bool_or(land and dist <= r), false) end as land from near cross join (select unnest([0, 24, 42, 60]) as r) group by lon, lat, r),
ens as (select o.profile_id, q.r, o.y0, s.temperature as v from obs o join reach q on q.lon = o.lon and q.lat = o.lat join near n on n.lon = o.lon and n.lat = o.lat and not n.land
        left join best b on b.lon = o.lon and b.lat = o.lat join surface s on s.x = n.x and s.y = n.y and s.t = o.t
        where case when q.r = 0 then n.x = b.x and n.y = b.y else n.dist <= q.r end),
score as (select a.profile_id, a.r, any_value(a.miss) - coalesce(sum(abs(e1.v - e2.v)), 0) / (2.0E0 * any_value(a.n) * any_value(a.n)) as crps, any_value(a.n) as n
          from (select profile_id, r, avg(abs(v - y0)) as miss, count(*) as n from ens group by profile_id, r) a
          join ens e1 on e1.profile_id = a.profile_id and e1.r = a.r join ens e2 on e2.profile_id = a.profile_id and e2.r = a.r group by a.profile_id, a.r)
select o.profile_id, 'temperature' as variable, q.r as radius_km, s.crps, coalesce(s.n, 0) as n_points, q.land from obs o join reach q on q.lon = o.lon and q.lat = o.lat
left join score s on s.profile_id = o.profile_id and s.r = q.r"""


def crps(t):
    return surface_crps.surface_crps(
        t("profile_header"), t("profile_level"), t("grid_cell"), t("grid_field"), ["temperature"], RADII)


@query("neighbourhood_crps_A23", "profile_id:long variable:s radius_km:int crps:d n_points:long land:b", CRPS_SQL)
def _(t):
    return crps(t)


@query("regional_crps_A24", "region:s variable:s radius_km:int crps:d crps_no_land:d n_points:d n:long", f"""
select m.region, c.variable, c.radius_km, avg(v) as crps, avg(case when not land then v end) as crps_no_land, avg(n_points) as n_points, count(v) as n from
(select c.*, case when radius_km = 0 then e.abs_diff else c.crps end as v from ({CRPS_SQL}) c
 left join (select profile_id, abs(avg(temperature_mod - temperature_obs)) as abs_diff from {{profile_pair_a}} where depth <= 5 group by profile_id) e on e.profile_id = c.profile_id) c
join (select h.profile_id, r.region from {{profile_header}} h join ({nearest_sql('profile_header', RADIUS)}) n on h.lon = n.lon and h.lat = n.lat
join ({INSIDE}) r on r.x = n.x and r.y = n.y) m on m.profile_id = c.profile_id group by 1, 2, 3""")
def _(t):
    members = G.region_membership(G.nearest_cell(t("profile_header"), t("grid_cell"), RADIUS), regions(t))
    return surface_crps.crps_by_region(crps(t), members, t("profile_pair_a"), ["temperature"])


# ---- flagship ---------------------------------------------------------------------------
FLAG_MOD = f"""(select m.profile_id, f.depth, f.temperature from mm m join {{grid_field}} f on f.x = m.x and f.y = m.y and f.t = m.t where f.temperature is not null)"""


CHAIN = f"""
mm as ({MATCH_SQL}),
obs as ({interp_sql('profile_level', 'temperature')}),
col as {FLAG_MOD},
at_obs as (select profile_id, depth, case when da = depth then va else va + (vb - va) * ((depth - da) / nullif(db - da, 0)) end as temperature from
 (select r.profile_id, r.depth, max(f.depth) filter (f.depth <= r.depth) as da, arg_max(f.temperature, f.depth) filter (f.depth <= r.depth) as va,
         min(f.depth) filter (f.depth >= r.depth) as db, arg_min(f.temperature, f.depth) filter (f.depth >= r.depth) as vb
  from {{profile_level}} r join col f on f.profile_id = r.profile_id group by r.profile_id, r.depth)),
mod as (select profile_id, z, depth, case when da = depth then va else va + (vb - va) * ((depth - da) / nullif(db - da, 0)) end as temperature from
 (select s.profile_id, r.z, r.depth, max(s.depth) filter (s.depth <= r.depth) as da, arg_max(s.temperature, s.depth) filter (s.depth <= r.depth) as va,
         min(s.depth) filter (s.depth >= r.depth) as db, arg_min(s.temperature, s.depth) filter (s.depth >= r.depth) as vb
  from at_obs s cross join (select * from {{ref_depth}} where depth <= 50) r where s.temperature is not null group by s.profile_id, r.z, r.depth) where da is not null and db is not null),
firsts as (select x, y, t, min(profile_id) as first_id from mm group by x, y, t),
obs_cell as (select m.x, m.y, m.t, o.z, avg(o.temperature) as temperature from obs o join mm m on m.profile_id = o.profile_id group by 1, 2, 3, 4),
mod_cell as (select c.x, c.y, c.t, m.z, m.temperature from firsts c join mod m on m.profile_id = c.first_id),
err as (select coalesce(o.x, m.x) as x, coalesce(o.y, m.y) as y, coalesce(o.t, m.t) as t, coalesce(o.z, m.z) as z, o.temperature as temperature_obs, m.temperature as temperature_mod
        from obs_cell o full join mod_cell m on o.x = m.x and o.y = m.y and o.t = m.t and o.z = m.z),
deep as (select e.*, r.depth, r.thickness, b.bathymetry as bed, case when b.bathymetry < 100 then 10 when b.bathymetry < 500 then 30 else 100 end as h
         from err e join {{ref_depth}} r on r.z = e.z left join {{grid_cell}} b on b.x = e.x and b.y = e.y)"""


def layer_sql(kind: str, where: str) -> str:
    side = lambda s: (f"sum(temperature_{s} * thickness) filter (temperature_{s} is not null) / nullif(sum(thickness) filter (temperature_{s} is not null), 0)")
    return f"""select '{kind}' as kind, year(t) as year, month(t) as month, count(*) as n, avg(m - o) as diff from
 (select x, y, t, {side('obs')} as o, {side('mod')} as m from deep where {where} group by x, y, t) group by 2, 3"""


@query("profile_publication_S09", "kind:s year:int month:int n:long diff:d", f"""
with {CHAIN}
select 'profile_errors' as kind, year(t) as year, month(t) as month, count(*) as n, avg(temperature_mod - temperature_obs) as diff from err group by 2, 3
union all select 'interpolated_profiles', year(t), month(t), count(*), avg(temperature_mod) from err group by 2, 3
union all select 'interpolated_obs', year(t), month(t), count(*), avg(temperature_obs) from err group by 2, 3
union all {layer_sql('surface_data', 'depth between 0 and 5')}
union all {layer_sql('mid_data', 'depth between 20 and 40')}
union all {layer_sql('bottom_data', 'depth between bed - h and bed')}
union all select 'extracted_profiles', year(m.t), month(m.t), count(*), avg(f.temperature) from mm m join {{grid_field}} f on f.x = m.x and f.y = m.y and f.t = m.t group by 2, 3""")
def _(t):
    base = stage_path(t.spark, uuid.uuid4().hex)
    profile_validation.publish_profile_tables(
        t("profile_header"), t("profile_level"), t("grid_cell"), t("grid_field"), t("grid_cell").select("x", "y", "bathymetry"), ["temperature"], base,
        depth_choices={"mid": (20.0, 40.0)}, max_km=RADIUS, max_lag_seconds=LAG)
    shown = {"profile_errors": "diff_temperature", "interpolated_profiles": "temperature_mod", "interpolated_obs": "temperature_obs", "surface_data": "diff_temperature",
             "mid_data": "diff_temperature", "bottom_data": "diff_temperature", "extracted_profiles": "temperature"}
    return scan.stack_tables([
        sink.read_published(t.spark, base, name).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("diff")).withColumn("kind", F.lit(name))
        for name, value in shown.items()])


@query("profile_validation_flagship", "region:s season:s z:int level_set:s mean_diff_temperature:d mean_abs_diff_temperature:d n:long", f"""
with mm as ({MATCH_SQL}),
obs as ({interp_sql('profile_level', 'temperature')}),
col as {FLAG_MOD},
at_obs as (select profile_id, depth, case when da = depth then va else va + (vb - va) * ((depth - da) / nullif(db - da, 0)) end as temperature from
 (select r.profile_id, r.depth, max(f.depth) filter (f.depth <= r.depth) as da, arg_max(f.temperature, f.depth) filter (f.depth <= r.depth) as va,
         min(f.depth) filter (f.depth >= r.depth) as db, arg_min(f.temperature, f.depth) filter (f.depth >= r.depth) as vb
  from {{profile_level}} r join col f on f.profile_id = r.profile_id group by r.profile_id, r.depth)),
mod as (select profile_id, z, depth, case when da = depth then va else va + (vb - va) * ((depth - da) / nullif(db - da, 0)) end as temperature from
 (select s.profile_id, r.z, r.depth, max(s.depth) filter (s.depth <= r.depth) as da, arg_max(s.temperature, s.depth) filter (s.depth <= r.depth) as va,
         min(s.depth) filter (s.depth >= r.depth) as db, arg_min(s.temperature, s.depth) filter (s.depth >= r.depth) as vb
  from at_obs s cross join (select * from {{ref_depth}} where depth <= 50) r where s.temperature is not null group by s.profile_id, r.z, r.depth) where da is not null and db is not null),
cells as (select x, y, t, min(profile_id) as first_id from mm group by x, y, t),
obs_cell as (select m.x, m.y, m.t, o.z, avg(o.temperature) as temperature from obs o join mm m on m.profile_id = o.profile_id group by 1, 2, 3, 4),
err as (select c.x, c.y, c.t, m.z, m.temperature - o.temperature as d from cells c join mod m on m.profile_id = c.first_id
        join obs_cell o on o.x = c.x and o.y = c.y and o.t = c.t and o.z = m.z)
select r.region, {season_sql('month(e.t)')} as season, e.z, case when grouping(e.z) = 0 then 'profile' else 'all' end as level_set,
       avg(e.d) as mean_diff_temperature, avg(abs(e.d)) as mean_abs_diff_temperature, count(*) as n
from err e join ({INSIDE}) r on r.x = e.x and r.y = e.y group by grouping sets ((1, 2, e.z), (1, 2))""")
def _(t):
    return profile_validation.regional_bias(
        t("profile_header"), t("profile_level"), t("grid_cell"), t("grid_field"), regions(t),
        ["temperature"], max_km=RADIUS, max_lag_seconds=LAG)
