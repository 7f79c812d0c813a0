"""Sources, filters, projections, scalar functions."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import query, season_sql
from soundings.functions import scalars as S
from soundings.operators import clean as C
from soundings.operators import matchup as M
from soundings.schema import canonicalise
from soundings.session import stage_path
from soundings.sources import clustered, scan, sink


def _folder(t, name):
    """A written stage of this run in the shared folder."""
    return stage_path(t.spark, f"{uuid.uuid4().hex}/{name}")


# ---- sources and sinks ------------------------------------------------------------------
@query("model_field_scan_S01", "year:int month:int n:long temperature:d", """
select year, month, count(*) as n, avg(temperature) as temperature from {grid_surface}
where year * 12 + month between 1996 * 12 + 11 and 1998 * 12 + 2 group by year, month""")
def _(t):
    path = _folder(t, "grid_field")
    sink.write_replacing(canonicalise(t("grid_surface"), "grid_field"), path, ("year", "month"))
    return scan.scan_months(t.spark, "grid_field", path, (1996, 11), (1998, 2), run="a").groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.avg("temperature").alias("temperature"))


@query("profile_archive_scan_S02", "profile_id:long time:t", "select o_orderkey as profile_id, o_orderdate as time from {orders}")
def _(t):
    return scan.scan_table(t.spark, "profile_header", t.path("orders"),
                           renames={"o_orderkey": "profile_id", "o_orderdate": "time"})


@query("bounded_field_scan_S01", "x:int y:int t:t z:int depth:d temperature:d", """
select x, y, t, z, depth, temperature from {grid_field} where run = 'a' and year * 12 + month between 1996 * 12 + 11 and 1998 * 12 + 2
and depth between 0.0 and 6.0 and t >= timestamp '1997-01-01 00:00:00' and t < timestamp '1998-01-01 00:00:00'""")
def _(t):
    path = _folder(t, "grid_field")
    sink.write_replacing(canonicalise(t("grid_field"), "grid_field"), path, ("year", "month"))
    return scan.scan_months(t.spark, "grid_field", path, (1996, 11), (1998, 2), run="a",
                            bounds={"depth": (0.0, 6.0), "t": ("1997-01-01 00:00:00", "1998-01-01 00:00:00")})


@query("bounded_profile_scan_S02", "profile_id:long time:t", """
select o_orderkey as profile_id, o_orderdate as time from {orders} where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-03-01' and o_orderkey >= 100""")
def _(t):
    return scan.scan_table(t.spark, "profile_header", t.path("orders"), renames={"o_orderkey": "profile_id", "o_orderdate": "time"},
                           bounds={"time": ("1996-01-01 00:00:00", "1996-03-01 00:00:00"), "profile_id": (100, None)})


@query("extent_scan_P01", "profile_id:long lon:d lat:d", """
select profile_id, lon, lat from {profile_header} where lon between (select min(lon) + 1 from {grid_cell}) and (select max(lon) - 1 from {grid_cell})
and lat between (select min(lat) + 1 from {grid_cell}) and (select max(lat) - 1 from {grid_cell})""")
def _(t):
    path = _folder(t, "headers")
    sink.write_replacing(canonicalise(t("profile_header"), "profile_header"), path)
    return scan.scan_table(t.spark, "profile_header", path, bounds=scan.extent_bounds(t("grid_cell"), -1.0))


@query("static_grid_scan_S03", "x:int y:int lon:d lat:d bathymetry:d bottom_level:int",
       "select x, y, lon, lat, bathymetry, bottom_level from {grid_cell}")
def _(t):
    return canonicalise(t("grid_cell"), "grid_cell")


@query("gauge_scan_S04", "port:int time:t ssh:d", "select user_id as port, ts as time, value as ssh from {events}")
def _(t):
    return scan.scan_table(t.spark, "tg_series", t.path("events"), renames={"user_id": "port", "ts": "time", "value": "ssh"})


@query("nested_concat_S05", "port:int time:t ssh_obs:d ssh_mod:d", """
select port, time, ssh_obs, null as ssh_mod from {tg_extract} union all
select port, time, null as ssh_obs, ssh_mod from {tg_extract}""")
def _(t):
    e = t("tg_extract")
    return scan.stack_tables([e.drop("ssh_mod"), e.drop("ssh_obs")])


@query("merge_station_outputs_S06", "port:int time:t ssh_obs:d ssh_mod:d", "select port, time, ssh_obs, ssh_mod from {tg_extract}")
def _(t):
    paths = [_folder(t, f"part{k}") for k in (0, 1)]
    e = canonicalise(t("tg_extract"), "tg_extract")
    sink.write_replacing(e.filter("port < 4"), paths[0])
    sink.write_replacing(e.filter("port >= 4"), paths[1])
    return scan.scan_table(t.spark, "tg_extract", *paths)


NEAREST = """
select p.lon, p.lat, first(c.x order by {dist}, c.x, c.y) as x, first(c.y order by {dist}, c.x, c.y) as y, min({dist}) as dist
from (select distinct lon, lat from {points}) p join (select * from {{grid_cell}} where bottom_level <> 0) c
on abs(p.lat - c.lat) < 0.6 where {dist} <= {r} group by p.lon, p.lat"""
HAVERSINE = ("2 * 6371.0E0 * asin(sqrt(least(1.0E0, pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * "
             "cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2))))")


def nearest_sql(points: str, r: float) -> str:
    return NEAREST.format(dist=HAVERSINE, points="{" + points + "}", r=r)


@query("station_cells_scan_S07", "x:int y:int t:t z:int temperature:d", f"""
select f.x, f.y, f.t, f.z, f.temperature from {{grid_field}} f
where (f.x, f.y) in (select (x, y) from ({nearest_sql('tg_station', 60.0)}) as n)""")
def _(t):
    from soundings.operators.spatial import nearest_cell

    return scan.keep_station_cells(t("grid_field"), nearest_cell(t("tg_station"), t("grid_cell"), 60.0))


@query("clustered_station_scan_S07", "x:int y:int t:t z:int temperature:d", f"""
select f.x, f.y, f.t, f.z, f.temperature from {{grid_field}} f
where (f.x, f.y) in (select (x, y) from ({nearest_sql('tg_station', 60.0)}) as n)""")
def _(t):
    from soundings.operators.spatial import nearest_cell

    path = _folder(t, "grid_field")
    clustered.write_clustered(canonicalise(t("grid_field"), "grid_field"), path)
    return clustered.scan_cells(t.spark, "grid_field", path, nearest_cell(t("tg_station"), t("grid_cell"), 60.0), (1900, 1), (2100, 12))


@query("clustered_station_series_J05", "port:int time:t ssh:d", f"""
select s.port, g.t as time, g.ssh from (select s.port, n.x, n.y from {{tg_station}} s join ({nearest_sql('tg_station', 60.0)}) n on s.lon = n.lon and s.lat = n.lat) s
join {{grid_ssh}} g on g.x = s.x and g.y = s.y""")
def _(t):
    from soundings.operators.matchup import model_series
    from soundings.operators.spatial import nearest_cell

    path, stations = _folder(t, "grid_ssh"), nearest_cell(t("tg_station"), t("grid_cell"), 60.0)
    months = t("grid_ssh").withColumns({"year": F.year("t"), "month": F.month("t")})
    clustered.write_clustered(canonicalise(months, "grid_ssh"), path)
    return model_series(stations, clustered.scan_cells(t.spark, "grid_ssh", path, stations, (1900, 1), (2100, 12)))


@query("replace_if_exists_S08", "season:s port:int time:t ssh_obs:d", """
select season, port, time, case when season = 'MAM' then ssh_obs * 2 else ssh_obs end as ssh_obs from {tg_daily}""")
def _(t):
    path = _folder(t, "tg_daily")
    daily = t("tg_daily").select("season", "port", "time", "ssh_obs")
    sink.write_replacing(daily.withColumn("ssh_obs", F.lit(-1.0)), path, ())
    sink.write_replacing(daily, path + "_p", ("season",))
    sink.write_replacing(daily.filter("season = 'MAM'").withColumn("ssh_obs", F.col("ssh_obs") * 2), path + "_p", ("season",))
    return t.spark.read.parquet(path + "_p")


@query("multi_output_sink_S09", "kind:s season:s n:long", """
select 'profiles' as kind, season, count(*) as n from {profile_pair_a} group by season union all
select 'errors' as kind, season, count(*) as n from {profile_pair_a} where temperature_obs is not null group by season""")
def _(t):
    paths = sink.write_all(t("profile_pair_a"), {
        "profiles": (lambda d: d.select("profile_id", "z", "temperature_mod", "season"), ("season",)),
        "errors": (lambda d: d.filter("temperature_obs is not null").select("profile_id", "z", "temperature_obs", "season"), ("season",)),
    }, _folder(t, "run"))
    return scan.stack_tables([
        t.spark.read.parquet(p).groupBy("season").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k))
        for k, p in paths.items()])


@query("provenance_S10", "port:int run:s n_boot:int n:long",
       "select port, 'control' as run, 200 as n_boot, count(*) as n from {tg_extract} group by port")
def _(t):
    return sink.with_provenance(t("tg_extract").groupBy("port").agg(F.count(F.lit(1)).alias("n")), run="control", n_boot=200)


# ---- filters and projections ------------------------------------------------------------
@query("lonlat_box_P01", "profile_id:long lon:d lat:d", """
select profile_id, lon, lat from {profile_header} where lon between -15.5 and 8.25 and lat between 48.0 and 60.5""")
def _(t):
    return C.lonlat_box(t("profile_header"), (-15.5, 8.25), (48.0, 60.5))


@query("grid_extent_cut_P01", "port:long lon:d lat:d", """
select port, lon, lat from {station_first} where lon between (select min(lon) from {grid_cell}) and (select max(lon) from {grid_cell})
and lat between (select min(lat) from {grid_cell}) and (select max(lat) from {grid_cell})""")
def _(t):
    return C.within_extent_of(t("station_first"), t("grid_cell"))


@query("qc_flags_P02", "profile_id:long z:int temperature:d salinity:d", """
with v as (select profile_id, z, case when qc = 4 then null else temperature end as temperature,
                  case when qc = 4 then null else salinity end as salinity from {profile_level})
select * from v where profile_id in (select profile_id from v where temperature is not null or salinity is not null)""")
def _(t):
    return C.null_flagged(t("profile_level"), ["temperature", "salinity"], F.col("qc") == 4)


@query("qc_flags_neighbours_P02", "profile_id:long z:int temperature:d salinity:d", """
with v as (select l.profile_id, l.z, case when b.z is null then l.temperature end as temperature,
                  case when b.z is null then l.salinity end as salinity
           from {profile_level} l left join (select distinct profile_id, z + unnest([-1, 0, 1]) as z from {profile_level} where qc = 4) b
           on l.profile_id = b.profile_id and l.z = b.z)
select * from v where profile_id in (select profile_id from v where temperature is not null or salinity is not null)""")
def _(t):
    return C.null_flagged(t("profile_level"), ["temperature", "salinity"], F.col("qc") == 4, neighbours=True)


@query("month_window_P03", "profile_id:long time:t", """
select profile_id, time from {profile_header} where time >= timestamp '1997-03-01' and time < timestamp '1997-04-01'""")
def _(t):
    return C.time_window(t("profile_header"), "1997-03-01", "1997-04-01")


@query("model_period_cut_P03", "port:int time:t ssh_obs:d", """
select port, time, ssh_obs from {tg_daily} where time between (select min(t) from {grid_field}) and (select max(t) from {grid_field})""")
def _(t):
    return C.cut_to_model_period(t("tg_daily"), t("grid_field"))


@query("select_rename_P04", "profile_id:long z:int potential:d practical:d",
       "select profile_id, z, temperature as potential, salinity as practical from {profile_level}")
def _(t):
    return t("profile_level").withColumnsRenamed({"temperature": "potential", "salinity": "practical"})


@query("land_mask_P05", "x:int y:int land:b", "select x, y, bottom_level = 0 as land from {grid_cell}")
def _(t):
    return C.land_flag(t("grid_cell"))


@query("season_filter_P08", "season:s month:int n:long", f"""
select season, month, count(*) as n from (select {season_sql('month(time)')} as season, month(time) as month from {{profile_header}})
where season in ('DJF', 'JJA') group by season, month""")
def _(t):
    h = C.only_label(C.with_season(t("profile_header")), season=["DJF", "JJA"])
    return h.groupBy("season", F.month("time").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("station_selection_P09", "port:int time:t ssh_obs:d", "select port, time, ssh_obs from {tg_extract} where port = 5")
def _(t):
    return C.only_label(t("tg_extract"), port=5)


@query("minimum_data_P10", "port:int time:t ssh_obs:d ssh_mod:d", """
select port, time, ssh_obs, ssh_mod from {tg_user} where port in
(select port from {tg_user} group by port having count(ssh_obs) >= 38 and count(ssh_mod) >= 26)""")
def _(t):
    return C.enough_data(C.enough_data(t("tg_user"), ["ssh_obs"], 38), ["ssh_mod"], 26)


@query("bad_station_nulling_P11", "port:int time:t ssh_obs:d ssh_mod:d", """
select port, time, case when port in (select port from {tg_extract} group by port having max(ssh_obs) > 4.5) then null else ssh_obs end as ssh_obs,
case when port in (select port from {tg_extract} group by port having max(ssh_obs) > 4.5) then null else ssh_mod end as ssh_mod from {tg_extract}""")
def _(t):
    bad = t("tg_extract").groupBy("port").agg(F.max("ssh_obs").alias("m")).filter("m > 4.5")
    return C.null_bad_stations(t("tg_extract"), bad, ["ssh_obs", "ssh_mod"])


@query("shared_missing_P12", "port:int time:t ssh_obs:d ssh_mod:d", """
select port, time, case when ssh_mod is not null then ssh_obs end as ssh_obs, case when ssh_obs is not null then ssh_mod end as ssh_mod from {tg_extract}""")
def _(t):
    return C.shared_missing(t("tg_extract"))


@query("mask_reconstruction_P13", "port:int time:t tide:d", """
select port, time, case when ssh_obs is not null then cast(hour(time) as double) / 7.0E0 end as tide from {tg_extract}""")
def _(t):
    return C.mask_where_missing(t("tg_extract").withColumn("tide", F.hour("time") / F.lit(7.0)), ["tide"], "ssh_obs")


@query("plausible_amplitude_P14", "port:int source:s constituent:s a:d", """
select port, source, constituent, case when a <> 0 and a <= 1.1 then a end as a from {tide_fit_a}""")
def _(t):
    return C.plausible_amplitude(t("tide_fit_a"), ["a"], 1.1)


@query("near_surface_P15", "edge:s profile_id:long z:int temperature:d", """
select 'closed' as edge, profile_id, z, temperature from {profile_level} where depth <= 5 union all
select 'open' as edge, profile_id, z, temperature from {profile_level} where depth < 5""")
def _(t):
    p = t("profile_level")
    return C.near_surface(p).withColumn("edge", F.lit("closed")).unionByName(
        C.near_surface(p, inclusive=False).withColumn("edge", F.lit("open")))


@query("drop_all_missing_P16", "profile_id:long z:int temperature:d salinity:d", """
select profile_id, z, temperature, salinity from {profile_level} where temperature is not null or salinity is not null""")
def _(t):
    return C.drop_empty(t("profile_level"), ["temperature", "salinity"])


@query("longitude_recentring_P17", "profile_id:long lon:d", """
select profile_id, ((lon * 9.0E0 + 180.0E0) % 360.0E0 + 360.0E0) % 360.0E0 - 180.0E0 as lon from {profile_header}""")
def _(t):
    return t("profile_header").withColumn("lon", S.recentre_longitude(F.col("lon") * 9.0))


@query("wide_to_long_P18", "profile_id:long z:int variable:s value:d", """
select profile_id, z, 'temperature' as variable, temperature as value from {profile_level} union all
select profile_id, z, 'salinity' as variable, salinity as value from {profile_level}""")
def _(t):
    return C.to_long(t("profile_level"), ["profile_id", "z"], ["temperature", "salinity"])


@query("flatten_depth_P18", "x:int y:int t:t z:int temperature:d", """
select x, y, t, z, temperature from {grid_field}""")
def _(t):
    cube = t("grid_field").groupBy("x", "y", "t").agg(
        F.expr("transform(array_sort(collect_list(struct(z, temperature))), s -> s.temperature)").alias("temperature"))
    return C.flatten_levels(cube, ["temperature"], ["x", "y", "t"])


@query("label_selection_P20", "profile_id:long z:int diff_temperature:d", """
select profile_id, z, diff_temperature from {profile_error_a} where region = 'north' and season = 'SON'""")
def _(t):
    return C.only_label(t("profile_error_a"), region="north", season="SON")


@query("first_levels_T02", "profile_id:long z:int temperature:d", "select profile_id, z, temperature from {profile_level} where z < 20")
def _(t):
    return C.first_levels(t("profile_level"), 20)


# ---- scalar functions -------------------------------------------------------------------
@query("phase_difference_H01", "port:int constituent:s r:d", """
select port, constituent, (((g_mod - g_obs + 180.0E0) % 360.0E0) + 360.0E0) % 360.0E0 - 180.0E0 as r from {tide_pair_a}""")
def _(t):
    return t("tide_pair_a").withColumn("r", S.wrap_phase("g_mod", "g_obs"))


@query("phase_unwrap_H02", "port:int constituent:s g:d", """
select port, constituent, case when u - g_obs > 300 then u - 360 else u end as g from
(select *, case when g_obs - g_mod > 250 then g_mod + 360 else g_mod end as u from {tide_pair_a})""")
def _(t):
    return t("tide_pair_a").withColumn("g", S.unwrap_pair("g_mod", "g_obs"))


@query("polar_vector_H03", "port:int source:s constituent:s zx:d zy:d", """
select port, source, constituent, a * cos(radians(g)) as zx, a * sin(radians(g)) as zy from {tide_fit_a}""")
def _(t):
    return t("tide_fit_a").withColumns({"zx": S.polar_x("a", "g"), "zy": S.polar_y("a", "g")})


@query("angle_from_correlation_H04", "region:s r:d theta:d", """
select region, r, degrees(acos(greatest(-1.0E0, least(1.0E0, r)))) as theta from
(select region, corr(salinity_obs, salinity_mod) as r from {profile_pair_a} group by region)""")
def _(t):
    return t("profile_pair_a").groupBy("region").agg(F.corr("salinity_obs", "salinity_mod").alias("r")).withColumn(
        "theta", S.angle_from_correlation("r"))


@query("bias_angle_H05", "profile_id:long z:int angle:d", """
select a.profile_id, a.z, case when a.abs_diff_temperature = 0 and b.abs_diff_temperature = 0 then null
       else atan2(a.abs_diff_temperature, b.abs_diff_temperature) end as angle
from {profile_error_a} a join {profile_error_b} b on a.profile_id = b.profile_id and a.z = b.z""")
def _(t):
    a, b = (t(f"profile_error_{r}").select("profile_id", "z", F.col("abs_diff_temperature").alias(r)) for r in "ab")
    return a.join(b, ["profile_id", "z"]).withColumn("angle", S.bias_angle("a", "b"))


@query("elementwise_H06", "profile_id:long z:int mag:d sq:d root:d missing:b", """
select profile_id, z, abs(diff_temperature) as mag, diff_temperature * diff_temperature as sq, sqrt(abs_diff_temperature) as root,
       diff_temperature is null as missing from {profile_error_a}""")
def _(t):
    d = F.col("diff_temperature")
    return t("profile_error_a").select("profile_id", "z", F.abs(d).alias("mag"), (d * d).alias("sq"),
                                       F.sqrt("abs_diff_temperature").alias("root"), d.isNull().alias("missing"))


@query("number_sequences_H07", "kind:s level:d n:long", """
select 'depth' as kind, r.depth as level, count(l.profile_id) as n from {ref_depth} r left join {profile_level} l on l.depth = r.depth group by r.depth
union all select 'threshold' as kind, k / 10.0E0 as level, (select count(*) from {tg_extract} where ssh_obs >= k / 10.0E0) as n from (select unnest(range(-4, 20)) as k)
""")
def _(t):
    from soundings.operators.threshold import exceedance

    counted = t("profile_level").groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    depths = t.spark.createDataFrame([(d,) for d in S.reference_depths()], "depth double").join(counted, "depth", "left").select(
        F.lit("depth").alias("kind"), F.col("depth").alias("level"), F.coalesce("n", F.lit(0)).alias("n"))
    levels = exceedance(t("tg_extract").withColumn("k", F.lit(0)), {"n": "ssh_obs"}, keys=("k",)).select(
        F.lit("threshold").alias("kind"), F.col("threshold").alias("level"), "n")
    return depths.unionByName(levels)


@query("month_keys_H08", "key:s n:long", """
select strftime(m.m, '%Y%m') as key, count(h.profile_id) as n
from (select unnest(generate_series((select date_trunc('month', min(time)) from {profile_header}),
             (select date_trunc('month', max(time)) from {profile_header}) - interval 1 month, interval 1 month)) as m) m
left join {profile_header} h on date_trunc('month', h.time) = m.m group by m.m""")
def _(t):
    h = t("profile_header")
    months = h.agg(F.min("time").alias("a"), F.max("time").alias("b")).select(F.explode(S.month_list("a", "b")).alias("m")).select(
        S.month_key("m").alias("key"))
    counted = h.groupBy(S.month_key("time").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return months.join(counted, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("bin_centres_H09", "k:int centre:d n:long", """
select k, -3.0E0 + (k + 0.5E0) * 0.15E0 as centre, count(*) as n from
(select cast(least(floor((diff_temperature + 3.0E0) / 0.15E0), 39) as int) as k from {profile_error_a} where diff_temperature between -3 and 3)
group by k""")
def _(t):
    b = t("profile_error_a").withColumn("k", S.histogram_bin("diff_temperature", -3.0, 3.0, 40)).filter("k is not null")
    return b.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("centre", S.bin_centre("k", -3.0, 3.0, 40))


# ---- sorting and sets -------------------------------------------------------------------
@query("sorted_bins_T01", "lat:d lon:d n:long", """
select lat, lon, count(*) as n from {profile_header} group by lat, lon order by lat, lon""")
def _(t):
    return t("profile_header").groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n")).orderBy("lat", "lon")


@query("union_of_runs_U01", "run:s season:s n:long diff:d", """
select 'a' as run, season, count(*) as n, avg(diff_temperature) as diff from {profile_error_a} group by season union all
select 'b' as run, season, count(*) as n, avg(diff_temperature) as diff from {profile_error_b} group by season""")
def _(t):
    both = scan.stack_tables([sink.with_provenance(t(f"profile_error_{r}"), run=r) for r in "ab"])
    return both.groupBy("run", "season").agg(F.count(F.lit(1)).alias("n"), F.avg("diff_temperature").alias("diff"))


@query("distinct_cells_U02", "x:int y:int", "select distinct x, y from {grid_ssh}")
def _(t):
    return t("grid_ssh").select("x", "y").dropDuplicates()


@query("common_keys_U03", "profile_id:long", """
select profile_id from {profile_level} where salinity is not null intersect select profile_id from {profile_level} where temperature is not null""")
def _(t):
    p = t("profile_level")
    return p.filter("salinity is not null").select("profile_id").intersect(p.filter("temperature is not null").select("profile_id"))


# ---- merges -----------------------------------------------------------------------------
@query("pair_stations_J06", "port:int time:t ssh_obs:d ssh_mod:d", """
select port, time, ssh_obs, ssh_mod from {tg_extract} where ssh_obs is not null and ssh_mod is not null""")
def _(t):
    e = t("tg_extract")
    obs = e.filter("ssh_obs is not null").select("port", "time", F.col("ssh_obs").alias("ssh"))
    mod = e.filter("ssh_mod is not null").select("port", "time", F.col("ssh_mod").alias("ssh"))
    return M.pair_equal(obs, mod, ["port", "time"])


@query("time_axis_check_J06", "n_both:long n_obs_only:long n_mod_only:long", """
select count(*) filter (ssh_obs is not null and ssh_mod is not null) as n_both, count(*) filter (ssh_obs is not null and ssh_mod is null) as n_obs_only,
       count(*) filter (ssh_obs is null and ssh_mod is not null) as n_mod_only from {tg_extract}""")
def _(t):
    e = t("tg_extract")
    return M.time_axis_check(e.filter("ssh_obs is not null"), e.filter("ssh_mod is not null"), ["port", "time"])


@query("merge_override_J12", "profile_id:long z:int temperature:d salinity:d qc:int diff_temperature:d", """
select l.profile_id, l.z, l.temperature, l.salinity, l.qc, e.diff_temperature from {profile_level} l
join {profile_error_b} e on l.profile_id = e.profile_id and l.z = e.z""")
def _(t):
    second = t("profile_error_b").withColumn("temperature", F.lit(-99.0))
    return M.merge_keeping_first(t("profile_level"), second, ["profile_id", "z"])


@query("attach_bathymetry_J13", "x:int y:int t:t ssh:d bathymetry:d", """
select s.x, s.y, s.t, s.ssh, c.bathymetry from {grid_ssh} s left join (select * from {grid_cell} where bottom_level <> 0) c on s.x = c.x and s.y = c.y""")
def _(t):
    return M.attach(t("grid_ssh"), t("grid_cell").filter("bottom_level <> 0"), ["x", "y"], ["bathymetry"])
