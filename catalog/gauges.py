"""Tide gauges: statistics, thresholds, tides, residuals, peaks, skew surges."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import query, season_sql
from catalog.cleaning import nearest_sql
from soundings.functions import scalars as S
from soundings.operators import compare as P, error as E, peaks as K, series as R, slots, threshold as H, tide as A, timejoin as T
from soundings.plans import gauge_validation
from soundings.session import stage_path
from soundings.sources import scan, sink

LEVELS = S.thresholds()
LEVEL_SQL = "(select k / 10.0E0 as threshold from (select unnest(range(-4, 20)) as k))"


# ---- statistics -------------------------------------------------------------------------
STATS = """stddev_pop(ssh_obs) as ssh_std_obs, stddev_pop(ssh_mod) as ssh_std_mod, stddev_pop(ssh_mod) - stddev_pop(ssh_obs) as ssh_std_err,
       stddev_pop(ntr_obs) as ntr_std_obs, stddev_pop(ntr_mod) as ntr_std_mod, stddev_pop(ntr_mod - ntr_obs) as ntr_err_std, avg(ntr_mod - ntr_obs) as ntr_me,
       avg(abs(ntr_mod - ntr_obs)) as ntr_mae, sqrt(avg(pow(ntr_mod - ntr_obs, 2))) as ntr_rmse"""


def stats_sql(view: str) -> str:
    return f"""
select port, case when grouping(season) = 1 then 'All' else season end as season, {STATS},
       case when grouping(season) = 1 or count(ntr_obs - ntr_mod) > 100 then corr(ntr_obs, ntr_mod) end as ntr_corr, count(ntr_obs - ntr_mod) as n
from {{{view}}} group by grouping sets ((port, season), (port))"""


STAT_SPEC = ("port:int season:s ssh_std_obs:d ssh_std_mod:d ssh_std_err:d ntr_std_obs:d ntr_std_mod:d ntr_err_std:d "
             "ntr_me:d ntr_mae:d ntr_rmse:d ntr_corr:d n:long")


@query("series_error_stats_A13", STAT_SPEC, stats_sql("tg_daily_ntr"))
def _(t):
    return E.tide_gauge_stats(t("tg_daily_ntr"))


@query("residual_correlation_A14", "port:int season:s ntr_corr:d n:long",
       f"select port, season, ntr_corr, n from ({stats_sql('tg_ntr')})")
def _(t):
    return E.tide_gauge_stats(t("tg_ntr"))


@query("demean_A15", "port:int time:t ssh_obs:d ssh_mod:d", """
select port, time, ssh_obs - avg(ssh_obs) over (partition by port) as ssh_obs, ssh_mod - avg(ssh_mod) over (partition by port) as ssh_mod from {tg_extract}""")
def _(t):
    return E.demean(t("tg_extract"), ["ssh_obs", "ssh_mod"])


CLIM = """select port, month(time) as month, avg(ntr_obs) as ntr_obs_mean, stddev_pop(ntr_obs) as ntr_obs_std, avg(ntr_mod) as ntr_mod_mean,
       stddev_pop(ntr_mod) as ntr_mod_std from {tg_daily_ntr} group by port, month(time)"""


@query("monthly_climatology_A16", "port:int month:int ntr_obs_mean:d ntr_obs_std:d ntr_mod_mean:d ntr_mod_std:d", CLIM)
def _(t):
    return E.month_climatology(t("tg_daily_ntr"), ["ntr_obs", "ntr_mod"])


@query("calendar_month_resample_A17", "port:int month_start:t ntr_obs_mean:d ntr_obs_std:d ntr_obs_max:d", """
select port, date_trunc('month', time) as month_start, avg(ntr_obs) as ntr_obs_mean, stddev_pop(ntr_obs) as ntr_obs_std, max(ntr_obs) as ntr_obs_max
from {tg_daily_ntr} group by 1, 2""")
def _(t):
    return E.calendar_months(t("tg_daily_ntr"), ["ntr_obs"])


@query("climatological_variance_error_C04", "port:int month:int std_err:d", f"select port, month, ntr_mod_std - ntr_obs_std as std_err from ({CLIM})")
def _(t):
    return E.climatology_error(E.month_climatology(t("tg_daily_ntr"), ["ntr_obs", "ntr_mod"]))


# ---- thresholds -------------------------------------------------------------------------
def over(source: str, columns: dict[str, str], op: str = ">=") -> str:
    counts = ", ".join(f"count(*) filter ({c} {op} h.threshold) as {n}" for n, c in columns.items())
    return f"select s.port, h.threshold, {counts} from ({source}) s cross join {LEVEL_SQL} h group by s.port, h.threshold"


BOTH = {"n_obs": "ntr_obs", "n_mod": "ntr_mod"}
COUNT_SPEC = "port:int threshold:d n_obs:long n_mod:long"


@query("threshold_daily_maxima_A18", COUNT_SPEC, over(
    "select port, date_trunc('day', time) as d, max(ntr_obs) as ntr_obs, max(ntr_mod) as ntr_mod from {tg_ntr} group by 1, 2", BOTH))
def _(t):
    return H.exceedance(H.period_maxima(t("tg_ntr"), ["ntr_obs", "ntr_mod"], "day"), BOTH, LEVELS)


@query("threshold_monthly_maxima_A18", COUNT_SPEC, over(
    "select port, date_trunc('month', time) as d, max(ntr_obs) as ntr_obs, max(ntr_mod) as ntr_mod from {tg_daily_ntr} group by 1, 2", BOTH))
def _(t):
    return H.exceedance(H.period_maxima(t("tg_daily_ntr"), ["ntr_obs", "ntr_mod"], "month"), BOTH, LEVELS)


HOURS = over("select * from {tg_ntr}", BOTH)


def hours_over(t):
    return H.exceedance(t("tg_ntr"), BOTH, LEVELS)


@query("threshold_hours_A19", COUNT_SPEC, HOURS)
def _(t):
    return hours_over(t)


@query("threshold_ratios_A22", "port:int threshold:d proportion:d", f"select port, threshold, cast(n_mod as double) / nullif(n_obs, 0) as proportion from ({HOURS})")
def _(t):
    return H.threshold_ratios(hours_over(t), {"proportion": ("n_mod", "n_obs")})


@query("threshold_curves_A22", "threshold:d mean_n_obs:d mean_n_mod:d proportion:d", f"""
select threshold, avg(n_obs) as mean_n_obs, avg(n_mod) as mean_n_mod, cast(sum(n_mod) as double) / nullif(cast(sum(n_obs) as double), 0) as proportion from ({HOURS}) group by threshold""")
def _(t):
    return H.threshold_curves(hours_over(t), ["n_obs", "n_mod"], {"proportion": ("n_mod", "n_obs")})


# ---- smoothing --------------------------------------------------------------------------
GRID = """select g.port, g.time, g.i, g.n, e.ssh_obs, e.ssh_mod, e.ssh from
(select port, n, unnest(range(0, n)) as i, t0 + unnest(range(0, n)) * interval 1 hour as time from
 (select port, min(time) as t0, cast(datediff('hour', min(time), max(time)) + 1 as bigint) as n from {tg_dense} group by port)) g
left join {tg_dense} e on e.port = g.port and e.time = g.time"""


def smooth_sql(window: int, order: int, column: str) -> str:
    half = window // 2
    centre, leading = R.smoothing_weights(window, order)
    terms = " + ".join(
        (f"v * ({c!r}::double)" if k == half else f"{'lead' if k > half else 'lag'}(v, {abs(k - half)}) over w * ({c!r}::double)")
        for k, c in enumerate(centre))
    rows = "[" + ", ".join("[" + ", ".join(f"{c!r}::double" for c in row) + "]" for row in leading) + "]"
    ends = []
    for place, i in (("i", "p"), ("n - 1 - i", "n - 1 - p")):
        ends.append(f"""select port, {i} as i, case when c = {window} then s end as v from (select port, n, p, count(v) as c, sum(v * ({rows})[p + 1][{place} + 1]) as s
 from g cross join (select unnest(range(0, {half})) as p) where {place} < {window} and n >= {window} group by port, n, p)""")
    return f"""(with g as (select port, i, n, {column} as v from ({GRID})),
 inner_part as (select port, i, n, {terms} as v from g window w as (partition by port order by i))
 select port, i, v from inner_part where i >= {half} and i < n - {half} union all {ends[0]} union all {ends[1]})"""


@query("smoothing_W03", "port:int i:long ssh:d", f"select port, i, v as ssh from {smooth_sql(25, 3, 'ssh')}")
def _(t):
    return R.smooth(slots.regular_hours(t("tg_dense")), "ssh")


# ---- tides ------------------------------------------------------------------------------
@query("harmonic_fit_one_constituent_W04", "port:int constituent:s a:d g:d", f"""
with b as (select port, ssh_obs as y, cos(w) as c, sin(w) as s from (select port, ssh_obs, radians((epoch_us(time) / 3600000000.0E0 * 28.9841042E0) % 360.0E0) as w
           from {{tg_dense}} where ssh_obs is not null)),
m as (select port, covar_pop(c, c) as cc, covar_pop(s, s) as ss, covar_pop(c, s) as cs, covar_pop(c, y) as cy, covar_pop(s, y) as sy from b group by port),
r as (select port, (cy * ss - sy * cs) / (cc * ss - cs * cs) as p, (sy * cc - cy * cs) / (cc * ss - cs * cs) as q from m)
select port, 'M2' as constituent, sqrt(p * p + q * q) as a, ((degrees(atan2(q, p)) % 360.0E0) + 360.0E0) % 360.0E0 as g from r""")
def _(t):
    return A.harmonic_fit(t("tg_dense"), "ssh_obs", constituents=["M2"], trend=False)


# Speeds in degrees per hour, in the order in which constituents are kept.
FIT_SPEEDS = {"M2": 28.9841042, "S2": 30.0, "K1": 15.0410686, "O1": 13.9430356, "N2": 28.4397295, "P1": 14.9589314, "K2": 30.0821373, "Q1": 13.3986609}


def full_fit_sql(rows: str, by: list[str], minimum: int = 0, chosen: dict[str, float] | None = None) -> str:
    """Normal equations of all constituents each group resolves, solved by elimination, one unknown a step.

    ``rows`` has the ``by`` columns, us (microseconds) and y.  Unknowns are the constant (0), the
    trend (1), and a cosine and a sine of each constituent; column 99 is the right side.
    """
    chosen = chosen or FIT_SPEEDS
    named = "[" + ", ".join(f"{{'name': '{c}', 'speed': {v!r}::double}}" for c, v in chosen.items()) + "]"
    keys, on = ", ".join(by), lambda a, b: " and ".join(f"{a}.{k} = {b}.{k}" for k in by)
    of = lambda a: ", ".join(f"{a}.{k}" for k in by)
    return f"""
(with recursive src as (select {keys}, us, y, row_number() over (order by {keys}, us, y) as r from ({rows}) where y is not null),
 span as (select {keys}, min(us) as u0, max(us) as u1, count(*) as n, (max(us) - min(us)) / 3.6E9 + 1 as hours from src group by {keys} having count(*) >= {minimum}),
 kept as (select *, list_reduce([[0.0::double], {", ".join(f"[{v!r}::double]" for v in chosen.values())}],
   lambda k, x: case when len(list_filter(k, lambda z: abs(z - x[1]) * hours < 360)) = 0 then list_concat(k, x) else k end)[2:] as speeds from span),
 used as (select *, 2 + 2 * len(speeds) as d from kept where len(speeds) > 0 and n >= 2 + 2 * len(speeds)),
 wave as (select {of("u")}, s.r, unnest(range(0, len(u.speeds))) as k, radians(((s.us / 3.6E9) * unnest(u.speeds)) % 360) as w from src s join used u on {on("s", "u")}),
 basis as (select {of("s")}, s.r, 0 as k, 1.0::double as x from src s join used u on {on("s", "u")}
   union all select {of("s")}, s.r, 1, 2.0 * (s.us - u.u0) / greatest(u.u1 - u.u0, 1) - 1 from src s join used u on {on("s", "u")}
   union all select {keys}, r, 2 + 2 * k, cos(w) from wave union all select {keys}, r, 3 + 2 * k, sin(w) from wave),
 sides as (select * from basis union all select {of("s")}, s.r, 99, s.y from src s join used u on {on("s", "u")}),
 normal as (select {of("a")}, a.k as i, b.k as j, sum(a.x * b.x) as v from basis a join sides b on a.r = b.r group by {of("a")}, a.k, b.k),
 solved as (select 0 as step, u.d, {of("m")}, m.i, m.j, m.v from normal m join used u on {on("m", "u")}
   union all
   select e.step + 1, e.d, {of("e")}, e.i, e.j, case when e.i = e.step then e.v / p.v else e.v - c.v * r.v / p.v end
   from solved e join solved p on {on("p", "e")} and p.i = e.step and p.j = e.step join solved r on {on("r", "e")} and r.i = e.step and r.j = e.j
   join solved c on {on("c", "e")} and c.i = e.i and c.j = e.step where e.step < e.d),
 found as (select {keys}, i, v from solved where step = d and j = 99),
 waves as (select {of("c")}, (c.i - 2) // 2 as k, c.v as p, s.v as q from found c join found s on {on("c", "s")} and s.i = c.i + 1 where c.i >= 2 and c.i % 2 = 0)
 select {of("w")}, list_filter({named}, lambda z: z.speed = u.speeds[w.k + 1])[1].name as constituent, sqrt(p * p + q * q) as a,
   ((degrees(atan2(q, p)) % 360.0E0) + 360.0E0) % 360.0E0 as g from waves w join used u on {on("w", "u")})"""


@query("harmonic_fit_W04", "port:int constituent:s a:d g:d",
       "select port, constituent, a, g from " + full_fit_sql("select port, epoch_us(time) as us, ssh_obs as y from {tg_dense}", ["port"], 30))
def _(t):
    return A.harmonic_fit(t("tg_dense"), "ssh_obs", constituents=A.CONSTITUENTS, minimum=30)


@query("harmonic_fit_whole_table_W04", "port:int constituent:s a:d g:d",
       "select port, constituent, a, g from " + full_fit_sql("select port, epoch_us(time) as us, ssh_obs as y from {tg_dense}", ["port"], 30, A.SPEEDS))
def _(t):
    return A.harmonic_fit(t("tg_dense"), "ssh_obs", minimum=30)


# Longitudes, argument and nodal factors of M2 and O1 by time, without the lines that depend on latitude.
SKY_SQL = """select *, {{m}} as sky_t, 218.3164477E0 + (481267.88123421E0 - 0.0015786E0 * {{m}}) * {{m}} as s, 280.46646E0 + (36000.76983E0 + 0.0003032E0 * {{m}}) * {{m}} as h,
 radians(125.0445479E0 + (-1934.1362891E0 + 0.0020754E0 * {{m}}) * {{m}}) as node, epoch_us(time) / 3.6E9 * 15 as sun from """.replace("{{m}}", "((epoch_us(time) / 3.6E9 - 262980) / 876600)")
NODAL_SQL = {
    "M2": ("1.0004E0 - 0.0373E0 * cos(node) + 0.0002E0 * cos(2 * node)", "2 * (sun + h - s) - 2.14E0 * sin(node)"),
    "O1": ("1.0089E0 + 0.1871E0 * cos(node) - 0.0147E0 * cos(2 * node) + 0.0014E0 * cos(3 * node)",
           "sun + h - 2 * s - 90 + 10.8E0 * sin(node) - 1.34E0 * sin(2 * node) + 0.19E0 * sin(3 * node)"),
}


def nodal_fit_sql(name: str) -> str:
    f, angle = NODAL_SQL[name]
    return f"""
with b as (select port, y, f * cos(w) as c, f * sin(w) as s from (select port, ssh_obs as y, {f} as f, radians(({angle}) % 360) as w from ({SKY_SQL} {{tg_dense}} where ssh_obs is not null))),
m as (select port, covar_pop(c, c) as cc, covar_pop(s, s) as ss, covar_pop(c, s) as cs, covar_pop(c, y) as cy, covar_pop(s, y) as sy from b group by port),
r as (select port, (cy * ss - sy * cs) / (cc * ss - cs * cs) as p, (sy * cc - cy * cs) / (cc * ss - cs * cs) as q from m)
select port, '{name}' as constituent, sqrt(p * p + q * q) as a, ((degrees(atan2(q, p)) % 360.0E0) + 360.0E0) % 360.0E0 as g from r"""


@query("harmonic_fit_nodal_W04", "port:int constituent:s a:d g:d", f"select * from ({nodal_fit_sql('M2')}) union all select * from ({nodal_fit_sql('O1')})")
def _(t):
    fits = [A.harmonic_fit(t("tg_dense"), "ssh_obs", constituents=[c], trend=False, nodal=True) for c in ("M2", "O1")]
    return fits[0].unionByName(fits[1])


FITTED = "case constituent " + " ".join(f"when '{c}' then {v!r}" for c, v in FIT_SPEEDS.items()) + " end"

BANDS = {"all": A.CONSTITUENTS, "semidiurnal": A.SEMIDIURNAL, "diurnal": A.DIURNAL}


def tide_sql(side: str) -> str:
    speeds = FITTED
    names = {b: ", ".join(f"'{c}'" for c in m) for b, m in BANDS.items()}
    one = f"f.a * cos(radians((epoch_us(e.time) / 3600000000.0E0 * {speeds}) % 360.0E0) - radians(f.g))"
    return (f"select e.port, e.time, " + ", ".join(f"sum(case when f.constituent in ({n}) then {one} end) as {b}" for b, n in names.items())
            + f" from {{tg_extract}} e left join (select * from {{tide_fit_a}} where source = '{side}') f on f.port = e.port group by e.port, e.time")


TIDES = f"""select e.port, e.time, e.ssh_obs, e.ssh_mod, o.diurnal as tide_obs_diurnal, o.semidiurnal as tide_obs_semidiurnal, o."all" as tide_obs_all,
 m.diurnal as tide_mod_diurnal, m.semidiurnal as tide_mod_semidiurnal, m."all" as tide_mod_all
 from {{tg_extract}} e join ({tide_sql('obs')}) o on o.port = e.port and o.time = e.time join ({tide_sql('mod')}) m on m.port = e.port and m.time = e.time"""
TIDES = TIDES.replace('as all from', 'as "all" from')


def tides(t):
    return A.reconstruct(t("tg_extract"), t("tide_fit_a"))


@query("tide_reconstruction_W05", "port:int time:t tide_obs_all:d tide_obs_semidiurnal:d tide_obs_diurnal:d tide_mod_all:d tide_mod_semidiurnal:d tide_mod_diurnal:d",
       TIDES.replace("as all", 'as "all"'))
def _(t):
    return tides(t)


def nodal_tide_sql(side: str) -> str:
    one = " ".join(f"when '{c}' then f.a * ({factor}) * cos(radians(({angle}) % 360) - radians(f.g))" for c, (factor, angle) in NODAL_SQL.items())
    return (f"select e.port, e.time, sum(case f.constituent {one} end) as tide from ({SKY_SQL} {{tg_extract}}) e "
            f"left join (select * from {{tide_fit_a}} where source = '{side}') f on f.port = e.port group by e.port, e.time")


@query("tide_reconstruction_nodal_W05", "port:int time:t tide_obs_all:d tide_mod_all:d", f"""
select o.port, o.time, o.tide as tide_obs_all, m.tide as tide_mod_all from ({nodal_tide_sql('obs')}) o join ({nodal_tide_sql('mod')}) m on m.port = o.port and m.time = o.time""")
def _(t):
    return A.reconstruct(t("tg_extract"), t("tide_fit_a"), constituents=["M2", "O1"], bands=("all",), nodal=True)


@query("tide_error_series_W06", "port:int time:t band:s tide_obs:d tide_mod:d tide_err:d tide_abs_err:d tide_square_err:d", " union all ".join(
    f"""select port, time, '{b}' as band, tide_obs_{b} as tide_obs, tide_mod_{b} as tide_mod, tide_mod_{b} - tide_obs_{b} as tide_err,
 abs(tide_mod_{b} - tide_obs_{b}) as tide_abs_err, pow(tide_mod_{b} - tide_obs_{b}, 2) as tide_square_err from ({TIDES})""" for b in BANDS).replace("as all", 'as "all"'))
def _(t):
    return A.tide_bands(tides(t))


@query("non_tidal_residual_W07", "port:int time:t ntr_obs:d ntr_mod:d ntr_err:d ntr_abs_err:d ntr_square_err:d", f"""
select port, time, o as ntr_obs, m as ntr_mod, m - o as ntr_err, abs(m - o) as ntr_abs_err, pow(m - o, 2) as ntr_square_err from
(select port, time, ssh_obs - tide_obs_all as o, ssh_mod - tide_mod_all as m from ({TIDES}))""".replace("as all", 'as "all"'))
def _(t):
    return R.with_residual(tides(t).withColumnsRenamed({"tide_obs_all": "tide_obs", "tide_mod_all": "tide_mod"}))


@query("smoothed_residual_W07", "port:int i:long ntr_obs:d ntr_mod:d ntr_err:d", f"""
select o.port, o.i, o.v as ntr_obs, m.v as ntr_mod, m.v - o.v as ntr_err from {smooth_sql(9, 2, 'ssh_obs')} o
join {smooth_sql(9, 2, 'ssh_mod')} m on m.port = o.port and m.i = o.i""")
def _(t):
    hours = slots.regular_hours(t("tg_dense")).withColumnsRenamed({"ssh_obs": "ntr_obs", "ssh_mod": "ntr_mod"})
    return R.smooth_residual(hours, window=9, order=2)


@query("constituent_lookup_J14", "port:int constituent:s a_obs:d a_mod:d a_err:d g_err:d", """
select p.port, c.constituent, t.a_obs, t.a_mod, t.a_mod - t.a_obs as a_err, (((t.g_mod - t.g_obs + 180.0E0) % 360.0E0) + 360.0E0) % 360.0E0 - 180.0E0 as g_err
from (select distinct port from {tide_pair_a}) p cross join (select unnest(['M2', 'S2', 'K1', 'O1']) as constituent) c
left join {tide_pair_a} t on t.port = p.port and t.constituent = c.constituent""")
def _(t):
    return A.lookup_constituents(A.constituent_table(t("tide_fit_a")), ["M2", "S2", "K1", "O1"])


@query("record_length_sweep_W09", "port:int length:int constituent:s a:d g:d", "select port, length, constituent, a, g from " + full_fit_sql(
    f"select g.port, l.length, epoch_us(time) as us, ssh as y from ({GRID}) g join (select unnest([25, 225, 425, 625, 720]) as length) l on g.i < l.length", ["port", "length"]))
def _(t):
    return A.record_length_sweep(slots.regular_hours(t("tg_dense")), "ssh", [25, 225, 425, 625, 720], constituents=A.CONSTITUENTS)


@query("record_length_sweep_whole_table_W09", "port:int length:int constituent:s a:d g:d", "select port, length, constituent, a, g from " + full_fit_sql(
    f"select g.port, l.length, epoch_us(time) as us, ssh as y from ({GRID}) g join (select unnest([25, 225, 425, 625, 720]) as length) l on g.i < l.length", ["port", "length"], 0, A.SPEEDS))
def _(t):
    return A.record_length_sweep(slots.regular_hours(t("tg_dense")), "ssh", [25, 225, 425, 625, 720])


# One constituent with trend: three regressors, solved from their covariances.
def one_fit(rows: str, by: str) -> str:
    """``rows`` has the ``by`` columns, y, s (trend), c, q (cosine, sine)."""
    return f"""
(select {by}, (i12 * y1 + i22 * y2 + i23 * y3) / d as p, (i13 * y1 + i23 * y2 + i33 * y3) / d as q from
 (select *, s13 * s23 - s12 * s33 as i12, s12 * s23 - s13 * s22 as i13, s11 * s33 - s13 * s13 as i22, s12 * s13 - s11 * s23 as i23, s11 * s22 - s12 * s12 as i33,
         s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13) as d from
  (select {by}, covar_pop(s, s) as s11, covar_pop(s, c) as s12, covar_pop(s, q) as s13, covar_pop(c, c) as s22, covar_pop(c, q) as s23, covar_pop(q, q) as s33,
          covar_pop(s, y) as y1, covar_pop(c, y) as y2, covar_pop(q, y) as y3 from ({rows}) group by {by})))"""


M2_ANGLE = f"radians((epoch_us(time) / 3600000000.0E0 * 28.9841042E0) % 360.0E0)"
M2_BASIS = f"cos({M2_ANGLE}) as c, sin({M2_ANGLE}) as q"


@query("record_length_sweep_one_constituent_W09", "port:int length:int constituent:s a:d g:d", f"""
select port, length, 'M2' as constituent, sqrt(p * p + q * q) as a, ((degrees(atan2(q, p)) % 360.0E0) + 360.0E0) % 360.0E0 as g from
{one_fit(f"select g.port, l.length, ssh as y, i / 720.0E0 as s, {M2_BASIS} from ({GRID}) g join (select unnest([25, 225, 425, 625, 720]) as length) l on g.i < l.length where ssh is not null", "port, length")}""")
def _(t):
    return A.record_length_sweep(slots.regular_hours(t("tg_dense")), "ssh", [25, 225, 425, 625, 720], constituents=["M2"])


@query("taylor_stats_A33", "constituent:s rms_obs:d rms_mod:d rms_err:d r:d n:long", """
select constituent, sqrt(avg(xo * xo + yo * yo)) as rms_obs, sqrt(avg(xm * xm + ym * ym)) as rms_mod, sqrt(avg(pow(xo - xm, 2) + pow(yo - ym, 2))) as rms_err,
       avg(xo * xm + yo * ym) / (sqrt(avg(xo * xo + yo * yo)) * sqrt(avg(xm * xm + ym * ym))) as r, count(*) as n from
(select constituent, a_obs * cos(radians(g_obs)) as xo, a_obs * sin(radians(g_obs)) as yo, a_mod * cos(radians(g_mod)) as xm, a_mod * sin(radians(g_mod)) as ym from {tide_pair_a})
group by constituent""")
def _(t):
    return A.taylor_stats(A.constituent_table(t("tide_fit_a")))


# ---- peaks ------------------------------------------------------------------------------
def peaks_sql(source: str, column: str, distance: int) -> str:
    """Greedy choice, highest first: a list of kept positions grows peak by peak."""
    return f"""(with c as (select port, i, v from (select port, i, {column} as v, lag({column}) over w as b, lead({column}) over w as f from ({source}) window w as (partition by port order by i)) where v > b and v > f),
 kept as (select port, list_reduce(list([i] order by v desc, i), lambda k, x: case when len(list_filter(k, lambda y: abs(y - x[1]) < {distance})) = 0 then list_concat(k, x) else k end) as k from c group by port)
 select c.port, c.i, c.v from c join kept on kept.port = c.port where list_contains(kept.k, c.i))"""


@query("peaks_W02", "port:int i:long ssh:d", f"select port, i, v as ssh from {peaks_sql(GRID, 'ssh', 12)}")
def _(t):
    return K.find_peaks(slots.regular_hours(t("tg_dense")), "ssh", 12)


@query("threshold_peaks_A20", "port:int threshold:d n_obs:long", over(f"select port, v as ssh_obs from {peaks_sql(GRID, 'ssh_obs', 12)}", {"n_obs": "ssh_obs"}))
def _(t):
    return H.exceedance(K.find_peaks(slots.regular_hours(t("tg_dense")), "ssh_obs", 12), {"n_obs": "ssh_obs"}, LEVELS)


@query("threshold_peaks_strict_A20", "port:int threshold:d n_obs:long", over(f"select port, v as ssh_obs from {peaks_sql(GRID, 'ssh_obs', 12)}", {"n_obs": "ssh_obs"}, ">"))
def _(t):
    return H.exceedance(K.find_peaks(slots.regular_hours(t("tg_dense")), "ssh_obs", 12), {"n_obs": "ssh_obs"}, LEVELS, strict=True)


# A tide-like curve for the skew surge: a smooth function of the hour, different per side.
TIDE_OBS = "1.0E0 + cos(radians(i * 28.9841042E0)) * 0.7E0 + i * 1.0E-7"
TIDE_MOD = "1.0E0 + cos(radians(i * 28.9841042E0 - 25.0E0)) * 0.65E0 + i * 1.0E-7"
SKEW_GRID = f"select port, time, i, n, ssh as ssh_obs, coalesce(ssh_mod, 0.4E0 + 0.0001E0 * (i % 7)) as ssh_mod, {TIDE_OBS} as tide_obs, {TIDE_MOD} as tide_mod from ({GRID})"


def skew_side(side: str) -> str:
    return f"""(select t.port, t.i, max(s.v) - any_value(t.v) as skew from {peaks_sql(SKEW_GRID, f'tide_{side}', 9)} t
 left join {peaks_sql(SKEW_GRID, f'ssh_{side}', 9)} s on s.port = t.port and abs(s.i - t.i) < 6 group by t.port, t.i)"""


SKEW = f"""
with o as {skew_side('obs')}, m as {skew_side('mod')},
e as (select port, min(i) as i0, max(i) as i1 from m group by port),
near as (select o.port, o.i, first(m.skew order by abs(m.i - o.i), m.i) as skew_mod from o join m on m.port = o.port join e on e.port = o.port where o.i between e.i0 and e.i1 group by o.port, o.i)
select o.port, g.time, o.skew as skew_obs, near.skew_mod, near.skew_mod - o.skew as skew_err from o join ({GRID}) g on g.port = o.port and g.i = o.i
left join near on near.port = o.port and near.i = o.i"""


def skew(t):
    i = F.col("i")
    hours = slots.regular_hours(t("tg_dense")).withColumns({
        "ssh_obs": F.col("ssh"), "ssh_mod": F.coalesce("ssh_mod", F.lit(0.4) + F.lit(0.0001) * (i % 7)),
        "tide_obs": F.lit(1.0) + F.cos(F.radians(i * F.lit(28.9841042))) * 0.7 + i * F.lit(1.0e-7),
        "tide_mod": F.lit(1.0) + F.cos(F.radians(i * F.lit(28.9841042) - 25.0)) * 0.65 + i * F.lit(1.0e-7)})
    return gauge_validation.skew_surges(hours)


@query("skew_surge_W08", "port:int time:t skew_obs:d skew_mod:d skew_err:d", SKEW)
def _(t):
    return skew(t)


@query("threshold_skew_A21", "port:int threshold:d n_obs:long n_mod:long", over(SKEW, {"n_obs": "skew_obs", "n_mod": "skew_mod"}))
def _(t):
    return H.exceedance(skew(t), {"n_obs": "skew_obs", "n_mod": "skew_mod"}, LEVELS)


@query("highest_within_six_hours_J15", "port:int time:t ssh_mod:d", """
select a.port, a.time, max(b.ssh_mod) as ssh_mod from {tg_extract} a
left join {tg_extract} b on b.port = a.port and abs(epoch_us(b.time) - epoch_us(a.time)) < 21600000000 group by a.port, a.time""")
def _(t):
    e = t("tg_extract")
    return T.highest_within(e.select("port", "time"), e, "ssh_mod", ["port"])


@query("nearest_time_transfer_J16", "port:int time:t ssh_mod:d", """
with m as (select port, time, ssh_mod from {tg_extract} where ssh_mod is not null), o as (select port, time from {tg_extract} where ssh_obs is not null),
e as (select port, min(time) as a, max(time) as b from m group by port)
select o.port, o.time, case when o.time between any_value(e.a) and any_value(e.b) then first(m.ssh_mod order by abs(epoch_us(m.time) - epoch_us(o.time)), m.time) end as ssh_mod
from o join m on m.port = o.port join e on e.port = o.port group by o.port, o.time""")
def _(t):
    e = t("tg_extract")
    return T.transfer_nearest(e.filter("ssh_mod is not null").select("port", "time", "ssh_mod"), e.filter("ssh_obs is not null"), "ssh_mod", ["port"])


@query("gauge_extraction_chain", "port:int time:t ssh_obs:d ssh_mod:d", f"""
with s as (select s.port, n.x, n.y from {{tg_station}} s join ({nearest_sql('tg_station', 60.0)}) n on s.lon = n.lon and s.lat = n.lat
           where s.lon between (select min(lon) from {{grid_cell}}) and (select max(lon) from {{grid_cell}}) and s.lat between (select min(lat) from {{grid_cell}}) and (select max(lat) from {{grid_cell}})),
k as (select s.port, g.t as time, g.ssh as v from s join {{grid_ssh}} g on g.x = s.x and g.y = s.y where g.ssh is not null),
o as (select e.port, e.time, e.ssh_obs from {{tg_daily}} e where e.port in (select port from s) and e.time between (select min(time) from k) and (select max(time) from k)),
b as (select o.*, p.time as tb, p.v as vb, n.time as ta, n.v as va from o asof left join k p on o.port = p.port and o.time >= p.time asof left join k n on o.port = n.port and o.time <= n.time),
m as (select port, time, ssh_obs, case when ta = tb then vb else vb + (va - vb) * (cast(epoch_us(time) - epoch_us(tb) as double) / cast(epoch_us(ta) - epoch_us(tb) as double)) end as ssh_mod from b)
select port, time, case when ssh_mod is not null then ssh_obs end as ssh_obs, case when ssh_obs is not null then ssh_mod end as ssh_mod from m""")
def _(t):
    return gauge_validation.gauge_extract(t("tg_daily").withColumnRenamed("ssh_obs", "ssh"), t("tg_station"), t("grid_cell"), t("grid_ssh"), 60.0)


@query("gauge_output_chain", "kind:s port:int threshold:d n_obs:long n_mod:long", f"""
with pairs as (select port, time, ssh_obs - avg(ssh_obs) over (partition by port) as ssh_obs, ssh_mod - avg(ssh_mod) over (partition by port) as ssh_mod
               from {{tg_dense}} where ssh_obs is not null and ssh_mod is not null qualify count(*) over (partition by port) >= 30),
long as (select port, 'obs' as source, ssh_obs as y, epoch_us(time) / 3.6E12 - 470.0E0 as s, {M2_BASIS} from pairs
         union all select port, 'mod' as source, ssh_mod as y, epoch_us(time) / 3.6E12 - 470.0E0 as s, {M2_BASIS} from pairs),
fit as {one_fit("select * from long", "port, source")},
v as (select e.port, e.time, e.ssh_obs - (o.p * cos({M2_ANGLE}) + o.q * sin({M2_ANGLE})) as ntr_obs, e.ssh_mod - (m.p * cos({M2_ANGLE}) + m.q * sin({M2_ANGLE})) as ntr_mod
      from pairs e join fit o on o.port = e.port and o.source = 'obs' join fit m on m.port = e.port and m.source = 'mod'),
d as (select port, date_trunc('day', time) as d, max(ntr_obs) as ntr_obs, max(ntr_mod) as ntr_mod from v group by 1, 2)
select 'threshold_hours' as kind, port, threshold, n_obs, n_mod from ({over('select * from v', BOTH)})
union all select 'threshold_days' as kind, port, threshold, n_obs, n_mod from ({over('select * from d', BOTH)})
union all select 'residuals', port, null, count(ntr_obs), count(ntr_mod) from v group by port
union all select 'tides', port, null, count(*), count(*) from {{tg_dense}} where port in (select port from v) group by port
union all select 'constituents', port, null, count(*), count(*) from (select distinct port from v) group by port""")
def _(t):
    base = stage_path(t.spark, uuid.uuid4().hex)
    gauge_validation.publish_gauge_tables(t("tg_dense").drop("ssh"), base, minimum=30, constituents=["M2"], nodal=False)
    read = lambda name: sink.read_published(t.spark, base, name).withColumn("kind", F.lit(name))
    out = [read(name).select("kind", "port", "threshold", "n_obs", "n_mod") for name in ("threshold_hours", "threshold_days")]
    counted = {"residuals": ("ntr_obs", "ntr_mod"), "tides": ("tide_obs", "tide_mod"), "constituents": ("a_obs", "a_mod")}
    for name, (first, second) in counted.items():
        rows = read(name).filter("band = 'all' and tide_obs is not null") if name == "tides" else read(name)
        out.append(rows.groupBy("kind", "port").agg(F.count(first).alias("n_obs"), F.count(second).alias("n_mod")))
    return scan.stack_tables(out)


@query("gauge_validation_end_to_end", "port:int season:s ssh_std_err:d ntr_mae:d ntr_rmse:d ntr_corr:d n:long", f"""
with pairs as (select port, time, ssh_obs - avg(ssh_obs) over (partition by port) as ssh_obs, ssh_mod - avg(ssh_mod) over (partition by port) as ssh_mod
               from {{tg_dense}} where ssh_obs is not null and ssh_mod is not null),
long as (select port, 'obs' as source, ssh_obs as y, epoch_us(time) / 3.6E12 - 470.0E0 as s, {M2_BASIS} from pairs
         union all select port, 'mod' as source, ssh_mod as y, epoch_us(time) / 3.6E12 - 470.0E0 as s, {M2_BASIS} from pairs),
fit as {one_fit("select * from long", "port, source")},
v as (select e.port, {season_sql('month(e.time)')} as season, e.ssh_obs, e.ssh_mod, e.ssh_obs - (o.p * cos({M2_ANGLE}) + o.q * sin({M2_ANGLE})) as ntr_obs,
             e.ssh_mod - (m.p * cos({M2_ANGLE}) + m.q * sin({M2_ANGLE})) as ntr_mod
      from pairs e join fit o on o.port = e.port and o.source = 'obs' join fit m on m.port = e.port and m.source = 'mod')
select port, season, ssh_std_err, ntr_mae, ntr_rmse, ntr_corr, n from (select port, case when grouping(season) = 1 then 'All' else season end as season, {STATS},
       case when grouping(season) = 1 or count(*) > 100 then corr(ntr_obs, ntr_mod) end as ntr_corr, count(*) as n from v group by grouping sets ((port, season), (port)))""")
def _(t):
    return gauge_validation.gauge_scores(t("tg_dense").drop("ssh"), minimum=30, constituents=["M2"])


PAIRS = """select port, time, ssh_obs - avg(ssh_obs) over (partition by port) as ssh_obs, ssh_mod - avg(ssh_mod) over (partition by port) as ssh_mod
               from {tg_dense} where ssh_obs is not null and ssh_mod is not null"""
PAIR_SIDES = f"select port, 'obs' as source, epoch_us(time) as us, ssh_obs as y from ({PAIRS}) union all select port, 'mod' as source, epoch_us(time) as us, ssh_mod as y from ({PAIRS})"


def scores_sql(chosen: dict[str, float]) -> str:
    speeds = "case constituent " + " ".join(f"when '{c}' then {v!r}" for c, v in chosen.items()) + " end"
    return f"""
with pairs as ({PAIRS} qualify count(*) over (partition by port) >= 30),
fit as (select * from {full_fit_sql(PAIR_SIDES, ["port", "source"], 0, chosen)}),
tide as (select e.port, e.time, sum(case when f.source = 'obs' then a * cos(radians((epoch_us(e.time) / 3.6E9 * {speeds}) % 360.0E0) - radians(f.g)) end) as tide_obs,
         sum(case when f.source = 'mod' then a * cos(radians((epoch_us(e.time) / 3.6E9 * {speeds}) % 360.0E0) - radians(f.g)) end) as tide_mod
         from pairs e left join fit f on f.port = e.port group by e.port, e.time),
v as (select e.port, {season_sql('month(e.time)')} as season, e.ssh_obs, e.ssh_mod, e.ssh_obs - tide_obs as ntr_obs, e.ssh_mod - tide_mod as ntr_mod
      from pairs e join tide t on t.port = e.port and t.time = e.time)
select port, season, ssh_std_err, ntr_mae, ntr_rmse, ntr_corr, n from (select port, case when grouping(season) = 1 then 'All' else season end as season, {STATS},
       case when grouping(season) = 1 or count(*) > 100 then corr(ntr_obs, ntr_mod) end as ntr_corr, count(ntr_obs - ntr_mod) as n from v group by grouping sets ((port, season), (port)))"""


SCORE_SPEC = "port:int season:s ssh_std_err:d ntr_mae:d ntr_rmse:d ntr_corr:d n:long"


@query("gauge_validation_main_constituents", SCORE_SPEC, scores_sql(FIT_SPEEDS))
def _(t):
    return gauge_validation.gauge_scores(t("tg_dense").drop("ssh"), minimum=30, constituents=A.CONSTITUENTS)


@query("gauge_validation_all_constituents", SCORE_SPEC, scores_sql(A.SPEEDS))
def _(t):
    return gauge_validation.gauge_scores(t("tg_dense").drop("ssh"), minimum=30, constituents=A.ALL)


@query("gauge_validation_whole_table", SCORE_SPEC, scores_sql(A.SPEEDS))
def _(t):
    return gauge_validation.gauge_scores(t("tg_dense").drop("ssh"), minimum=30)
