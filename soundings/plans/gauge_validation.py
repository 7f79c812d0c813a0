"""Tide-gauge validation: from gauges and model field to extracted series, and on to all tables per station."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from soundings.functions.scalars import season, thresholds
from soundings.operators.clean import cut_to_model_period, enough_data, shared_missing, within_extent_of
from soundings.operators.error import demean, tide_gauge_stats
from soundings.operators.matchup import model_series
from soundings.operators.peaks import find_peaks, skew_surge
from soundings.operators.series import smooth_residual, with_residual
from soundings.operators.slots import regular_hours
from soundings.operators.spatial import nearest_cell
from soundings.operators.threshold import exceedance, period_maxima
from soundings.operators.tide import ALL, constituent_table, harmonic_fit, reconstruct, tide_bands
from soundings.operators.timejoin import interpolate_in_time
from soundings.schema import one_run
from soundings.session import cut_lineage
from soundings.sources.sink import publish


def gauge_extract(series: DataFrame, stations: DataFrame, cells: DataFrame, field: DataFrame, max_km: float = 5.0,
                  run: str | None = None) -> DataFrame:
    """(port, time, ssh_obs, ssh_mod) at the times observed: the model's value, linear in time, at each gauge's cell.

    Stations outside the grid's extent or farther than ``max_km`` from a sea cell are left out, and so are times
    outside the model's period.  A value missing on one side is missing on both.  ``series`` has port, time and ssh,
    ``stations`` port, lon and lat; ``field`` (x, y, t, ssh) is read for the stations' cells alone (see
    ``sources.clustered`` for a layout in which that spares most of it).
    """
    cells, field = one_run(cells, run), one_run(field, run)
    matched = cut_lineage(nearest_cell(within_extent_of(stations, cells), cells, max_km).select("port", "x", "y"))
    model = cut_lineage(model_series(matched, field.filter("ssh is not null")))
    observed = series.select("port", "time", F.col("ssh").alias("ssh_obs")).join(matched.select("port"), "port", "left_semi")
    observed = cut_lineage(cut_to_model_period(observed, model, model_time="time"))
    at_obs = interpolate_in_time(model, observed.select("port", "time"), "ssh", ["port"]).withColumnRenamed("ssh", "ssh_mod")
    return shared_missing(observed.join(at_obs.select("port", "time", "ssh_mod"), ["port", "time"], "left"))


def both_sides(series: DataFrame, prefix: str = "ssh") -> DataFrame:
    """(port, time, source, value) from the two columns."""
    return series.select("port", "time", F.inline(F.array(
        F.struct(F.lit("obs").alias("source"), F.col(f"{prefix}_obs").alias(prefix)),
        F.struct(F.lit("mod").alias("source"), F.col(f"{prefix}_mod").alias(prefix)))))


def residual_series(extract: DataFrame, minimum: int = 4380, constituents=ALL) -> DataFrame:
    """Shared mask, minimum data, demeaned, tide fitted on both sides and subtracted."""
    kept = enough_data(shared_missing(extract), ["ssh_obs", "ssh_mod"], minimum)
    centred = demean(kept, ["ssh_obs", "ssh_mod"])
    fits = harmonic_fit(both_sides(centred), "ssh", ("port", "source"), constituents)
    tides = reconstruct(centred, fits, constituents=constituents)
    return with_residual(tides.withColumnsRenamed({"tide_obs_all": "tide_obs", "tide_mod_all": "tide_mod"}))


def gauge_tables(extract: DataFrame, minimum: int = 4380, constituents=ALL, nodal: bool = True, latitudes: DataFrame | None = None,
                 levels=None) -> dict[str, DataFrame]:
    """All tables of a gauge analysis, from one fit: constituents, tides, residuals, scores, threshold_hours, threshold_days.

    ``nodal`` fits with astronomical arguments and nodal factors, and with ``latitudes`` (port, lat) with their part
    that depends on latitude.  The fit and the residual series are written once and read by all tables.
    """
    levels = thresholds() if levels is None else levels
    kept = enough_data(shared_missing(extract), ["ssh_obs", "ssh_mod"], minimum)
    centred = demean(kept, ["ssh_obs", "ssh_mod"])
    lat = "lat" if nodal and latitudes is not None else None
    if lat:
        centred = centred.join(latitudes.select("port", "lat"), "port", "left")
    centred = cut_lineage(centred)
    long = both_sides(centred)
    if lat:
        long = long.join(latitudes.select("port", "lat"), "port", "left")
    fits = cut_lineage(harmonic_fit(long, "ssh", ("port", "source"), constituents, nodal=nodal, latitude=lat))
    tides = cut_lineage(reconstruct(centred, fits, constituents=constituents, nodal=nodal, latitude=lat))
    residuals = cut_lineage(with_residual(tides.withColumnsRenamed({"tide_obs_all": "tide_obs", "tide_mod_all": "tide_mod"})).withColumn("season", season("time")))
    sides = {"n_obs": "ntr_obs", "n_mod": "ntr_mod"}
    return {
        "constituents": constituent_table(fits),
        "tides": tide_bands(tides),
        "residuals": residuals.select("port", "time", "season", "ssh_obs", "ssh_mod", "ntr_obs", "ntr_mod"),
        "scores": tide_gauge_stats(residuals),
        "threshold_hours": exceedance(residuals, sides, levels),
        "threshold_days": exceedance(period_maxima(residuals, ["ntr_obs", "ntr_mod"], "day"), sides, levels),
    }


def publish_gauge_tables(extract: DataFrame, base_path: str, **choices) -> str:
    """``gauge_tables``, published together (see ``sink.publish``)."""
    return publish({name: (df, ()) for name, df in gauge_tables(extract, **choices).items()}, base_path)


def gauge_scores(extract: DataFrame, minimum: int = 4380, smoothed: bool = False, constituents=ALL) -> DataFrame:
    """Error statistics of sea level and residual per station, by season and for all."""
    series = residual_series(extract, minimum, constituents)
    if smoothed:
        series = cut_lineage(series)  # read three times below
        smooth = smooth_residual(regular_hours(series.select("port", "time", "ntr_obs", "ntr_mod")))
        series = series.select("port", "time", "ssh_obs", "ssh_mod").join(smooth, ["port", "time"], "left")
    return tide_gauge_stats(series.withColumn("season", season("time")))


def skew_surges(hours: DataFrame, distance: int = 9) -> DataFrame:
    """Skew surges of regular series holding ssh and tide of both sides."""
    long = hours.select("port", "time", "i", F.inline(F.array(*[
        F.struct(F.lit(s).alias("source"), F.col(f"tide_{s}").alias("tide"), F.col(f"ssh_{s}").alias("ssh"))
        for s in ("obs", "mod")])))
    by = ("port", "source")
    return skew_surge(find_peaks(long, "tide", distance, by), find_peaks(long, "ssh", distance, by))
