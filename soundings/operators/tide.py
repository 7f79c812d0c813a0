"""Harmonic analysis, tide reconstruction and the record-length sweep."""
from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from soundings.functions.scalars import epoch_micros, polar_x, polar_y, ratio, wrap_phase
from soundings.operators import astro
from soundings.operators.slots import HOUR_MICROS

class Constituent(NamedTuple):
    """A row of a table of constituents: speed in degrees per hour; band is 'long', 'diurnal', 'semidiurnal' or 'shallow'."""

    name: str
    speed: float
    band: str


# Tidal constituents, largest first.  When two cannot be told apart, the one
# that stands first is kept.
KNOWN = (
    Constituent("M2", 28.9841042, "semidiurnal"), Constituent("S2", 30.0, "semidiurnal"), Constituent("K1", 15.0410686, "diurnal"),
    Constituent("O1", 13.9430356, "diurnal"), Constituent("N2", 28.4397295, "semidiurnal"), Constituent("P1", 14.9589314, "diurnal"),
    Constituent("K2", 30.0821373, "semidiurnal"), Constituent("Q1", 13.3986609, "diurnal"), Constituent("M4", 57.9682084, "shallow"),
    Constituent("SA", 0.0410686, "long"), Constituent("SSA", 0.0821373, "long"), Constituent("MF", 1.0980331, "long"),
    Constituent("MM", 0.5443747, "long"), Constituent("NU2", 28.5125831, "semidiurnal"), Constituent("MU2", 27.9682084, "semidiurnal"),
    Constituent("L2", 29.5284789, "semidiurnal"), Constituent("T2", 29.9589333, "semidiurnal"), Constituent("2N2", 27.8953548, "semidiurnal"),
    Constituent("J1", 15.5854433, "diurnal"), Constituent("M1", 14.4966939, "diurnal"), Constituent("OO1", 16.1391017, "diurnal"),
    Constituent("RHO1", 13.4715145, "diurnal"), Constituent("2Q1", 12.8542862, "diurnal"), Constituent("S1", 15.0, "diurnal"),
    Constituent("LAM2", 29.4556253, "semidiurnal"), Constituent("R2", 30.0410667, "semidiurnal"), Constituent("2SM2", 31.0158958, "semidiurnal"),
    Constituent("MSF", 1.0158958, "long"), Constituent("MS4", 58.9841042, "shallow"), Constituent("MN4", 57.4238337, "shallow"),
    Constituent("S4", 60.0, "shallow"), Constituent("M6", 86.9523127, "shallow"), Constituent("MK3", 44.0251729, "shallow"),
    Constituent("2MK3", 42.9271398, "shallow"), Constituent("M3", 43.4761563, "shallow"), Constituent("S6", 90.0, "shallow"),
    Constituent("M8", 115.9364166, "shallow"),
)
SPEEDS = {c.name: c.speed for c in KNOWN}
SEMIDIURNAL = ("M2", "S2", "K2", "N2")
DIURNAL = ("K1", "O1", "P1", "Q1")
CONSTITUENTS = ("M2", "S2", "K2", "N2", "K1", "O1", "P1", "Q1")
ALL = tuple(c.name for c in KNOWN)


def constituents_of(wanted) -> list[Constituent]:
    """Rows of the table for names, which come in the table's order; rows given as such are kept as they are."""
    own = [c for c in wanted if isinstance(c, Constituent)]
    names = {c for c in wanted if not isinstance(c, Constituent)}
    unknown = sorted(names - set(SPEEDS))
    if unknown:
        raise ValueError(f"unknown constituents {unknown}: give them as Constituent(name, speed, band)")
    return own + [c for c in KNOWN if c.name in names]


def resolvable(constituents, hours: float) -> list[str]:
    """Constituents a record of ``hours`` can separate (Rayleigh criterion)."""
    kept: list[Constituent] = []
    for one in constituents_of(constituents):
        if all(hours >= 360.0 / abs(one.speed - other) for other in [k.speed for k in kept] + [0.0]):
            kept.append(one)
    return [c.name for c in kept]


def phase_angle(constituent: str | Constituent, hours: Column) -> Column:
    """Angle in radians of a constituent, reduced to one turn before it is converted."""
    speed = constituents_of([constituent])[0].speed
    return F.radians(F.pmod(hours * F.lit(speed), F.lit(360.0)))


#: A task keeps sums of so many records before it passes them on.
HELD = 128


def _basis(micros: np.ndarray, centred: np.ndarray, constituents: list[Constituent], trend: bool,
           nodal: bool = False, latitude: np.ndarray | None = None) -> np.ndarray:
    """One column for each unknown: constant, trend, and a cosine and a sine of each constituent."""
    hours = micros / float(HOUR_MICROS)
    angles = np.outer(hours, [c.speed for c in constituents])
    factors = np.ones_like(angles)
    if nodal:
        at = astro.sky(hours)
        for k, c in enumerate(constituents):
            if astro.known(c.name):
                f, u = astro.nodal(c.name, at, np, latitude)
                angles[:, k], factors[:, k] = astro.argument(c.name, at) + u, f
    angles = np.radians(angles % 360.0)
    waves = np.stack([factors * np.cos(angles), factors * np.sin(angles)], axis=2).reshape(len(hours), -1)
    return np.column_stack([np.ones(len(hours)), *([centred] if trend else []), waves])


def _summing(keys: list[str], constituents: list[Constituent], trend: bool, nodal: bool = False):
    """Products of all unknowns' columns with each other and with the record, summed per task and record."""
    def add(batches):
        held: dict[tuple, list] = {}

        def out():
            rows = [(*k, n, a, b, products.tobytes()) for k, (n, a, b, products) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*keys, "_n", "_u0", "_u1", "_sums"])

        for batch in batches:
            for key, own in batch.groupby(keys, dropna=False):
                micros = own["_us"].to_numpy()
                latitude = own["_lat"].to_numpy(float) if "_lat" in own else None
                columns = np.column_stack([_basis(micros, own["_c"].to_numpy(), constituents, trend, nodal, latitude), own["_y"].to_numpy()])
                have = held.setdefault(tuple(key), [0, micros[0], micros[0], 0.0])
                have[0] += len(own)
                have[1], have[2] = min(have[1], micros.min()), max(have[2], micros.max())
                have[3] = have[3] + columns.T @ columns
            if len(held) >= HELD:
                yield out()
        yield out()
    return add


def _unpacked(blob: bytes) -> np.ndarray:
    flat = np.frombuffer(blob, np.float64)
    return flat.reshape(int(round(len(flat) ** 0.5)), -1)


def _solve(m: np.ndarray, n: int, hours: float, constituents: list[Constituent], trend: bool) -> list[tuple[str, float, float]]:
    """(name, amplitude, phase) of the constituents the record resolves; none if the sums do not determine them."""
    names = resolvable(constituents, hours)
    first = 2 if trend else 1
    place = {c.name: first + 2 * k for k, c in enumerate(constituents)}
    use = [*range(first), *(i for c in constituents if c.name in names for i in (place[c.name], place[c.name] + 1))]
    if n < len(use) or not names:
        return []
    left, right = m[np.ix_(use, use)], m[use, -1]
    scale = np.sqrt(np.diag(left))
    if not np.all(scale > 0):
        return []
    fit, _, rank, _ = np.linalg.lstsq(left / np.outer(scale, scale), right / scale, rcond=1e-12)
    if rank < len(use):
        return []
    value = dict(zip(use, fit / scale))
    return [(c, math.hypot(value[place[c]], value[place[c] + 1]), math.degrees(math.atan2(value[place[c] + 1], value[place[c]])) % 360.0) for c in names]


def _schema(df: DataFrame, keys) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


FIT = ", constituent string, a double, g double"
SUMS = ", _n long, _u0 long, _u1 long, _sums binary"


def harmonic_fit(series: DataFrame, value: str, keys=("port",), constituents=ALL, trend: bool = True,
                 time="time", minimum: int = 0, nodal: bool = False, latitude: str | None = None) -> DataFrame:
    """(keys, constituent, a, g): least-squares amplitude and phase lag in degrees.

    ``constituents`` are names of the table or own ``Constituent`` rows.  The record itself is only summed:
    each task adds up one small matrix of products per record, so a record of any length
    becomes a row per task; those meet and are solved.

    Without ``nodal`` phases refer to 1970-01-01.  With it they are lags behind the astronomical
    argument at Greenwich, and every value is fitted with the nodal factors of its own time, so
    amplitudes do not depend on the years of the record; ``latitude`` names a column of degrees
    for the factors' part that depends on it (none of it where that is NULL).  Own constituents
    have no astronomical argument and are fitted as without.
    """
    keys, chosen = list(keys), constituents_of(constituents)
    rows = series.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_y"), epoch_micros(time).alias("_us"), *_latitude_column(nodal, latitude))
    if trend:
        span = rows.groupBy(*keys).agg(F.min("_us").alias("_u0"), F.max("_us").alias("_u1"))
        rows = rows.join(span, keys).withColumn(
            "_c", ratio(F.col("_us") - (F.col("_u0") + F.col("_u1")) / 2, F.greatest(F.col("_u1") - F.col("_u0"), F.lit(1)) / 2)).drop("_u0", "_u1")
    else:
        rows = rows.withColumn("_c", F.lit(0.0))

    def solve(key, parts):
        n, hours = int(parts["_n"].sum()), (parts["_u1"].max() - parts["_u0"].min()) / HOUR_MICROS + 1
        found = _solve(sum(_unpacked(s) for s in parts["_sums"]), n, hours, chosen, trend) if n >= minimum else []
        return pd.DataFrame([(*key, *f) for f in found], columns=[*keys, "constituent", "a", "g"])

    return rows.mapInPandas(_summing(keys, chosen, trend, nodal), _schema(series, keys) + SUMS).groupBy(*keys).applyInPandas(
        solve, _schema(series, keys) + FIT)


def _latitude_column(nodal: bool, latitude: str | None) -> list[Column]:
    return [astro.off_equator(F.col(latitude)).alias("_lat")] if nodal and latitude else []


def record_length_sweep(series: DataFrame, value: str, lengths, keys=("port",), constituents=ALL,
                        time="time", nodal: bool = False, latitude: str | None = None) -> DataFrame:
    """(keys, length, constituent, a, g) of the first ``length`` hours for each length; ``nodal`` and ``latitude`` as in ``harmonic_fit``.

    A row is summed once, into the shortest length it belongs to; sums of longer records
    are running totals over those few rows.  ``series`` comes from ``regular_hours``.
    """
    keys, chosen, lengths = list(keys), constituents_of(constituents), sorted(lengths)
    step = F.lit(None).cast("int")
    for length in reversed(lengths):
        step = F.when(F.col("i") < length, F.lit(length)).otherwise(step)
    rows = (
        series.filter(F.col(value).isNotNull())
        .select(*keys, step.alias("length"), F.col(value).cast("double").alias("_y"), epoch_micros(time).alias("_us"),
                (F.col("i") / F.lit(float(lengths[-1]))).alias("_c"), *_latitude_column(nodal, latitude))
        .filter(F.col("length").isNotNull())
    )
    by = [*keys, "length"]

    def solve(key, parts):
        out, n, total, first, last = [], 0, 0.0, None, None
        for length, own in parts.sort_values("length").groupby("length"):
            n += int(own["_n"].sum())
            total = total + sum(_unpacked(s) for s in own["_sums"])
            first = own["_u0"].min() if first is None else min(first, own["_u0"].min())
            last = own["_u1"].max() if last is None else max(last, own["_u1"].max())
            out += [(*key, length, *f) for f in _solve(total, n, (last - first) / HOUR_MICROS + 1, chosen, True)]
        return pd.DataFrame(out, columns=[*by, "constituent", "a", "g"])

    return rows.mapInPandas(_summing(by, chosen, True, nodal), _schema(rows, by) + SUMS).groupBy(*keys).applyInPandas(
        solve, _schema(rows, by) + FIT)


def constituent_table(fits: DataFrame, keys=("port",)) -> DataFrame:
    """Observed and modelled amplitude and phase side by side, with errors.

    Only constituents the observed fit resolved; the phase error is wrapped.
    ``fits`` has ``source`` = obs or mod.
    """
    keys = [*keys, "constituent"]
    obs = fits.filter("source = 'obs'").select(*keys, F.col("a").alias("a_obs"), F.col("g").alias("g_obs"))
    mod = fits.filter("source = 'mod'").select(*keys, F.col("a").alias("a_mod"), F.col("g").alias("g_mod"))
    return obs.join(mod, keys, "left").withColumn("a_err", F.col("a_mod") - F.col("a_obs")).withColumn(
        "g_err", wrap_phase("g_mod", "g_obs"))


def lookup_constituents(table: DataFrame, wanted, keys=("port",)) -> DataFrame:
    """One row per station and wanted constituent; unresolved ones have NULL values."""
    every = table.select(*keys).distinct().withColumn(
        "constituent", F.explode(F.array(*[F.lit(c) for c in wanted])))
    return every.join(table, [*keys, "constituent"], "left")


def reconstruct(times: DataFrame, fits: DataFrame, keys=("port",), constituents=ALL, time="time",
                bands=("all", "semidiurnal", "diurnal"), nodal: bool = False, latitude: str | None = None) -> DataFrame:
    """``times`` with tide_<side>_<band> for the sides in ``fits.source`` and the bands asked for.

    The few fitted values of a station are turned into columns first, so each time gets
    its tides by arithmetic in one row instead of a join and a sum per constituent; the cosine and
    sine of a constituent are worked out once for all bands and sides.  A station without a fit
    keeps its rows, with NULL tides.  ``nodal`` and ``latitude`` (a column of ``times``) have to be those of the fit.
    """
    members = {"all": None, "semidiurnal": SEMIDIURNAL, "diurnal": DIURNAL}
    keys, chosen, sides = list(keys), constituents_of(constituents), ("obs", "mod")
    chosen = [c for c in chosen if any(members[b] is None or c.name in members[b] for b in bands)]
    own = lambda side, c: (F.col("source") == side) & (F.col("constituent") == c.name)
    lag = F.radians("g")
    wide = fits.groupBy(*keys).agg(*[
        F.max(F.when(own(side, c), F.col("a") * part)).alias(f"_{name}_{side}_{c.name}")
        for side in sides for c in chosen for name, part in (("x", F.cos(lag)), ("y", F.sin(lag)))])
    hours = epoch_micros(time) / F.lit(float(HOUR_MICROS))
    out = times.join(wide, keys, "left").withColumn("_hours", hours)
    lat = None
    if nodal:
        out = out.withColumns({f"_{name}": value for name, value in astro.sky(F.col("_hours"))._asdict().items()})
        if latitude:
            out, lat = out.withColumn("_lat", astro.off_equator(F.col(latitude))), F.col("_lat")
    at, waves, given = astro.Sky(*(F.col(f"_{name}") for name in astro.Sky._fields)), {}, {}
    if nodal:
        # the factors of each base as columns of their own, which compounds and both waves use again
        needed = sorted({base for c in chosen if astro.known(c.name) for base in astro.bases(c.name)})
        factors = {base: astro.nodal(base, at, F, lat) for base in needed}
        out = out.withColumns({f"_{part}_{base}": F.lit(0.0) + value for base, pair in factors.items() for part, value in zip("fu", pair)})
        given = {base: (F.col(f"_f_{base}"), F.col(f"_u_{base}")) for base in needed}
    for c in chosen:
        angle, f = phase_angle(c, F.col("_hours")), F.lit(1.0)
        if nodal and astro.known(c.name):
            f, u = astro.nodal(c.name, at, F, lat, given)
            angle = F.radians(F.pmod(astro.argument(c.name, at) + u, F.lit(360.0)))
        waves |= {f"_c_{c.name}": F.cos(angle) * f, f"_s_{c.name}": F.sin(angle) * f}
    out = out.withColumns(waves)
    tides = {}
    for side in sides:
        for band in bands:
            terms, known = [], []
            for c in chosen:
                if members[band] is None or c.name in members[band]:
                    x, y = F.col(f"_x_{side}_{c.name}"), F.col(f"_y_{side}_{c.name}")
                    terms.append(F.coalesce(x * F.col(f"_c_{c.name}") + y * F.col(f"_s_{c.name}"), F.lit(0.0)))
                    known.append(x)
            total = F.aggregate(F.array(*terms), F.lit(0.0), lambda x, y: x + y) if terms else F.lit(0.0)
            tides[f"tide_{side}_{band}"] = F.when(F.coalesce(*known).isNotNull(), total) if known else F.lit(None).cast("double")
    return out.withColumns(tides).select(*times.columns, *tides)


def tide_bands(reconstructed: DataFrame, keys=("port",), time="time") -> DataFrame:
    """(keys, time, band, tide_obs, tide_mod, errors) in long form."""
    parts = F.array(*[
        F.struct(F.lit(b).alias("band"), F.col(f"tide_obs_{b}").alias("tide_obs"), F.col(f"tide_mod_{b}").alias("tide_mod"))
        for b in ("diurnal", "semidiurnal", "all")])
    long = reconstructed.select(*keys, time, F.inline(parts))
    d = F.col("tide_mod") - F.col("tide_obs")
    return long.withColumns({"tide_err": d, "tide_abs_err": F.abs(d), "tide_square_err": d * d})


def taylor_stats(table: DataFrame, keys=("constituent",)) -> DataFrame:
    """Vector statistics over stations: RMS amplitudes, RMS error, correlation, angle."""
    xo, yo, xm, ym = polar_x("a_obs", "g_obs"), polar_y("a_obs", "g_obs"), polar_x("a_mod", "g_mod"), polar_y("a_mod", "g_mod")
    sums = table.groupBy(*keys).agg(
        F.sqrt(F.avg(xo * xo + yo * yo)).alias("rms_obs"), F.sqrt(F.avg(xm * xm + ym * ym)).alias("rms_mod"),
        F.sqrt(F.avg((xo - xm) * (xo - xm) + (yo - ym) * (yo - ym))).alias("rms_err"),
        F.avg(xo * xm + yo * ym).alias("_inner"), F.count(F.lit(1)).alias("n"))
    r = ratio("_inner", F.col("rms_obs") * F.col("rms_mod"))
    return sums.withColumn("r", r).drop("_inner")
