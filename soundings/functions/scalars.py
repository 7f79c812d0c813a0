"""Scalar column functions and the fixed number lists (all JVM-side expressions)."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = EARTH_RADIUS_KM * math.pi / 180.0

# Default domain box, seasons, quantiles, radii.
DOMAIN_LON = (-25.47, 16.25)
DOMAIN_LAT = (43.0, 64.5)
SEASONS = ("DJF", "MAM", "JJA", "SON")
QUANTILES = (0.02, 0.05, 0.25, 0.5, 0.75, 0.95, 0.98)
CRPS_RADII_KM = (0, 8, 14, 20)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- number lists: integer sequences, scaled afterwards, so no float drift ----

def reference_depths() -> list[float]:
    """134 depths: 2 m steps to 99, 5 m to 295, 50 m to 950, 100 m to 3900."""
    parts = (range(1, 100, 2), range(100, 300, 5), range(300, 1000, 50), range(1000, 4000, 100))
    return [float(d) for part in parts for d in part]


def thresholds(first_tenth: int = -4, last_tenth: int = 19) -> list[float]:
    """Threshold levels in metres, every 0.1 from ``first_tenth``/10 to ``last_tenth``/10."""
    return [k / 10 for k in range(first_tenth, last_tenth + 1)]


def record_lengths(first: int = 25, step: int = 1000, below: int = 8760) -> list[int]:
    """Record lengths in hours for the record-length sweep."""
    return list(range(first, below, step))


def layer_thickness(depths: list[float]) -> list[float]:
    """Cell thickness from mid-depth edges; both end cells copy their neighbour."""
    if len(depths) < 3:
        raise ValueError("thickness needs at least three depths")
    inner = [(b - a) / 2 for a, b in zip(depths, depths[2:])]
    return [inner[0], *inner, inner[-1]]


# ---- missing values, seasons, months ----

def nan_to_null(c) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def season(time) -> Column:
    """Season label from the month alone: December counts as DJF of any year."""
    return season_of_month(F.month(_col(time)))


def season_of_month(month) -> Column:
    month = _col(month)
    return (
        F.when(month.isin(12, 1, 2), "DJF")
        .when(month.isin(3, 4, 5), "MAM")
        .when(month.isin(6, 7, 8), "JJA")
        .when(month.isin(9, 10, 11), "SON")
    )


def month_key(time) -> Column:
    """Zero-padded ``yyyymm``."""
    return F.date_format(_col(time), "yyyyMM")


def month_list(first, last) -> Column:
    """Array of month starts from ``first`` up to, but without, the month of ``last``."""
    start = F.to_date(F.date_trunc("month", _col(first)))
    end = F.to_date(F.date_trunc("month", _col(last)))
    stop = F.add_months(end, -1)
    return F.when(stop >= start, F.sequence(start, stop, F.expr("interval 1 month"))).otherwise(
        F.array().cast("array<date>")
    )


def truncate_ntz(unit: str, time) -> Column:
    """``date_trunc`` that stays TIMESTAMP_NTZ."""
    return F.date_trunc(unit, _col(time)).cast("timestamp_ntz")


def epoch_micros(time: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column: exact, and free of any time zone."""
    t = F.col(time)
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def from_epoch_micros(micros) -> Column:
    """The TIMESTAMP_NTZ so many microseconds after the start of 1970."""
    seconds = _col(micros).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def epoch_hours(time: str) -> Column:
    return epoch_micros(time) / F.lit(3_600_000_000.0)


# ---- angles ----

def wrap_phase(g1, g2) -> Column:
    """g1 - g2 in degrees, wrapped to [-180, 180)."""
    return F.pmod(_col(g1) - _col(g2) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def unwrap_pair(mod, obs) -> Column:
    """Model phase moved by a turn when it sits on the other side of north from obs."""
    mod, obs = _col(mod), _col(obs)
    up = F.when(obs - mod > 250, mod + 360).otherwise(mod)
    return F.when(up - obs > 300, up - 360).otherwise(up)


def polar_x(amplitude, phase) -> Column:
    return _col(amplitude) * F.cos(F.radians(_col(phase)))


def polar_y(amplitude, phase) -> Column:
    return _col(amplitude) * F.sin(F.radians(_col(phase)))


def angle_from_correlation(r) -> Column:
    r = _col(r)
    return F.when(r.isNotNull(), F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))))


def bias_angle(first, second) -> Column:
    """Angle whose tangent is first/second (absolute errors); NULL when both are 0."""
    a, b = _col(first), _col(second)
    return F.when((a == 0) & (b == 0), None).otherwise(F.atan2(a, b))


def recentre_longitude(lon) -> Column:
    return F.pmod(_col(lon) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


# ---- distance ----

def great_circle_km(lon1, lat1, lon2, lat2, radius_km: float = EARTH_RADIUS_KM) -> Column:
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    return F.lit(2.0 * radius_km) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


# ---- bins ----

def interval_bin(x, low: float, high: float, n: int) -> Column:
    """0-based bin, right-closed as in (edge, next]; NULL outside (low, high]."""
    x = _col(x)
    width = (high - low) / n
    k = F.least(F.greatest(F.ceil((x - low) / width), F.lit(1)), F.lit(n)) - 1
    return F.when((x > low) & (x <= high), k.cast("int"))


def histogram_bin(x, low: float, high: float, n: int) -> Column:
    """0-based bin, left-closed, with a closed last bin; NULL outside [low, high]."""
    x = _col(x)
    width = (high - low) / n
    k = F.least(F.floor((x - low) / width), F.lit(n - 1))
    return F.when((x >= low) & (x <= high), k.cast("int"))


def bin_centre(k, low: float, high: float, n: int) -> Column:
    width = (high - low) / n
    return F.lit(low) + (_col(k).cast("double") + F.lit(0.5)) * F.lit(width)


# ---- NULL-safe arithmetic ----

def ratio(a, b) -> Column:
    return F.try_divide(_col(a), _col(b))


def std_from_moments(mean_square, mean) -> Column:
    """sqrt(E[x^2] - E[x]^2), with rounding below zero clamped."""
    ms, m = _col(mean_square), _col(mean)
    return F.sqrt(F.when(ms - m * m > 0, ms - m * m).when((ms - m * m).isNotNull(), F.lit(0.0)))
