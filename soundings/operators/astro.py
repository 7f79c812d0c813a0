"""Astronomical arguments of tidal constituents, and nodal factors by time and latitude.

A constituent is A f cos(V + u - g): V follows the mean longitudes of moon and sun, f and u
the moon's node (18.6 years) and perigee.  Formulas take ``m``, a module with cos, sin,
radians, atan2 and sqrt: numpy inside tasks, ``pyspark.sql.functions`` in column expressions.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

#: Hours from 1970-01-01 00:00 to 2000-01-01 12:00.
J2000 = 262_980.0
CENTURY = 876_600.0

# Mean longitudes in degrees as polynomials in Julian centuries from 2000-01-01
# 12:00: moon, sun, lunar perigee, lunar node, solar perigee.
LONGITUDES = {
    "s": (218.3164477, 481267.88123421, -0.0015786),
    "h": (280.46646, 36000.76983, 0.0003032),
    "p": (83.3532465, 4069.0137287, -0.01032),
    "n": (125.0445479, -1934.1362891, 0.0020754),
    "p1": (282.93735, 1.71946, 0.00046),
}

# Multiples of lunar time, moon, sun, lunar perigee and solar perigee, then degrees.
ARGUMENTS = {
    "SA": (0, 0, 1, 0, 0, 0), "SSA": (0, 0, 2, 0, 0, 0), "MM": (0, 1, 0, -1, 0, 0), "MF": (0, 2, 0, 0, 0, 0),
    "2Q1": (1, -3, 0, 2, 0, -90), "Q1": (1, -2, 0, 1, 0, -90), "RHO1": (1, -2, 2, -1, 0, -90), "O1": (1, -1, 0, 0, 0, -90),
    "M1": (1, 0, 0, 1, 0, 90), "P1": (1, 1, -2, 0, 0, -90), "S1": (1, 1, -1, 0, 0, 180), "K1": (1, 1, 0, 0, 0, 90),
    "J1": (1, 2, 0, -1, 0, 90), "OO1": (1, 3, 0, 0, 0, 90),
    "2N2": (2, -2, 0, 2, 0, 0), "MU2": (2, -2, 2, 0, 0, 0), "N2": (2, -1, 0, 1, 0, 0), "NU2": (2, -1, 2, -1, 0, 0),
    "M2": (2, 0, 0, 0, 0, 0), "LAM2": (2, 1, -2, 1, 0, 180), "L2": (2, 1, 0, -1, 0, 180), "T2": (2, 2, -3, 0, 1, 0),
    "S2": (2, 2, -2, 0, 0, 0), "R2": (2, 2, -1, 0, -1, 180), "K2": (2, 2, 0, 0, 0, 0), "M3": (3, 0, 0, 0, 0, 180),
}

#: Shallow-water constituents as multiples of others: arguments and u add up, f multiplies.
COMPOUND = {
    "MSF": {"S2": 1, "M2": -1}, "2SM2": {"S2": 2, "M2": -1}, "MK3": {"M2": 1, "K1": 1}, "2MK3": {"M2": 2, "K1": -1},
    "M4": {"M2": 2}, "MN4": {"M2": 1, "N2": 1}, "MS4": {"M2": 1, "S2": 1}, "S4": {"S2": 2}, "M6": {"M2": 3}, "S6": {"S2": 3}, "M8": {"M2": 4},
}

# F as cosines, u as sines (degrees) of 0, 1, 2, 3 times the node's longitude.
SERIES = {
    "MM": ((1.0, -0.13, 0.0013), (0.0,)),
    "MF": ((1.0429, 0.4135, -0.004), (0.0, -23.74, 2.68, -0.38)),
    "O1": ((1.0089, 0.1871, -0.0147, 0.0014), (0.0, 10.8, -1.34, 0.19)),
    "K1": ((1.006, 0.115, -0.0088, 0.0006), (0.0, -8.86, 0.68, -0.07)),
    "J1": ((1.0129, 0.1676, -0.017, 0.0016), (0.0, -12.94, 1.34, -0.19)),
    "OO1": ((1.1027, 0.6504, 0.0317, -0.0014), (0.0, -36.68, 4.02, -0.57)),
    "M2": ((1.0004, -0.0373, 0.0002), (0.0, -2.14)),
    "K2": ((1.0241, 0.2863, 0.0083, -0.0015), (0.0, -17.74, 0.68, -0.04)),
}
#: Constituents that follow another's series; those in neither table have f = 1 and u = 0.
FOLLOWS = {"2Q1": "O1", "Q1": "O1", "RHO1": "O1", "2N2": "M2", "MU2": "M2", "N2": "M2", "NU2": "M2", "LAM2": "M2"}

# Side lines as (multiple of perigee, multiple of node, share, degrees).
LINES = {
    "M1": ((-2, 0, 0.3333, 0.0), (0, -1, 0.2, 0.0), (-2, 1, 0.0667, 0.0)),
    "L2": ((2, 0, -0.2505, 0.0), (2, -1, -0.1102, 0.0), (2, -2, -0.0156, 0.0), (0, 1, -0.037, 0.0)),
}
# Lines of the third-degree potential, whose share depends on latitude.
LATITUDE_LINES = {
    "Q1": ((-1, 2, 0.001, 270.0), (-1, 1, 0.0115, 270.0), (-1, 0, 0.0292, 270.0), (1, 0, 0.0018, 270.0)),
    "O1": ((-1, 0, 0.0003, 90.0), (1, 1, 0.0004, 90.0), (1, 0, 0.0029, 270.0), (1, -1, 0.0004, 90.0)),
    "K1": ((-1, 0, 0.0007, 90.0), (1, 0, 0.0002, 90.0)),
    "M2": ((-1, 0, 0.0004, 270.0), (1, 0, 0.0009, 270.0)),
    "K2": ((-1, 0, 0.0024, 270.0), (-1, -1, 0.0004, 270.0)),
}
#: Nearer to the equator than this, the shares of this latitude are used.
LEAST_LATITUDE = 5.0


class Sky(NamedTuple):
    """Mean longitudes at a time, and lunar time, in degrees."""

    tau: object
    s: object
    h: object
    p: object
    n: object
    p1: object


def off_equator(latitude: Column) -> Column:
    """Latitudes of less than ``LEAST_LATITUDE`` moved there, as the diurnal share has no value at the equator."""
    latitude = latitude.cast("double")
    return F.when(F.abs(latitude) < LEAST_LATITUDE, F.when(latitude < 0, -LEAST_LATITUDE).otherwise(LEAST_LATITUDE)).otherwise(latitude)


def sky(hours) -> Sky:
    """``hours`` since 1970-01-01 00:00 UTC, as a Column or an array."""
    t = (hours - J2000) / CENTURY
    at = {name: a + (b + c * t) * t for name, (a, b, c) in LONGITUDES.items()}
    return Sky(tau=(hours % 24.0) * 15.0 + at["h"] - at["s"], **at)


def known(name: str) -> bool:
    return name in ARGUMENTS or name in COMPOUND


def argument(name: str, at: Sky):
    """V in degrees, not reduced to one turn."""
    if name in COMPOUND:
        parts = [argument(base, at) * float(times) for base, times in COMPOUND[name].items()]
        return sum(parts[1:], parts[0])
    tau, s, h, p, p1, degrees = ARGUMENTS[name]
    parts = [getattr(at, place) * float(times) for place, times in (("tau", tau), ("s", s), ("h", h), ("p", p), ("p1", p1)) if times]
    return sum(parts[1:], parts[0]) + float(degrees)


def _cos(m, degrees):
    return m.cos(m.radians(degrees))


def _sin(m, degrees):
    return m.sin(m.radians(degrees))


def latitude_share(name: str, latitude, m):
    """Factor of the third-degree lines, diurnal or semidiurnal; none of them where the latitude is missing."""
    s = _sin(m, latitude)
    share = (1.0 - s * s * 5.0) / s * 0.36309 if ARGUMENTS[name][0] == 1 else s * 2.59808
    return m.nan_to_num(share) if hasattr(m, "nan_to_num") else m.coalesce(share, m.lit(0.0))


def bases(name: str) -> dict[str, float]:
    """Constituents whose nodal factors give those of ``name``, with their powers."""
    return COMPOUND.get(name) or ({"M2": 1.5} if name == "M3" else {name: 1})


def nodal(name: str, at: Sky, m, latitude=None, given: dict | None = None):
    """f, and u in degrees.  ``latitude`` in degrees adds the lines that depend on it; see ``off_equator``.

    ``given`` has (f, u) of ``bases`` that are worked out already.
    """
    if given and name in given:
        return given[name]
    if list(bases(name)) != [name]:
        f, u = 1.0, 0.0
        for base, times in bases(name).items():
            own_f, own_u = nodal(base, at, m, latitude, given)
            f, u = f * own_f ** abs(times), u + own_u * float(times)
        return f, u
    series = SERIES.get(FOLLOWS.get(name, name))
    f, u = 1.0, 0.0
    if series:
        f = sum((_cos(m, at.n * float(k)) * c for k, c in enumerate(series[0]) if k), series[0][0])
        u = sum((_sin(m, at.n * float(k)) * c for k, c in enumerate(series[1]) if k), 0.0)
    lines = [(p, n, share, degrees) for p, n, share, degrees in LINES.get(name, ())]
    if latitude is not None:
        by_latitude = latitude_share(name, latitude, m) if name in LATITUDE_LINES else None
        lines += [(p, n, by_latitude * share, degrees) for p, n, share, degrees in LATITUDE_LINES.get(name, ())]
    if not lines:
        return f, u
    angles = [at.p * float(p) + at.n * float(n) + degrees for p, n, _, degrees in lines]
    x = sum((_cos(m, a) * line[2] for a, line in zip(angles, lines)), f * _cos(m, u) if series else 1.0)
    y = sum((_sin(m, a) * line[2] for a, line in zip(angles, lines)), f * _sin(m, u) if series else 0.0)
    return m.sqrt(x * x + y * y), m.degrees(m.atan2(y, x))
