"""J2000 direction to local east/north/up direction cosines, as column arithmetic.

Precession follows IAU 1976 and sidereal time IAU 1982.  Nutation has the four largest
terms of IAU 1980 and aberration is that of the Earth's elliptic orbit, which is within
an arc second of published apparent places.  Both are small rotations of a direction,
so nothing is singular at the poles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_ARCSEC = math.pi / (180.0 * 3600.0)


def _poly(t: Column, *c: float) -> Column:
    out = F.lit(c[-1])
    for k in reversed(c[:-1]):
        out = out * t + F.lit(k)
    return out


def sidereal_degrees(mjd: Column) -> Column:
    """Greenwich mean sidereal time in degrees (not reduced)."""
    days = mjd - F.lit(51544.5)
    t = days / 36525.0
    return F.lit(280.46061837) + days * 360.98564736629 + t * t * 0.000387933 - t * t * t / 38710000.0


def precess(ra: Column, dec: Column, mjd: Column) -> tuple[Column, Column]:
    """Mean J2000 to mean-of-date right ascension and declination, radians."""
    t = (mjd - F.lit(51544.5)) / 36525.0
    zeta = t * _poly(t, 2306.2181, 0.30188, 0.017998) * _ARCSEC
    z = t * _poly(t, 2306.2181, 1.09468, 0.018203) * _ARCSEC
    theta = t * _poly(t, 2004.3109, -0.42665, -0.041833) * _ARCSEC
    a = F.cos(dec) * F.sin(ra + zeta)
    b = F.cos(theta) * F.cos(dec) * F.cos(ra + zeta) - F.sin(theta) * F.sin(dec)
    c = F.sin(theta) * F.cos(dec) * F.cos(ra + zeta) + F.cos(theta) * F.sin(dec)
    return F.atan2(a, b) + z, F.asin(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))


def _linear(t: Column, constant: float, rate: float) -> Column:
    return F.radians(F.lit(constant) + t * rate)


def nutation(mjd: Column) -> tuple[Column, Column, Column]:
    """Nutation in longitude and obliquity and the true obliquity, radians."""
    t = (mjd - F.lit(51544.5)) / 36525.0
    node, sun, moon = _linear(t, 125.04452, -1934.136261), _linear(t, 280.4665, 36000.7698), _linear(t, 218.3165, 481267.8813)
    longitude = (F.sin(node) * -17.20 - F.sin(sun * 2) * 1.32 - F.sin(moon * 2) * 0.23 + F.sin(node * 2) * 0.21) * _ARCSEC
    obliquity = (F.cos(node) * 9.20 + F.cos(sun * 2) * 0.57 + F.cos(moon * 2) * 0.10 - F.cos(node * 2) * 0.09) * _ARCSEC
    return longitude, obliquity, _linear(t, 23.43929111, -0.013004167) + obliquity


def orbital_velocity(mjd: Column) -> tuple[Column, Column]:
    """The Earth's velocity over that of light along the ecliptic's axes, towards the equinox and 90 degrees on."""
    t = (mjd - F.lit(51544.5)) / 36525.0
    anomaly, perihelion = _linear(t, 357.52911, 35999.05029), _linear(t, 102.93735, 1.71946)
    eccentricity = F.lit(0.016708634) - t * 0.000042037
    centre = F.sin(anomaly) * 1.914602 + F.sin(anomaly * 2) * 0.019993 + F.sin(anomaly * 3) * 0.000289
    sun = _linear(t, 280.46646, 36000.76983) + F.radians(centre)
    k = 20.49552 * _ARCSEC
    return (F.sin(sun) - eccentricity * F.sin(perihelion)) * k, (eccentricity * F.cos(perihelion) - F.cos(sun)) * k


def apparent(ra: Column, dec: Column, mjd: Column) -> tuple[Column, Column, Column]:
    """Unit vector of the apparent place of a mean place of date (radians)."""
    longitude, obliquity, eps = nutation(mjd)
    x, y, z = F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec)
    dx, dy, dz = (-longitude * (y * F.cos(eps) + z * F.sin(eps)), longitude * x * F.cos(eps) - obliquity * z,
                  longitude * x * F.sin(eps) + obliquity * y)
    vx, vy = orbital_velocity(mjd)
    x, y, z = x + dx + vx, y + dy + vy * F.cos(eps), z + dz + vy * F.sin(eps)
    length = F.sqrt(x * x + y * y + z * z)
    return x / length, y / length, z / length


def topocentric(ra_deg: Column, dec_deg: Column, mjd: Column, lat_deg: Column, lon_deg: Column) -> Column:
    """Struct (l, m, n): sin(az)cos(el), cos(az)cos(el), sin(el)."""
    ra, dec = precess(F.radians(ra_deg), F.radians(dec_deg), mjd)
    x, y, z = apparent(ra, dec, mjd)
    longitude, _, eps = nutation(mjd)
    lst, lat = F.radians(sidereal_degrees(mjd) + lon_deg) + longitude * F.cos(eps), F.radians(lat_deg)
    west, south = x * F.sin(lst) - y * F.cos(lst), x * F.cos(lst) + y * F.sin(lst)      # by hour angle
    return F.struct((-west).alias("l"), (z * F.cos(lat) - south * F.sin(lat)).alias("m"), (z * F.sin(lat) + south * F.cos(lat)).alias("n"))
