"""WGS 84 to UTM zone 37N and back as column expressions (the usual series of the transverse Mercator)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ellipsoid and the zone.
AXIS, ECC2, SCALE, EAST0, MERIDIAN = 6378137.0, 0.0066943799901413165, 0.9996, 500000.0, math.radians(39.0)
ECC2P = ECC2 / (1 - ECC2)
_ARC = (1 - ECC2 / 4 - 3 * ECC2**2 / 64 - 5 * ECC2**3 / 256, 3 * ECC2 / 8 + 3 * ECC2**2 / 32 + 45 * ECC2**3 / 1024, 15 * ECC2**2 / 256 + 45 * ECC2**3 / 1024, 35 * ECC2**3 / 3072)


def to_metres(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(east, north) of degrees."""
    phi = F.radians(lat)
    sin, cos, tan2 = F.sin(phi), F.cos(phi), F.tan(phi) * F.tan(phi)
    n = AXIS / F.sqrt(1 - ECC2 * sin * sin)
    c = ECC2P * cos * cos
    a = cos * (F.radians(lon) - MERIDIAN)
    arc = AXIS * (_ARC[0] * phi - _ARC[1] * F.sin(2 * phi) + _ARC[2] * F.sin(4 * phi) - _ARC[3] * F.sin(6 * phi))
    east = SCALE * n * (a + (1 - tan2 + c) * a**3 / 6 + (5 - 18 * tan2 + tan2 * tan2 + 72 * c - 58 * ECC2P) * a**5 / 120) + EAST0
    north = SCALE * (arc + n * F.tan(phi) * (a**2 / 2 + (5 - tan2 + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * tan2 + tan2 * tan2 + 600 * c - 330 * ECC2P) * a**6 / 720))
    return east, north


def to_degrees(east: Column, north: Column) -> tuple[Column, Column]:
    """(lon, lat) of metres."""
    e1 = (1 - math.sqrt(1 - ECC2)) / (1 + math.sqrt(1 - ECC2))
    mu = north / (SCALE * AXIS * _ARC[0])
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu)
    sin, cos, tan = F.sin(foot), F.cos(foot), F.tan(foot)
    w = 1 - ECC2 * sin * sin
    n, r = AXIS / F.sqrt(w), AXIS * (1 - ECC2) / w**1.5
    t, c = tan * tan, ECC2P * cos * cos
    d = (east - EAST0) / (n * SCALE)
    lat = foot - (n * tan / r) * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ECC2P) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ECC2P - 3 * c * c) * d**6 / 720)
    lon = MERIDIAN + (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ECC2P + 24 * t * t) * d**5 / 120) / cos
    return F.degrees(lon), F.degrees(lat)


def is_geographic(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Degrees, if all coordinates could be and span under 15 of them."""
    return (F.greatest(F.abs(min_x), F.abs(max_x)) <= 180) & (F.greatest(F.abs(min_y), F.abs(max_y)) <= 90) & (max_x - min_x < 15) & (max_y - min_y < 15)
