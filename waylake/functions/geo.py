"""Geographic functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid of the offset coordinate system.
SEMI_MAJOR, ECCENTRICITY2 = 6378245.0, 0.006693421622965943

#: Offsets as sums of terms: constants of 1, x, y, x*x or y*y, x*y, sqrt|x|; then (amplitude, variable, divisor) of sines.
_LAT_POLY = (-100.0, 2.0, 3.0, 0.0, 0.2, 0.1, 0.2)
_LON_POLY = (300.0, 1.0, 2.0, 0.1, 0.0, 0.1, 0.1)
_LAT_WAVES = ((20.0, "x", 1 / 6), (20.0, "x", 1 / 2), (20.0, "y", 1.0), (40.0, "y", 3.0), (160.0, "y", 12.0), (320.0, "y", 30.0))
_LON_WAVES = ((20.0, "x", 1 / 6), (20.0, "x", 1 / 2), (20.0, "x", 1.0), (40.0, "x", 3.0), (150.0, "x", 12.0), (300.0, "x", 30.0))


def _offset(x: Column, y: Column, poly: tuple, waves: tuple) -> Column:
    one, px, py, pxx, pyy, pxy, proot = poly
    out = F.lit(one) + px * x + py * y + pxx * x * x + pyy * y * y + pxy * x * y + proot * F.sqrt(F.abs(x))
    for amplitude, variable, divisor in waves:
        out = out + (2.0 / 3.0) * amplitude * F.sin((x if variable == "x" else y) * (math.pi / divisor))
    return out


def gcj02_to_wgs84(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude without the offset of the national map system (first-order inverse)."""
    x, y = lon - 105.0, lat - 35.0
    phi = F.radians(lat)
    w = 1.0 - ECCENTRICITY2 * F.sin(phi) * F.sin(phi)
    dlat = _offset(x, y, _LAT_POLY, _LAT_WAVES) * 180.0 / (math.pi * SEMI_MAJOR * (1.0 - ECCENTRICITY2) / (w * F.sqrt(w)))
    dlon = _offset(x, y, _LON_POLY, _LON_WAVES) * 180.0 / (math.pi * SEMI_MAJOR / F.sqrt(w) * F.cos(phi))
    return lon - dlon, lat - dlat


def mercator_pixel(lon: Column, lat: Column, zoom: float, tile: int = 512) -> tuple[Column, Column]:
    """Web-Mercator pixel coordinates in the world at a zoom."""
    size = tile * 2.0**zoom
    s = F.sin(F.radians(lat))
    return (lon / 360.0 + 0.5) * size, (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * size


def distance_text(km: Column) -> Column:
    """Kilometres as shown: never below 1, in steps of 5 below 100 and of 10 beyond; from 20 km on rounded so."""
    shown = F.when(km < 20, F.greatest(F.lit(1.0), F.round(km))).when(km < 100, F.round(km / 5) * 5).otherwise(F.round(km / 10) * 10)
    return F.concat(F.lit("约 "), shown.cast("long").cast("string"), F.lit(" km"))


def interpolated(x: Column, stops: list[tuple[float, float]]) -> Column:
    """Linear between (x, y) stops, constant beyond the ends."""
    out = F.lit(float(stops[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(stops, stops[1:]))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x <= stops[0][0], F.lit(float(stops[0][1]))).otherwise(out)


def stepped(x: Column, base: float, steps: list[tuple[float, float]]) -> Column:
    """``base`` below the first threshold, then the value of the last threshold reached."""
    out = F.lit(base)
    for threshold, value in steps:
        out = F.when(x >= threshold, F.lit(value)).otherwise(out)
    return out
