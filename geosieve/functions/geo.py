"""Row-local geometry as Column expressions (no UDF, whole-stage codegen)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius, the older radius kept by the split, and the
# latitude at which the square Web-Mercator world ends.
EARTH_RADIUS_M = 6_371_008.8
SPLIT_RADIUS_M = 6_371_000.0
MERCATOR_MAX_LAT = 85.05112878


def _col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def valid_latlon(lat, lon) -> Column:
    """True when both coordinates are in range; null and NaN count as invalid."""
    lat, lon = _col(lat), _col(lon)
    ok = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.coalesce(ok, F.lit(False))


def require_latlon(lat, lon) -> tuple[Column, Column]:
    """The same coordinates, failing the job on a value out of range."""
    lat, lon = _col(lat), _col(lon)
    message = F.concat(
        F.lit("coordinates out of range: "), lat.cast("string"), F.lit(", "), lon.cast("string")
    )
    wrong = F.raise_error(message).cast("double")
    bad_lat = ~lat.between(-90.0, 90.0)
    bad_lon = ~lon.between(-180.0, 180.0)
    return F.when(bad_lat, wrong).otherwise(lat), F.when(bad_lon, wrong).otherwise(lon)


def dms_to_decimal(degrees, minutes, seconds, direction) -> Column:
    """Degrees, minutes and seconds to signed decimal degrees; S and W are negative."""
    value = _col(degrees) + _col(minutes) / F.lit(60.0) + _col(seconds) / F.lit(3600.0)
    negative = F.upper(F.trim(_col(direction))).isin("S", "W")
    return value * F.when(negative, F.lit(-1.0)).otherwise(F.lit(1.0))


def world_x(lon, world_size: int) -> Column:
    return (_col(lon) + 180.0) / 360.0 * float(world_size)


def world_y(lat, world_size: int) -> Column:
    clamped = F.least(F.greatest(_col(lat), F.lit(-MERCATOR_MAX_LAT)), F.lit(MERCATOR_MAX_LAT))
    return (1.0 - F.asinh(F.tan(F.radians(clamped))) / math.pi) / 2.0 * float(world_size)


def world_lon(px, world_size) -> Column:
    return _col(px) / _col(world_size) * 360.0 - 180.0


def world_lat(py, world_size) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi - _col(py) * (2.0 * math.pi) / _col(world_size))))


def _half_chord_squared(lat1, lon1, lat2, lon2) -> Column:
    lat1, lat2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    lon1, lon2 = F.radians(_col(lon1)), F.radians(_col(lon2))
    up = F.sin((lat2 - lat1) / 2.0)
    across = F.sin((lon2 - lon1) / 2.0)
    return up * up + F.cos(lat1) * F.cos(lat2) * across * across


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    a = _half_chord_squared(lat1, lon1, lat2, lon2)
    rest = F.greatest(F.lit(0.0), 1.0 - a)
    return F.atan2(F.sqrt(a), F.sqrt(rest)) * (2.0 * EARTH_RADIUS_M)


def haversine_split_m(lat1, lon1, lat2, lon2) -> Column:
    """The great-circle distance the train/val/test split is defined with."""
    a = _half_chord_squared(lat1, lon1, lat2, lon2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2.0 * SPLIT_RADIUS_M)


def sphere_xyz(lat, lon, radius: float = EARTH_RADIUS_M) -> dict[str, Column]:
    """Position on the sphere in metres, for grid cells without poles or date line."""
    phi, lam = F.radians(_col(lat)), F.radians(_col(lon))
    return {
        "x": F.cos(phi) * F.cos(lam) * radius,
        "y": F.cos(phi) * F.sin(lam) * radius,
        "z": F.sin(phi) * radius,
    }


def chord_m(arc_m: float, radius: float = EARTH_RADIUS_M) -> float:
    """Straight-line length under an arc of the given length."""
    return 2.0 * radius * math.sin(min(arc_m / (2.0 * radius), math.pi / 2.0))


def map_link(base_url: str, lat, lon) -> Column:
    """Map address with the longitude first, six decimals each."""
    lat, lon = require_latlon(lat, lon)
    return F.format_string(base_url.replace("%", "%%") + "%.6f/%.6f", lon, lat)
