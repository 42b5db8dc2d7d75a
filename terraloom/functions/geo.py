"""Geometry on WGS84 degrees as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("double") if isinstance(x, int | float) else F.col(x)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    term = F.pow(F.sin((c - a) / 2), F.lit(2)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2))
    return EARTH_KM * 2 * F.atan2(F.sqrt(term), F.sqrt(F.greatest(1 - term, F.lit(0.0))))


def wrap_longitude(lon) -> Column:
    """To [-180, 180), but +180 stays."""
    x = _c(lon)
    wrapped = F.pmod(x + 180, F.lit(360.0)) - 180
    return F.when((wrapped == -180) & (x > 0), F.lit(180.0)).otherwise(wrapped)


def longitude_offset(lon, reference) -> Column:
    return F.pmod(_c(lon) - _c(reference) + 540, F.lit(360.0)) - 180


def longitude_between(lon, low, high) -> Column:
    """Also for intervals that cross 180 degrees."""
    x, lo, hi = _c(lon), _c(low), _c(high)
    return F.when(lo <= hi, (x >= lo) & (x <= hi)).otherwise((x >= lo) | (x <= hi))


def longitude_into(lon, low, high) -> Column:
    x, lo, hi = wrap_longitude(lon), _c(low), _c(high)
    nearer_low = F.abs(wrap_longitude(x - lo)) <= F.abs(wrap_longitude(x - hi))
    return F.when(longitude_between(x, lo, hi), x).when(nearer_low, lo).otherwise(hi)


def box_distance_km(lat, lon, box: tuple[float, float, float, float]) -> Column:
    """0 inside (lat_min, lat_max, lon_min, lon_max), else the distance to its nearest point."""
    lat_min, lat_max, lon_min, lon_max = (F.lit(float(x)) for x in box)
    y, x = _c(lat), wrap_longitude(lon)
    inside = y.between(lat_min, lat_max) & longitude_between(x, lon_min, lon_max)
    near = haversine_km(y, x, F.least(F.greatest(y, lat_min), lat_max), longitude_into(x, lon_min, lon_max))
    return F.when(inside, F.lit(0.0)).otherwise(near)


def angle_between(a, b) -> Column:
    """0 to 180 degrees."""
    d = F.abs(F.pmod(_c(a) - _c(b), F.lit(360.0)))
    return F.least(d, 360 - d)


def circular_mean_deg(angle: Column) -> Column:
    """The mean direction of a group, in [0, 360); null for none."""
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(F.radians(angle))), F.sum(F.cos(F.radians(angle))))), F.lit(360.0))


def local_xy_km(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    return longitude_offset(lon, lon0) * 111.320 * F.cos(F.radians(_c(lat0))), (_c(lat) - _c(lat0)) * 110.574


def local_degrees(x_km, y_km, lat0, lon0) -> tuple[Column, Column]:
    """The inverse of ``local_xy_km``."""
    across = 111.320 * F.cos(F.radians(_c(lat0)))
    return _c(lat0) + _c(y_km) / 110.574, wrap_longitude(_c(lon0) + _c(x_km) / F.when(F.abs(across) < 1e-9, F.lit(1e-9)).otherwise(across))


def distance_bucket(km) -> Column:
    d = _c(km)
    return F.when(d <= 1, "0-1km").when(d <= 5, "1-5km").when(d <= 25, "5-25km").when(d <= 100, "25-100km").otherwise(">100km")


def ellipse(xx, xy, yy) -> Column:
    """struct(major_m, minor_m, orientation_deg) of a covariance in metres."""
    a, b, d = _c(xx), _c(xy), _c(yy)
    trace = a + d
    root = F.sqrt(F.greatest(trace * trace / 4 - (a * d - b * b), F.lit(0.0)))
    flat = trace <= 0
    axis = lambda e: F.when(flat, F.lit(0.0)).otherwise(F.sqrt(F.greatest(e, F.lit(0.0))))
    turn = F.when(flat | (F.abs(b) < 1e-9), F.lit(0.0)).otherwise(F.degrees(0.5 * F.atan2(2 * b, a - d)))
    return F.struct(axis(trace / 2 + root).alias("major_m"), axis(trace / 2 - root).alias("minor_m"), turn.alias("orientation_deg"))


def grid_cell(lat, lon, size_deg: float) -> tuple[Column, Column]:
    return F.floor(_c(lat) / size_deg).cast("long"), F.floor(_c(lon) / size_deg).cast("long")


def world_pixel(lat, lon, zoom: int, tile: int = 256) -> tuple[Column, Column]:
    """Web-Mercator pixel of a point."""
    n = float(tile * 2**zoom)
    s = F.sin(F.radians(F.least(F.greatest(_c(lat), F.lit(-85.05112878)), F.lit(85.05112878))))
    return (_c(lon) + 180) / 360 * n, (0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * n


def dms_to_degrees(deg, minutes, seconds, hemisphere) -> Column:
    value = _c(deg) + _c(minutes) / 60 + _c(seconds) / 3600
    return F.when(F.upper(_c(hemisphere)).isin("S", "W"), -value).otherwise(value)


def metres_per_degree(lat) -> tuple[Column, Column]:
    """Of latitude and longitude, by the public cosine series of the ellipsoid (fixed values)."""
    p = F.radians(_c(lat))
    along = 111132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p) - 0.0023 * F.cos(6 * p)
    across = 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p) + 0.118 * F.cos(5 * p)
    return along, across


def box_cells(south: float, west: float, north: float, east: float, step: float) -> list[tuple[float, float, float, float]]:
    """A box as a grid of cells of ``step`` degrees, row by row; the last row and column are cut at the box."""
    if not (south < north and west < east and step > 0):
        raise ValueError("a box needs south < north, west < east and a positive step")
    rows, cols = int(-(-(north - south) // step)), int(-(-(east - west) // step))
    return [(south + r * step, west + c * step, min(north, south + (r + 1) * step), min(east, west + (c + 1) * step)) for r in range(rows) for c in range(cols)]
