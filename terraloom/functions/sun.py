"""The sun's position from time and place, and the shadow azimuth that it implies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import angle_between

# The public series of the general solar position calculations, as (coefficient, harmonic) of cosines and sines.
EQUATION_OF_TIME = (0.000075, ((0.001868, 1), (-0.014615, 2)), ((-0.032077, 1), (-0.040849, 2)))
DECLINATION = (0.006918, ((-0.399912, 1), (-0.006758, 2), (-0.002697, 3)), ((0.070257, 1), (0.000907, 2), (0.00148, 3)))


def _series(g: Column, terms) -> Column:
    out = F.lit(terms[0])
    for a, k in terms[1]:
        out = out + a * F.cos(g * k)
    for a, k in terms[2]:
        out = out + a * F.sin(g * k)
    return out


def sun_position(ts: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(azimuth, elevation) in degrees; the clock fields are taken as they are (the session's zone is UTC)."""
    hour = F.hour(ts) + F.minute(ts) / 60.0 + F.floor(F.second(ts)) / 3600.0
    g = 2 * F.pi() * (F.dayofyear(ts) - 1 + (hour - 12) / 24.0) / 365.0
    d = _series(g, DECLINATION)
    h = F.radians((hour * 60 + 229.18 * _series(g, EQUATION_OF_TIME) + 4 * lon) / 4 - 180)
    la = F.radians(lat)
    up = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(la) * F.sin(d) + F.cos(la) * F.cos(d) * F.cos(h)))
    azimuth = F.pmod(F.degrees(F.atan2(F.sin(h), F.cos(h) * F.sin(la) - F.tan(d) * F.cos(la))) + 180, F.lit(360.0))
    return azimuth, 90 - F.degrees(F.acos(up))


def shadow_azimuth(ts: Column, lat: Column, lon: Column) -> Column:
    return F.pmod(sun_position(ts, lat, lon)[0] + 180, F.lit(360.0))


def shadow_verdict(ts: Column, lat: Column, lon: Column, shadows: Column) -> Column:
    """What the sun says of an image's shadow azimuths (an array; null entries are none): night, low_sun (below 5 degrees),
    time_only, ok (a mean difference of at most 25 degrees) or diff. A null time is missing_time."""
    azimuth, elevation = sun_position(ts, lat, lon)
    seen = F.filter(shadows, lambda x: x.isNotNull())
    expected = F.pmod(azimuth + 180, F.lit(360.0))
    mean = F.aggregate(seen, F.lit(0.0), lambda s, x: s + angle_between(expected, x)) / F.size(seen)
    return F.when(ts.isNull(), "missing_time").when(elevation <= 0, "night").when(elevation < 5, "low_sun").when(F.size(seen) == 0, "time_only").when(mean <= 25, "ok").otherwise("diff")


def shadow_length_fits(elevation: Column, ratio: Column) -> Column:
    """Within a factor of three of what the elevation implies."""
    expected = 1 / F.greatest(F.lit(0.01), F.tan(F.radians(elevation)))
    return (elevation > 0) & (ratio > 0) & ratio.between(expected / 3, expected * 3)
