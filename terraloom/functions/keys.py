"""Keys read from match ids and paths, tiers of estimates, weights of triplets, and map tiles, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import world_pixel
from .text import base_name, posix_path

#: Prefixes of image names that tell the sensor, not the scene (fixed values, tried in this order).
SENSORS = ("RGB-PanSharpen_", "MUL-PanSharpen_", "PAN_", "RGB_", "MUL_")


def retrieval_source(match_id: Column) -> Column:
    """The source in retrieval:<source>:<id>; null for other and for older ids of two parts."""
    parts = F.split(F.coalesce(match_id, F.lit("")), ":")
    name = F.trim(F.get(parts, F.lit(1)))
    return F.when((F.get(parts, F.lit(0)) == "retrieval") & (F.size(parts) >= 3) & (name != ""), name)


def provider_key(match_id: Column) -> Column:
    """exif, geoclip, retrieval with its source, else unknown; without regard to case."""
    text = F.lower(F.trim(F.coalesce(match_id, F.lit(""))))
    named = F.when(retrieval_source(text).isNotNull(), F.concat(F.lit("retrieval:"), retrieval_source(text))).otherwise("retrieval")
    return F.when(text.startswith("exif:"), "exif").when(text.startswith("geoclip"), "geoclip").when(text.startswith("retrieval:"), named).otherwise("unknown")


def scene_key(path: Column) -> Column:
    """The base name without the first sensor prefix that it has."""
    name = base_name(path)
    return F.coalesce(*(F.when(name.startswith(p), F.substr(name, F.lit(len(p) + 1))) for p in SENSORS), name)


def reference_path(path: Column) -> Column:
    """The path from ``chips/`` on, if it has such a part."""
    p = posix_path(path)
    at = F.locate("/chips/", F.lower(p))
    return F.when(at > 0, F.substr(p, at + 1)).otherwise(p)


def reuse_key(path: Column) -> Column:
    return F.lower(posix_path(path))


def estimate_tier(confidence: Column, uncertainty_m: Column) -> Column:
    """high from 0.75, medium from 0.45, after a discount for uncertainty over 50, 200 and 1,000 m."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    u = F.coalesce(uncertainty_m, F.lit(0.0))
    s = c * F.when(u > 1000, 0.4).when(u > 200, 0.6).when(u > 50, 0.85).otherwise(1.0)
    return F.when(s >= 0.75, "high").when(s >= 0.45, "medium").otherwise("low")


def spread_weight(closest_km: Column, farthest_km: Column, hardest_score: Column) -> Column:
    """A triplet's weight by how close, how spread and how well scored its negatives are, in [1, 4]."""
    spread = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (farthest_km - closest_km) / 25))
    return F.least(F.lit(4.0), F.greatest(F.lit(1.0), 1 + 1.2 / F.greatest(F.lit(1.0), closest_km) + 0.8 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), hardest_score)) + 0.4 * spread))


def richness_weight(closest_km: Column, n: Column) -> Column:
    """A triplet's weight by its closest negative and their number, in [1, 3]; 1 without any."""
    value = F.least(F.lit(3.0), 1 + 1.5 * F.greatest(F.lit(0.0), 1 - closest_km / 5) + 0.5 * F.least(F.lit(1.0), n / 20))
    return F.coalesce(value, F.lit(1.0))


def target_zoom(lat: Column, crop_m: float, crop_px: int) -> Column:
    """The least zoom, 0 to 22, at which a pixel is no wider than the crop's (of 0.05 m at least)."""
    wanted = max(crop_m / max(1.0, crop_px), 0.05)
    return F.least(F.lit(22), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(156543.03392804097) * F.cos(F.radians(lat)) / wanted, F.lit(1.0)))))).cast("int")


def crop_tiles(lat: str, lon: str, zoom: int, crop_px: int) -> Column:
    """The tiles (x, y) that a crop around a point touches; x goes round, y ends at the map's edge."""
    x, y = world_pixel(lat, lon, zoom)
    n, half = 2**zoom, crop_px / 2
    span = lambda c: F.sequence(F.floor((c - half) / 256), F.floor((c + half - 1) / 256))
    tile = lambda b: lambda a: F.struct(F.pmod(a, F.lit(n)).alias("x"), F.least(F.lit(n - 1), F.greatest(F.lit(0), b)).alias("y"))
    return F.array_distinct(F.flatten(F.transform(span(y), lambda b: F.transform(span(x), tile(b)))))
