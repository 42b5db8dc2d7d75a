"""Likeness of two images' scenes from their signatures: histograms of lines, layouts and footprints, densities, shadows."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scores import histogram_concentration, histogram_similarity

#: The fields of a signature: arrays of a histogram's shares; numbers of 0 to 1; angles in degrees, which may be null.
HISTOGRAMS = ("line_hist", "corner_layout", "edge_layout", "footprint_layout", "footprint_orientation")
LEVELS = (
    "edge_density", "corner_density", "line_orthogonality", "line_anisotropy", "footprint_rectangularity", "footprint_density",
    "line_strength", "shadow_strength", "shadow_elongation", "sun_shadow_strength",
)
AXES = ("shadow_axis_deg", "sun_shadow_axis_deg")
#: The histograms whose concentration gates a cue.
GATING = HISTOGRAMS[1:]
#: Fixed value: the most that the geometry cues may count for.
MOST_GEOMETRY = 0.46


def prepared(signatures: DataFrame, key: str, name: str) -> DataFrame:
    """``key`` and a struct ``name`` of the signature with its concentrations, made once per image and not once per pair."""
    own = [F.col(c) for c in (*HISTOGRAMS, *LEVELS, *AXES)]
    return signatures.select(key, F.struct(*own, *(histogram_concentration(F.col(h)).alias(f"{h}_c") for h in GATING)).alias(name))


def scene_similarity(a: Column, b: Column) -> Column:
    """0 to 1, from two structs of ``prepared``; null if either is null. Four base cues give the score; nine cues of geometry
    replace up to 0.46 of it, as far as both images support them."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    both = lambda f: F.least(F.greatest(F.lit(0.0), a[f]), F.greatest(F.lit(0.0), b[f]))
    level = lambda f: unit(1 - F.abs(a[f] - b[f]))
    shape = lambda f: histogram_similarity(a[f], b[f])
    axis = lambda f: F.coalesce(0.5 * (1 + F.cos(F.radians(a[f] - b[f]))), F.lit(0.5))
    gated = lambda density, h, least: F.least(F.lit(1.0), both(density) * (least + (1 - least) * both(f"{h}_c")))
    total = lambda terms: reduce(add, terms)

    line, shadow = both("line_strength"), both("shadow_strength")
    direction = line * both("line_anisotropy")
    ortho = direction * both("line_orthogonality")
    footprint = gated("footprint_density", "footprint_layout", 0.35)
    turned = footprint * (0.35 + 0.65 * both("footprint_rectangularity") * both("footprint_orientation_c"))
    # Fixed values. Base cues: (weight, likeness).
    base = [(0.50 * line, shape("line_hist")), (F.lit(0.22), level("corner_density")), (F.lit(0.13), level("edge_density")), (0.15 * shadow, axis("shadow_axis_deg"))]
    # Fixed values. Geometry cues: (support, weight, share of the mix, likeness).
    geometry = [
        (gated("corner_density", "corner_layout", 0.35), 0.36, 0.24, shape("corner_layout")),
        (gated("edge_density", "edge_layout", 0.40), 0.24, 0.16, shape("edge_layout")),
        (ortho, 0.24, 0.18, level("line_orthogonality")),
        (direction, 0.10, 0.10, level("line_anisotropy")),
        (footprint, 0.12, 0.06, shape("footprint_layout")),
        (turned, 0.06, 0.04, shape("footprint_orientation")),
        (footprint, 0.04, 0.0, 0.55 * level("footprint_rectangularity") + 0.45 * level("footprint_density")),
        (shadow * both("shadow_elongation"), 0.06, 0.06, level("shadow_elongation")),
        (both("sun_shadow_strength"), 0.04, 0.03, axis("sun_shadow_axis_deg")),
    ]
    first = total(w * x for w, x in base) / total(w for w, _ in base)
    mass = total(s * w for s, w, _, _ in geometry)
    mix = F.least(F.lit(MOST_GEOMETRY), total(s * m for s, _, m, _ in geometry))
    second = total(s * w * x for s, w, _, x in geometry) / F.greatest(mass, F.lit(1e-9))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(unit(F.when(mass <= 1e-9, first).otherwise((1 - mix) * first + mix * second)))


def with_structure(c: DataFrame, queries: DataFrame, items: DataFrame, name: str = "structure") -> DataFrame:
    """The candidates with ``name``, the likeness of the query's and the item's scene, null where either has no signature:
    evidence for the rerank behind a gate. ``queries`` has query_id, ``items`` item_id, one row each."""
    j = c.join(prepared(queries, "query_id", "_q"), "query_id", "left").join(prepared(items, "item_id", "_i"), "item_id", "left")
    return j.withColumn(name, scene_similarity(F.col("_q"), F.col("_i"))).drop("_q", "_i")
