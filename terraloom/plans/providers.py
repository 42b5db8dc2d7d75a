"""Providers of candidates and what is decided before any of them runs: scope, views, index weights."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spatial import valid_candidates
from .verification import ScoreWeights, overall_score, verified


class CandidateProvider(Protocol):
    """Queries (query_id, ...) to candidates (query_id, item_id, lat, lon, score, match_id)."""

    def __call__(self, queries: DataFrame) -> DataFrame: ...


class Detector(Protocol):
    """Images (image_id, ...) to detections (image_id, label, confidence, points)."""

    def __call__(self, images: DataFrame) -> DataFrame: ...


def union_of_providers(queries: DataFrame, providers: dict[str, CandidateProvider], min_score: float = 0.001) -> tuple[DataFrame | None, dict[str, str]]:
    """(the valid candidates of all providers with their ``provider``, the messages of those that cannot be planned)."""
    out, errors = None, {}
    for name, provider in providers.items():
        try:
            found = provider(queries).withColumn("provider", F.lit(name))
        except Exception as e:  # the others go on
            errors[name] = f"{type(e).__name__}: {e}".splitlines()[0]
            continue
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return (None if out is None else valid_candidates(out, min_score)), errors


def scope_of(raw: Column) -> Column:
    """A named scope: PARIS, US, GLOBAL, UNKNOWN, or the text in upper case; empty for none."""
    value = F.replace(F.upper(F.trim(F.coalesce(raw, F.lit("")))), F.lit("-"), F.lit("_"))
    return F.when(F.contains(value, F.lit("PARIS")), "PARIS").when(value.isin("US", "USA") | F.contains(value, F.lit("OPEN_GEO")), "US").otherwise(value)


def scope_of_profile(named: Column, path: Column) -> Column:
    """The profile's own scope, else what its file's name says."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))
    by_name = F.when(F.contains(stem, F.lit("paris")), "PARIS").when(F.contains(stem, F.lit("open_geo")) | stem.startswith("us") | F.contains(stem, F.lit("_us")), "US").otherwise("")
    return F.when(scope_of(named) != "", scope_of(named)).otherwise(by_name)


def scope_of_dataset(*paths: Column) -> Column:
    text = F.replace(F.lower(F.concat_ws(" ", *paths)), F.lit("\\"), F.lit("/"))
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return F.when(has("spacenet_paris", "/paris/", "_paris", "paris_"), "PARIS").when(has("open_geo", "/us/", "_us"), "US").otherwise("UNKNOWN")


def scope_mismatch(profile: Column, dataset: Column) -> Column:
    """Whether the two scopes speak against each other; what is not known or global never does."""
    return ~profile.isin("", "GLOBAL") & ~dataset.isin("", "UNKNOWN") & (profile != dataset)


#: Views of a query (fixed values): the modes there are, those that each modality prefers, how many angles and scales.
MODES = ("rgb", "gray", "equalize", "edge")
PREFERRED = {"pan": ("gray", "edge"), "rgb": ("rgb",), "mul": ("rgb", "gray")}
MAX_ANGLES, MAX_SCALES, LEAST_SCALE = 12, 6, 0.45


def _finite(values: Iterable | None) -> list[float]:
    return [float(x) for x in values or () if isinstance(x, int | float) and math.isfinite(x)]


def chosen_angles(values: Sequence | None) -> list[float]:
    """Turns in [-180, 180), each once by four decimals, the smallest first."""
    turned = {round(t, 4): t for x in reversed(_finite(values)) for t in [(x + 180.0) % 360.0 - 180.0]}
    in_order = [t for x in _finite(values) for t in [(x + 180.0) % 360.0 - 180.0] if turned.pop(round(t, 4), None) is not None]
    return sorted(in_order, key=abs)[:MAX_ANGLES] or [0.0]


def chosen_scales(values: Sequence | None) -> list[float]:
    """Scales clamped to [0.45, 1], each once by three decimals, with 1, the largest first."""
    return sorted({1.0, *(round(min(1.0, max(LEAST_SCALE, x)), 3) for x in _finite(values))}, reverse=True)[:MAX_SCALES]


def chosen_modes(values: Sequence | None) -> list[str]:
    return [m for m in dict.fromkeys(str(x).strip().lower() for x in values or () if x is not None) if m in MODES] or ["rgb"]


def modality_of(path: Column) -> Column:
    """pan, rgb or mul by the beginning of the file's name; null for others."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    return F.coalesce(*(F.when(name.startswith(m), F.lit(m)) for m in PREFERRED))


def with_views(queries: DataFrame, path: str, modes: Sequence | None, angles: Sequence | None, scales: Sequence | None, by_modality: bool = True) -> DataFrame:
    """One row per query and view (mode, angle, scale). With ``by_modality`` a query keeps the modes that its modality
    prefers, if any of them is there."""
    there = chosen_modes(modes)
    both = lambda names: F.array(*(F.lit(m) for m in ([m for m in names if m in there] or there)))
    m = modality_of(F.col(path))
    own = F.coalesce(*(F.when(m == name, both(wanted)) for name, wanted in PREFERRED.items()), both(("rgb", "gray"))) if by_modality else F.array(*map(F.lit, there))
    literal = lambda values: F.explode(F.array(*map(F.lit, values)))
    return queries.withColumn("mode", F.explode(own)).withColumn("angle", literal(chosen_angles(angles))).withColumn("scale", literal(chosen_scales(scales)))


def index_weights(indices: DataFrame) -> DataFrame:
    """``weight`` as given; 1 where it is missing, not finite or not positive."""
    w = F.col("weight")
    return indices.withColumn("weight", F.when(w.isNull() | F.isnan(w) | (w == float("inf")) | (w <= 0), F.lit(1.0)).otherwise(w))


def whole_pipeline(images: DataFrame, detections: DataFrame, estimates: DataFrame, provider: CandidateProvider, fuse: Callable[[DataFrame], DataFrame], weights: ScoreWeights = ScoreWeights()) -> DataFrame:
    """Per image (image_id, and captured_at if known): detections and their score, the verification of a given estimate, the
    estimate (a given one, else fusion's mean with the top weight clamped to [0.05, 0.95] as its confidence), fusion's
    result, and the overall score of all of these. An estimate that is given is never replaced; one that fusion makes comes
    too late to be verified."""
    from ..operators.spatial import detection_summary

    timed = images if "captured_at" in images.columns else images.withColumn("captured_at", F.lit(None).cast("timestamp"))
    marked = detections
    for name in ("shadow_azimuth_deg", "heading_deg", "shadow_length_ratio"):
        if name not in detections.columns:
            marked = marked.withColumn(name, F.lit(None).cast("double"))
    checked = verified(timed, estimates, marked).select("image_id", "shadow_ok", "ground_ok", "verdict", "notes")

    fused = fuse(provider(images.withColumn("query_id", F.col("image_id"))))
    seen = detection_summary(detections).withColumnsRenamed({"n": "n_detections", "score": "detection_score"})
    given = estimates.select("image_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("confidence").alias("_c"), F.col("uncertainty_m").alias("_u"))
    j = images.join(seen, "image_id", "left").join(given, "image_id", "left").join(checked, "image_id", "left").join(fused.withColumnRenamed("query_id", "image_id"), "image_id", "left")
    own = F.col("_lat").isNotNull()
    pick = lambda a, b: F.when(own, F.col(a)).otherwise(b)
    top = F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("top1")))
    out = j.select("image_id", F.coalesce("n_detections", F.lit(0)).alias("n_detections"), "detection_score", pick("_lat", F.col("mean_lat")).alias("lat"), pick("_lon", F.col("mean_lon")).alias("lon"), pick("_c", top).alias("confidence"), pick("_u", F.col("major_m")).alias("uncertainty_m"), "tier", F.when(own, "given").when(F.col("mean_lat").isNotNull(), "fused").alias("estimate"), "shadow_ok", "ground_ok", "verdict", "notes")
    score = overall_score(*(F.col(c) for c in ("detection_score", "confidence", "uncertainty_m", "shadow_ok", "ground_ok")), weights)
    return out.withColumn("score", score)
