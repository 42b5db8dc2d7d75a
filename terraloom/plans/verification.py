"""Whether the sun and the ground speak for an image's estimate, and the image's overall score.

The sun's place follows from the capture time and the estimate. An image's detections may have the azimuth of a shadow, a
heading, and the ratio of the shadow's length to the height; what they say is summed per image, so that no image's
detections are gathered. Images without an estimate are not verified.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import angle_between
from ..functions.sun import shadow_length_fits, sun_position


@dataclass(frozen=True)
class ScoreWeights:
    detection: float = 0.4
    geo: float = 0.4
    shadow: float = 0.1
    ground: float = 0.1


#: A shadow this close to the heading, in degrees, may be the object itself.
HEADING_CONFLICT_DEG = 12.0
SHADOW_DEG = 25.0
LOW_SUN_DEG = 5.0
LEAST_CONFIDENCE = 0.5


def verified(images: DataFrame, estimates: DataFrame, detections: DataFrame, use_shadow: bool = True, use_length: bool = True, use_heading: bool = True) -> DataFrame:
    """image_id, shadow_ok, ground_ok, verdict, mean_diff_deg, elevation_deg and notes of every image (image_id, captured_at)
    with an estimate (image_id, lat, lon, confidence). Detections: image_id, shadow_azimuth_deg, heading_deg,
    shadow_length_ratio. The verdict is disabled, missing_time, night, low_sun, time_only, length_mismatch,
    conflicts_heading, ok or diff, the first that holds."""
    placed = images.select("image_id", "captured_at").join(estimates.where("lat is not null and lon is not null").select("image_id", "lat", "lon", "confidence"), "image_id")
    azimuth, elevation = sun_position(F.col("captured_at"), F.col("lat"), F.col("lon"))
    sunny = placed.withColumns({"azimuth": azimuth, "elevation_deg": elevation})
    seen = detections.where("shadow_azimuth_deg is not null").select("image_id", "shadow_azimuth_deg", "heading_deg", "shadow_length_ratio")
    met = seen.join(sunny.select("image_id", "azimuth", "elevation_deg"), "image_id")
    conflict = F.coalesce(angle_between(F.col("heading_deg"), F.col("shadow_azimuth_deg")) < HEADING_CONFLICT_DEG, F.lit(False))
    misfit = F.col("shadow_length_ratio").isNotNull() & ~shadow_length_fits(F.col("elevation_deg"), F.col("shadow_length_ratio"))
    said = met.groupBy("image_id").agg(
        F.avg(angle_between(F.pmod(F.col("azimuth") + 180, F.lit(360e0)), F.col("shadow_azimuth_deg"))).alias("mean_diff_deg"),
        F.bool_or(conflict & F.lit(use_heading)).alias("_conflict"),
        F.bool_or(misfit & F.lit(use_length)).alias("_misfit"),
    )
    up = F.col("elevation_deg")
    verdict = (
        F.when(F.lit(not use_shadow), "disabled")
        .when(F.col("captured_at").isNull(), "missing_time")
        .when(up <= 0, "night")
        .when(up < LOW_SUN_DEG, "low_sun")
        .when(F.col("mean_diff_deg").isNull(), "time_only")
        .when(F.col("_misfit"), "length_mismatch")
        .when(F.col("_conflict"), "conflicts_heading")
        .when(F.col("mean_diff_deg") <= SHADOW_DEG, "ok")
        .otherwise("diff")
    )
    sure = F.coalesce(F.col("confidence") >= LEAST_CONFIDENCE, F.lit(False))
    told = sunny.join(said, "image_id", "left").withColumn("verdict", verdict)
    return told.select(
        "image_id",
        F.col("verdict").isin("disabled", "time_only", "ok").alias("shadow_ok"),
        sure.alias("ground_ok"),
        "verdict",
        "mean_diff_deg",
        "elevation_deg",
        _notes(sure).alias("notes"),
    )


def _notes(sure: Column) -> Column:
    """One line of what was found. The prefixes are fixed values of the result format."""
    at = lambda form, *columns: F.format_string(form, *columns)
    up, diff, azimuth, verdict = F.col("elevation_deg"), F.col("mean_diff_deg"), F.col("azimuth"), F.col("verdict")
    shadow = (
        F.when(verdict.isin("night", "low_sun", "length_mismatch"), at("shadow:%s el=%.1f", verdict, up))
        .when(verdict == "time_only", at("shadow:time_only az=%.1f el=%.1f", azimuth, up))
        .when(verdict == "conflicts_heading", at("shadow:conflicts_heading diff=%.1f", diff))
        .when(verdict == "ok", at("shadow:ok diff=%.1f az=%.1f", diff, azimuth))
        .when(verdict == "diff", at("shadow:diff=%.1f az=%.1f", diff, azimuth))
        .otherwise(F.concat(F.lit("shadow:"), verdict))
    )
    ground = F.when(sure, F.lit("topo:stub_confidence_ok")).otherwise(at("topo:low_conf %.2f", F.coalesce(F.col("confidence"), F.lit(0e0))))
    return F.concat_ws("; ", shadow, ground)


def overall_score(detection: Column, confidence: Column, uncertainty_m: Column, shadow_ok: Column, ground_ok: Column, weights: ScoreWeights = ScoreWeights()) -> Column:
    """The weighed mean of what an image has: the score of its detections, its estimate's confidence, discounted by its
    uncertainty, and both flags of the verification; 0 without any of them. Rounded half to even to three places."""
    unit = lambda x: F.greatest(F.lit(0e0), F.least(F.lit(1e0), x))
    discount = F.when(uncertainty_m.isNull() | (uncertainty_m <= 50), 1e0).when(uncertainty_m <= 200, 0.85).when(uncertainty_m <= 1000, 0.6).otherwise(0.4)
    parts = [
        (F.when(detection.isNotNull(), unit(detection)), weights.detection),
        (F.when(confidence.isNotNull(), unit(confidence) * discount), weights.geo),
        (shadow_ok.cast("double"), weights.shadow),
        (ground_ok.cast("double"), weights.ground),
    ]
    total = sum((F.when(value.isNotNull(), F.lit(max(0.0, w))).otherwise(0e0) for value, w in parts), F.lit(0e0))
    mean = sum((F.coalesce(value * w, F.lit(0e0)) for value, w in parts), F.lit(0e0)) / total
    return F.when(total > 0, F.bround(mean, 3)).otherwise(F.lit(0e0))
