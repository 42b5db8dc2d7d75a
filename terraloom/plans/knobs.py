"""Knobs from settings: defaults, guards and clamps; sweeps over them; and the best of a sweep written back."""

from __future__ import annotations

import json
import math
from dataclasses import fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, fusion

#: Knob -> (least, most, default). A number that is missing or not finite counts as the default, others are clamped.
RANGES: dict[str, tuple[float, float, float]] = {
    "temperature": (1e-3, 100.0, 0.2), "prior_retrieval": (1e-3, 100.0, 1.0), "prior_geoclip": (1e-3, 100.0, 1.0), "prior_exif": (1e-3, 100.0, 1.0),
    "spatial_sigma_km": (0.1, 500.0, 2.0), "spatial_weight": (0.0, 10.0, 1.0), "cross_sigma_km": (0.1, 500.0, 15.0), "cross_weight": (0.0, 10.0, 1.0),
    "plausibility_radius_km": (1.0, 20_000.0, 200.0), "plausibility_weight": (0.0, 10.0, 0.0), "outlier_strength": (0.0, 10.0, 0.0), "outlier_min_scale_km": (1.0, 20_000.0, 120.0),
    "outlier_mad_scale": (0.0, 100.0, 3.0), "high_threshold": (0.0, 1.0, 0.70), "medium_threshold": (0.0, 1.0, 0.45), "credible_mass": (0.5, 0.999, 0.9), "min_credible": (1.0, 100.0, 2.0), "top_k": (1.0, 1000.0, 5.0),
}
#: Knob -> the values that it may have; another counts as the first.
CHOICES: dict[str, tuple[str, ...]] = {"normalise": ("none", "zscore", "minmax", "rank")}


def clamped(name: str, value: Column) -> Column:
    low, high, default = RANGES[name]
    x = value.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def clamped_grid(grid: DataFrame) -> DataFrame:
    """A sweep's table of settings, with every knob that is known clamped; one row of each setting that is left."""
    known = {c: clamped(c, F.col(c)) for c in grid.columns if c in RANGES}
    known |= {c: F.when(F.lower(F.trim(c)).isin(*CHOICES[c]), F.lower(F.trim(c))).otherwise(CHOICES[c][0]) for c in grid.columns if c in CHOICES}
    return grid.withColumns(known).distinct()


def fusion_knobs(settings: dict[str, Any], base: fusion.Knobs = fusion.Knobs()) -> fusion.Knobs:
    """The knobs with the given settings, guarded as above; what is no knob, or of another type, is left out."""
    whole = {f.name for f in fields(fusion.Knobs) if f.type == "int"}
    out: dict[str, Any] = {}
    for name, value in settings.items():
        if name in RANGES and isinstance(value, int | float) and not isinstance(value, bool):
            low, high, default = RANGES[name]
            x = max(low, min(high, float(value))) if math.isfinite(value) else default
            out[name] = int(x) if name in whole else x
        elif name in CHOICES and isinstance(value, str):
            out[name] = value.strip().lower() if value.strip().lower() in CHOICES[name] else CHOICES[name][0]
    return replace(base, **out)


def fusion_sweep(c: DataFrame, truth: DataFrame, settings: list[dict[str, Any]]) -> DataFrame:
    """One row per setting (its number and its JSON): mean error of the fused position, and its place. Settings are a short
    list; the candidates are one table that all of them read."""
    t = truth.select("query_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    out = None
    for n, s in enumerate(settings):
        one = fusion.fuse(c, fusion_knobs(s)).join(t, "query_id").select(F.lit(n).alias("setting"), F.lit(json.dumps(s, sort_keys=True)).alias("knobs"), evaluate.haversine_km("mean_lat", "mean_lon", "t_lat", "t_lon").alias("km"))
        out = one if out is None else out.unionByName(one)
    report = out.groupBy("setting", "knobs").agg(F.count(F.lit(1)).alias("n"), F.avg("km").alias("mean_km"))
    return evaluate.objective_ranking(report.withColumn("_m", F.round("mean_km", 9)), ["_m", "setting"]).drop("_m")


def with_best(config: str, section: str, best: dict[str, Any]) -> str:
    """The JSON text of a config with the best settings in a section; all else stays as it is."""
    whole = json.loads(config) if config.strip() else {}
    whole[section] = {**whole.get(section, {}), **best}
    return json.dumps(whole, indent=2, sort_keys=True)
