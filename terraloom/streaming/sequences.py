"""Runs of fused frames: every frame joins a track of its sequence, and its posterior is reweighted by the track's last one.

A frame is a row of sequence, frame, ts, lat, lon, radius_m, tier (of its own fusion) and candidates, an array of (item_id,
lat, lon, w). It joins the first of the sequence's open tracks, in the order of their beginning, whose last position lies
within ``base_m`` plus half of both radii, or begins a new one. In a track, its candidates' weights are multiplied by the
support that the track's last candidates give them, and position, radius, diagnostics and tier follow from the new weights.
Tracks that saw nothing for ``expire_s`` are closed. A frame without candidates passes as it is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..operators.greedy import _km
from .ordered import folded, folded_stream
from .temporal import updated

#: Least top weight, least margin and most entropy of the tiers.
TIERS = (("high", 0.75, 0.20, 0.55), ("medium", 0.50, 0.08, 0.80))
SCHEMA = "sequence long, frame long, track int, mean_lat double, mean_lon double, radius_m double, entropy double, effective double, top1 double, margin double, tier string, ambiguous boolean, credible_size int, weights array<struct<item_id:long,w:double>>"


def _place(rows: list[tuple[float, float, float]]) -> tuple[float, float, float]:
    """Mean latitude and longitude of weighed (lat, lon, w) rows, and the larger half axis of their spread in metres."""
    lat = sum(r[0] * r[2] for r in rows)
    s, c = (sum(r[2] * f(math.radians(r[1])) for r in rows) for f in (math.sin, math.cos))
    lon = math.degrees(math.atan2(s, c)) if abs(s) > 1e-12 or abs(c) > 1e-12 else 0.0
    lon = (lon + 180.0) % 360.0 - 180.0
    wide = max(1e-6, abs(111_320.0 * math.cos(math.radians(lat))))
    at = [(((r[1] - lon + 540.0) % 360.0 - 180.0) * wide, (r[0] - lat) * 111_320.0, r[2]) for r in rows]
    xx, xy, yy = (sum(r[2] * r[i] * r[j] for r in at) for i, j in ((0, 0), (0, 1), (1, 1)))
    half = max(0.0, xx + yy) / 2
    return lat, lon, math.sqrt(max(0.0, half + math.sqrt(max(0.0, half * half - (xx * yy - xy * xy)))))


def diagnosed(weights: list[float], mass: float = 0.9) -> tuple[float, float, float, float, str, bool, int]:
    """Entropy, effective count, top weight, margin, tier, ambiguity and the size of the credible set."""
    n, ranked = len(weights), sorted(weights, reverse=True)
    entropy = max(0.0, min(1.0, -sum(w * math.log(max(w, 1e-12)) for w in weights) / math.log(max(n, 2))))
    effective = 1.0 / max(sum(w * w for w in weights), 1e-12)
    margin = ranked[0] - (ranked[1] if n > 1 else 0.0)
    tier = next((name for name, top, gap, most in TIERS if ranked[0] >= top and margin >= gap and entropy <= most), "low")
    total, size = 0.0, 0
    for w in ranked:
        total, size = total + w, size + 1
        if total >= mass:
            break
    return entropy, effective, ranked[0], margin, tier, tier == "low" or effective >= max(3.0, 0.65 * n), size


def _stepper(base_m: float, expire_s: float | None):
    def step(tracks: list | None, f: dict) -> tuple[list, list[tuple]]:
        """``tracks``: number, last time, lat, lon, radius and candidates of every open one; the first entry counts all."""
        count, *opened = tracks or [0]
        now = f["seconds"]
        if expire_s is not None:
            opened = [t for t in opened if now - t[1] <= expire_s]
        radius = max(0.0, f["radius_m"] or 0.0)
        reach = lambda t: max(100.0, base_m) + 0.5 * (t[4] + radius)
        track = next((t for t in opened if 1000 * _km((t[2], t[3]), (f["lat"], f["lon"])) <= reach(t)), None)
        rows = [(c["lat"], c["lon"], c["w"]) for c in f["candidates"] or []]
        lat, lon, tier = f["lat"], f["lon"], f["tier"]
        weights = updated(None, rows, 0.0, 0.0)[0].tolist() if rows else []
        if rows and track and track[5]:
            weights, shrunk = updated(track[5], rows, track[4], radius)
            weights = weights.tolist()
            lat, lon, spread = _place([(*r[:2], w) for r, w in zip(rows, weights, strict=True)])
            radius, tier = max(spread, shrunk), None
        said = diagnosed(weights) if rows else (1.0, 0.0, 0.0, 0.0, tier, True, 0)
        number = count if track is None else track[0]
        last = [number, now, lat, lon, radius, [(*r[:2], w) for r, w in zip(rows, weights, strict=True)]]
        opened = [*opened, last] if track is None else [last if t is track else t for t in opened]
        pairs = sorted(zip((c["item_id"] for c in f["candidates"] or []), weights, strict=True), key=lambda x: -x[1])
        row = (f["sequence"], f["frame"], number, lat, lon, radius, *said[:4], tier or said[4], said[5], said[6], [{"item_id": i, "w": w} for i, w in pairs])
        return [count + (track is None), *opened], [row]

    return step


def _timed(frames: DataFrame) -> DataFrame:
    return frames.withColumn("seconds", frames.ts.cast("timestamp").cast("double"))


def sequence_run(frames: DataFrame, base_m: float = 5000.0, expire_s: float | None = None) -> DataFrame:
    """One row per frame: its track and its posterior after the track's last one."""
    return folded(_timed(frames), "sequence", "ts", "frame", _stepper(base_m, expire_s), SCHEMA)


def sequence_stream(frames: DataFrame, base_m: float = 5000.0, expire_s: float | None = None, late: str = "10 minutes") -> DataFrame:
    """The same over a stream of frames, whose order in time the watermark restores."""
    return folded_stream(_timed(frames), "sequence", "ts", "frame", _stepper(base_m, expire_s), SCHEMA, late, expire_s)
