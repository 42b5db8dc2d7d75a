"""Greedy selection within one query's or image's bounded list. Lists are dealt by their key and streamed to the tasks in
key order; a task holds one list at a time."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_key(df: DataFrame, key: str, order: list, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on the rows of each key, in the given order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if held.empty:
                continue
            last = held[key].iloc[-1]
            whole, held = held[held[key] != last], held[held[key] == last]
            done = [work(part) for _, part in whole.groupby(key, sort=False)]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held is not None and len(held):
            yield work(held)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _km(a, b) -> float:
    la, lo, lb, lp = map(math.radians, (a[0], a[1], b[0], b[1]))
    t = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 12742 * math.atan2(math.sqrt(t), math.sqrt(max(0.0, 1 - t)))


def _rounded(score: float) -> float:
    return score if math.isinf(score) else round(score, 9)


def diverse(c: DataFrame, top_k: int, radius_km: float, weight: float, min_keep: int = 1) -> DataFrame:
    """query_id, item_id, at: the best ``min_keep``, then the largest weight * score - (1 - weight) * exp(-nearest / r).
    Null and NaN scores count as less than any other."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(score=pdf["score"].fillna(-math.inf))
        rows = sorted(pdf.itertuples(index=False), key=lambda r: (-_rounded(r.score), r.item_id))
        taken, left = rows[: max(1, min_keep)], rows[max(1, min_keep) :]
        near = {r.item_id: min(_km((r.lat, r.lon), (t.lat, t.lon)) for t in taken) for r in left}
        while left and len(taken) < top_k:
            best = max(left, key=lambda r: (weight * r.score - (1 - weight) * math.exp(-near[r.item_id] / max(1e-3, radius_km)), -rows.index(r)))
            left.remove(best)
            taken.append(best)
            for r in left:
                near[r.item_id] = min(near[r.item_id], _km((r.lat, r.lon), (best.lat, best.lon)))
        taken.sort(key=lambda r: (-_rounded(r.score), r.item_id))
        return pd.DataFrame([(r.query_id, r.item_id, k + 1) for k, r in enumerate(taken[:top_k])], columns=["query_id", "item_id", "at"])

    return per_key(c.select("query_id", "item_id", "lat", "lon", "score"), "query_id", [], work, "query_id long, item_id long, at int")


def clustered(c: DataFrame, radius_m: float = 300.0) -> DataFrame:
    """query_id, cluster, lat, lon, score, n: best first, each row joins the first cluster whose moving centroid lies within
    the radius; a cluster's score is 1 - prod(1 - s), its centroid weighted by max(s, 0.05). Null and NaN scores
    count as 0."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(score=pdf["score"].fillna(0.0))
        clusters: list[list[float]] = []  # lat sum, lon sum, weight, prod(1 - s), n
        for r in sorted(pdf.itertuples(index=False), key=lambda r: (-round(r.score, 9), r.item_id)):
            s = min(0.999, max(0.0, r.score))
            w = max(s, 0.05)
            home = next((k for k in clusters if 1000 * _km((k[0] / k[2], k[1] / k[2]), (r.lat, r.lon)) <= radius_m), None)
            if home is None:
                clusters.append(home := [0.0, 0.0, 0.0, 1.0, 0])
            home[0] += r.lat * w
            home[1] += r.lon * w
            home[2] += w
            home[3] *= 1 - s
            home[4] += 1
        q = pdf["query_id"].iloc[0]
        return pd.DataFrame([(q, i, k[0] / k[2], k[1] / k[2], 1 - k[3], k[4]) for i, k in enumerate(clusters)], columns=["query_id", "cluster", "lat", "lon", "score", "n"])

    return per_key(c.select("query_id", "item_id", "lat", "lon", "score"), "query_id", [], work, "query_id long, cluster int, lat double, lon double, score double, n long")


def _clipped_area(p: list[tuple[float, float]], q: list[tuple[float, float]]) -> float:
    """The area that two convex polygons with counter-clockwise corners share."""
    for a, b in zip(q, [*q[1:], q[0]], strict=True):
        side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for x, y in p]
        out = []
        for k, (e, at) in enumerate(zip(p, side, strict=True)):
            s, was = p[k - 1], side[k - 1]
            if (at >= 0) != (was >= 0):
                t = was / (was - at)
                out.append((s[0] + t * (e[0] - s[0]), s[1] + t * (e[1] - s[1])))
            if at >= 0:
                out.append(e)
        p = out
        if len(p) < 3:
            return 0.0
    return abs(_area(p))


def _area(p: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], p[0]], strict=True)) / 2


def suppressed(d: DataFrame, iou: float = 0.5, most: int = 100, per_label: bool = True, mode: str = "hull") -> DataFrame:
    """Non-maximum suppression of detections (image_id, label, det, confidence, and quad or x, y, w, h) in each image, of one
    label or across labels, by the overlap of hulls or of quads; image_id and det of the rest, ``most`` an image (0: all).
    The best confidence comes first, then the smallest det; null and NaN confidences come last. Rows stream through in this
    order, and a task holds what it kept of one image. A threshold of 0 or less suppresses nothing."""
    if "quad" not in d.columns:
        x, y, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
        d = d.withColumn("quad", F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x1, y), (x1, y1), (x, y1)))))
    corners = [F.get("quad", i)[axis].cast("double").alias(f"{axis}{i}") for i in range(4) for axis in ("x", "y")]
    sure = F.when(F.isnan(F.col("confidence").cast("double")), F.lit(None)).otherwise(F.col("confidence").cast("double"))
    flat = d.select("image_id", "label", "det", sure.alias("confidence"), *corners)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        image, kept, n = object(), [], 0
        for pdf in batches:
            out = []
            xs, ys = pdf[[f"x{i}" for i in range(4)]].to_numpy(), pdf[[f"y{i}" for i in range(4)]].to_numpy()
            boxes = np.stack([xs.min(axis=1), ys.min(axis=1), xs.max(axis=1), ys.max(axis=1)], axis=1)
            if mode == "hull":
                xs, ys = boxes[:, [0, 2, 2, 0]], boxes[:, [1, 1, 3, 3]]
            for key, label, det, px, py, box in zip(pdf["image_id"], pdf["label"], pdf["det"], xs.tolist(), ys.tolist(), boxes.tolist(), strict=True):
                if key != image:
                    image, kept, n = key, [], 0
                if most > 0 and n >= most:
                    continue
                p = list(zip(px, py, strict=True))
                area = _area(p)
                if area < 0:
                    p, area = p[::-1], -area
                if iou > 0 and any((not per_label or other == label) and not _out_of_reach(area, box, q_area, q_box, iou) and _overlap(p, area, box, q, q_area, q_box) > iou for other, q, q_area, q_box in kept):
                    continue
                n += 1
                kept.append((label, p, area, box))
                out.append((key, det))
            yield pd.DataFrame(out, columns=["image_id", "det"])

    order = [F.col("image_id"), F.col("confidence").desc_nulls_last(), F.col("det")]
    return flat.repartition("image_id").sortWithinPartitions(*order).mapInPandas(run, "image_id long, det long")


def _out_of_reach(p_area: float, p_box, q_area: float, q_box, iou: float) -> bool:
    """Whether what the hulls share, by its size, is too little for that overlap (with room for rounding)."""
    w, h = min(p_box[2], q_box[2]) - max(p_box[0], q_box[0]), min(p_box[3], q_box[3]) - max(p_box[1], q_box[1])
    return w <= 0 or h <= 0 or w * h * (1 + iou) < iou * (p_area + q_area) * (1 - 1e-6)


def _overlap(p, p_area: float, p_box, q, q_area: float, q_box) -> float:
    if p_area <= 0 or q_area <= 0 or p_box[2] <= q_box[0] or q_box[2] <= p_box[0] or p_box[3] <= q_box[1] or q_box[3] <= p_box[1]:
        return 0.0
    both = _clipped_area(p, q)
    return both / (p_area + q_area - both) if both > 0 else 0.0
