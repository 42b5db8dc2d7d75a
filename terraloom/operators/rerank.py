"""Re-ranking of candidate lists by positions of consensus and density, by evidence behind gates, and by linear models.

Candidate lists are bounded (k times the sources), so that a query's list may be gathered into one array and worked on by
array functions; queries are spread over tasks."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, local_degrees, local_xy_km
from ..functions.scores import by_group, scaled_by_peak, unit_by_logistic, unit_by_shift
from ..sources.stage import written
from .evaluate import view_agreement
from .fit import sums_of_products
from .retrieval import Q, pairs, ranked


def with_agreement(c: DataFrame, ranks: DataFrame, top_n: int, n_views: int, weight: float, within: tuple[str, ...] = ()) -> DataFrame:
    """``score`` blended, in the lists' own range, with the agreement of the views on each item. A query has as many lists
    as it has values of ``within``. Flat lists stay."""
    joined = c.join(view_agreement(ranks, top_n, n_views), [*Q, "item_id"], "left")
    own = by_group([*Q, *within])
    low, span = F.min("score").over(own), F.max("score").over(own) - F.min("score").over(own)
    mixed = (1 - weight) * (F.col("score") - low) / span + weight * F.least(F.lit(1.0), F.coalesce("agreement", F.lit(0.0)))
    return joined.withColumn("score", F.when(span <= 1e-12, F.col("score")).otherwise(low + F.least(F.lit(1.0), mixed) * span)).drop("agreement")


def folded(start: Column, steps: int, step) -> Column:
    """``step`` applied to a struct (x, y, done) ``steps`` times; it stays once it is done."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.when(s["done"], s).otherwise(step(s)))


def _total(points: Column, term) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda a, p: a + term(p))


def _moved(s: Column, x: Column, y: Column, tolerance: float) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), (F.hypot(x - s["x"], y - s["y"]) <= tolerance).alias("done"))


def geometric_median(points: Column, steps: int = 24, tolerance_km: float = 1e-3) -> Column:
    """struct(x, y, done): the point of the least weighted sum of distances to the points (x, y, w), by Weiszfeld's steps
    from the mean; a step that meets a point stays on it."""
    mass = _total(points, lambda p: p["w"])
    start = F.struct((_total(points, lambda p: p["x"] * p["w"]) / mass).alias("x"), (_total(points, lambda p: p["y"] * p["w"]) / mass).alias("y"), F.lit(False).alias("done"))

    def step(s: Column) -> Column:
        far = lambda p: F.hypot(s["x"] - p["x"], s["y"] - p["y"])
        met = F.filter(points, lambda p: far(p) < 1e-9)
        pull = lambda p: p["w"] / F.greatest(far(p), F.lit(1e-9))
        mean = lambda axis: _total(points, lambda p: pull(p) * p[axis]) / _total(points, pull)
        x, y = (F.when(F.size(met) > 0, F.get(met, F.lit(0))[axis]).otherwise(mean(axis)) for axis in ("x", "y"))
        return _moved(s, x, y, tolerance_km)

    return folded(start, steps, step)


def _planar(rows: DataFrame, weight: Column) -> DataFrame:
    """Per query the reference place (weighted mean) and ``pts``, an array of (rank, x, y, w) on its plane, best first."""
    w = rows.withColumn("w", F.greatest(F.lit(1e-9), weight))
    angle = F.radians("lon")
    mean = w.groupBy(*Q).agg((F.sum(F.col("lat") * F.col("w")) / F.sum("w")).alias("lat0"), F.degrees(F.atan2(F.sum(F.sin(angle) * F.col("w")), F.sum(F.cos(angle) * F.col("w")))).alias("lon0"))
    there = w.join(mean, Q)
    x, y = local_xy_km("lat", "lon", "lat0", "lon0")
    return there.withColumns({"x": x, "y": y}).groupBy(*Q, "lat0", "lon0").agg(F.array_sort(F.collect_list(F.struct("rank", "x", "y", "w", "lat", "lon"))).alias("pts"))


def _first_moved(order: DataFrame, places: DataFrame, match_id: str) -> DataFrame:
    """``order`` with the first row of each query at the new place (to_lat, to_lon), unless it is there already."""
    j = order.join(places, Q, "left")
    moved = (F.col("rank") == 1) & F.col("to_lat").isNotNull() & ((F.abs(F.col("to_lat") - F.col("lat")) >= 1e-9) | (F.abs(F.col("to_lon") - F.col("lon")) >= 1e-9))
    to = {"match_id": F.when(moved, F.lit(match_id)).otherwise(F.col("match_id")), "lat": F.when(moved, F.col("to_lat")).otherwise(F.col("lat")), "lon": F.when(moved, F.col("to_lon")).otherwise(F.col("lon"))}
    return j.withColumns(to).drop("to_lat", "to_lon")


def refined_by_consensus(c: DataFrame, top_n: int, radius_km: float, power: float) -> DataFrame:
    """The candidates ranked; the first one's place becomes the centre of the densest ball among the first ``top_n``: the
    mean of its members, or their geometric median where that has over 1.05 times the mean's support and is far enough
    from it. Balls of one member change nothing."""
    order = ranked(c)
    if top_n < 2 or radius_km <= 0:
        return order
    head = order.where(F.col("rank") <= top_n).withColumn("unit", F.greatest(F.lit(1e-9), unit_by_shift(F.col("score"))))
    both = pairs(head, ["rank", "unit", "score"])
    kernel = lambda km, s: F.exp(-0.5 * F.pow(km / s, F.lit(2)))
    support = both.groupBy(*Q, "item_id", "rank").agg(F.sum(F.col("o_unit") * kernel(F.col("km"), max(0.5, radius_km))).alias("s"))
    anchor = support.groupBy(*Q).agg(F.min_by("item_id", F.struct(-F.round("s", 12), F.col("rank"))).alias("anchor"))
    ball = both.join(anchor, Q).where((F.col("item_id") == F.col("anchor")) & (F.col("km") <= radius_km))
    members = ball.select(*Q, F.col("o_rank").alias("rank"), F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon"), F.col("o_score").alias("score"))
    flat = _planar(members, F.pow(unit_by_shift(F.col("score")), F.lit(max(0.0, power)))).where(F.size("pts") >= 2).withColumn("m", geometric_median(F.col("pts")))
    m_lat, m_lon = local_degrees(F.col("m.x"), F.col("m.y"), "lat0", "lon0")
    flat = flat.withColumns({"m_lat": m_lat, "m_lon": m_lon})
    mass = lambda lat, lon: _total(F.col("pts"), lambda p: p["w"] * kernel(haversine_km(F.col(lat), F.col(lon), p["lat"], p["lon"]), max(0.5, radius_km * 0.5)))
    use = (mass("m_lat", "m_lon") > 1.05 * mass("lat0", "lon0")) & (haversine_km("lat0", "lon0", "m_lat", "m_lon") >= max(0.15, radius_km * 0.05))
    places = flat.withColumn("use", use).select(*Q, F.when(F.col("use"), F.col("m_lat")).otherwise(F.col("lat0")).alias("to_lat"), F.when(F.col("use"), F.col("m_lon")).otherwise(F.col("lon0")).alias("to_lon"))
    return _first_moved(order, places, "retrieval:consensus")


def refined_by_density(c: DataFrame, top_n: int, sigma_km: float, power: float, margin: float = 0.0, switch_km: float = 0.0, steps: int = 12, mass: float = 0.0, seeds: int = 8) -> DataFrame:
    """The candidates ranked; the first one's place becomes the densest mode that mean shift reaches from the first
    ``seeds`` places. With ``mass``, the shortest prefix with that share of the weight counts (two rows or more). Where the
    first leads the second by the margin, a mode of ``switch_km`` or more away is not taken."""
    order = ranked(c)
    if top_n < 2 or sigma_km <= 0:
        return order
    n = F.count(F.lit(1)).over(by_group(Q))
    head = order.where(F.col("rank") <= top_n).withColumn("_w", F.greatest(F.lit(1e-9), F.pow(unit_by_shift(F.col("score")), F.lit(max(0.0, power)))))
    if mass > 0:
        before = F.coalesce(F.sum("_w").over(by_group(Q).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        head = head.withColumns({"_b": before, "_t": F.sum("_w").over(by_group(Q)), "_n": n}).where((F.col("_n") < 3) | (F.col("_b") < mass * F.col("_t")) | (F.col("rank") <= 2))
    flat = _planar(head, F.col("_w"))
    pts, k = F.col("pts"), 0.5 / max(1e-6, sigma_km * sigma_km)
    pull = lambda s: lambda p: p["w"] * F.exp(-(F.pow(s["x"] - p["x"], F.lit(2)) + F.pow(s["y"] - p["y"], F.lit(2))) * k)

    def step(s: Column) -> Column:
        share = _total(pts, pull(s))
        go = lambda axis: F.when(share <= 1e-12, s[axis]).otherwise(_total(pts, lambda p: pull(s)(p) * p[axis]) / share)
        return _moved(s, go("x"), go("y"), 1e-3)

    modes = F.transform(F.slice(pts, 1, seeds), lambda p: folded(F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(False).alias("done")), steps, step))
    dense = flat.withColumn("modes", modes).withColumn("best", F.array_min(F.transform("modes", lambda m, i: F.struct((-F.round(_total(pts, pull(m)), 9)).alias("d"), i.alias("i"), m["x"].alias("x"), m["y"].alias("y")))))
    to_lat, to_lon = local_degrees(F.col("best.x"), F.col("best.y"), "lat0", "lon0")
    places = dense.select(*Q, to_lat.alias("to_lat"), to_lon.alias("to_lon"))
    if switch_km > 0:
        two = order.groupBy(*Q).agg(*(F.max(F.when(F.col("rank") == r, F.col(x))).alias(f"_{x}{r}") for r, x in ((1, "score"), (2, "score"), (1, "lat"), (1, "lon"))))
        held = (F.col("_score1") - F.col("_score2") >= max(0.0, margin)) & (haversine_km("to_lat", "to_lon", "_lat1", "_lon1") >= switch_km)
        places = places.join(two, Q).where(~F.coalesce(held, F.lit(False))).select(*Q, "to_lat", "to_lon")
    size = order.groupBy(*Q).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(*Q)
    return _first_moved(order, places.join(size, Q, "left_semi"), "retrieval:kde_mode")


@dataclass(frozen=True)
class Gate:
    """When evidence may re-rank: its best value, its spread, and its lead over a first candidate that leads by 0.10."""

    best: float
    spread: float
    lead: float
    #: The value from which on evidence counts at all, growing to its full weight at 1.
    floor: float


#: Fixed values of the two kinds of evidence.
STRUCTURE, LOCAL_MATCH = Gate(0.52, 0.05, 0.10, 0.45), Gate(0.18, 0.0, 0.28, 0.10)


def reranked_behind_gate(c: DataFrame, evidence: str, gate: Gate, top_n: int, weight: float) -> DataFrame:
    """``score`` blended with the column ``evidence`` (null: none) for the first ``top_n``, where the gate is open."""
    g, at = by_group(Q), lambda r: F.col("rank") == r
    order = ranked(c).withColumn("_e", F.when(F.col("rank") <= top_n, F.col(evidence))).withColumn("_u", unit_by_shift(F.col("score")))
    best, least = F.max("_e").over(g), F.min("_e").over(g)
    first = F.max(F.when(at(1), F.col("_e"))).over(g)
    gap = F.coalesce(F.greatest(F.lit(0.0), F.max(F.when(at(1), F.col("_u"))).over(g) - F.max(F.when(at(2), F.col("_u"))).over(g)), F.lit(1.0))
    contradicts = (first.isNull() | (best > first)) & (best - F.coalesce(first, F.lit(0.0)) < gate.lead)
    is_open = (best >= gate.best) & (best - least >= gate.spread) & ~((gap >= 0.10) & contradicts)
    share = weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_e") - gate.floor) / (1 - gate.floor)))
    mixed = F.greatest(F.lit(1e-6), F.least(F.lit(1.0), (1 - share) * F.col("_u") + share * F.col("_e")))
    marked = order.withColumns({"_open": F.coalesce(is_open, F.lit(False)), "_m": mixed})
    return marked.withColumn("score", F.when(F.col("_open") & F.col("_e").isNotNull(), F.col("_m")).otherwise(F.col("score"))).drop("_e", "_u", "_open", "_m", "rank")


# Linear models over a candidate's features --------------------------------------------------------------------------

FEATURES = ("bias", "rank_frac", "retrieval_unit", "retrieval_gap_top", "retrieval_gap_prev", "support_1km", "support_3km", "support_8km", "support_20km", "dist_top_km", "dist_centroid_km", "source_retrieval", "source_consensus", "source_geoclip")


def candidate_features(c: DataFrame) -> DataFrame:
    """query_id, item_id, rank and the ``FEATURES`` of every candidate. A candidate supports itself with weight 0.35."""
    g = by_group(Q)
    order = ranked(c).withColumn("unit", unit_by_logistic(F.col("score")))
    mass = F.greatest(F.lit(1e-6), F.col("unit"))
    order = order.withColumn("_p", mass / F.sum(mass).over(g))
    angle = F.radians("lon")
    mean = F.degrees(F.atan2(F.sum(mass * F.sin(angle)).over(g), F.sum(mass * F.cos(angle)).over(g)))
    order = order.withColumns({"_clat": F.sum(F.col("lat") * mass).over(g) / F.sum(mass).over(g), "_clon": mean, "_n": F.count(F.lit(1)).over(g)})
    own = F.when(F.col("item_id") == F.col("o_item_id"), F.lit(0.35)).otherwise(F.lit(1.0))
    near = lambda s: F.sum(F.col("o__p") * own * F.exp(-0.5 * F.pow(F.col("km") / s, F.lit(2))))
    support = pairs(order, ["_p"]).groupBy(*Q, "item_id").agg(*(near(s).alias(f"_s{s}") for s in (1, 3, 8, 20)))
    support = support.select(*Q, "item_id", *(scaled_by_peak(f"_s{s}", Q, 1e-6).alias(f"support_{s}km") for s in (1, 3, 8, 20)))
    top = lambda x: F.max(F.when(F.col("rank") == 1, F.col(x))).over(g)
    order = order.withColumns({"_tlat": top("lat"), "_tlon": top("lon"), "_top": top("unit"), "_prev": F.lag("unit").over(g.orderBy("rank"))})
    m = F.coalesce(F.col("match_id"), F.lit(""))
    kind = F.when((m == "geoclip") | m.startswith("geoclip:"), "geoclip").when(m.startswith("retrieval:consensus"), "consensus").otherwise("retrieval")
    up = lambda x: F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0)))
    values = {
        "bias": F.lit(1.0), "rank_frac": (F.col("rank") - 1) / F.greatest(F.col("_n") - 1, F.lit(1)), "retrieval_unit": F.col("unit"),
        "retrieval_gap_top": up(F.col("_top") - F.col("unit")), "retrieval_gap_prev": up(F.col("_prev") - F.col("unit")),
        "dist_top_km": haversine_km("lat", "lon", "_tlat", "_tlon"), "dist_centroid_km": haversine_km("lat", "lon", "_clat", "_clon"),
    } | {f"source_{k}": (kind == k).cast("double") for k in ("retrieval", "consensus", "geoclip")}
    return order.join(support, [*Q, "item_id"]).withColumns(values).select(*Q, "item_id", "rank", *FEATURES)


@dataclass(frozen=True)
class LinearModel:
    feature_names: tuple[str, ...] = FEATURES
    weights: tuple[float, ...] = ()
    intercept: float = 0.0
    means: tuple[float, ...] = ()
    scales: tuple[float, ...] = ()
    activation: str = "sigmoid"
    output_floor: float = 0.05
    output_ceiling: float = 1.0
    version: int = field(default=1, compare=False)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> LinearModel:
        """Missing weights count as 0, missing means as 0, missing scales as 1; ``bias`` may stand for the intercept."""
        raw = json.loads(text)
        names = tuple(map(str, raw.get("feature_names", FEATURES)))
        fit = lambda key, default: tuple(float(x) for x in [*raw.get(key, []), *[default] * len(names)][: len(names)])
        base = LinearModel(names, fit("weights", 0.0), float(raw.get("intercept", raw.get("bias", 0.0))), fit("means", 0.0), fit("scales", 1.0))
        return replace(base, activation=str(raw.get("activation", "sigmoid")).lower(), output_floor=float(raw.get("output_floor", 0.05)), output_ceiling=float(raw.get("output_ceiling", 1.0)))


def scored_by_model(features: DataFrame, model: LinearModel) -> DataFrame:
    """``features`` with ``rerank``: standardised features times weights, activated (sigmoid, exp or linear_clamp) and
    scaled by the query's peak; 1 throughout where no value is positive."""
    value = F.lit(model.intercept)
    for k, name in enumerate(model.feature_names):
        scale, mean, w = (seq[k] if k < len(seq) else other for seq, other in ((model.scales, 1.0), (model.means, 0.0), (model.weights, 0.0)))
        if abs(scale) >= 1e-12 and w:
            value = value + w * (F.col(name) - mean) / scale
    low = max(1e-6, min(1.0, model.output_floor))
    high = max(low, min(1.0, model.output_ceiling))
    capped = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), value))
    out = {"exp": F.exp(capped), "linear_clamp": F.greatest(F.lit(low), F.least(F.lit(high), value))}.get(model.activation, low + (high - low) / (1 + F.exp(-capped)))
    raw = features.withColumn("_r", out)
    peak = F.max("_r").over(by_group(Q))
    return raw.withColumn("rerank", F.when(peak <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(model.output_floor), F.least(F.lit(model.output_ceiling), F.col("_r") / peak)))).drop("_r")


def standard_scales(rows: DataFrame, names: tuple[str, ...] = FEATURES) -> tuple[tuple[float, ...], tuple[float, ...]]:
    row = rows.agg(*(F.avg(n).alias(f"m{k}") for k, n in enumerate(names)), *(F.stddev_pop(n).alias(f"s{k}") for k, n in enumerate(names))).first()
    return tuple(row[f"m{k}"] or 0.0 for k in range(len(names))), tuple(x if (x := row[f"s{k}"]) and x >= 1e-9 else 1.0 for k in range(len(names)))


def ridge_model(rows: DataFrame, target: str, strength: float, names: tuple[str, ...] = FEATURES) -> LinearModel:
    """Least squares on standardised features; sums of products are taken by Spark, the small system is solved here."""
    means, scales = standard_scales(rows, names)
    z = rows.select(*(((F.col(n) - m) / s).alias(n) for n, m, s in zip(names, means, scales, strict=True)), target)
    weights = sums_of_products(z, list(names), target, strength)
    return LinearModel(names, tuple(weights[:-1]), weights[-1], means, scales, "linear_clamp", 0.03, 1.0)


def listwise_model(rows: DataFrame, km: str, sigma_km: float, rate: float = 0.5, epochs: int = 12, l2: float = 1e-3, names: tuple[str, ...] = FEATURES) -> LinearModel:
    """Softmax over each query's candidates against the softmax of -0.5 (km / sigma)^2, by full gradients: an epoch is one
    sum over all candidates in Spark, so that the order of queries does not matter."""
    means, scales = standard_scales(rows, names)
    z = rows.select(*Q, F.array(*((F.col(n) - m) / s for n, m, s in zip(names, means, scales, strict=True))).alias("x"), (-0.5 * F.pow(F.col(km) / max(0.1, sigma_km), F.lit(2))).alias("_t"))
    soft = lambda c: F.exp(F.col(c) - F.max(c).over(by_group(Q))) / F.sum(F.exp(F.col(c) - F.max(c).over(by_group(Q)))).over(by_group(Q))
    z = z.withColumn("_m", F.max("_t").over(by_group(Q))).withColumn("_e", F.exp(F.col("_t") - F.col("_m")))
    z = written(z.select(*Q, "x", (F.col("_e") / F.sum("_e").over(by_group(Q))).alias("want")), "listwise")
    n = max(1, z.select(*Q).distinct().count())
    weights = [0.0] * len(names)
    for _ in range(epochs):
        logit = F.aggregate(F.zip_with("x", F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        off = z.withColumn("_l", F.greatest(F.lit(-60.0), F.least(F.lit(60.0), logit))).withColumn("_d", soft("_l") - F.col("want"))
        grad = off.agg(*(F.sum(F.get("x", F.lit(k)) * F.col("_d")).alias(f"g{k}") for k in range(len(names)))).first()
        weights = [w - rate * ((grad[f"g{k}"] or 0.0) / n + l2 * w) for k, w in enumerate(weights)]
    if not all(map(math.isfinite, weights)):
        raise ArithmeticError("the fit diverged: take a smaller rate")
    return LinearModel(names, tuple(weights), 0.0, means, scales, "exp", 1e-6, 1.0)
