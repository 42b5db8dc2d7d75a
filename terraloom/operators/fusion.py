"""Fusion of a query's candidates into a posterior, a position with its uncertainty, and a confidence tier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import ellipse, haversine_km, longitude_offset, wrap_longitude
from ..functions.scores import by_group, calibrated, minmax, rank_decay, scaled_by_peak, scaled_log_odds, softmax, source_family, unit_by_logistic, zscore_logistic
from ..sources.stage import written
from .rerank import LinearModel, candidate_features, scored_by_model
from .retrieval import Q, pairs


@dataclass(frozen=True)
class Knobs:
    temperature: float = 0.2
    #: none, zscore, minmax or rank, within a source family.
    normalise: str = "none"
    prior_retrieval: float = 1.0
    prior_geoclip: float = 1.0
    prior_exif: float = 1.0
    spatial_sigma_km: float = 2.0
    spatial_weight: float = 1.0
    #: The spatial weight has this least value, whatever is asked for.
    spatial_weight_floor: float = 1.2
    cross_sigma_km: float = 15.0
    cross_weight: float = 1.0
    plausibility_radius_km: float = 200.0
    plausibility_weight: float = 0.0
    outlier_strength: float = 0.0
    outlier_min_scale_km: float = 120.0
    outlier_mad_scale: float = 3.0
    high_threshold: float = 0.70
    medium_threshold: float = 0.45
    credible_mass: float = 0.9
    min_credible: int = 2
    top_k: int = 5
    #: A linear model of candidates whose likelihood counts with this power.
    reranker: LinearModel | None = None
    reranker_weight: float = 0.0
    #: The densest ball of this radius stands for the credible set, if it has the mass.
    cluster_radius_km: float = 0.0
    cluster_least_mass: float = 0.35
    #: Least cross-source support and largest radius in metres of the high and of the medium tier.
    high_cap: tuple[float, float] | None = None
    medium_cap: tuple[float, float] = (0.10, 800_000.0)


def normalised_scores(c: DataFrame, mode: str = "none") -> DataFrame:
    """``norm`` and ``family``: z-score logistic, min-max or decay by rank within each source family of two rows or more."""
    c = c.withColumn("family", source_family("match_id"))
    keys = [*Q, "family"]
    value = {"none": F.col("score"), "zscore": zscore_logistic("score", keys), "minmax": minmax("score", keys), "rank": rank_decay("score", keys, [F.col("item_id")])}[mode]
    return c.withColumn("norm", F.when(F.count(F.lit(1)).over(by_group(keys)) < 2, F.col("score")).otherwise(value))


def with_priors(c: DataFrame) -> DataFrame:
    p = c.withColumn("_p", F.greatest(F.lit(1e-3), unit_by_logistic(F.col("norm"))))
    return p.withColumn("p", F.col("_p") / F.sum("_p").over(by_group(Q))).drop("_p")


def spatial_and_cross_support(c: DataFrame, knobs: Knobs) -> DataFrame:
    """``spatial``: kernel density over all candidates; ``cross``: kernel mean over those of other sources. Both scaled by
    the query's peak, with a floor of 0.001; 1 for a single candidate (source)."""
    both = pairs(with_priors(c), ["p", "family"])
    kernel = lambda s: F.exp(-0.5 * F.pow(F.col("km") / max(0.1, s), F.lit(2)))
    other = F.col("family") != F.col("o_family")
    summed = both.groupBy(*Q, "item_id").agg(
        F.sum(F.col("o_p") * kernel(knobs.spatial_sigma_km)).alias("_s"),
        F.sum(F.when(other, F.col("o_p") * kernel(knobs.cross_sigma_km)).otherwise(0.0)).alias("_c"),
        F.sum(F.when(other, F.col("o_p")).otherwise(0.0)).alias("_o"),
        F.count(F.lit(1)).alias("_n"),
    )
    summed = summed.withColumn("_r", F.when(F.col("_o") <= 0, F.lit(1.0)).otherwise(F.col("_c") / F.col("_o")))
    single = F.max("_o").over(by_group(Q)) <= 0
    likes = summed.select(*Q, "item_id", F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(scaled_by_peak("_s", Q)).alias("spatial"), F.when(single, F.lit(1.0)).otherwise(scaled_by_peak("_r", Q)).alias("cross"))
    return c.join(likes, [*Q, "item_id"])


def source_prior(knobs: Knobs) -> Column:
    f = F.col("family")
    return F.greatest(F.lit(1e-3), F.when(f == "exif", F.lit(knobs.prior_exif)).when(f == "geoclip", F.lit(knobs.prior_geoclip)).otherwise(F.lit(knobs.prior_retrieval)))


def reweighted(c: DataFrame, like: str, strength: float) -> DataFrame:
    """``w`` times like ** strength, normalised again."""
    if strength <= 0:
        return c
    floor = lambda x: F.greatest(F.lit(1e-12), F.col(x))
    return c.withColumn("_l", F.log(floor("w")) + strength * F.log(floor(like))).withColumn("w", softmax("_l", Q)).drop("_l")


def plausibility(c: DataFrame, radius_km: float) -> DataFrame:
    """``plausible``: the posterior mass of the other candidates within the radius, scaled by its peak."""
    near = F.when((F.col("item_id") != F.col("o_item_id")) & (F.col("km") <= max(1.0, radius_km)), F.col("o_w")).otherwise(0.0)
    mass = pairs(c, ["w"]).groupBy(*Q, "item_id").agg(F.greatest(F.lit(1e-6), F.sum(near)).alias("_m"))
    peak = F.max("_m").over(by_group(Q))
    like = F.when(peak <= 1e-6, F.lit(1.0)).otherwise(F.greatest(F.lit(1e-3), F.least(F.lit(1.0), F.col("_m") / peak)))
    return c.join(mass.select(*Q, "item_id", like.alias("plausible")), [*Q, "item_id"])


def outlier_guard(c: DataFrame, min_scale_km: float = 120.0, mad_scale: float = 3.0) -> DataFrame:
    """``inlier``: decay with the distance from the medoid, on a scale from the lower median and deviation of distances;
    1 for lists of fewer than three."""
    total = pairs(c, []).groupBy(*Q, "item_id", "lat", "lon").agg(F.sum("km").alias("_t"))
    center = total.groupBy(*Q).agg(F.min_by(F.struct("lat", "lon"), F.struct(F.round("_t", 9), F.col("item_id"))).alias("_c"))
    d = c.join(center, Q).withColumn("_d", haversine_km("lat", "lon", "_c.lat", "_c.lon")).drop("_c")
    n = F.count(F.lit(1)).over(by_group(Q))

    def lower_median(df: DataFrame, value: str, name: str) -> DataFrame:
        at = F.row_number().over(by_group(Q).orderBy(value, "item_id"))
        return df.withColumn("_at", at).withColumn(name, F.max(F.when(F.col("_at") == F.ceil(n / 2), F.col(value))).over(by_group(Q))).drop("_at")

    d = lower_median(d, "_d", "_med").withColumn("_e", F.abs(F.col("_d") - F.col("_med")))
    d = lower_median(d, "_e", "_mad")
    scale = F.greatest(F.lit(max(1.0, min_scale_km)), F.col("_med") + max(0.0, mad_scale) * F.greatest(F.col("_mad"), F.lit(1e-6)))
    d = d.withColumn("_r", F.exp(-0.5 * F.pow(F.col("_d") / scale, F.lit(2))))
    return d.withColumn("inlier", F.when(n < 3, F.lit(1.0)).otherwise(scaled_by_peak("_r", Q))).drop("_d", "_e", "_med", "_mad", "_r")


def posterior(c: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """The candidates with their likelihoods and ``w``, the posterior weight."""
    c = spatial_and_cross_support(normalised_scores(c, knobs.normalise), knobs)
    log = lambda x: F.log(F.greatest(x, F.lit(1e-12)))
    logit = scaled_log_odds(F.col("norm"), knobs.temperature) + log(source_prior(knobs)) + max(knobs.spatial_weight_floor, knobs.spatial_weight) * log(F.col("spatial")) + max(0.0, knobs.cross_weight) * log(F.col("cross"))
    if knobs.reranker and knobs.reranker_weight > 0:
        likes = scored_by_model(candidate_features(c), knobs.reranker).select(*Q, "item_id", "rerank")
        c = c.join(likes, [*Q, "item_id"])
        logit = logit + knobs.reranker_weight * log(F.col("rerank"))
    c = c.withColumn("logit", logit).withColumn("w", softmax("logit", Q))
    if knobs.plausibility_weight > 0:
        c = reweighted(plausibility(c, knobs.plausibility_radius_km), "plausible", knobs.plausibility_weight)
    if knobs.outlier_strength > 0:
        c = reweighted(outlier_guard(c, knobs.outlier_min_scale_km, knobs.outlier_mad_scale), "inlier", knobs.outlier_strength)
    return c


def diagnostics(c: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """Per query: entropy, effective count, top-1, margin, calibrated top-1, tier, ambiguity."""
    w = F.col("w")
    top = c.groupBy(*Q).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(-w * F.log(F.greatest(w, F.lit(1e-12)))).alias("_h"),
        (1 / F.greatest(F.sum(w * w), F.lit(1e-12))).alias("effective"),
        F.sort_array(F.collect_list("w"), asc=False).alias("_w"),
    )
    top = top.withColumns({"entropy": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_h") / F.log(F.greatest(F.col("n"), F.lit(2))))), "top1": F.get("_w", 0), "margin": F.get("_w", 0) - F.coalesce(F.get("_w", 1), F.lit(0.0))})
    top = top.withColumn("calibrated_top1", calibrated(F.col("top1")))
    tier = F.when((F.col("calibrated_top1") >= knobs.high_threshold) & (F.col("margin") >= 0.20) & (F.col("entropy") <= 0.55), "high").when((F.col("calibrated_top1") >= knobs.medium_threshold) & (F.col("margin") >= 0.08) & (F.col("entropy") <= 0.80), "medium").otherwise("low")
    top = top.withColumn("tier", tier)
    return top.withColumn("ambiguous", (F.col("tier") == "low") | (F.col("effective") >= F.greatest(F.lit(3.0), 0.65 * F.col("n")))).drop("_h", "_w")


def by_weight() -> list[Column]:
    return [F.round("w", 9).desc(), F.col("item_id")]


def credible_set(c: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """Of the ``top_k`` heaviest: the shortest prefix that reaches the mass and the least size."""
    w = by_group(Q).orderBy(*by_weight())
    head = c.withColumn("at", F.row_number().over(w)).where(F.col("at") <= knobs.top_k)
    target = max(0.5, min(0.999, knobs.credible_mass))
    before = F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return head.withColumn("_before", before).where((F.col("_before") < target) | (F.col("at") <= max(1, knobs.min_credible))).drop("_before")


def weighted_position(c: DataFrame) -> DataFrame:
    """Per query: weighted mean position (dateline safe), covariance in metres and its ellipse."""
    norm = c.withColumn("v", F.col("w") / F.sum("w").over(by_group(Q)))
    angle = F.radians(F.col("lon"))
    mean = norm.groupBy(*Q).agg(F.sum(F.col("lat") * F.col("v")).alias("mean_lat"), F.sum(F.col("v") * F.sin(angle)).alias("_s"), F.sum(F.col("v") * F.cos(angle)).alias("_c"), F.sum(F.col("lon") * F.col("v")).alias("_l"))
    flat = (F.abs(F.col("_s")) < 1e-12) & (F.abs(F.col("_c")) < 1e-12)
    mean = mean.select(*Q, "mean_lat", wrap_longitude(F.when(flat, F.col("_l")).otherwise(F.degrees(F.atan2("_s", "_c")))).alias("mean_lon"))
    there = norm.join(mean, Q)
    x = longitude_offset("lon", "mean_lon") * F.greatest(F.lit(1e-6), F.abs(111320.0 * F.cos(F.radians("mean_lat"))))
    y = (F.col("lat") - F.col("mean_lat")) * 111320.0
    cov = there.withColumn("x", x).withColumn("y", y).groupBy(*Q, "mean_lat", "mean_lon").agg(F.count(F.lit(1)).alias("set_size"), *(F.sum(F.col("v") * F.col(a) * F.col(b)).alias(f"c{a}{b}") for a, b in ("xx", "xy", "yy")))
    return cov.withColumn("e", ellipse("cxx", "cxy", "cyy")).select(*Q, "mean_lat", "mean_lon", "set_size", F.col("e.major_m").alias("major_m"), F.col("e.minor_m").alias("minor_m"), F.col("e.orientation_deg").alias("orientation_deg"))


def fused(weighed: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """One row per query from its weighed candidates: position, ellipse, diagnostics. With a cluster's radius, the densest
    cluster stands for the credible set of ambiguous queries."""
    credible, told = credible_set(weighed, knobs), diagnostics(weighed, knobs)
    if knobs.cluster_radius_km > 0:
        unsure = credible.join(told.where("ambiguous").select(*Q), Q, "left_semi")
        dense = densest_cluster(unsure, knobs.cluster_radius_km, knobs.cluster_least_mass, max(1, knobs.min_credible))
        credible = dense.unionByName(credible.join(told.where("ambiguous").select(*Q), Q, "left_anti"))
    out = weighted_position(credible).join(told, Q)
    if knobs.high_cap:
        support = weighed.groupBy(*Q).agg(F.max_by("cross", F.struct(F.round("w", 9), -F.col("item_id"))).alias("top1_cross_support"))
        out = out.join(support, Q).withColumn("tier", capped_tier("tier", "top1_cross_support", "major_m", knobs.high_cap, knobs.medium_cap))
    return out


def fuse(c: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    return fused(written(posterior(c, knobs), "posterior"), knobs)


def densest_cluster(credible: DataFrame, radius_km: float, min_weight: float, min_size: int = 1) -> DataFrame:
    """Of each query's credible rows: the ball around one of them with the largest (mass, size, weight of its centre); all
    rows where no ball has the mass and ``min_size`` rows, or all rows if they are fewer."""
    both = pairs(credible, ["w"])
    sizes = credible.groupBy(*Q).agg(F.least(F.count(F.lit(1)), F.lit(min_size)).alias("_least"))
    both = both.where(F.col("km") <= max(1.0, radius_km))
    balls = both.groupBy(*Q, "item_id", "w").agg(F.sum("o_w").alias("mass"), F.count(F.lit(1)).alias("size")).join(sizes, Q).where((F.col("mass") >= min_weight) & (F.col("size") >= F.col("_least")))
    best = balls.groupBy(*Q).agg(F.max_by("item_id", F.struct(F.round("mass", 9), F.col("size"), F.round("w", 9), -F.col("item_id"))).alias("center"))
    members = both.join(best, Q).where(F.col("item_id") == F.col("center")).select(*Q, F.col("o_item_id").alias("item_id"), F.lit(True).alias("_in"))
    return credible.join(best, Q, "left").join(members, [*Q, "item_id"], "left").where(F.col("center").isNull() | F.col("_in")).drop("_in", "center")


def capped_tier(tier: str, support: str, radius_m: str, high=(0.30, 150_000.0), medium=(0.10, 800_000.0)) -> Column:
    """The tier lowered where cross-source support is too small or the radius too large."""
    t = F.when((F.col(tier) == "high") & ((F.col(support) < high[0]) | (F.col(radius_m) > high[1])), "medium").otherwise(F.col(tier))
    return F.when((t == "medium") & ((F.col(support) < medium[0]) | (F.col(radius_m) > medium[1])), "low").otherwise(t)


def adaptive_prefix(c: DataFrame, mass: float, least: int = 2) -> DataFrame:
    """The shortest prefix by weight with the given share of the weight, of ``least`` rows or more; lists of fewer than
    three stay whole."""
    w = by_group(Q).orderBy(*by_weight())
    n = F.count(F.lit(1)).over(by_group(Q))
    before = F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.sum("w").over(by_group(Q))
    marked = c.withColumns({"_n": n, "_at": F.row_number().over(w), "_b": before})
    return marked.where((F.col("_n") < 3) | (F.col("_b") < mass) | (F.col("_at") <= least)).drop("_n", "_at", "_b")


def evidence_text() -> Column:
    """One line on a candidate: its score, normalised score and likelihoods."""
    return F.format_string("retrieval=%.3f (norm=%.3f); likelihoods=spatial:%.3f,cross:%.3f", "score", "norm", "spatial", "cross")
