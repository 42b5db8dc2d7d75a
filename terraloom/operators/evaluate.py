"""Evaluation: errors, order statistics, reports, calibration and regression gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import distance_bucket, haversine_km
from ..functions.scores import by_group
from ..sources.scan import match_truth
from .retrieval import Q, ranked


def errors(c: DataFrame, truth: DataFrame) -> DataFrame:
    """Every candidate with its rank and ``km`` from the query's true place (t_lat, t_lon)."""
    t = truth.select(*Q, F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), "grp")
    return ranked(c).join(t, Q).withColumn("km", haversine_km("lat", "lon", "t_lat", "t_lon"))


def order_statistics(rows: DataFrame, keys: list[str], value: str, places: dict[str, Column], width: float = 0.01) -> DataFrame:
    """Per group of ``keys`` its size ``n`` and the values at the given places (from 0, columns of ``n``) of its sorted
    values. Values are counted by buckets of ``width`` first; only the buckets that hold a place are sorted, by value, and
    equal values are one row: no group is ever gathered or sorted whole."""
    keyed = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.floor(F.col(value) / width).alias("_b"))
    before = lambda part, order, n: F.coalesce(F.sum(n).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = keyed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_m"))
    counted = counted.withColumns({"_at": before(keys, "_b", "_m"), "n": F.sum("_m").over(Window.partitionBy(*keys))})
    wanted = counted.withColumn("_p", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), place.cast("long").alias("at")) for name, place in places.items()))))
    wanted = wanted.where((F.col("_p.at") >= F.col("_at")) & (F.col("_p.at") < F.col("_at") + F.col("_m"))).select(*keys, "_b", "n", "_p.name", (F.col("_p.at") - F.col("_at")).alias("_k"))
    same = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in [*keys, "_b"]))
    inside = keyed.alias("v").join(wanted.select(*keys, "_b").distinct().alias("w"), same("v", "w"), "left_semi")
    runs = inside.groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_m"))
    runs = runs.withColumn("_at", before([*keys, "_b"], "_v", "_m"))
    met = wanted.alias("w").join(runs.alias("r"), same("w", "r"))
    met = met.where((F.col("_k") >= F.col("_at")) & (F.col("_k") < F.col("_at") + F.col("_m")))
    return met.groupBy(*(F.col(f"w.{k}").alias(k) for k in keys)).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in places))


def nearest_rank(percent: float) -> Column:
    """The place at half-even rounding of p / 100 * (n - 1)."""
    return F.bround(F.lit(percent) / 100.0 * (F.col("n") - 1))


def distance_report(top: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean, upper median, the report's p90, nearest-rank percentiles and the shares within 1, 2, 5, 10 and 50 km."""
    keys = keys or []
    p90 = F.floor(F.col("n") * F.lit(0.9)) - 1
    places = {"median_km": F.floor(F.col("n") / 2), "p90_km": F.when(p90 < 0, F.col("n") - 1).otherwise(p90)} | {f"p{p}_km": nearest_rank(p) for p in (10, 25, 75, 95)}
    out = top.groupBy(*keys).agg(F.avg("km").alias("mean_km"), F.count("km").alias("evaluated"), *((F.avg((F.col("km") <= r).cast("double")) * 100).alias(f"within_{r}km_pct") for r in (1, 2, 5, 10, 50)))
    stats = order_statistics(top, keys, "km", places).drop("n")
    if not keys:
        return out.join(stats, F.lit(True), "left")  # one row each
    stats = stats.withColumnsRenamed({k: f"_{k}" for k in keys})
    return out.join(stats, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left").drop(*(f"_{k}" for k in keys))


def candidate_oracle(e: DataFrame) -> DataFrame:
    """Per query: distance and rank of the candidate nearest to the truth, and the number of candidates."""
    return e.groupBy(*Q).agg(F.min("km").alias("oracle_km"), F.min_by("rank", F.struct(F.round("km", 9), F.col("rank"))).cast("long").alias("oracle_rank"), F.count(F.lit(1)).alias("n_candidates"))


def bucket_report(top: DataFrame) -> DataFrame:
    return top.groupBy(distance_bucket("km").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("km").alias("mean_km"))


def group_report(e: DataFrame, radius_km: float, k: int) -> DataFrame:
    """Per group of queries: mean and median top-1 error, top-k hit rate, and the group's place by mean error, the hardest
    first."""
    per = e.groupBy(*Q, "grp").agg(F.max(F.when(F.col("rank") == 1, F.col("km"))).alias("km"), F.max(((F.col("rank") <= k) & (F.col("km") <= radius_km)).cast("double")).alias("hit"))
    middle = order_statistics(per, ["grp"], "km", {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)})
    out = per.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("km").alias("mean_km"), F.avg("hit").alias("hit_rate"))
    joined = out.join(middle.select(F.col("grp").alias("_g"), ((F.col("low") + F.col("high")) / 2).alias("median_km")), F.col("grp").eqNullSafe(F.col("_g")), "left").drop("_g")
    return joined.withColumn("hardest", F.row_number().over(Window.orderBy(F.round("mean_km", 9).desc(), "grp")))


def recall_report(e: DataFrame, ks=(1, 5, 10), radii=(0.5, 1.0, 2.0, 5.0)) -> DataFrame:
    """Long form: recall at k within a radius. A distance of exactly 0 is a hit."""
    total = e.select(F.countDistinct(*Q).alias("n"))
    grid = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(r).alias("radius_km")) for k in ks for r in radii)))
    hits = e.select(*Q, "rank", "km", grid.alias("g")).groupBy("g.k", "g.radius_km", *Q).agg(F.max(((F.col("rank") <= F.col("g.k")) & (F.col("km") <= F.col("g.radius_km"))).cast("double")).alias("hit"))
    return hits.groupBy("k", "radius_km").agg(F.avg("hit").alias("recall")).crossJoin(F.broadcast(total)).select("k", "radius_km", "recall", "n")


def source_reliability(e: DataFrame, radius_km: float) -> DataFrame:
    """Per source: queries, hits of the best candidate within the radius, the rate, and the smoothed prior, relative to
    the mean of the sources and clipped to [0.25, 4]."""
    w = Window.partitionBy(*Q, "source").orderBy("rank")
    best = e.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    rate = best.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("km") <= radius_km).cast("long")).alias("hits")).withColumn("rate", (F.col("hits") + 1) / (F.col("n") + 2))
    return rate.withColumn("prior", F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.col("rate") / F.avg("rate").over(Window.partitionBy()))))


def calibration_report(rows: DataFrame, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """From (conf, hit): expected calibration error over equal bins (1.0 in the last), Brier score, log loss."""
    c, y = F.col("conf"), F.col("hit").cast("double")
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), c))
    b = rows.withColumn("b", F.least(F.floor(c * bins), F.lit(bins - 1))).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("acc"), F.avg(c).alias("mean_conf"), F.sum(F.pow(c - y, F.lit(2))).alias("sq"), F.sum(F.when(y == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("nl"))
    n = F.sum("n")
    return b.agg(n.alias("n"), (F.sum(F.abs(F.col("acc") - F.col("mean_conf")) * F.col("n")) / n).alias("ece"), (F.sum("sq") / n).alias("brier"), (F.sum("nl") / n).alias("nll"))


def calibration_fit(rows: DataFrame) -> DataFrame:
    """The scale and bias of the 31 x 41 grid (0.5 to 3.5, -2 to 2) with the lowest log loss; the first on ties. Rows are
    first counted by confidence rounded to 6 digits, so that the grid meets counts, not rows."""
    counted = rows.groupBy(F.round("conf", 6).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("double")).alias("ones"))
    u = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("c")))
    grid = rows.sparkSession.range(31 * 41).select(F.col("id").alias("g"), (0.5 + F.floor(F.col("id") / 41) * 0.1).alias("scale"), (-2.0 + (F.col("id") % 41) * 0.1).alias("bias"))
    p = 1 / (1 + F.exp(-(F.log(u / (1 - u)) * F.col("scale") + F.col("bias"))))
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    loss = counted.crossJoin(F.broadcast(grid)).groupBy("g", "scale", "bias").agg((-F.sum(F.col("ones") * F.log(q) + (F.col("n") - F.col("ones")) * F.log(1 - q)) / F.sum("n")).alias("loss"))
    return loss.orderBy(F.round("loss", 9), "g").limit(1).select("scale", "bias", "loss")


def compare_runs(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Outer join of two runs' values: delta and per cent, null if one is missing, and what became of it (less is better)."""
    j = base.select(*keys, F.col("value").alias("before")).join(other.select(*keys, F.col("value").alias("after")), keys, "full")
    delta = F.col("after") - F.col("before")
    return j.withColumns({"delta": delta, "delta_pct": F.when(F.col("before") != 0, 100 * delta / F.abs(F.col("before"))), "verdict": F.when(delta.isNull(), "missing").when(F.abs(delta) < 1e-9, "unchanged").when(delta < 0, "improved").otherwise("regressed")})


def policy_check(compared: DataFrame, max_regression: float, max_regression_pct: float) -> DataFrame:
    allowed = F.greatest(F.lit(max_regression), F.abs(F.col("before")) * max_regression_pct / 100)
    return compared.withColumn("allowed", allowed).withColumn("passed", F.coalesce(F.col("delta") <= F.col("allowed"), F.lit(False)))


def standardised(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Population mean and deviation removed; a tiny deviation counts as 1."""
    w = by_group(keys)
    z = lambda x: (F.col(x) - F.avg(x).over(w)) / F.when(F.stddev_pop(x).over(w) < 1e-9, F.lit(1.0)).otherwise(F.stddev_pop(x).over(w))
    return df.withColumns({f"z_{x}": z(x) for x in columns})


def tier_threshold(rows: DataFrame, target: float, least: int, digits: int = 2) -> DataFrame:
    """From (conf, hit): the highest confidence, rounded, from which on there are ``least`` rows of at least the target
    precision. Rows are counted by rounded confidence first."""
    counted = rows.groupBy(F.round("conf", digits).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))
    w = Window.orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counted.select("threshold", F.sum("n").over(w).alias("support"), (F.sum("hits").over(w) / F.sum("n").over(w)).alias("precision"))
    return run.where((F.col("support") >= least) & (F.col("precision") >= target)).orderBy(F.col("threshold").desc()).limit(1)


def worst_failures(e: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Per query the ``n`` largest errors, one per rounded key."""
    first = e.withColumn("_n", F.row_number().over(Window.partitionBy(*Q, *keys).orderBy(F.round("km", 9).desc(), "item_id"))).where("_n = 1").drop("_n")
    return first.withColumn("at", F.row_number().over(by_group(Q).orderBy(F.round("km", 9).desc(), "item_id"))).where(F.col("at") <= n)


def objective_ranking(values: DataFrame, keys: list[str]) -> DataFrame:
    """Places by a chain of keys, each smaller first and nulls last."""
    order = [F.col(k).asc_nulls_last() for k in keys]
    return values.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def regression_gate(compared: DataFrame, absolute: float, relative_pct: float) -> DataFrame:
    """One row: how many values regressed by more than the larger of the absolute and relative allowance, and whether the
    run passes; a missing value fails."""
    bad = F.coalesce(F.col("delta") > F.greatest(F.lit(absolute), F.abs("before") * relative_pct / 100), F.lit(True))
    return compared.agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("n_failed")).withColumn("passed", F.col("n_failed") == 0)


def utility_weights(rows: DataFrame, keys: list[str], score: str, temperature: float) -> DataFrame:
    """Softmax of score / temperature within each group."""
    w = by_group(keys)
    e = F.exp((F.col(score) - F.max(score).over(w)) / max(1e-6, temperature))
    return rows.withColumn("weight", e / F.sum(e).over(w))


def view_agreement(ranks: DataFrame, top_n: int, n_views: int) -> DataFrame:
    """From (query_id, view, item_id, rank): the items' share of the reciprocal ranks that agreement could give them."""
    best = sum(1.0 / r for r in range(1, top_n + 1)) * n_views
    return ranks.where(F.col("rank") <= top_n).groupBy(*Q, "item_id").agg((F.sum(1.0 / F.col("rank")) / best).alias("agreement"))


def metric_report(assessed: DataFrame, truth: DataFrame, radius_km: float = 1.0, top_k: int = 5, bins: int = 10) -> DataFrame:
    """One row on results as ``sources.results.assessed`` gives them, and the truth (image, lat, lon): hits of the first and
    of the first ``top_k``, distances, support, coverage and precision by tier, buckets, calibration, radius. Radius and
    support count results with candidates; the rest those that have a true place as well."""
    some = assessed.where(F.col("image").isNotNull() & (F.size("candidates") > 0))
    far = F.transform("candidates", lambda x: haversine_km(F.col("t.lat"), F.col("t.lon"), x["latitude"], x["longitude"]))
    met = match_truth(some, truth).where("t is not null").withColumn("d", far).withColumn("km", F.get("d", F.lit(0)))
    any_within = lambda n, r: F.exists(F.slice("d", 1, n), lambda x: x <= r).cast("double")
    hit = (F.col("km") <= radius_km).cast("double")
    rated = F.col("tier").isin("high", "medium")
    bucket = distance_bucket("km")
    names = {"0-1km": "n_0_1km", "1-5km": "n_1_5km", "5-25km": "n_5_25km", "25-100km": "n_25_100km", ">100km": "n_over_100km"}
    row = met.agg(
        F.count(F.lit(1)).alias("with_ground_truth"), F.avg(hit).alias("top1"), F.avg(any_within(top_k, radius_km)).alias("topk"), F.avg("km").alias("top1_mean_km"), (100 * F.avg(any_within(5, 25.0))).alias("top5_within_25km_pct"),
        (100 * F.avg(F.col("tier").eqNullSafe("high").cast("double"))).alias("high_confidence_coverage_pct"), F.avg(F.when(F.col("tier") == "high", hit)).alias("high_confidence_top1"),
        (100 * F.avg(F.coalesce(rated, F.lit(False)).cast("double"))).alias("medium_or_higher_coverage_pct"), F.avg(F.when(rated, hit)).alias("medium_or_higher_top1"), *(F.count_if(bucket == b).alias(n) for b, n in names.items()),
    )
    whole = assessed.agg(F.count(F.lit(1)).alias("total"))
    seen = some.agg(F.avg("support").alias("avg_top1_cross_source_support"), F.avg("radius_m").alias("avg_uncertainty_radius_m"))
    middle = order_statistics(met, [], "km", {"top1_median_km": F.floor(F.col("n") / 2)}).select("top1_median_km")
    score = F.get("candidates", F.lit(0))["score"]
    conf = F.when(F.isnan(score), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    calibration = calibration_report(met.select(conf.alias("conf"), hit.alias("hit")), bins).drop("n")
    out = whole
    for one in (row, seen, middle, calibration):  # one row each
        out = out.join(one, F.lit(True), "left")
    return out


def provider_report(rows: DataFrame) -> DataFrame:
    """Per (model, error; null where none): rows, and mean, least and largest score of those without an error."""
    return rows.groupBy("model", "error").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def promoted(runs: DataFrame, run: str, profile: str, baseline: DataFrame | None = None) -> DataFrame:
    """The baseline (profile, scenario, value, run) with the values of a chosen run in place of that profile's old ones."""
    fresh = runs.where(F.col("run") == run).select(F.lit(profile).alias("profile"), "scenario", "value", "run")
    return fresh if baseline is None else baseline.where(F.col("profile") != profile).select(*fresh.columns).unionByName(fresh)


def best_round(rounds: DataFrame, objective: str, higher: bool) -> DataFrame:
    """The round (columns round, mean_km, within_2km_pct and the objective) that no later one improves: by the objective;
    on ties by mean_km if higher is better, else by the share within 2 km; then the first."""
    aim = F.col(objective).desc_nulls_last() if higher else F.col(objective).asc_nulls_last()
    ties = F.col("mean_km").asc_nulls_last() if higher else F.coalesce("within_2km_pct", F.lit(0.0)).desc()
    return rounds.orderBy(aim, ties, "round").limit(1)


def score_report(top: DataFrame, expected: DataFrame) -> DataFrame:
    """One row on first candidates (query_id, score, km; km null without a place) of the expected queries: how many have no
    candidate, how many no distance, and mean, least and largest score."""
    j = expected.select(*Q).join(top.select(*Q, "score", "km", F.lit(True).alias("_there")), Q, "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_there").isNull()).alias("n_missing"), F.count_if(F.col("_there") & F.col("km").isNull()).alias("n_null"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def crossview_report(e: DataFrame) -> DataFrame:
    """One row: the shares of first candidates within 0.1 to 5 km, and of queries with a hit among the first 1, 5 and 10
    within 0.1 to 1 km."""
    names = {0.1: "100m", 0.25: "250m", 0.5: "500m", 1.0: "1km", 2.0: "2km", 5.0: "5km"}
    hit = lambda k, r: F.max(((F.col("rank") <= k) & (F.col("km") <= r)).cast("double")).alias(f"h{k}_{names[r]}")
    grid = [(k, r) for k in (1, 5, 10) for r in (0.1, 0.25, 0.5, 1.0)]
    per = e.groupBy(*Q).agg(*(hit(k, r) for k, r in [*grid, (1, 2.0), (1, 5.0)]))
    return per.agg(F.count(F.lit(1)).alias("evaluated"), *((100 * F.avg(f"h1_{n}")).alias(f"within_{n}_pct") for n in names.values()), *((100 * F.avg(f"h{k}_{names[r]}")).alias(f"top{k}_recall_{names[r]}_pct") for k, r in grid))


def metric_gate(compared: DataFrame, tolerances: DataFrame) -> DataFrame:
    """Per metric of two runs (metric, before, after) whether it passes its tolerance (metric, kind, absolute, relative): a
    hit rate may drop by ``absolute``; an error may grow by the larger of both; a count must keep 95 %. A missing value
    fails, but for an error that both runs lack, and for counts."""
    j = tolerances.join(compared, "metric", "left")
    before, after = F.col("before"), F.col("after")
    ok = (
        F.when(F.col("kind") == "rate", F.coalesce(after >= before - F.col("absolute"), F.lit(False)))
        .when(F.col("kind") == "error", (before.isNull() & after.isNull()) | F.coalesce(after <= before + F.greatest(F.col("absolute"), before * F.col("relative")), F.lit(False)))
        .otherwise(F.coalesce((before <= 0) | (after >= 0.95 * before), F.lit(True)))
    )
    return j.select("metric", "kind", "before", "after", ok.alias("passed"))


def tier_thresholds(rows: DataFrame, high: tuple[float, int], medium: tuple[float, int]) -> DataFrame:
    """One row: the thresholds of both tiers, each with its target precision and least support; medium never above high."""
    one = lambda target, name: tier_threshold(rows, *target).select(F.col("threshold").alias(name))
    j = one(high, "high").join(one(medium, "medium"), F.lit(True), "full")
    return j.withColumn("medium", F.when(F.col("high").isNotNull(), F.least("medium", "high")).otherwise(F.col("medium")))
