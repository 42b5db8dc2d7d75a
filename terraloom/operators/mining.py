"""Hard-example mining from candidates with a known error."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.scores import by_group
from ..sources.stage import written
from .ranges import RANGE_ROWS, first_of_keys, quotas_by_cell
from .retrieval import Q
from .spatial import first_by_key, nearest_in_ring, running_totals


def triplet_items(e: DataFrame, positive_km: float, near_km: float, far_km: float, n: int) -> DataFrame:
    """Candidates (with rank and km) as items of triplets: up to ``n`` positives within ``positive_km``, else the closest
    one; up to ``n`` negatives between ``near_km`` and ``far_km``, best ranks first. Queries without negatives are lost."""
    close = F.row_number().over(by_group(Q).orderBy(F.round("km", 9), "item_id"))
    inside = F.sum((F.col("km") <= positive_km).cast("int")).over(by_group(Q))
    m = e.withColumns({"_close": close, "_inside": inside})
    positive = F.when(F.col("_inside") > 0, (F.col("km") <= positive_km) & (F.col("_close") <= n)).otherwise(F.col("_close") == 1)
    m = m.withColumn("role", F.when(positive, "positive").when(F.col("km").between(near_km, far_km), "negative")).where("role is not null")
    m = m.withColumn("at", F.row_number().over(Window.partitionBy(*Q, "role").orderBy("rank"))).where(F.col("at") <= n)
    return m.withColumn("_neg", F.max((F.col("role") == "negative").cast("int")).over(by_group(Q))).where("_neg = 1").select(*Q, "role", "item_id", "at", "km", "score")


def capped_reuse(items: DataFrame, cap: int) -> DataFrame:
    """A negative stays in the first ``cap`` queries that use it; queries whose negatives are all gone are lost."""
    use = F.row_number().over(Window.partitionBy("role", "item_id").orderBy("query_id"))
    kept = items.withColumn("_use", use).where((F.col("role") == "positive") | (F.col("_use") <= cap)).drop("_use")
    return kept.withColumn("_neg", F.max((F.col("role") == "negative").cast("int")).over(by_group(Q))).where("_neg = 1").drop("_neg")


def triplet_summary(items: DataFrame) -> DataFrame:
    return items.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("queries"), F.countDistinct("item_id").alias("items"), F.avg("km").alias("mean_km"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def margin_stats(items: DataFrame, margin: float = 0.1) -> DataFrame:
    """Hardest positive minus hardest negative score per query: mean, share above 0, hinge loss."""
    per = items.groupBy(*Q).agg((F.min(F.when(F.col("role") == "positive", F.col("score"))) - F.max(F.when(F.col("role") == "negative", F.col("score")))).alias("m"))
    return per.agg(F.count("m").alias("n"), F.avg("m").alias("mean_margin"), F.avg((F.col("m") > 0).cast("double")).alias("satisfied"), F.avg(F.greatest(F.lit(0.0), margin - F.col("m"))).alias("hinge"))


def with_vectors(items: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training rows: query_id, role, item_id, embedding, without the query itself or repeats and only of queries that
    still have both roles; the number of rows dropped, by reason)."""
    own = items.withColumn("reason", F.when(F.col("item_id") == F.col("query_id"), "self"))
    again = F.row_number().over(Window.partitionBy(*Q, "role", "item_id").orderBy("at"))
    own = own.withColumn("reason", F.coalesce("reason", F.when(again > 1, F.lit("repeat"))))
    met = own.join(index.select("item_id", "embedding"), "item_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("embedding").isNull(), "no vector")))
    roles = F.size(F.collect_set(F.when(F.col("reason").isNull(), F.col("role"))).over(by_group(Q)))
    met = met.withColumn("reason", F.coalesce("reason", F.when(roles < 2, "one role left")))
    return met.where("reason is null").select(*Q, "role", "item_id", "embedding"), met.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def pair_features(c: DataFrame, index: DataFrame, queries: DataFrame) -> DataFrame:
    """Per candidate the sums of the product and of the absolute difference of both vectors, its score, reciprocal rank and
    whether its source is the query's best."""
    q = queries.select(*Q, F.col("embedding").alias("qv"))
    j = c.join(index.select("item_id", F.col("embedding").alias("v")), "item_id").join(q, Q)
    total = lambda f: F.aggregate(F.zip_with("qv", "v", lambda a, b: f(a.cast("double"), b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    best = F.first("source").over(by_group(Q).orderBy(F.round("score", 9).desc(), "item_id"))
    return j.select(*Q, "item_id", total(lambda a, b: a * b).alias("product"), total(lambda a, b: F.abs(a - b)).alias("difference"), "score", (1.0 / F.col("rk")).alias("reciprocal_rank"), (F.col("source") == best).alias("best_source"))


def severity_weights(items: DataFrame, cap: float, power: float) -> DataFrame:
    """Per query ln(1 + error) of its first candidate over the mean of all, capped and raised to a power."""
    per = items.where("rank = 1").select(*Q, F.log1p("km").alias("s"))
    mean = per.agg(F.avg("s").alias("mean"))
    share = F.when(F.col("mean") > 0, F.col("s") / F.col("mean")).otherwise(F.lit(1.0))
    return per.crossJoin(F.broadcast(mean)).select(*Q, F.pow(F.least(F.lit(cap), share), F.lit(power)).alias("weight"))


def _listed(rows: DataFrame, keys: list[str], name: str, fields: list[str], at: str = "at") -> DataFrame:
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), *fields))).alias("_l"))
    return packed.select(*keys, F.transform("_l", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))


def _place(rows: DataFrame, keys: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def failure_triplets(failures: DataFrame, references: DataFrame, min_error_km: float = 2.0, positive_km: float = 0.35, predicted_km: float = 2.0, least_km: float = 2.0, most_km: float = 25.0, max_positives: int = 3, max_negatives: int = 10, reference_km: float = 10.0, max_weight: float = 3.0) -> DataFrame:
    """Triplets of failed queries (query_path, scene, lat, lon, pred_lat, pred_lon, km) among references (path, scene, lat,
    lon): positives near the true place; negatives near the wrong prediction, then in a ring around the true place. One
    reference per scene, none of the query's scene or a positive's. Each list is the nearest scenes, searched by growing
    radii, and what is gathered is the lists. A query_path is one failure."""
    key = ["query_path"]
    failed = failures.where(F.col("km").isNull() | (F.col("km") >= min_error_km))
    asked = failed.select("query_path", F.col("scene").alias("q_scene"), "lat", "lon")
    refs = references.select("path", "scene", "lat", "lon")

    def one_per_scene(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
        first = rows.withColumn("_n", _place(rows, [*key, "scene"], order)).where("_n = 1").drop("_n")
        return first.withColumn("at", _place(first, key, order)).where(F.col("at") <= most)

    by_truth = [F.round("distance_to_gt_km", 9), F.col("path")]
    near = nearest_in_ring(asked, refs, "query_path", 0.0, positive_km, max_positives).withColumnRenamed("km", "distance_to_gt_km")
    positives = written(one_per_scene(near, by_truth, max_positives).select(*key, "at", "path", "scene", "distance_to_gt_km"), "positives")
    going = asked.join(positives.select(*key).distinct(), key, "left_semi")
    wrong = failed.where("pred_lat is not null and pred_lon is not null").join(going.select(*key), key, "left_semi")
    wrong = wrong.select(*key, F.col("scene").alias("q_scene"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), F.col("pred_lat").alias("lat"), F.col("pred_lon").alias("lon"))
    truly = haversine_km("t_lat", "t_lon", "r_lat", "r_lon")
    barred = positives.select(*key, "scene")
    first = nearest_in_ring(wrong, refs, "query_path", 0.0, predicted_km, max_negatives, barred, max_positives + 1, truly >= least_km).withColumn("distance_to_gt_km", truly)
    first = first.select(*key, "path", "scene", "distance_to_gt_km", F.col("km").alias("distance_to_pred_km"), F.lit("pred_neighborhood").alias("source"))
    # Scenes near the prediction may be among the ring's nearest as well.
    ring = nearest_in_ring(going, refs, "query_path", least_km, most_km, 2 * max_negatives, barred, max_positives + 1)
    ring = ring.select(*key, "path", "scene", F.col("km").alias("distance_to_gt_km"), F.lit(None).cast("double").alias("distance_to_pred_km"), F.lit("gt_ring").alias("source"))
    pool = first.unionByName(ring)
    order = [F.col("source") == "gt_ring", F.round(F.coalesce("distance_to_pred_km", "distance_to_gt_km"), 9), F.col("path")]
    negatives = one_per_scene(pool, order, max_negatives)
    lists = _listed(positives, key, "positives", ["path", "distance_to_gt_km"]).join(_listed(negatives, key, "hard_negatives", ["path", "distance_to_gt_km", "distance_to_pred_km", "source"]), key)
    severity = F.log1p(F.greatest(F.lit(0.0), F.coalesce("km", F.lit(0.0)))) / math.log1p(max(0.1, reference_km))
    mixed = 0.5 * F.size(F.filter("hard_negatives", lambda x: x["source"] == "pred_neighborhood")) / F.size("hard_negatives")
    weight = F.least(F.lit(max(1.0, max_weight)), F.greatest(F.lit(1.0), 1 + severity + mixed))
    return lists.join(failed.select(*key, "lat", "lon", "pred_lat", "pred_lon", "km"), key).withColumn("triplet_weight", weight)


def crossview_triplets(pairs: DataFrame, aerials: DataFrame, positive_km: float, least_km: float, most_km: float, max_positives: int, max_negatives: int) -> DataFrame:
    """Triplets of street images (query_id, lat, lon, aerial_id) among aerial images (aerial_id, lat, lon): the paired image
    first, then near ones; negatives from a ring, nearest first, that are no positives. Queries without either are left out."""
    key, by_km = ["query_id"], [F.round("km", 9), F.col("aerial_id")]
    paired = pairs.select("query_id", "lat", "lon", "aerial_id").join(aerials.select("aerial_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")), "aerial_id")
    exact = paired.select("query_id", "aerial_id", haversine_km("lat", "lon", "r_lat", "r_lon").alias("km"), F.lit(0).alias("late"))
    place = F.min(F.struct("lat", "lon")).alias("p")
    asked = pairs.groupBy("query_id").agg(place).select("query_id", F.lit(None).cast("string").alias("q_scene"), "p.lat", "p.lon")
    refs = aerials.select(F.col("aerial_id").alias("path"), F.col("aerial_id").alias("scene"), "lat", "lon")
    most_of = lambda low, high, n, barred, spare: nearest_in_ring(asked, refs, "query_id", low, high, n, barred, spare, paths=False).select("query_id", F.col("scene").alias("aerial_id"), "km")
    own = exact.select("query_id", F.col("aerial_id").alias("scene"))
    near = most_of(0.0, positive_km, max(1, max_positives), own, 1).join(exact.select("query_id", "aerial_id"), ["query_id", "aerial_id"], "left_anti").withColumn("late", F.lit(1))
    both = exact.unionByName(near)
    placed = both.withColumn("at", _place(both, key, [F.col("late"), *by_km])).where(F.col("at") <= F.greatest(F.lit(1), F.lit(max_positives)))
    placed = written(placed.select("query_id", "at", "aerial_id", "km"), "positives")
    ring = most_of(least_km, most_km, max(1, max_negatives), placed.select("query_id", F.col("aerial_id").alias("scene")), max(1, max_positives)).join(placed.select("query_id", "aerial_id"), ["query_id", "aerial_id"], "left_anti")
    negatives = ring.withColumn("at", _place(ring, key, by_km)).where(F.col("at") <= max(1, max_negatives))
    return _listed(placed, key, "positives", ["aerial_id", "km"]).join(_listed(negatives, key, "hard_negatives", ["aerial_id", "km"]), key)


def quota_sample(candidates: DataFrame, per_cell: int, per_sequence: int, order: list[Column], most: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Of candidates (cell, image_id, sequence, ...; the cells in their order) the best by ``order`` in each cell, one of a
    sequence per cell and ``per_sequence`` of it in all, an image once; the first ``most`` by cell and order. What a cell
    may take of a sequence depends on the cells before it."""
    once = first_by_key(candidates, ["image_id"], [F.col("cell"), *order])
    pool = once.withColumn("_k", F.row_number().over(Window.partitionBy("cell").orderBy(*order, "image_id")))
    taken = quotas_by_cell(pool, per_cell, max(1, per_sequence), range_rows)
    if most is None:
        return taken.drop("_k")
    # How many the cells before it took: cells are counted by ranges of their order first, then within each range.
    sizes = taken.groupBy("cell").agg(F.count(F.lit(1)).alias("_c"))
    start = running_totals(sizes, "cell", "_c", "_b")
    at = F.col("_b") + F.row_number().over(Window.partitionBy("cell").orderBy("_k"))
    return taken.join(start, "cell").withColumn("_at", at).where(F.col("_at") <= most).drop("_k", "_b", "_at")


def merged_once(rows: DataFrame, keys: list[str], order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Walks the rows in order and takes one if none of its ``keys`` was taken before; rows without a key are left out.
    ``order`` should leave no ties; the keys settle those that it leaves, and of rows that are equal in all one is taken."""
    ok = rows
    for k in keys:
        ok = ok.where(F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != ""))
    return first_of_keys(ok, keys, [*order, *keys], range_rows)


def most_reused(items: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` negatives that most queries use, with their number."""
    uses = items.where("role = 'negative'").groupBy("item_id").agg(F.countDistinct("query_id").alias("uses"))
    return uses.orderBy(F.col("uses").desc(), "item_id").limit(n)


def weight_summary(weights: DataFrame, items: DataFrame) -> DataFrame:
    """One row: triplets, mean positives and negatives, least, mean and largest weight, distinct items."""
    per = items.groupBy(*Q).agg(F.count_if(F.col("role") == "positive").alias("p"), F.count_if(F.col("role") == "negative").alias("m"))
    totals = per.join(weights, Q, "left").agg(F.count(F.lit(1)).alias("triplets"), F.avg("p").alias("mean_positives"), F.avg("m").alias("mean_negatives"), F.min("weight").alias("min_weight"), F.avg("weight").alias("mean_weight"), F.max("weight").alias("max_weight"))
    return totals.join(items.agg(F.countDistinct("item_id").alias("items")), F.lit(True), "left")
