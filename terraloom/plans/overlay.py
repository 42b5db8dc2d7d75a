"""Location tables that the registered queries derive from the given tables: an index of vectors with coordinates, query
vectors (every hundredth row), street points, detections and reference points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scene import AXES, HISTOGRAMS, LEVELS
from ..operators.retrieval import similarity_topk
from ..sources.stage import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key: str, fine: bool = False):
    a, b, s = (10000, 20000, 1e5) if fine else (1000, 2000, 1e4)
    return (48.8 + F.pmod(F.col(key) * 7919, F.lit(a)).cast("double") / s).alias("lat"), (2.25 + F.pmod(F.col(key) * 104729, F.lit(b)).cast("double") / s).alias("lon")


def geo_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), F.concat(F.lit("idx"), F.col("vec_id") % 3).alias("source"), *_place("vec_id"), "embedding")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0)
    return e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("grp"), *_place("vec_id"), "embedding")


#: Candidate lists of the query that is being planned: one search serves all its parts.
_LISTS: dict[tuple[str, int], DataFrame] = {}


def planned(query, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query's plan; what it searches for is searched once, and not kept for the next query."""
    _LISTS.clear()
    try:
        return query(spark, sf_dir)
    finally:
        _LISTS.clear()


def candidates(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """query_id, source, item_id, lat, lon, score, match_id, rk: the best k other items of each source."""
    if (sf_dir, k) in _LISTS:
        return _LISTS[sf_dir, k]
    index, q = geo_index(spark, sf_dir), queries(spark, sf_dir)
    best = similarity_topk(index, q, k).join(index.select("item_id", "lat", "lon"), "item_id")
    # Written out: the lists are small beside the index, and what follows uses them several times.
    _LISTS[sf_dir, k] = written(best.withColumn("match_id", F.concat(F.lit("retrieval:"), "source", F.lit(":"), "item_id")), "candidates")
    return _LISTS[sf_dir, k]


def street_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("image_id"), F.col("user_id").alias("sequence"), F.col("ts").cast("timestamp").alias("captured_at"), *_place("event_id", fine=True),
        F.when(F.col("event_id") % 11 != 0, (F.col("event_id") * 37 % 360).cast("double")).alias("heading_deg"), F.col("event_type").alias("source"), F.col("value").alias("quality"),
    )


def reference_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref_id"), *_place("c_custkey"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("label"), (F.col("l_discount").cast("double") * 10).alias("confidence"),
        (F.col("l_partkey") % 50).cast("double").alias("x"), (F.col("l_suppkey") % 50).cast("double").alias("y"), F.col("l_quantity").cast("double").alias("w"), (5 + F.col("l_tax").cast("double") * 100).alias("h"),
    )


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("run"), F.col("o_orderpriority").alias("scenario")).agg((F.avg(F.col("o_totalprice").cast("double")) / 1e4).alias("value"))


def scene_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures read off the vectors: histograms from runs of them, levels and axes from single entries. Every seventh
    item has none."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 7 <> 0").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    at = lambda i: F.get("e", F.lit(i - 1))
    run = lambda first, size: F.transform(F.slice("e", first, size), F.abs)
    level = lambda i: F.least(F.lit(1.0), F.abs(at(i)) * 4)
    hists = [run(first, size).alias(h) for h, (first, size) in zip(HISTOGRAMS, ((1, 8), (9, 16), (25, 16), (41, 8), (49, 8)), strict=True)]
    levels = [level(57 + n if n < 8 else n - 7).alias(f) for n, f in enumerate(LEVELS)]
    axes = [F.when(at(3 + 2 * n) > 0, F.abs(at(4 + 2 * n)) * 720).alias(f) for n, f in enumerate(AXES)]
    return e.select("item_id", *hists, *levels, *axes)
