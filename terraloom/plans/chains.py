"""Composite plans: the retrieval chain and the comparison of scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluate, greedy, rerank, retrieval
from ..sources.stage import written


@dataclass(frozen=True)
class RetrievalKnobs:
    """A stage whose knob is at its neutral value returns its input as it is."""

    norm: str = "none"
    agreement_weight: float = 0.0
    agreement_top_n: int = 10
    weights: dict[str, float] | None = None
    reciprocal_rank: bool = False
    structure_weight: float = 0.0
    structure_top_n: int = 20
    local_weight: float = 0.0
    local_top_n: int = 20
    min_score: float | None = None
    min_keep: int = 0
    box: tuple[float, float, float, float] | None = None
    hard_box: bool = False
    locality_radius_km: float = 0.0
    locality_weight: float = 0.0
    balance_beta: float = 0.0
    graph_top_n: int = 0
    diverse_km: float = 0.0
    diverse_weight: float = 0.7
    consensus_top_n: int = 0
    consensus_radius_km: float = 3.0
    consensus_power: float = 1.5
    density_top_n: int = 0
    density_sigma_km: float = 2.0
    density_power: float = 2.0
    density_mass: float = 0.0
    #: Where the first candidate leads by this score, a mode this far away is not taken (0: any mode is).
    density_margin: float = 0.0
    density_switch_km: float = 0.0
    top_k: int = 10


def _rescored(c: DataFrame, scores: DataFrame, column: str) -> DataFrame:
    joined = c.drop("score").join(scores.select("query_id", "item_id", F.col(column).alias("score")), ["query_id", "item_id"])
    return written(joined, "chain")  # lists are small beside the index, and the next stage uses them several times


def retrieval_chain(c: DataFrame, knobs: RetrievalKnobs, views: DataFrame | None = None) -> DataFrame:
    """Normalise, agreement of the query's views, fusion by weights or reciprocal ranks, de-duplicate, evidence of
    structure and of local matches (columns ``structure`` and ``local``), box prior, threshold, locality, source balance,
    graph support, diversity, rank, consensus, density mode: in this order. Queries are expanded, and views reduced, by the
    search before it; ``views`` (query_id, source, item_id, view, score) is how each view saw the candidates, and agreement
    is taken in each source's list, before sources are merged."""
    if knobs.norm != "none":
        c = retrieval.normalise_by_source(c, knobs.norm).drop("score").withColumnRenamed("norm", "score")
    if knobs.agreement_weight > 0:
        if views is None:
            raise ValueError("agreement needs the views' scores")
        order = Window.partitionBy("query_id", "source", "view").orderBy(F.round("score", 9).desc(), "item_id")
        ranks = written(views.withColumn("rank", F.row_number().over(order)), "views")
        n_views = ranks.select("view").distinct().count()
        c = written(rerank.with_agreement(c, ranks, knobs.agreement_top_n, n_views, knobs.agreement_weight, ("source",)), "chain")
    if knobs.weights:
        c = retrieval.fuse_by_weight(c.withColumn("norm", F.col("score")), knobs.weights).drop("score", "norm").withColumnRenamed("fused", "score")
    elif knobs.reciprocal_rank:
        c = _rescored(c, retrieval.fuse_by_reciprocal_rank(c), "fused")
    c = retrieval.distinct_places(c)
    if knobs.structure_weight > 0:
        c = written(rerank.reranked_behind_gate(c, "structure", rerank.STRUCTURE, knobs.structure_top_n, knobs.structure_weight), "chain")
    if knobs.local_weight > 0:
        c = written(rerank.reranked_behind_gate(c, "local", rerank.LOCAL_MATCH, knobs.local_top_n, knobs.local_weight), "chain")
    if knobs.box:
        c = retrieval.geo_prior(c, knobs.box, knobs.hard_box).drop("score", "box_km").withColumnRenamed("adjusted", "score")
    if knobs.min_score is not None:
        c = written(retrieval.with_backfill(c, knobs.min_score, knobs.min_keep), "chain")
    if knobs.locality_radius_km > 0 and knobs.locality_weight > 0:
        c = _rescored(c, retrieval.rerank_by_locality(c, knobs.locality_radius_km, knobs.locality_weight), "local_score")
    if knobs.balance_beta > 0:
        c = retrieval.balanced_by_source(c, knobs.top_k, knobs.balance_beta).drop("balanced")
    if knobs.graph_top_n > 1:
        c = _rescored(c, retrieval.rerank_by_graph(c, knobs.graph_top_n), "graph_score")
    if knobs.diverse_km > 0:
        c = c.join(greedy.diverse(c, knobs.top_k, knobs.diverse_km, knobs.diverse_weight).select("query_id", "item_id"), ["query_id", "item_id"], "left_semi")
    c = retrieval.ranked(c).where(F.col("rank") <= knobs.top_k)
    if knobs.consensus_top_n > 1:
        c = rerank.refined_by_consensus(written(c, "chain").drop("rank"), knobs.consensus_top_n, knobs.consensus_radius_km, knobs.consensus_power)
    if knobs.density_top_n > 1:
        c = rerank.refined_by_density(written(c, "chain").drop("rank"), knobs.density_top_n, knobs.density_sigma_km, knobs.density_power, knobs.density_margin, knobs.density_switch_km, mass=knobs.density_mass)
    return c


def compare_scenarios(c: DataFrame, truth: DataFrame, scenarios: dict[str, RetrievalKnobs]) -> DataFrame:
    """One row per scenario: the distance report of its first candidates, and its place by mean error."""
    out = None
    for name, knobs in scenarios.items():
        top = evaluate.errors(retrieval_chain(c, knobs).drop("rank"), truth).where("rank = 1").withColumn("scenario", F.lit(name))
        out = top if out is None else out.unionByName(top, allowMissingColumns=True)
    report = evaluate.distance_report(out, ["scenario"]).select("scenario", "mean_km", "median_km")
    return evaluate.objective_ranking(report, ["mean_km", "scenario"])
