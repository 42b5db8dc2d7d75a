"""Sweeps as one plan against single runs of the chain, and their edges."""

import pytest
from pyspark.sql import functions as F

from terraloom.operators import evaluate
from terraloom.plans import chains, sweeps
from terraloom.plans import overlay as o
from terraloom.plans.knobs import with_best


def test_a_sweep_equals_single_chains(spark, sf_dir):
    c, q = o.candidates(spark, sf_dir), o.queries(spark, sf_dir)
    settings = [{}, {"locality_radius_km": 3, "locality_weight": 0.7}, {"graph_top_n": 15, "top_k": 30}, {"locality_radius_km": 5, "locality_weight": 1.5, "graph_top_n": 6, "balance_beta": 0.4, "top_k": 8}, {}]
    knobs = [
        chains.RetrievalKnobs(),
        chains.RetrievalKnobs(locality_radius_km=3, locality_weight=0.7),
        chains.RetrievalKnobs(graph_top_n=15, top_k=30),
        chains.RetrievalKnobs(locality_radius_km=5, locality_weight=1.5, graph_top_n=6, balance_beta=0.4, top_k=8),
        chains.RetrievalKnobs(),
    ]
    got = {(r["id"], r["setting"]): r["item_id"] for r in sweeps.first_candidates(c, settings).collect()}
    for n, k in enumerate(knobs):
        one = {r["query_id"]: r["item_id"] for r in chains.retrieval_chain(c, k).where("rank = 1").collect()}
        assert one == {q_: item for (q_, s), item in got.items() if s == n}
    report = sweeps.retrieval_sweep(c, q, settings).orderBy("place").collect()
    assert [r["place"] for r in report] == [1, 2, 3, 4, 5]
    mean = {r["setting"]: r["mean_km"] for r in report}
    truth = evaluate.errors(c, q).where("rank = 1").agg(F.avg("km")).first()[0]
    assert mean[0] == mean[4] == pytest.approx(truth)
    best = sweeps.best_setting(sweeps.retrieval_sweep(c, q, settings), settings)
    assert best == sweeps.complete(settings[report[0]["setting"]]) and '"balance_beta"' in with_best("{}", "retrieval", best)


def _lists(spark, rows):
    return spark.createDataFrame([(q, "s", i, 48.0 + i / 100, 2.0, score, f"retrieval:s:{i}") for q, i, score in rows], "query_id long, source string, item_id long, lat double, lon double, score double, match_id string")


def test_queries_without_candidates_are_counted_or_topped_up(spark):
    c = _lists(spark, [(1, 10, 0.9), (1, 11, 0.2), (2, 20, 0.1), (2, 21, 0.1)])
    truth = spark.createDataFrame([(1, 48.1, 2.0), (2, 48.2, 2.0), (3, 48.3, 2.0)], "query_id long, lat double, lon double")
    rows = {r["setting"]: r for r in sweeps.retrieval_sweep(c, truth, [{"min_score": 0.5}, {"min_score": 0.5, "min_keep": 2}, {"min_score": 2}]).collect()}
    assert (rows[0]["evaluated"], rows[0]["null_predictions"]) == (1, 2)
    assert (rows[1]["evaluated"], rows[1]["null_predictions"]) == (2, 1)
    assert rows[1]["mean_km"] == pytest.approx(0.0, abs=1e-6)  # ties go by item id: 20 is the true place
    assert (rows[2]["evaluated"], rows[2]["mean_km"], rows[2]["place"]) == (0, None, 3)


def test_empty_lists_and_unknown_knobs(spark):
    truth = spark.createDataFrame([(1, 48.1, 2.0)], "query_id long, lat double, lon double")
    assert [r["null_predictions"] for r in sweeps.retrieval_sweep(_lists(spark, []), truth, [{}, {"min_keep": 3}]).collect()] == [1, 1]
    with pytest.raises(ValueError, match="radius"):
        sweeps.complete({"radius": 1})
    assert sweeps.complete({"top_k": 0, "graph_sigma_km": -1})["top_k"] == 1.0


def test_models_meet_only_their_own_index(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("b", 1, [0.0, 1.0, 0.0]), ("b", 2, [1.0, 0.0, 0.0])]
    index = spark.createDataFrame([(m, i, "s", 48.0 + i, 2.0, v) for m, i, v in rows], "model string, item_id long, source string, lat double, lon double, embedding array<double>")
    queries = spark.createDataFrame([("a", 100, 49.0, 2.0, [1.0, 0.1]), ("b", 100, 49.0, 2.0, [1.0, 0.1, 0.0])], "model string, query_id long, lat double, lon double, embedding array<double>")
    got = {r["model"]: r["mean_km"] for r in sweeps.compare_models(index, queries, [{}], 2).collect()}
    assert got["a"] == pytest.approx(0.0, abs=1e-6) and got["b"] > 100


def test_the_plan_does_not_grow_with_the_settings(spark, sf_dir):
    c = o.candidates(spark, sf_dir)
    size = lambda n: len(sweeps.first_candidates(c, [{"locality_radius_km": 1 + k, "locality_weight": 0.5, "graph_top_n": 4} for k in range(n)])._jdf.queryExecution().optimizedPlan().toString().split("Join"))
    assert size(3) == size(40)
