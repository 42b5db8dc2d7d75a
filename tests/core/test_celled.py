"""The celled index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import celled
from terraloom.operators.retrieval import similarity_topk


@pytest.fixture(scope="module")
def vectors(spark):
    """2,400 vectors around 40 places; a third of all are copies of one."""
    rng = np.random.default_rng(3)
    homes = rng.normal(size=(40, 16))
    x = homes[rng.integers(0, 40, 2400)] + 0.35 * rng.normal(size=(2400, 16))
    x[::3] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, f"s{i % 2}", v.tolist()) for i, v in enumerate(x)], "item_id long, source string, embedding array<double>")


def _queries(index):
    return index.where("item_id % 100 = 1").select(F.col("item_id").alias("query_id"), "embedding")


def _rows(df):
    return sorted((r["query_id"], r["source"], r["item_id"], round(r["score"], 8), r["rk"]) for r in df.collect())


def test_all_cells_give_the_exact_lists(spark, vectors, monkeypatch):
    monkeypatch.setattr(celled, "BLOCK_BYTES", 64 * 16 * 8)  # 64 rows a block: the hot cell is cut into chunks
    centres = celled.fit_cells(vectors, 12)
    table = celled.celled_index(vectors, centres)
    assert table.count() == 2400 and table.groupBy("cell").count().agg(F.max("count")).first()[0] >= 800
    assert _rows(celled.celled_topk(table, _queries(vectors), centres, 5, 12)) == _rows(similarity_topk(vectors, _queries(vectors), 5))


def test_measured_probes_reach_the_recall(spark, vectors):
    centres = celled.fit_cells(vectors, 24)
    table = celled.celled_index(vectors, centres).persist()
    probes, measured = celled.probes_for(table, centres, 5, 0.95)
    assert probes < 24 and measured >= 0.95
    found, exact = celled.celled_topk(table, _queries(vectors), centres, 5, probes), similarity_topk(vectors, _queries(vectors), 5)
    assert celled.recall(found, exact).first()["recall"] >= 0.9
    assert {(r[0], r[3]) for r in _rows(found)} and all(r["rk"] <= 5 for r in found.collect())


def test_cells_do_not_depend_on_the_dealing(spark, vectors):
    assert np.array_equal(celled.fit_cells(vectors, 6), celled.fit_cells(vectors.repartition(5, "source"), 6))


def test_edges(spark, vectors):
    three = vectors.where("item_id in (1, 2, 4)")
    centres = celled.fit_cells(three, 10)
    assert len(centres) == 3
    table = celled.celled_index(three, centres)
    assert celled.celled_topk(table.limit(0), _queries(vectors), centres, 5, 2).count() == 0
    assert celled.celled_topk(table, _queries(vectors).limit(0), centres, 5, 2).count() == 0
    assert celled.recall(table.limit(0).select(F.col("item_id").alias("query_id"), "source", "item_id"), table.limit(0).select(F.col("item_id").alias("query_id"), "source", "item_id")).first()["recall"] == 1.0
    with pytest.raises(ValueError, match="cells"):
        celled.fit_cells(vectors, 0)
    with pytest.raises(ValueError, match="no rows"):
        celled.fit_cells(vectors.limit(0), 3)
