"""A vector index in coarse cells, for searches that need not meet every row.

``fit_cells`` learns cells from a bounded sample; ``celled_index`` files every row of the index under its cell. A search
looks into the cells nearest to each query only, so that a query block no longer travels with the whole index.
``probes_for`` measures recall against the exact search and gives the least number of cells that reaches a target; the exact
search (``retrieval.similarity_topk``) stays the way to complete lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import BLOCK_BYTES, best_of_two, similarity_topk

#: At most so many rows are learned from, and so many cells made: of 1,024 dimensions, 64 MB of vectors and 32 MB of centres.
SAMPLE, MOST_CELLS = 8192, 4096
STEPS = 12


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def fit_cells(index: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """The unit centres of ``cells`` cells, by spherical k-means over the ``sample`` rows of the least hashes of ``item_id``
    (the same rows however the table is dealt). Cells that lose all rows move to the rows that are worst off. Fewer rows than
    cells: each is a centre."""
    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"between 1 and {MOST_CELLS} cells")
    rows = index.select("item_id", "embedding").orderBy(F.xxhash64("item_id"), "item_id").limit(min(sample, SAMPLE)).toPandas()
    if rows.empty:
        raise ValueError("no rows to learn cells from")
    x = np.unique(_unit(np.array(rows["embedding"].tolist(), np.float64)), axis=0)
    centres = x[np.random.default_rng(7).permutation(len(x))[:cells]]
    for _ in range(STEPS):
        likeness = x @ centres.T
        home, best = likeness.argmax(1), likeness.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        empty = np.flatnonzero(np.bincount(home, minlength=len(centres)) == 0)
        sums[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


def _nearest_cells(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """The rows with ``cells``, their ``probes`` nearest cells, the nearest first. The centres travel with the function; their
    size is bounded by ``MOST_CELLS``."""
    columns = rows.schema.names

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            far = -np.round(_unit(np.array(pdf["embedding"].tolist(), np.float64).reshape(len(pdf), -1)) @ centres.T, 9) if len(pdf) else np.zeros((0, len(centres)))
            near = np.argsort(far, axis=1, kind="stable")[:, :probes]
            yield pdf.assign(cells=list(near.astype(np.int32)))[[*columns, "cells"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(work, f"{fields}, cells array<int>")


def celled_index(index: DataFrame, centres: np.ndarray) -> DataFrame:
    """The index with ``cell`` for every row; write it partitioned or sorted by ``cell`` to let searches skip files."""
    return _nearest_cells(index, centres, 1).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")


def celled_topk(celled: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """query_id, source, item_id, score, rk: for every query and source the best k of the items in the ``probes`` cells
    nearest to the query. Queries have one vector. A cell of more than a block's bytes (hot cells: copies of one scene) is cut
    into chunks by hashes, and its queries go to each; many queries of a cell are cut likewise. So each group is two bounded
    blocks, and an item travels once per block of queries that ask for its own cell, however many others there are."""
    asked = _nearest_cells(queries.select("query_id", "embedding"), centres, probes).withColumn("cell", F.explode("cells")).drop("cells")
    rows = max(1, BLOCK_BYTES // (8 * max(1, centres.shape[1])))
    sizes = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    # One row per cell: no more than MOST_CELLS rows.
    cut = F.broadcast(sizes(celled, "n_i").join(sizes(asked, "n_q"), "cell"))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    items = celled.join(cut, "cell").select("item_id", "source", "embedding", "cell", block("item_id", "n_i").alias("ib"), all_of("n_q").alias("qb"))
    wanted = asked.join(cut, "cell").select("query_id", "embedding", "cell", block("query_id", "n_q").alias("qb"), all_of("n_i").alias("ib"))

    keys = ["cell", "ib", "qb"]
    out = items.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(lambda mine, theirs: best_of_two(mine, theirs, k), "query_id long, source string, item_id long, score double")
    w = Window.partitionBy("query_id", "source").orderBy(F.round("score", 9).desc(), "item_id")
    return out.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the exact lists' rows, how many of them were found, and the share (1 of no rows)."""
    keys = ["query_id", "source", "item_id"]
    met = exact.select(keys).join(found.select(*keys, F.lit(1).alias("_f")), keys, "left")
    counted = met.agg(F.count(F.lit(1)).alias("n"), F.count("_f").alias("n_found"))
    return counted.withColumn("recall", F.when(F.col("n") > 0, F.col("n_found") / F.col("n")).otherwise(1.0))


def probes_for(celled: DataFrame, centres: np.ndarray, k: int, target: float = 0.9, sample: int = 256) -> tuple[int, float]:
    """The least number of probes, and its recall, that finds the ``target`` share of exact lists and two standard errors more,
    as if all of a query's list were found or missed at once: other queries should reach the target too. It is measured with the
    ``sample`` rows of the least hashes as queries, against the whole index: an exact list's item counts as found by as many
    probes as its cell's place among the query's cells, so that one search measures all numbers of probes."""
    asked = celled.select(F.col("item_id").alias("query_id"), "embedding").orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    exact = similarity_topk(celled, asked, k).join(celled.select("item_id", "cell"), "item_id").select("query_id", "cell")
    places = exact.join(_nearest_cells(asked, centres, len(centres)).select("query_id", "cells"), "query_id").groupBy(F.array_position("cells", F.col("cell")).alias("probe")).count()
    counts = sorted((r["probe"], r["count"]) for r in places.collect())  # a row per probe, no more than there are cells
    total, found = sum(n for _, n in counts), 0
    asked_for = min(1.0, target + 2 * (target * (1 - target) / max(1, asked.count())) ** 0.5)
    for probe, n in counts:
        found += n
        if found >= asked_for * total:
            return int(probe), found / total
    return len(centres), 1.0
