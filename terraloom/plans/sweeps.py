"""Sweeps over the knobs of the retrieval chain, for one index or several models' indices, as one plan.

The settings are not planned one by one. Spark gathers each query's candidates, a bounded list, into one row and deals these over
tasks; a task works on many lists at once by numpy. The stages form a tree: a list goes through a stage once for every distinct
choice of the knobs up to it, and settings that differ only later share the work before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM
from ..operators import evaluate, retrieval
from ..sources.stage import written

#: The knobs of each stage, in order, with their neutral values.
STAGES: tuple[dict[str, float], ...] = (
    {"min_score": -1e9},
    {"locality_radius_km": 0.0, "locality_weight": 0.0},
    {"top_k": 10.0, "balance_beta": 0.0},
    {"graph_top_n": 0.0, "graph_sigma_km": 3.0, "graph_score_alpha": 0.4, "graph_support_beta": 1.0},
    {"min_keep": 0.0},
)
#: Least values that a knob may have; smaller ones count as these.
LEAST = {"min_score": -1e9, "top_k": 1.0, "graph_sigma_km": 0.1}
REPORT = ["evaluated", "null_predictions", "mean_km", "median_km", "p90_km", *(f"within_{r}km_pct" for r in (1, 2, 5, 10, 50))]


def complete(setting: dict[str, Any]) -> dict[str, float]:
    """All knobs of a setting: given ones clamped, others neutral. A name that is no knob is an error."""
    neutral = {name: value for stage in STAGES for name, value in stage.items()}
    if unknown := sorted(set(setting) - set(neutral)):
        raise ValueError(f"no knobs of the sweep: {unknown}")
    return {name: max(LEAST.get(name, 0.0), float(setting.get(name, value))) for name, value in neutral.items()}


def _tree(settings: list[dict[str, Any]]) -> tuple[list[list[tuple]], list[int]]:
    """For each stage its nodes (parent, node, the stage's knobs), and every setting's node in the last stage."""
    levels: list[dict[tuple, int]] = [{} for _ in STAGES]
    leaves = []
    for s in map(complete, settings):
        node = 0
        for stage, level in zip(STAGES, levels, strict=True):
            node = level.setdefault((node, *(s[name] for name in stage)), len(level))
        leaves.append(node)
    return [[(key[0], node, *key[1:]) for key, node in level.items()] for level in levels], leaves


def _unit(score: np.ndarray) -> np.ndarray:
    """``scores.unit_by_shift`` of an array."""
    with np.errstate(over="ignore", invalid="ignore"):
        inner = np.where(score >= 0, score, 0.5 * (score + 1))
        unit = np.where((score >= -1) & (score <= 1), inner, 1 / (1 + np.exp(-score)))
    return np.where(np.isfinite(score), unit, 0.5)


def _km(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """``geo.haversine_km`` between the rows of each list; infinite without coordinates, so that there is no support."""
    y, x = np.radians(lat), np.radians(lon)
    y1, y2, dx = y[:, :, None], y[:, None, :], x[:, None, :] - x[:, :, None]
    term = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin(dx / 2) ** 2
    km = EARTH_KM * 2 * np.arctan2(np.sqrt(term), np.sqrt(np.maximum(1 - term, 0.0)))
    return np.where(np.isnan(km), np.inf, km)


def _by_score(score: np.ndarray) -> np.ndarray:
    """Places of the rows of each list, best first; rows lie in the order of their items, which settles ties."""
    return np.argsort(-np.round(score, 9), axis=1, kind="stable")


def _scaled(value: np.ndarray, on: np.ndarray, floor: float) -> np.ndarray:
    peak = np.max(np.where(on, value, 0.0), axis=1, keepdims=True, initial=0.0)
    return np.where(peak <= 0, 1.0, np.clip(value / np.where(peak <= 0, 1.0, peak), floor, 1.0))


# Below, a score of -inf stands for a row that is not in the list. Each function is the operator of that name, for many lists.


def _local(score: np.ndarray, km: np.ndarray, radius: float, weight: float) -> np.ndarray:
    """``retrieval.rerank_by_locality``."""
    on = score > -np.inf
    unit = _unit(score)
    near = np.exp(-km / radius)
    near[:, range(near.shape[1]), range(near.shape[1])] = 0.0
    support = np.maximum(1e-9, (near @ np.where(on, unit, 0.0)[:, :, None])[:, :, 0])
    like = np.where(on.sum(axis=1, keepdims=True) < 3, 1.0, _scaled(support, on, 1e-3))
    alpha = weight / (1 + weight)
    return np.where(on, np.clip(unit * ((1 - alpha) + alpha * like), 1e-6, 1.0), -np.inf)


def _balanced(score: np.ndarray, source: np.ndarray, top_k: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """``retrieval.balanced_by_source``: places of the rows that are kept, in the order of items, and their scores."""
    order = _by_score(score)
    own, of = np.take_along_axis(score, order, 1), np.take_along_axis(source, order, 1)
    least = np.full(score.shape, -np.inf)
    for code in range(source.max(initial=-1) + 1):
        mine = (of == code) & (own > -np.inf)
        weighed = np.round(own / (1 + beta * np.maximum(0, np.cumsum(mine, axis=1) - 1)), 9)
        least = np.where(mine, np.minimum.accumulate(np.where(mine, weighed, np.inf), axis=1), least)
    kept = np.take_along_axis(order, np.argsort(-least, axis=1, kind="stable")[:, : int(min(top_k, score.shape[1]))], 1)
    kept.sort(axis=1)
    return kept, np.take_along_axis(score, kept, 1)


def _by_graph(score: np.ndarray, km: np.ndarray, top_n: float, sigma: float, alpha: float, beta: float) -> np.ndarray:
    """``retrieval.rerank_by_graph``."""
    rank = np.argsort(_by_score(score), axis=1, kind="stable") + 1
    head = (rank <= top_n) & (score > -np.inf)
    unit = np.where(head, np.maximum(1e-9, _unit(score)), 0.0)
    support = np.maximum(1e-9, (np.exp(-km * km * 0.5 / sigma**2) @ unit[:, :, None])[:, :, 0])
    return np.where(head, _scaled(unit**alpha * support**beta, head, 1e-6), score)


def _fresh(raw: np.ndarray, order: np.ndarray, kept: np.ndarray, on: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The best row of each raw list at another place than the rows that are kept; -1 if there is none."""
    mine = np.where(on, np.take_along_axis(place, kept, 1), -1)
    free = (place != -2) & ~((place[:, :, None] == mine[:, None, :]) & (place >= 0)[:, :, None]).any(axis=2)
    sorted_free = np.take_along_axis(free, order, 1)
    best = np.take_along_axis(order, sorted_free.argmax(axis=1)[:, None], 1)[:, 0]
    return np.where(sorted_free.any(axis=1), best, -1)


def _firsts_of(levels: list[list[tuple]], given: np.ndarray, lat: np.ndarray, lon: np.ndarray, source: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list and each leaf of the tree: the place of its first row (-1: none is left) and that row's score. Lists are rows
    of arrays, their candidates in the order of items; ``given`` is -inf for a null score, ``place`` (numbers of equal
    coordinates and match ids) -1 for one with a null, and -2 beyond a list's end."""
    below = lambda stage, node: [x for x in levels[stage] if x[0] == node]
    n, rows = len(given), np.arange(len(given))[:, None, None]
    at, value = np.full((n, len(levels[4])), -1, np.int32), np.full((n, len(levels[4])), np.nan)
    km, raw_order = _km(lat, lon), _by_score(given)
    for _, node0, low in levels[0]:
        over = np.where(given >= low, given, -np.inf)
        for _, node1, radius, weight in below(1, node0):
            local = _local(over, km, radius, weight) if radius > 0 and weight > 0 else over
            for _, node2, top_k, beta in below(2, node1):
                kept, cut = _balanced(local, source, top_k, beta)
                on = cut > -np.inf
                size, among, other = on.sum(axis=1), None, None
                for _, node3, top_n, *knobs in below(3, node2):
                    if top_n > 1 and among is None:
                        among = km[rows, kept[:, :, None], kept[:, None, :]]
                    score = _by_graph(cut, among, top_n, *knobs) if top_n > 1 else cut
                    best = np.round(score, 9).argmax(axis=1)[:, None]
                    first, its = np.take_along_axis(kept, best, 1)[:, 0], np.take_along_axis(score, best, 1)[:, 0]
                    first = np.where(size > 0, first, -1)
                    for _, node4, keep in below(4, node3):
                        at[:, node4], value[:, node4] = first, its
                        short = np.floor(keep - size) >= 1
                        if short.any():
                            other = _fresh(given, raw_order, kept, on, place) if other is None else other
                            theirs = np.take_along_axis(given, np.maximum(other, 0)[:, None], 1)[:, 0]
                            a, b = np.round(theirs, 9), np.round(its, 9)
                            swap = short & (other >= 0) & ((first < 0) | (a > b) | ((a == b) & (other < first)))
                            at[swap, node4], value[swap, node4] = other[swap], theirs[swap]
    return at, value


def _codes(values: pa.Array) -> np.ndarray:
    """Numbers of equal values from 0; -1 for a null."""
    return pc.fill_null(values.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _padded(values: np.ndarray, row: np.ndarray, col: np.ndarray, shape: tuple[int, int], beyond: float) -> np.ndarray:
    out = np.full(shape, beyond, values.dtype)
    out[row, col] = values
    return out


def _settled(batch: pa.RecordBatch, levels: list[list[tuple]], leaves: np.ndarray) -> pa.RecordBatch:
    """A batch of lists (column c) with ``at`` and ``value``, an entry for each setting."""
    lists = batch.column("c")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    row, shape = np.repeat(np.arange(len(sizes)), sizes), (len(sizes), int(sizes.max()))
    col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = dict(zip((f.name for f in lists.type.value_type), lists.flatten().flatten(), strict=True))
    number = lambda name: pc.fill_null(flat[name].cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    pad = lambda values, beyond: _padded(values, row, col, shape, beyond)
    score, lat, lon, match = number("score"), number("lat"), number("lon"), _codes(flat["match_id"])
    null = flat["score"].is_null().to_numpy(zero_copy_only=False)
    # Spark takes NaN for the largest number.
    given = np.where(null, -np.inf, np.where(np.isnan(score), np.inf, score))
    known = lambda x: np.where(np.isnan(x), 1e9, x) + 0.0  # noqa: E731  NaN is a place, 0.0 and -0.0 are one
    place = np.unique(np.column_stack([match, known(lat), known(lon)]), axis=0, return_inverse=True)[1].reshape(-1)
    place[(match < 0) | flat["lat"].is_null().to_numpy(zero_copy_only=False) | flat["lon"].is_null().to_numpy(zero_copy_only=False)] = -1
    source = pd.Series(_codes(flat["source"])).groupby(row).rank("dense").to_numpy(np.int64) - 1
    at, value = _firsts_of(levels, pad(given, -np.inf), pad(lat, np.nan), pad(lon, np.nan), pad(source, -1), pad(place, -2))
    at, value = at[:, leaves], value[:, leaves]
    own = np.take_along_axis(pad(score, np.nan), np.maximum(at, 0), 1)
    unknown = np.take_along_axis(pad(null, True), np.maximum(at, 0), 1) & ~np.isfinite(value)
    value = np.where(np.isfinite(value), value, own)
    ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(leaves))
    of = lambda x, mask=None: pa.ListArray.from_arrays(ends, pa.array(x.ravel(), mask=mask))
    return pa.RecordBatch.from_arrays([*batch.columns, of(at), of(value, unknown.ravel())], names=[*batch.schema.names, "at", "value"])


def _with_firsts(lists: DataFrame, settings: list[dict[str, Any]]) -> DataFrame:
    """Rows (setting, item_id, score, lat, lon and the other columns of ``lists``), whose column c holds a query's candidates in the
    order of items. A task takes as many lists at a time as their pairs fit in arrays of 8 MB."""
    levels, leaves = _tree(settings)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest = pc.max(pc.list_value_length(batch.column("c"))).as_py() or 1
            step = max(1, (1 << 20) // max(longest * longest, len(leaves)))
            for k in range(0, len(batch), step):
                yield _settled(batch.slice(k, step), levels, np.array(leaves))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lists.schema.fields)
    done = lists.mapInArrow(work, f"{types}, at array<int>, value array<double>")
    others = [F.col(f"`{name}`") for name in lists.columns if name != "c"]
    each = done.select(*others, "c", F.posexplode(F.arrays_zip("at", "value")).alias("setting", "_f")).where("_f.at >= 0")
    its = F.get("c", F.col("_f.at"))
    return each.select(*others, F.col("setting").cast("long").alias("setting"), its["item_id"].alias("item_id"), F.col("_f.value").alias("score"), its["lat"].alias("lat"), its["lon"].alias("lon"))


def _packed(c: DataFrame) -> DataFrame:
    """(id, c): a query's candidates, in the order of items, as one row. Lists are bounded (k times the sources), rows are few and
    the work on one is large, so that they are dealt over as many tasks as there are shuffle partitions, and all cores at least."""
    spark = c.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = c.select(F.col("query_id").alias("id"), F.struct("item_id", "source", "lat", "lon", "score", "match_id").alias("_c"))
    return rows.repartition(n, "id").groupBy("id").agg(F.array_sort(F.collect_list("_c")).alias("c"))


def first_candidates(c: DataFrame, settings: list[dict[str, Any]]) -> DataFrame:
    """(id, setting, item_id, score, lat, lon): the first candidate of every query under every setting that leaves it one.
    Per setting: threshold, locality, cut by balanced sources, graph support, topping up. ``c`` has query_id (of any type),
    source, item_id (unique in a list), lat, lon, score and match_id. ``settings`` are numbered from 0; equal ones share all work."""
    return _with_firsts(_packed(c), settings).select("id", "setting", "item_id", "score", "lat", "lon")


def retrieval_sweep(c: DataFrame, truth: DataFrame, settings: list[dict[str, Any]], by: tuple[str, ...] = ()) -> DataFrame:
    """One row per setting: its distance report, the queries left without a candidate, and its place by median, mean and
    number; settings that leave no query a candidate come last. ``truth`` has query_id, lat, lon. With ``by``, query_id is
    a struct and the report is made for each value of those fields of it; places are over all rows."""
    t = truth.select(F.col("query_id").alias("id"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    at = [F.col(f"id.{name}").alias(name) for name in by]
    # The truth joins the lists, not their rows under every setting.
    top = _with_firsts(_packed(c).join(t, "id"), settings).withColumn("km", evaluate.haversine_km("lat", "lon", "t_lat", "t_lon")).select("setting", "km", *at)
    asked = t.select(*at, "id").groupBy(*by).agg(F.count(F.lit(1)).alias("_asked")).withColumn("setting", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(settings) - 1).cast("long"))))
    report = evaluate.distance_report(written(top, "sweep_top"), ["setting", *by])
    out = asked.join(report, ["setting", *by], "left").withColumn("evaluated", F.coalesce("evaluated", F.lit(0)))
    out = out.withColumn("null_predictions", F.col("_asked") - F.col("evaluated")).withColumns({"_d": F.round("median_km", 9), "_m": F.round("mean_km", 9)})
    # The report has as many rows as settings (times models): its order is that of a small table.
    return evaluate.objective_ranking(out, ["_d", "_m", "setting", *by]).select("setting", *by, *REPORT, "place")


def compare_models(index: DataFrame, queries: DataFrame, settings: list[dict[str, Any]], k: int) -> DataFrame:
    """``retrieval_sweep`` over several models: ``index`` (model, item_id, source, lat, lon, embedding) and ``queries``
    (model, query_id, lat, lon, embedding) hold one vector per model, whose dimensions may differ. A query meets only its own
    model's index; all models are searched in one job and swept in one plan."""
    best = retrieval.similarity_topk(index, queries, k, within="model").join(index.select("model", "item_id", "lat", "lon"), ["model", "item_id"])
    key = F.struct("model", F.col("query_id").alias("query_id")).alias("query_id")
    match = F.concat(F.lit("retrieval:"), "source", F.lit(":"), "item_id").alias("match_id")
    lists = written(best.select(key, "source", "item_id", "lat", "lon", "score", match), "models")
    return retrieval_sweep(lists, queries.select(key, "lat", "lon"), settings, ("model",))


def best_setting(report: DataFrame, settings: list[dict[str, Any]]) -> dict[str, float]:
    """The knobs of the first place, ready to be written to a config; one row comes to the driver."""
    first = report.where("place = 1").select("setting").first()
    return complete(settings[first["setting"]]) if first else {}
