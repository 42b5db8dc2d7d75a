"""Similarity search and the re-ranking of candidate lists.

A candidate list is bounded by the search's k times the number of sources, so that work within a list (pairs, windows by
query) stays small however many queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import box_distance_km, haversine_km
from ..functions.scores import by_group, minmax, rank_decay, scaled_by_peak, unit_by_shift, zscore_logistic

#: Bytes of vectors, as doubles, in one block of queries or of index rows.
BLOCK_BYTES = 32 << 20
#: Queries of a block that are multiplied at a time, with four times as many items, so that a tile of scores has a bounded size.
TILE = 512
Q = ["query_id"]


def _blocks(df: DataFrame) -> int:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    return max(1, -(-row["n"] * 8 * max(row["dim"] or 1, 1) // BLOCK_BYTES))


def _cut(row: np.ndarray, score: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each row by rounded score, then item."""
    order = np.lexsort((item, -np.round(score, 9), row))
    row, score, item = row[order], score[order], item[order]
    first = np.append(0, np.flatnonzero(np.diff(row)) + 1) if len(row) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(row)))
    keep = np.arange(len(row)) - np.repeat(first, sizes) < k
    return row[keep], score[keep], item[keep]


def _vectors(table: pa.Table) -> np.ndarray:
    """The rows of ``embedding`` as a matrix that shares the table's memory and its type."""
    flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(table), len(flat) // len(table))


def _surely_kth(tile: np.ndarray, k: int) -> np.ndarray:
    """Per row a number that k scores at least reach: the k-th largest of the largest scores of 8 k groups of columns."""
    n = 8 * k
    if tile.shape[1] < 2 * n:
        return np.full(len(tile), -np.inf)
    largest = tile[:, : tile.shape[1] // n * n].reshape(len(tile), -1, n).max(axis=1)
    return np.partition(largest, n - k, axis=1)[:, n - k]


def _best_of_blocks(index: pa.Table, queries: pa.Table, k: int, reduce: str) -> Iterator[tuple]:
    """(query ids, source, item ids, scores) of a block of queries against a block of the index, tile by tile. Only tiles are
    held as doubles, and of a tile only scores that can be among the best k are sorted."""
    order = np.argsort(queries["query_id"].to_numpy(), kind="stable")
    ids, at = np.unique(queries["query_id"].to_numpy()[order], return_index=True)
    ends = np.append(at[1:], len(order))
    asked, vectors, items = _vectors(queries), _vectors(index), index["item_id"].to_numpy()
    size = max(1, TILE * len(ids) // len(order))
    of = index["source"].combine_chunks().dictionary_encode()
    codes = of.indices.to_numpy(zero_copy_only=False)
    reach = float(np.abs(asked).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, asked.shape[1])
    for code, source in enumerate(of.dictionary.to_pylist()):
        rows = np.flatnonzero(codes == code)
        for q in range(0, len(ids), size):
            own = ids[q : q + size]
            a, b = at[q], ends[min(q + size, len(ids)) - 1]
            mine = asked[order[a:b]].astype(np.float64)
            row, score, item, least = np.zeros(0, np.int64), np.zeros(0), items[:0], np.full(len(own), -np.inf)
            for i in range(0, len(rows), 4 * TILE):
                part = rows[i : i + 4 * TILE]
                theirs = items[part]
                tile = mine @ vectors[part].astype(np.float64).T
                if b - a > len(own):  # several views of a query
                    tile = np.array([getattr(np, reduce)(tile[x - a : y - a], axis=0) for x, y in zip(at[q : q + size], ends[q : q + size], strict=True)])
                same = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                c = np.flatnonzero(own[same] == theirs)
                tile[same[c], c] = -np.inf  # not itself
                if not np.isfinite(reach):
                    tile[~np.isfinite(tile)] = -np.inf
                least = np.maximum(least, _surely_kth(tile, k))
                # Wider than the rounding of scores to 9 digits: what ties with the k-th is cut exactly below.
                low = np.where(np.isfinite(least), least - 1e-8 * np.maximum(1, np.abs(least)), -np.inf)
                met = np.flatnonzero(tile >= low[:, None])
                met = met[tile.ravel()[met] > -np.inf]
                row, score, item = _cut(np.append(row, met // len(part)), np.append(score, tile.ravel()[met]), np.append(item, theirs[met % len(part)]), k)
            yield own[row], source, item, score


def best_of_two(index: pa.Table, queries: pa.Table, k: int, reduce: str = "mean") -> pa.Table:
    """query_id, source, item_id, score: the best k per query and source of one block against another; either may be empty."""
    found = list(_best_of_blocks(index, queries, k, reduce)) if len(index) and len(queries) else []
    joined = lambda n, kind: pa.array(np.concatenate([f[n] for f in found] or [np.zeros(0)]), kind)
    source = [pa.repeat(pa.scalar(f[1], pa.string()), len(f[0])) for f in found]
    return pa.table({"query_id": joined(0, pa.int64()), "source": pa.chunked_array(source, pa.string()), "item_id": joined(2, pa.int64()), "score": joined(3, pa.float64())})


def same_dimension(*tables: DataFrame, within: str | None = None) -> int | None:
    """The largest number of dimensions of vectors (column embedding); an error where they differ, or a row has none, or a null or NaN among
    them. With ``within`` (a column of few values, such as models), dimensions are compared among its equal values only. Tables without
    rows fit any."""
    bad = F.count_if(F.col("embedding").isNull() | F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    key = F.col(within) if within else F.lit(0)
    ends = [r for t in tables for r in t.groupBy(key.alias("key")).agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), bad.alias("bad")).collect()]
    if n := sum(e["bad"] for e in ends):
        raise ValueError(f"{n} rows have no vector, or one with a null or NaN: leave them out by scan.check_index")
    for group in {e["key"] for e in ends}:
        sizes = {x for e in ends if e["key"] == group for x in (e["low"], e["high"]) if x is not None}
        if len(sizes) > 1:
            raise ValueError(f"vectors of different dimensions: {sorted(sizes)}")
    return max((e["high"] for e in ends if e["high"] is not None), default=None)


def similarity_topk(index: DataFrame, queries: DataFrame, k: int, reduce: str = "mean", within: str | None = None) -> DataFrame:
    """query_id, source, item_id, score, rk: for every query and source the k items of the largest dot product. A query
    of several rows has as many views; an item's score is the mean, median or max over them. With ``within`` (a string column
    of both, such as the model), queries meet only items of their own value, and the rows carry it.

    Queries and index rows are dealt by hashes into blocks of bounded bytes, and every pair of blocks is one group of a
    grid: a task multiplies the two blocks and keeps the best k per query and source. So neither side passes the driver or
    is sent whole to any task; an index row travels once per block of queries, and k rows per query, source and block
    come back.
    """
    same_dimension(index, queries, within=within)
    keys = [within] if within else []
    n_query, n_index = _blocks(queries), _blocks(index)
    n_index = max(n_index, -(-index.sparkSession.sparkContext.defaultParallelism // n_query))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    items = index.select(*keys, "item_id", "source", "embedding", block("item_id", n_index).alias("ib"), all_of(n_query).alias("qb"))
    # Under names of their own, as both sides may come from one table.
    asked = queries.select(*(F.col(x).alias(f"q_{x}") for x in [*keys, "embedding"]), "query_id", block("query_id", n_query).alias("qb"), all_of(n_index).alias("ib"))

    def search(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        best = best_of_two(mine, theirs.append_column("embedding", theirs["q_embedding"]), k, reduce)
        for name in keys:
            best = best.append_column(name, pa.repeat(pa.scalar(key[2].as_py(), pa.string()), len(best)))
        return best.select([*keys, "query_id", "source", "item_id", "score"])

    of_keys = "".join(f"{name} string, " for name in keys)
    out = items.groupBy("ib", "qb", *keys).cogroup(asked.groupBy("ib", "qb", *(f"q_{x}" for x in keys))).applyInArrow(search, f"{of_keys}query_id long, source string, item_id long, score double")
    w = Window.partitionBy(*keys, "query_id", "source").orderBy(F.round("score", 9).desc(), "item_id")
    return out.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def views_by_rank(scores: DataFrame, k: float = 60.0) -> DataFrame:
    """From (query_id, view, item_id, score) the items' sums of 1 / (k + rank in the view), min-max scaled per query."""
    w = Window.partitionBy(*Q, "view").orderBy(F.round("score", 9).desc(), "item_id")
    summed = scores.withColumn("_r", F.row_number().over(w)).groupBy(*Q, "item_id").agg(F.sum(1 / (k + F.col("_r"))).alias("rrf"))
    return summed.withColumn("score", minmax("rrf", Q))


def best_first(score: str = "score") -> list[Column]:
    return [F.round(score, 9).desc(), F.col("item_id")]


def ranked(c: DataFrame, score: str = "score") -> DataFrame:
    return c.withColumn("rank", F.row_number().over(by_group(Q).orderBy(*best_first(score))))


def normalise_by_source(c: DataFrame, mode: str) -> DataFrame:
    """``norm``: the score normalised within (query, source): none, minmax, zscore or rank."""
    keys = [*Q, "source"]
    value = {"none": F.col("score"), "minmax": minmax("score", keys), "zscore": zscore_logistic("score", keys), "rank": rank_decay("score", keys, [F.col("item_id")])}[mode]
    return c.withColumn("norm", value)


def fuse_by_weight(c: DataFrame, weights: dict[str, float]) -> DataFrame:
    w = F.coalesce(*(F.when(F.col("source") == s, F.lit(float(x))) for s, x in weights.items()), F.lit(1.0))
    clamp = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return c.withColumn("fused", clamp(clamp(F.col("norm")) * w))


def fuse_by_reciprocal_rank(c: DataFrame, k: float = 60.0) -> DataFrame:
    """One row per query and coordinates (rounded to 5 decimals): the best raw score's item stands for them."""
    places = c.withColumn("la", F.round("lat", 5)).withColumn("lo", F.round("lon", 5))
    summed = places.groupBy(*Q, "la", "lo").agg(F.sum(1 / (k + F.col("rk"))).alias("rrf"), F.min_by("item_id", F.struct(-F.round("score", 9), F.col("item_id"))).alias("item_id"))
    return summed.withColumn("fused", minmax("rrf", Q))


def distinct_places(c: DataFrame) -> DataFrame:
    """The best row of each query, coordinates (6 decimals) and match id."""
    w = Window.partitionBy(*Q, F.round("lat", 6), F.round("lon", 6), "match_id").orderBy(*best_first())
    return c.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_backfill(c: DataFrame, min_score: float, min_keep: int) -> DataFrame:
    """Rows of at least ``min_score``, topped up to ``min_keep`` by the best of the others."""
    ok = F.col("score") >= min_score
    marked = c.withColumn("_ok", ok).withColumn("_kept", F.sum(ok.cast("int")).over(by_group(Q)))
    place = F.row_number().over(Window.partitionBy(*Q, "_ok").orderBy(*best_first()))
    return marked.withColumn("_at", place).where(F.col("_ok") | (F.col("_at") <= min_keep - F.col("_kept"))).drop("_ok", "_kept", "_at")


def geo_prior(c: DataFrame, box: tuple[float, float, float, float], hard: bool, sigma_km: float = 250.0, min_keep: int = 0) -> DataFrame:
    """``adjusted``: the score under a box prior. Hard: only rows inside, topped up to ``min_keep``."""
    d = box_distance_km("lat", "lon", box)
    out = c.withColumn("box_km", d).withColumn("adjusted", F.greatest(F.lit(1e-9), unit_by_shift(F.col("score")) * F.when(F.col("box_km") <= 1e-6, F.lit(1.0)).otherwise(F.exp(-F.col("box_km") / max(1.0, sigma_km)))))
    if hard:
        inside = F.col("box_km") <= 1e-6
        out = out.withColumn("_in", inside).withColumn("_n", F.sum(inside.cast("int")).over(by_group(Q)))
        out = out.withColumn("_at", F.row_number().over(Window.partitionBy(*Q, "_in").orderBy(F.round("adjusted", 9).desc(), "item_id")))
        out = out.where(F.col("_in") | (F.col("_at") <= min_keep - F.col("_n"))).drop("_in", "_n", "_at")
    return out.withColumn("adjusted", F.greatest(F.lit(1e-6), F.least(F.lit(1.0), F.col("adjusted"))))


def pairs(c: DataFrame, other_columns: list[str]) -> DataFrame:
    """Every pair of rows of one candidate list, the second's columns prefixed o_, with their distance km."""
    o = c.select(*Q, *(F.col(x).alias(f"o_{x}") for x in dict.fromkeys(["item_id", "lat", "lon", *other_columns])))
    return c.join(o, Q).withColumn("km", haversine_km("lat", "lon", "o_lat", "o_lon"))


def rerank_by_locality(c: DataFrame, radius_km: float, weight: float) -> DataFrame:
    """``local_score``: the unit score blended with the support of the others, which decays with distance."""
    n = F.count(F.lit(1)).over(by_group(Q))
    base = c.withColumn("unit", unit_by_shift(F.col("score"))).withColumn("_n", n)
    term = F.when(F.col("item_id") != F.col("o_item_id"), F.col("o_unit") * F.exp(-F.col("km") / radius_km)).otherwise(0.0)
    support = pairs(base, ["unit"]).groupBy(*Q, "item_id", "unit", "_n").agg(F.greatest(F.lit(1e-9), F.sum(term)).alias("support"))
    alpha = weight / (1 + weight)
    like = F.when(F.col("_n") < 3, F.lit(1.0)).otherwise(scaled_by_peak("support", Q))
    return support.withColumn("local_score", F.greatest(F.lit(1e-6), F.least(F.lit(1.0), F.col("unit") * ((1 - alpha) + alpha * like)))).select(*Q, "item_id", "local_score")


def rerank_by_graph(c: DataFrame, top_n: int, sigma_km: float = 3.0, score_alpha: float = 0.4, support_beta: float = 1.0) -> DataFrame:
    """``graph_score`` of the top n: score ** alpha * support ** beta, scaled by its peak; the others keep theirs."""
    top = ranked(c).withColumn("unit", F.greatest(F.lit(1e-9), unit_by_shift(F.col("score"))))
    head = top.where(F.col("rank") <= top_n)
    support = pairs(head, ["unit"]).groupBy(*Q, "item_id", "unit").agg(F.greatest(F.lit(1e-9), F.sum(F.col("o_unit") * F.exp(-F.col("km") * F.col("km") * 0.5 / sigma_km**2))).alias("support"))
    raw = support.withColumn("raw", F.pow("unit", F.lit(score_alpha)) * F.pow("support", F.lit(support_beta)))
    scored = raw.select(*Q, "item_id", scaled_by_peak("raw", Q, 1e-6).alias("graph_score"))
    return scored.unionByName(top.where(F.col("rank") > top_n).select(*Q, "item_id", F.col("score").alias("graph_score")))


def balanced_by_source(c: DataFrame, top_k: int, beta: float) -> DataFrame:
    """Repeatedly the largest score / (1 + beta * rows taken of its source). Within a source the order is by score, and the
    n-th row is always weighed with n - 1 taken. Of scores below 0 a later row may weigh more than an earlier one; it still
    waits for that, and follows it at once. So the place of a row is that of the least weight up to it in its source."""
    by_score = Window.partitionBy(*Q, "source").orderBy(*best_first())
    out = c.withColumn("_n", F.row_number().over(by_score) - 1).withColumn("balanced", F.col("score") / (1 + beta * F.col("_n")))
    out = out.withColumn("_least", F.min(F.round("balanced", 9)).over(by_score.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    w = by_group(Q).orderBy(F.col("_least").desc(), F.round("score", 9).desc(), "item_id")
    return out.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= top_k).drop("_at", "_n", "_least")


def rank_features(c: DataFrame) -> DataFrame:
    w = by_group(Q).orderBy(*best_first())
    n = F.count(F.lit(1)).over(by_group(Q))
    return ranked(c).select(*Q, "item_id", "rank", ((F.col("rank") - 1) / F.greatest(n - 1, F.lit(1))).alias("rank_fraction"), (F.max("score").over(by_group(Q)) - F.col("score")).alias("gap_top"), F.coalesce(F.lag("score").over(w) - F.col("score"), F.lit(0.0)).alias("gap_previous"))


def rotated_views(queries: DataFrame, by: int, n: int) -> DataFrame:
    """``n`` views of each query: its vector rotated left by 0, ``by``, 2 * ``by``, ..."""
    size = F.size("embedding")
    views = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda v: F.concat(F.slice("embedding", v * by + 1, size), F.slice("embedding", 1, v * by)))
    return queries.withColumn("embedding", F.explode(views))


def expanded_queries(index: DataFrame, queries: DataFrame, c: DataFrame, top_n: int, beta: float, alpha: float) -> DataFrame:
    """Queries whose vectors are blended with the softmax-weighted mean of their best ``top_n`` items. Scores are linear in
    the query, so that alpha * (score of q) + (1 - alpha) * (score of the blend) is one search with one vector."""
    best = ranked(c).where(F.col("rank") <= top_n).join(index.select("item_id", F.col("embedding").alias("v")), "item_id")
    e = F.exp(F.col("score") - F.max("score").over(by_group(Q)))
    weighed = best.withColumn("wt", e / F.sum(e).over(by_group(Q))).groupBy(*Q).agg(F.sort_array(F.collect_list(F.struct("rank", "wt", "v"))).alias("items"))
    add = lambda acc, x: F.zip_with(acc, x["v"], lambda p, q: p + q.cast("double") * x["wt"])
    zeros = F.transform(F.get(F.col("items"), 0)["v"], lambda x: F.lit(0.0))
    unit = lambda v: F.transform(v, lambda x: x / F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)), F.lit(1e-12)))
    mean = weighed.select(*Q, F.aggregate("items", zeros, add).alias("f")).select(*Q, unit(F.col("f")).alias("f"))
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    j = queries.withColumn("embedding", doubles).join(mean, Q)
    j = j.withColumn("b", F.zip_with("embedding", "f", lambda p, q: (1 - beta) * p + beta * q)).withColumn("b", unit(F.col("b")))
    return j.withColumn("embedding", F.zip_with("embedding", "b", lambda p, q: alpha * p + (1 - alpha) * q)).drop("f", "b")


def augmented_vectors(index: DataFrame, queries: DataFrame, neighbours: int, self_weight: float, least: float, temperature: float, max_km: float | None = None) -> DataFrame:
    """query_id, embedding: each query row's unit vector plus the softmax-weighted unit vectors of its nearest items of any
    source that are similar enough, made a unit vector again. With ``max_km``, those of its nearest items that lie farther
    away do not count (others do not take their place)."""
    unit = lambda v: F.transform(v, lambda x: x / F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)), F.lit(1e-12)))
    doubles = lambda c: F.transform(c, lambda x: x.cast("double"))
    items = index.withColumn("embedding", unit(doubles("embedding")))
    mine = queries.withColumn("embedding", unit(doubles("embedding")))
    near = similarity_topk(items.withColumn("source", F.lit("all")), mine, neighbours).where(F.col("score") >= least)
    if max_km is not None:
        there = near.join(index.select("item_id", "lat", "lon"), "item_id").join(queries.select("query_id", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")), "query_id")
        near = there.where(haversine_km("lat", "lon", "q_lat", "q_lon") <= max_km).drop("lat", "lon", "q_lat", "q_lon")
    e = F.exp((F.col("score") - F.max("score").over(by_group(Q))) / temperature)
    weighed = near.withColumn("wt", e / F.sum(e).over(by_group(Q))).join(items.select("item_id", F.col("embedding").alias("v")), "item_id")
    packed = weighed.groupBy(*Q).agg(F.sort_array(F.collect_list(F.struct("rk", "wt", "v"))).alias("items"))
    j = mine.select(*Q, "embedding").join(packed, Q, "left")
    start = F.transform("embedding", lambda x: x * self_weight)
    total = F.aggregate(F.coalesce("items", F.array().cast(packed.schema["items"].dataType)), start, lambda acc, x: F.zip_with(acc, x["v"], lambda p, q: p + q * x["wt"]))
    return j.select(*Q, total.alias("embedding")).select(*Q, unit(F.col("embedding")).alias("embedding"))


def temporal_support(now: DataFrame, before: DataFrame, sigma_km: float) -> DataFrame:
    """Per current candidate of a sequence the prior weight near it: sum of w * Gaussian of the distance to each candidate of
    the frame before (both sides: key, item_id, lat, lon; the prior with w)."""
    b = before.select("key", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), "w")
    near = now.join(b, "key").withColumn("km", haversine_km("lat", "lon", "o_lat", "o_lon"))
    return near.groupBy("key", "item_id").agg(F.sum(F.col("w") * F.exp(-0.5 * F.pow(F.col("km") / sigma_km, F.lit(2)))).alias("support"))


def local_matches(pairs: DataFrame, own: DataFrame, theirs: DataFrame, ratio: float) -> DataFrame:
    """From pairs (query_id, item_id), descriptors of queries (query_id, q_part, qv) and of items (item_id, part, v): per
    pair the query's descriptors, and those whose nearest one in the item is nearer than ``ratio`` times the second. What is
    gathered is the distances of one descriptor to those of one image."""
    d2 = F.aggregate(F.zip_with("qv", "v", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    far = pairs.join(own, "query_id").join(theirs, "item_id").select("query_id", "item_id", "q_part", F.sqrt(d2).alias("d"))
    two = far.groupBy("query_id", "item_id", "q_part").agg(F.slice(F.array_sort(F.collect_list("d")), 1, 2).alias("n"))
    good = (F.size("n") == 2) & (F.get("n", F.lit(0)) < ratio * F.get("n", F.lit(1)))
    return two.groupBy("query_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_good"))
