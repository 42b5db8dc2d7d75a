"""Merging of vector indices without near copies, and quota sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.geo import haversine_km
from ..sources.scan import unit_vector
from ..sources.stage import written
from .spatial import radius_pairs


def cosine(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a) * dot(b, b)), F.lit(1e-12))


def decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """item_id and kept (1, else -1) of the items that can be decided from conflicts sorted by item_id: an item goes if one
    of its earlier conflicts stays, and stays if all of them go. ``known`` is 1, -1 or 0 for those of other tasks; those of
    this task are decided on the way. Only the numbers of decided items are held."""
    here: dict = {}
    item, stays, waits = None, True, False

    def close() -> list[tuple]:
        if item is None or (stays and waits):
            return []
        here[item] = 1 if stays else -1
        return [(item, here[item])]

    for pdf in batches:
        out = []
        for i, other, known in zip(pdf["item_id"].tolist(), pdf["other"].tolist(), pdf["known"].tolist(), strict=True):
            if i != item:
                out += close()
                item, stays, waits = i, True, False
            known = known or here.get(other, 0)
            stays, waits = stays and known != 1, waits or known == 0
        yield pd.DataFrame(out, columns=["item_id", "kept"])
    yield pd.DataFrame(close(), columns=["item_id", "kept"])


#: Items of the first block of a merge; each block after it is as large as all before.
FIRST_BLOCK = 1 << 13


def merge_without_copies(index: DataFrame, radius_m: float, least_cosine: float, first_block: int = FIRST_BLOCK) -> DataFrame:
    """Walks the items in order of item_id and drops one if a kept earlier item lies within the radius and is at least
    that similar. Items of equal place and vector that conflict with each other are one item, that of the smallest id:
    the others go with it or by it. Items with numbers as ids go by blocks of ascending ids that double: a block meets the
    items kept before it, and only what these leave meets itself, so that dropped items are never paired with each other."""
    alike = (haversine_km("lat", "lon", "lat", "lon") <= radius_m / 1000) & (cosine(F.col("embedding"), F.col("embedding")) >= least_cosine)
    own = F.when(~F.coalesce(alike, F.lit(False)), F.col("item_id")).alias("_own")
    first = written(index.groupBy(own, "lat", "lon", "embedding").agg(F.min("item_id").alias("item_id")).drop("_own"), "first")
    lows: list = []
    if isinstance(first.schema["item_id"].dataType, IntegralType) and (n := first.count()) > first_block:
        ends = [first_block * 2**k / n for k in range(64) if first_block * 2**k < n]
        lows = sorted(set(first.agg(F.percentile_approx("item_id", ends, 100_000)).first()[0]))
    kept = None
    for low, high in zip([None, *lows], [*lows, None], strict=True):
        block = first if low is None else first.where(F.col("item_id") > low)
        block = block if high is None else block.where(F.col("item_id") <= high)
        if kept is not None:
            gone = _conflicts(block, kept, radius_m, least_cosine).select("item_id").distinct()
            block = written(block.join(gone, "item_id", "left_anti"), "left")
        stays = written(_without_conflicts(block, radius_m, least_cosine), "kept")
        kept = stays if kept is None else kept.unionByName(stays)
    return index.join(kept.select("item_id"), "item_id", "left_semi")


def _conflicts(items: DataFrame, others: DataFrame, radius_m: float, least_cosine: float) -> DataFrame:
    """item_id, other: of ``items`` with those of ``others`` within the radius that are at least that similar."""
    right = others.select(F.col("item_id").alias("other"), "lat", "lon", F.col("embedding").alias("v"))
    near = radius_pairs(items, right, radius_m / 1000)
    return near.where(cosine(F.col("embedding"), F.col("v")) >= least_cosine).select("item_id", "other")


def _without_conflicts(first: DataFrame, radius_m: float, least_cosine: float) -> DataFrame:
    """One block's kept items. Conflicts are found by a distance join and dealt by ranges of ids; a task walks its range in
    order, so that a chain of ascending ids takes one round. What waits for other ranges goes to the next round; each round
    decides the first range that is left at least, so that the rounds end by themselves."""
    edges = written(_conflicts(first, first, radius_m, least_cosine).where("other < item_id"), "conflicts")
    # Items without an earlier conflict are kept at once; only the others go through the rounds.
    at_once = edges.select("other").distinct().join(edges.select(F.col("item_id").alias("other")).distinct(), "other", "left_anti")
    left = written(edges.join(at_once.withColumn("n", F.lit(1)), "other", "left").select("item_id", "other", F.coalesce("n", F.lit(0)).alias("known")), "undecided")
    schema = f"item_id {first.schema['item_id'].dataType.simpleString()}, kept int"
    dropped = edges.select("item_id").limit(0)
    while not left.isEmpty():
        fresh = written(left.repartitionByRange("item_id").sortWithinPartitions("item_id").mapInPandas(decided, schema), "decided")
        dropped = dropped.unionByName(fresh.where("kept = -1").select("item_id"))
        waiting = left.join(fresh, "item_id", "left_anti").join(fresh.select(F.col("item_id").alias("other"), F.col("kept").alias("n")), "other", "left")
        left = written(waiting.select("item_id", "other", F.when(F.col("known") == 0, F.coalesce("n", F.lit(0))).otherwise(F.col("known")).alias("known")), "undecided")
    return first.join(dropped, "item_id", "left_anti")


def merge_indices(indices: Sequence[DataFrame], order: str, keys: Sequence[str] = ("match_id", "path"), radius_m: float = 0.0, least_cosine: float = 0.999, most: int = 0) -> DataFrame:
    """One index of several (lat, lon, embedding, the keys and ``order``): the rows of the first index in their order, then
    those of the next. Of rows with equal keys (nulls are equal) the first stays; then, with a radius, a row goes if a kept
    earlier one lies within it and is at least that similar; then the first ``most`` stay, all if 0. ``origin`` is the number
    of the index and ``item_id`` grows in the merged order; columns of these names are replaced, vectors get unit length.

    Rows without valid coordinates or a vector are left out. Ties of ``order`` within an index go by the keys, then by
    place and vector. No rows give an empty index. The order is one range sort whose numbers are written out once; a cap
    is found from counts of its ranges and the numbers of one range, so that it moves no vectors."""
    columns = [c for c in indices[0].columns if c not in ("origin", "item_id")]
    sides = [index.select(*columns, F.col(order).alias("__order"), F.lit(n).alias("origin")) for n, index in enumerate(indices)]
    valid = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.col("embedding").isNotNull()
    rows = reduce(DataFrame.unionByName, sides).where(valid).withColumn("embedding", unit_vector(F.col("embedding")))
    ways = [*keys, "lat", "lon", "embedding"]
    place = F.struct("origin", "__order", *ways)
    first = rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.min_by(F.struct(*rows.columns), place).alias("row")).select("row.*")
    merged = written(first.orderBy("origin", "__order", *ways).withColumn("item_id", F.monotonically_increasing_id()).drop("__order"), "merged")
    if radius_m > 0:
        merged = merge_without_copies(merged, radius_m, least_cosine)
    return first_in_order(merged, most) if most > 0 else merged


def first_in_order(df: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of the least ``item_id``, where the ids are those of a sorted table (``monotonically_increasing_id``)."""
    df = written(df, "uncapped")
    part, seen = F.shiftright("item_id", 33), 0
    for r in df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # one row a range of the sort
        if seen + r["n"] > most:
            ids = df.where(part == r["part"]).select("item_id").orderBy("item_id")
            last = ids.limit(most - seen).agg(F.max("item_id")).first()[0]
            return df.where(F.col("item_id") <= last) if last is not None else df.where(part < r["part"])
        seen += r["n"]
    return df
