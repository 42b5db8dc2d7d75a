"""Greedy decisions in a global order over any number of rows: what may be taken depends on what was taken before.

The rows are dealt into ranges of the order, of at most ``RANGE_ROWS`` rows, and written once. In a round every range walks
through its rows in order, by itself, given what the ranges before it took in the round before; rounds go on until one
changes nothing, or as many as there are ranges. The first range is right after one round and each round settles one more at
least, whatever chains the rows make; rows depend on far ranges seldom, so that a few rounds do. One range, that is up to a million rows, needs one round.
A task holds the marks of what its range took.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import removed, written

RANGE_ROWS = 1 << 20


def settled(rows: DataFrame, cut: list[str], order: list[str], informed: Callable[[DataFrame, DataFrame], DataFrame], chooser: Callable[[], Callable[[dict], list[bool]]], range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows that are taken. ``cut``: columns that ranges are cut by, rows of equal values staying together; ``order``:
    the order of all rows, beginning with them. ``informed(rows, taken)`` gives the rows that are still possible, with
    columns that tell what lower ranges (``_range``) took; ``chooser()`` gives a function from a batch's columns, as lists,
    to the choice of each row, and lives as long as a range."""
    parts = max(1, -(-rows.count() // range_rows))
    pool = written(rows.repartitionByRange(parts, *cut).withColumn("_range", F.spark_partition_id()), "ranges")
    taken = pool.limit(0)
    before, rounds = (0, None), 0
    while True:
        open_rows = informed(pool, taken)
        schema = open_rows.schema

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            choice = chooser()
            for batch in batches:
                yield batch.filter(pa.array(choice({name: batch.column(name).to_pylist() for name in batch.schema.names}), pa.bool_()))

        dealt = open_rows.repartitionById(parts, "_range").sortWithinPartitions(*order)
        old, taken = taken, written(dealt.mapInArrow(choose, schema).select(*pool.columns), "taken")
        removed(old)
        now = tuple(taken.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*order).cast("decimal(20,0)"))).first())
        rounds += 1
        if rounds == parts or now == before:
            return taken.drop("_range")
        before = now


def _sure_firsts(rows: DataFrame, keys: list[str], order: list[str], range_rows: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of rows that are taken, and the rows that are still open. A row that is the first of all its keys is taken,
    and the other rows of these keys go; rounds go on while more than a range is open and each leaves half of it at most."""
    columns, taken, left = rows.columns, [], rows.count()
    live = rows.withColumn("_tie", F.monotonically_increasing_id())
    while left > range_rows:
        marked = live.withColumn("_first", F.lit(True))
        for k in keys:
            place = Window.partitionBy(k).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            marked = marked.withColumn("_first", F.col("_first") & (F.row_number().over(place) == 1))
        # The rows of the last key lie together, so that those behind a taken one go before they are written.
        marked = written(marked.withColumn("_gone", F.first("_first").over(place)).where("_first or not _gone").drop("_gone"), "marked")
        won, live = marked.where("_first"), marked.where("not _first").drop("_first")
        for k in keys[:-1]:
            live = live.join(won.select(F.col(k).alias("_k")), F.col(k).eqNullSafe(F.col("_k")), "left_anti")
        taken.append(won.select(columns))
        before, left = left, live.count()
        if left > before / 2:
            break
    return taken, live.select(columns)


def first_of_keys(rows: DataFrame, keys: list[str], order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Walks the rows in order and takes one if none of its ``keys`` was taken before. ``order`` leaves no ties. Where there
    is more than a range of rows, those that come first of all their keys are taken together; the walk is for what these
    rounds leave, as long chains do."""

    def informed(pool: DataFrame, taken: DataFrame) -> DataFrame:
        for k in keys:
            first = taken.groupBy(F.col(k).alias("_k")).agg(F.min("_range").alias("_r"))
            pool = pool.join(first, pool[k] == first["_k"], "left").where("_r is null or _r >= _range").drop("_k", "_r")
        return pool

    def chooser() -> Callable[[dict], list[bool]]:
        marks = [set() for _ in keys]

        def choice(columns: dict) -> list[bool]:
            out = []
            for values in zip(*(columns[k] for k in keys), strict=True):
                free = not any(v in m for v, m in zip(values, marks, strict=True))
                out.append(free)
                if free:
                    for v, m in zip(values, marks, strict=True):
                        m.add(v)
            return out

        return choice

    taken, live = _sure_firsts(rows, keys, order, range_rows)
    return reduce(DataFrame.unionByName, taken, settled(live, order, order, informed, chooser, range_rows))


def quotas_by_cell(rows: DataFrame, per_cell: int, per_sequence: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Walks the rows (cell, _k, sequence, others) by cell and ``_k`` and takes one if its cell has room, its sequence was
    not taken in this cell, and in fewer than ``per_sequence`` cells before. Rows without a sequence only need room."""

    def informed(pool: DataFrame, taken: DataFrame) -> DataFrame:
        seen = taken.where("sequence is not null").groupBy(F.col("sequence").alias("_s"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_c"))
        asked = pool.where("sequence is not null").select(F.col("sequence").alias("_s"), F.col("_range").alias("_r")).distinct()
        earlier = F.coalesce(F.sum("_c").over(Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier")
        counts = asked.join(seen, ["_s", "_r"], "left").select("_s", "_r", earlier)
        met = pool.join(counts, (pool["sequence"] == counts["_s"]) & (pool["_range"] == counts["_r"]), "left").drop("_s", "_r")
        return met.where(F.coalesce(F.col("_earlier") < per_sequence, F.lit(True)))

    def chooser() -> Callable[[dict], list[bool]]:
        total: dict = {}
        cell, room, here = object(), 0, set()

        def choice(columns: dict) -> list[bool]:
            nonlocal cell, room, here
            out = []
            for c, s, earlier in zip(columns["cell"], columns["sequence"], columns["_earlier"], strict=True):
                if c != cell:
                    cell, room, here = c, per_cell, set()
                ok = room > 0 and (s is None or s not in here and total.get(s, 0) + (earlier or 0) < per_sequence)
                out.append(ok)
                if ok:
                    room -= 1
                    if s is not None:
                        here.add(s)
                        total[s] = total.get(s, 0) + 1
            return out

        return choice

    return settled(rows, ["cell"], ["cell", "_k"], informed, chooser, range_rows)
