"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index over bit rotations, and components.

*Fingerprints.* Words of the ASCII-lower-cased text form 4-word shingles, repeats included; each is hashed by XXH64; a
bit of the fingerprint is set if it is set in more than half of the hashes.

*Links.* Equal fingerprints are merged first, so that thousands of copies are one row. The 64 bits are cut into
``budget + t`` blocks: two fingerprints within ``budget`` bits agree in ``t`` blocks at least. So each distinct fingerprint
goes once per choice of ``t`` blocks to the bucket of their bits: the buckets are the top nodes of the index. ``t`` is the
least for which buckets of evenly spread fingerprints hold ``BUCKET`` codes at most (``blocks_together``): 1 up to 4
million distinct fingerprints, 2 (15 copies of a row) up to 10^9, 3 (35 copies) up to 10^11; every ``t`` finds the same
links. Spark sorts every bucket by Gray rank, which puts codes with common leading bits side by side, and a task builds a tree over each sorted
list: a node is a run of neighbours and holds the mask of the bits that all of them share, with the pattern there; the
nodes above hold what their children share. The search goes down pairs of nodes from the roots. A pair adds to its
parents' differences only the bits that have become common since, and when the sum exceeds the budget the whole
group of pairs below falls away. Groups that are already joined by links are not looked at again. Buckets of more than
``chunk`` rows are dealt by a hash into chunks; chunks meet in pairs, and each pair of chunks is a group of its own
that any task can take. A task returns, for its lists, a spanning forest of the links that it finds (at most one row per
fingerprint, not the pairs).

*Components.* The forests' links are joined by alternating large-star and small-star steps, each a shuffle by node with
its state written to the shared folder, until nothing changes.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; a null doc_id counts as
larger than all others and never names a component unless alone with its like; repeated rows keep their rows in the
index, and ``keep_one`` keeps one row of each component; extra columns are ignored by the index and pass through it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..sources.stage import removed
from .common import let, shuffle_width, staged

SHINGLE = 4
BUDGET = 4
SEED = 42
#: Codes of a mean bucket from which wider keys cost less than larger buckets.
BUCKET = 1024
#: Fingerprints of a bucket that one tree holds; larger buckets are cut into chunks of about this size.
CHUNK = 4096
#: Children of a node.
FAN = 2
#: Rows that a task indexes at a time, and pairs of nodes that it looks at at a time.
UNIT = 1 << 16
FRONTIER = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    n = max(1, len(words) - shingle + 1)
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    total = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounded memory for texts of any length
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)), np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def with_fingerprints(docs: DataFrame) -> DataFrame:
    return docs.withColumn("fp", _fingerprints("text"))


# The Gray-order index ----------------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_rank_column(code: str) -> Column:
    folded = lambda shift: lambda r: r.bitwiseXOR(F.shiftrightunsigned(r, shift))
    rank = F.col(code)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = let(rank, folded(shift))
    return rank


class _Level:
    """Nodes over runs of neighbours in Gray order, none across two lists: the bits that all members share (mask), their
    common pattern there, and the first and last of each node's children on the level below."""

    def __init__(self, below: _Level | None, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray | None = None):
        self.starts, self.sizes = starts, sizes  # of each list, on this level
        if below is None:
            self.mask, self.bits, self.first = np.full(len(codes), ~np.uint64(0)), codes, None
            return
        at = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)  # the node's place in its list
        self.first = np.repeat(below.starts, sizes) + at * FAN
        self.last = np.minimum(self.first + FAN, np.repeat(below.starts + below.sizes, sizes))
        agree = below.mask & below.bits, below.mask & ~below.bits
        ones, zeros = (np.bitwise_and.reduceat(x, self.first) if len(at) else x[:0] for x in agree)
        self.mask, self.bits = ones | zeros, ones


class GrayForest:
    """One tree of nodes per list of codes; every list is sorted by Gray rank. Level 0 are the codes themselves."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        self.codes = codes
        sizes = np.diff(np.append(starts, len(codes)))
        self.levels = [_Level(None, starts, sizes, codes)]
        while (sizes > 1).any():
            sizes = -(-sizes // FAN)
            self.levels.append(_Level(self.levels[-1], np.cumsum(sizes) - sizes, sizes))
        self.label = np.arange(len(codes))  # the tree of links that a code is known to lie in
        self.visits = self.n_links = 0

    def links(self, left: np.ndarray, right: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Codes a, b of a spanning forest of the links within ``budget`` bits between list ``left[i]`` and ``right[i]``,
        for every i; within a list if both are the same. Starts at the roots; a pair of nodes carries the differences
        that it has run up and the bits where they were counted, and all that lies below it falls away beyond the budget."""
        top = len(self.levels) - 1
        none = np.zeros(len(left), np.uint64)
        pile = [(top, left, right, np.zeros(len(left), np.uint8), none)]
        while pile:
            depth, a, b, spent, seen = pile.pop()
            if len(a) > FRONTIER:
                for k in range(0, len(a), FRONTIER):
                    pile.append((depth, *(x[k : k + FRONTIER] for x in (a, b, spent, seen))))
                continue
            level = self.levels[depth]
            self.visits += len(a)
            fresh = level.mask[a] & level.mask[b] & ~seen
            spent = spent + np.bitwise_count((level.bits[a] ^ level.bits[b]) & fresh)
            near = spent <= budget
            a, b, spent, seen = a[near], b[near], spent[near], (seen | fresh)[near]
            if depth == 0:
                yield from self._join(a, b)
            elif len(a):
                open_ = ~self._joined(depth, a, b)
                a, b, spent, seen = a[open_], b[open_], spent[open_], seen[open_]
                # the children of one side, then those of the other; of equal nodes each pair once
                n, m = (level.last - level.first)[a], (level.last - level.first)[b]
                pair = np.repeat(np.arange(len(a)), n * m)
                k = np.arange(len(pair)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
                x, y = level.first[a][pair] + k // m[pair], level.first[b][pair] + k % m[pair]
                once = (a[pair] != b[pair]) | (x < y) | ((x == y) & (depth > 1))
                pile.append((depth - 1, x[once], y[once], spent[pair][once], seen[pair][once]))

    def _joined(self, depth: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether all codes below two nodes are already known to lie in one tree of links."""
        if not self.n_links:
            return np.zeros(len(a), bool)
        low = high = self.label
        for level in self.levels[1 : depth + 1]:
            low, high = np.minimum.reduceat(low, level.first), np.maximum.reduceat(high, level.first)
        return (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])

    def _join(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while True:
            p, q = self.label[a], self.label[b]
            apart = p != q
            if not apart.any():
                return
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            high, one = np.unique(np.maximum(p, q), return_index=True)  # each tree is hung once below a smaller one
            self.n_links += len(one)
            yield self.codes[a[one]], self.codes[b[one]]
            up = np.arange(len(self.label))
            up[high] = np.minimum(p, q)[one]
            while not np.array_equal(nxt := up[up], up):
                up = nxt
            self.label = up[self.label]


def link_codes(left: np.ndarray, right: np.ndarray | None, budget: int = BUDGET) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of codes, of the links within ``budget`` bits among ``left`` (distinct codes), or
    between ``left`` and ``right`` if given."""
    lists = [x[np.argsort(gray_rank(x), kind="stable")] for x in (left, right) if x is not None]
    if not len(lists[0]) or not len(lists[-1]):
        return []
    forest = GrayForest(np.concatenate(lists), np.array([0, len(left)][: len(lists)]))
    found = forest.links(np.array([0]), np.array([len(lists) - 1]), budget)
    return [(int(x), int(y)) for a, b in found for x, y in zip(a, b, strict=True)]


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """codes, starts and sides of whole lists. Rows come sorted by (block, value, pair, side, rank); what is held at a time
    is ``UNIT`` rows and one bounded group more."""
    held, size = [], 0
    names = ["block", "value", "pair", "side"]

    def unit(pdf: pd.DataFrame):
        keys = pdf[names].to_numpy()
        starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)
        return np.ascontiguousarray(pdf["fp"].to_numpy()).view(np.uint64), starts, keys[starts]

    for pdf in batches:
        if pdf.empty:
            continue
        held.append(pdf)
        size += len(pdf)
        if size >= UNIT:
            whole = pd.concat(held, ignore_index=True)
            groups = whole[names[:3]].to_numpy()
            last = np.flatnonzero((groups != groups[-1]).any(axis=1))  # the last group may go on in the next batch
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield unit(whole[:cut])
            held, size = [whole[cut:]], len(whole) - cut
    if size:
        yield unit(pd.concat(held, ignore_index=True))


def bucket_links(budget: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for codes, starts, keys in _units(batches):
            # a group is one list that meets itself (side 0), or two that meet each other (sides 1 and 2)
            alone = np.flatnonzero(keys[:, 3] == 0)
            first = np.flatnonzero((keys[:-1, 3] == 1) & (keys[1:, 3] == 2) & (keys[:-1, :3] == keys[1:, :3]).all(axis=1))
            forest = GrayForest(codes, starts)
            for a, b in forest.links(np.append(alone, first), np.append(alone, first + 1), budget):
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def key_masks(budget: int = BUDGET, together: int = 1) -> list[int]:
    """The bits of each choice of ``together`` out of ``budget + together`` blocks."""
    blocks = budget + together
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [sum(chosen) for chosen in combinations(masks, together)]


def blocks_together(n: int, budget: int = BUDGET, bucket: int = BUCKET) -> int:
    """The least number of blocks of a key for which no mean bucket of ``n`` evenly spread codes exceeds ``bucket``."""
    together = 1
    while together + budget < 64 and n > bucket << min(m.bit_count() for m in key_masks(budget, together)):
        together += 1
    return together


def fingerprint_links(distinct: DataFrame, budget: int = BUDGET, chunk: int = CHUNK, together: int | None = None) -> DataFrame:
    """a, b: links whose components are those of all links within ``budget`` bits among the distinct ``fp``. ``together``
    blocks make a key, by default as many as the number of rows asks for."""
    spark = distinct.sparkSession
    masks = key_masks(budget, together or blocks_together(distinct.count(), budget))
    values = F.array(*(F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks))
    rows = distinct.select("fp", gray_rank_column("fp").alias("rank"), F.posexplode(values).alias("block", "value"))
    counts = rows.groupBy("block", "value").agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") > chunk).select("block", "value", F.ceil(F.col("n") / chunk).cast("int").alias("m"))
    sized = rows.join(hot, ["block", "value"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct((F.least(o, F.col("mine")) * F.col("m") + F.greatest(o, F.col("mine"))).alias("pair"), F.when(o == F.col("mine"), 0).when(F.col("mine") < o, 1).otherwise(2).alias("side")))
    plain = F.array(F.struct(F.lit(0).alias("pair"), F.lit(0).alias("side")))
    dealt = sized.withColumn("mine", mine).select("fp", "rank", "block", "value", F.explode(F.when(F.col("m").isNull(), plain).otherwise(others)).alias("x")).select("fp", "rank", "block", "value", "x.*")
    keys = ["block", "value", "pair"]
    sorted_ = dealt.repartition(shuffle_width(spark), *keys).sortWithinPartitions(*keys, "side", "rank")
    return sorted_.mapInPandas(bucket_links(budget), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every linked node but the roots themselves, by alternating star steps
    until a round changes nothing. A round's tables are deleted when the next one's are written."""
    spent = []

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        if large:
            # A hub has many neighbours: with the least ones written out, the engine can split the hub's side of the join.
            low = staged(low, "least")
            spent.append(low)
            joined = both.join(low, "a")
            return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        joined = both.join(low, "a")
        return joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.where(F.col("a") != F.col("m")).select("a", F.col("m").alias("b"))).distinct()

    edges, now, before = staged(links.where(F.col("a") != F.col("b")).distinct(), "links"), None, ()
    while now != before:
        spent.append(edges)
        edges = staged(star(star(edges, True), False), "stars")
        now, before = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first(), now
        while spent:
            removed(spent.pop())
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def _rooted(distinct: DataFrame, budget: int) -> DataFrame:
    """``distinct``, one row per fp, with the smallest fingerprint (``root``) of each one's component."""
    distinct = staged(distinct, "distinct")
    links = components(fingerprint_links(distinct.select("fp"), budget))
    return distinct.join(links, distinct.fp == links.node, "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``."""
    marked = staged(with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "fingerprints")
    rooted = _rooted(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), budget)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row of ``docs`` per component: of its smallest doc_id (a null doc_id stays only in components without another),
    and of repeated ones any single row. Rows are numbered in a written table, so that the numbers hold in both reads."""
    rows = staged(docs.withColumn("__sim_row", F.monotonically_increasing_id()), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__sim_row")).alias("first")
    rooted = _rooted(with_fingerprints(rows.select("__sim_row", "doc_id", "text")).groupBy("fp").agg(first), budget)
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.__sim_row")
    return rows.join(kept, "__sim_row", "left_semi").drop("__sim_row")


def query(documents: DataFrame) -> DataFrame:
    found = near_duplicates(documents.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
