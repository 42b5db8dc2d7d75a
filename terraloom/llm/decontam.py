"""Benchmark decontamination by pigeonhole edit matching.

Texts and benchmark items are lower-cased and their white space is single spaces. An item of n characters has an error
budget of e = n * ``rate`` edits and is split into e + 1 pieces: where the item occurs in a text with e edits or fewer,
one piece at least occurs unchanged. An automaton of all pieces finds their exact hits in one pass over the whole text;
each hit puts the item at one place of the text, and Myers' bit-parallel algorithm decides whether the text holds the
item there within the budget. Hits of one item that point at overlapping places are verified together. An item too short
for a budget of one edit (under 13 characters at the given rate) has one piece, itself, and counts where no letter or digit
of the text goes on from its own: ``no`` is not in ``nothing``.

The benchmark is the stated query set: it is read in blocks of at most ``BLOCK_CHARS`` characters, each block an
automaton of bounded size that is sent to all tasks, and every block meets every text.

Defined results: null and empty texts hold nothing; null, blank and one-character items are ignored; items equal after
normalising are each reported; items keep the type of their ids; a null doc_id is kept; repeated rows get equal results; extra columns pass through
``decontaminate``; an empty table on either side gives no match.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.08
#: Characters of benchmark items that one automaton takes.
BLOCK_CHARS = 4_000_000


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget_of(item: str, rate: float = RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece) of the budget + 1 pieces of a normalised item."""
    n, parts = len(item), budget_of(item, rate) + 1
    cuts = [n * j // parts for j in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def pattern_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return dict(masks)


def best_distance(masks: dict[str, int], size: int, text: str, enough: int = -1) -> tuple[int, int]:
    """The least edit distance of the pattern to any stretch of ``text``, and where that stretch ends (exclusive)."""
    full, high = (1 << size) - 1, 1 << (size - 1)
    pv, mv, score, best, end = full, 0, size, size, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, i + 1
            if best <= enough:
                break
    return best, end


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether no word of the text goes on across either border of the stretch."""
    inside = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return not inside(start) and not inside(end)


class Matcher:
    """The pieces of a block of items, and the items' bit masks."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items, self.machine = {}, ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for key, (item_id, text) in enumerate(items):
            if len(item := normalised(text)) > 1:
                self.items[key] = (item_id, item, budget_of(item, rate), pattern_masks(item))
                for at, piece in pieces(item, rate):
                    where[piece].append((key, at))
        for piece, places in where.items():
            self.machine.add_word(piece, (len(piece), places))
        if where:
            self.machine.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, distance) of the items that the whole text holds."""
        if not self.items or not (text := normalised(text)):
            return []
        starts: dict[int, list[int]] = defaultdict(list)
        for end, (size, places) in self.machine.iter(text):
            for key, at in places:
                starts[key].append(end + 1 - size - at)
        found = []
        for key, places in starts.items():
            item_id, item, budget, masks = self.items[key]
            if not budget:
                if any(stands_alone(text, place, place + len(item)) for place in places):
                    found.append((item_id, 0))
                continue
            least, seen = budget + 1, None
            for place in sorted(set(places)):
                if seen is not None and place <= seen:
                    continue  # lies in the window that was verified
                seen = place + budget
                window = text[max(0, place - budget) : seen + len(item) + budget]
                least = min(least, best_distance(masks, len(item), window, 0)[0])
                if not least:
                    break
            if least <= budget:
                found.append((item_id, least))
        return found


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.where(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def marked(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, column: str = "leaks") -> DataFrame:
    """``docs`` with ``column``, an array of (item_id, distance); a column of that name is replaced."""
    found = f"array<struct<item_id:{benchmark.schema['item_id'].dataType.simpleString()},distance:int>>"
    out = docs.withColumn(column, F.array().cast(found))
    for items in _blocks(benchmark):
        out = out.withColumn(column, F.concat(column, _finder(docs.sparkSession.sparkContext.broadcast(items), rate, found)("text")))
    return out


def _finder(shared, rate: float, schema: str):
    @F.pandas_udf(schema)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, rate)
        for texts in batches:
            yield pd.Series([[{"item_id": i, "distance": n} for i, n in matcher.matches(t)] for t in texts], dtype=object)

    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    return marked(docs, benchmark, rate, "__leaks").where(F.size("__leaks") == 0).drop("__leaks")


def query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document with ``contaminated``, and its items by id."""
    out = marked(documents.select("doc_id", "text"), benchmark)
    ids = F.array_sort(F.transform("leaks", lambda x: x["item_id"]))
    return out.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), ids.alias("item_ids"), F.array_min(F.transform("leaks", lambda x: x["distance"])).alias("least_distance"))
