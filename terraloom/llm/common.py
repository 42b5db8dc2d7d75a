"""What the text operators share: word splitting, a let-binding for expressions, and staged tables."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import shared_dir  # noqa: F401  (the text operators take both from here)
from ..sources.stage import written as staged  # noqa: F401

#: The white space of the contracts: space and the control characters tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The maximal runs without white space; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RUN))


def window_hashes(words: Column, window: int) -> Column:
    """A 64-bit hash of every run of ``window`` words, for more than ``window`` - 1 words. Runs of 1, 2, 4, ... words are
    hashed from two hashes of the length before, so that a window costs a few hashes of numbers and no copied words."""

    def grown(h: Column, have: int, ones: Column) -> Column:
        if have == window:
            return F.slice(h, 1, F.greatest(F.size(h) - window + 1, F.lit(0)))
        if 2 * have <= window:
            return let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + have))), lambda n: grown(n, 2 * have, ones))
        return let(F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(ones, i + j) for j in range(have, window)))), lambda n: grown(n, window, ones))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda ones: grown(ones, 1, ones))


def prefix_sums(values: Column, block: int = 512) -> Column:
    """Running sums of an array of numbers: within blocks first, then the blocks' totals, because appending to one
    accumulator copies it each time; an array of a million numbers takes some 10^8 steps instead of 10^12."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("sums"))
    running = lambda a: F.aggregate(a, start, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["sums"], F.array(acc["sum"] + x)).alias("sums")), lambda acc: acc["sums"])

    def joined(blocks: Column) -> Column:
        totals = running(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.when(i > 0, F.get(t, i - 1)).otherwise(F.lit(0).cast("long"))))))

    cut = lambda a: F.transform(F.sequence(F.lit(0), (F.size(a) - 1).cast("int"), F.lit(block)), lambda i: running(F.slice(a, i + 1, block)))
    return let(values, lambda a: F.when(F.size(a) == 0, F.array().cast("array<long>")).otherwise(let(cut(a), joined)))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain ``lower`` suffices where every character is ASCII."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
