"""Importance resampling towards a target distribution, drawn without replacement by a distributed radix sort.

*Weights.* Features are runs of up to ``ngrams`` words, hashed into ``buckets`` buckets. One pass over all documents and
one over all target texts count the buckets; each bucket's gain is the floored log ratio of the two smoothed shares. The
gains are one array of ``buckets`` numbers, and a document's weight is the floored mean of its features' gains. A second
pass over the documents scores them with that array; to the weight comes Gumbel noise from a hash of doc_id, so that the
highest scores are a draw without replacement in proportion to exp(weight / 1000).

*Ranks.* Documents are sorted by (score down, doc_id) as a composite key of digits of ``DIGIT_BITS`` bits, the least
significant first; how many digits there are follows from the least and largest values of both. Each digit takes one
stable counting-sort pass: Spark counts the rows of every (part, digit); prefix sums over (digit, part), in two levels,
give each part the place where its first row of each digit goes; the part's rows are then read in their present order and
given their destinations by running counters. A task holds one counter a digit and one batch of rows, and learns its
offsets from the first rows that it reads, so that nothing passes the driver but the bounds of the keys. After the last
pass a row's place is its rank. Every pass is written to the shared folder; the one before the last is removed.

Defined results: null texts have no words; a null doc_id hashes as no characters and ranks before others of its score;
doc_id is an integer; repeated rows are separate rows, and rows of one doc_id and score rank in the order in which they
were written; extra columns are ignored by ``importance_ranks`` and kept by ``resample``; without target texts the weights
compare with a uniform distribution; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import removed
from .common import shuffle_width, staged

BUCKETS = 10_000
NGRAMS = 1
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
#: Bits of a digit: a pass counts 2 ** DIGIT_BITS digits in every part.
DIGIT_BITS = 11
#: Rows of a part at most.
PART_ROWS = 1 << 20

#: Bytes to themselves in lower case, and those that belong to no word to a space; bytes over 127 are in words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def features_of(words: list[bytes], ngrams: int) -> Counter[bytes]:
    """All runs of 1 to ``ngrams`` consecutive words with their numbers."""
    found = Counter(words)
    for size in range(2, ngrams + 1):
        found.update(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
    return found


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, ngrams: int = NGRAMS) -> np.ndarray:
    """How many features of ``texts`` (a column text) fall in each bucket; Spark sums the tasks' counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                for feature, n in features_of(words_of(text), ngrams).items():
                    total[zlib.crc32(feature) % buckets] += n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    out = np.zeros(buckets, np.int64)
    # One number a bucket reaches the driver, whatever the size of the corpus.
    for row in texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = lambda s, t: (float(t) + 1) * (s_all + buckets) / ((float(s) + 1) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source, target, strict=True)], np.int64)


def scored(docs: DataFrame, gains: np.ndarray, seed: int = SEED, ngrams: int = NGRAMS) -> DataFrame:
    """``docs`` (doc_id, text, others) with n_words, n_features, weight and score."""
    buckets = len(gains)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weighed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = words_of(text)
            found = features_of(words, ngrams)
            n = sum(found.values())
            total = sum(int(gains[zlib.crc32(feature) % buckets]) * k for feature, k in found.items())
            rows.append((len(words), n, total // n if n else 0))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000e0) * F.log(-F.log((h + 0.5) / F.lit(4294967296e0))))
    return docs.withColumn("w", weighed("text")).select(*docs.columns, "w.n_words", "w.n_features", "w.weight", (F.col("w.weight") + noise).alias("score"))


def key_digits(rows: DataFrame, bits: int = DIGIT_BITS) -> list[Column]:
    """The digits of (score down, doc_id), the least significant first, each a column of 0 to 2 ** bits - 1."""
    ends = rows.agg(F.max("score").alias("top"), F.min("score").alias("low"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bool_or(F.col("doc_id").isNull()).alias("unnamed")).first()
    first, last, top, low = (ends[name] or 0 for name in ("first", "last", "top", "low"))
    if last - first < 1 << 62:
        doc, doc_bits = F.coalesce(F.col("doc_id") - F.lit(first), F.lit(0)), (last - first).bit_length()
    else:  # ids over the whole range of a long: as unsigned numbers with the sign turned
        doc, doc_bits = F.coalesce(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63))), F.lit(0)), 64
    score, score_bits = F.lit(top) - F.col("score"), (top - low).bit_length()
    parts = [(doc.cast("long"), doc_bits), (F.col("doc_id").isNotNull().cast("long"), int(bool(ends["unnamed"]))), (score.cast("long"), score_bits)]
    return [F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << min(bits, size - at)) - 1)).cast("int") for value, size in parts for at in range(0, size, bits)]


def counting_pass(rows: DataFrame, digit: Column, parts: int, radix: int = 1 << DIGIT_BITS) -> DataFrame:
    """One stable pass: ``rows`` (part, place, others) in the order of (part, place) get the place that sorting by ``digit``
    gives them. Their part is left as it was."""
    keyed = rows.withColumns({"digit": digit, "offset": F.lit(0).cast("long")})
    seen = keyed.groupBy("digit", "part").agg(F.count("*").alias("n"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Prefix sums over the digits (at most ``radix`` rows), then over the parts within each digit.
    base = seen.groupBy("digit").agg(F.sum("n").alias("all")).select("digit", (F.sum("all").over(upto(Window.orderBy("digit"))) - F.col("all")).alias("base"))
    before = seen.withColumn("before", F.sum("n").over(upto(Window.partitionBy("digit").orderBy("part"))) - F.col("n"))
    marks = before.join(F.broadcast(base), "digit").select("part", F.lit(-1).cast("long").alias("place"), "digit", (F.col("base") + F.col("before")).alias("offset"))
    dealt = keyed.unionByName(marks, allowMissingColumns=True).repartitionById(parts, "part").sortWithinPartitions("place")
    names = rows.columns

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upcoming = np.zeros(radix, np.int64)
        for batch in batches:
            digits, places = (np.asarray(batch.column(name)) for name in ("digit", "place"))
            marked = places < 0
            if marked.any():
                upcoming[digits[marked]] = np.asarray(batch.column("offset"))[marked]
                batch, digits = batch.filter(pa.array(~marked)), digits[~marked]
            order = np.argsort(digits, kind="stable")
            grouped = digits[order]
            to = np.empty(len(digits), np.int64)
            to[order] = upcoming[grouped] + np.arange(len(digits)) - np.searchsorted(grouped, grouped)
            upcoming += np.bincount(digits, minlength=radix)
            yield pa.RecordBatch.from_arrays([pa.array(to) if name == "place" else batch.column(name) for name in names], names=names)

    return dealt.mapInArrow(placed, rows.schema)


def radix_ranked(rows: DataFrame, digits: list[Column], name: str = "radix", part_rows: int = PART_ROWS, bits: int = DIGIT_BITS) -> DataFrame:
    """``rows`` with ``place``: 0, 1, 2 ... in the order of the composite key of ``digits`` (least significant first)."""
    n = rows.count()
    parts = max(shuffle_width(rows.sparkSession), -(-n // part_rows))
    size = max(1, -(-n // parts))
    # Numbered as written; the order that the numbers give is the one that ties keep.
    numbered = staged(rows.withColumn("place", F.monotonically_increasing_id()), name)
    ordered = numbered.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int"))
    # Without any digit all keys are equal; one pass still turns the numbers into places.
    for digit in digits or [F.lit(0)]:
        done = staged(counting_pass(ordered, digit, parts, 1 << bits), name)
        removed(numbered)
        numbered, ordered = done, done.withColumn("part", F.floor(F.col("place") / size).cast("int"))
    return numbered.drop("part")


def importance_ranks(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngrams: int = NGRAMS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, and text_key, a hash that tells rows of one doc_id apart.
    Of the documents of ``min_words`` words or more, ``percent`` of a hundred have a rank."""
    gains = gains_of(bucket_counts(docs, buckets, ngrams), bucket_counts(target, buckets, ngrams))
    keyed = scored(docs.select("doc_id", "text"), gains, seed, ngrams)
    table = staged(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_features", "weight", "score", F.xxhash64("text").alias("text_key")), "importance")
    able = F.col("n_words") >= min_words
    eligible = table.where(able).drop("n_words")
    drawn = percent * eligible.count() // 100
    ranked = radix_ranked(eligible, key_digits(eligible))
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank")
    rest = table.where(~able).drop("n_words").withColumn("place", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", rank, "text_key")


def resample(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn documents with all their columns, and ``__rank``; a row that is repeated comes once."""
    ranks = importance_ranks(docs, target, **options).where(F.col("rank").isNotNull())
    taken = ranks.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.min("rank").alias("__rank"))
    rows = docs.withColumns({"__text_key": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    joined = rows.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")))
    first = F.row_number().over(Window.partitionBy("__id", "__key").orderBy("__row"))
    return joined.withColumn("__first", first).where("__first = 1").drop("__id", "__key", "__text_key", "__row", "__first")


def query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return importance_ranks(documents, benchmark).drop("text_key")
