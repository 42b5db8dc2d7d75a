"""Language identification by error-correcting output codes.

*Learning.* Labelled documents (a bounded sample of each language: about ``SAMPLE`` documents, chosen by a hash) are
turned into counts of hashed byte n-grams by Spark and summed per language. Each language gets a codeword of ``BITS``
bits; of many random words each next language takes the one that is farthest from the others', so that a few wrong bits
still leave the right word nearest. For every bit, a binary classifier separates the n-grams of the languages whose bit
is one from those whose bit is zero: its weights are smoothed log odds. In a second pass the sample's documents go through
all classifiers; from the means and spreads of their margins come each bit's threshold, its scale, and how often it errs.

*Prediction.* A text's mean weights give a margin for every bit; a codeword's loss is the logistic loss of the margins
against its bits, weighted by how reliably each bit's classifier separates the sample's documents; the nearest codeword wins. The score
is the winner's share of exp(-loss), and a text is ambiguous if the runner-up's loss is nearly as small.

Only the text enters a prediction. Defined results: null texts and texts without a letter are ``und`` with score 0 and
not ambiguous; rows with null lang are never learned from; a null doc_id is held out from learning; repeated rows get equal
results; extra columns pass through; with no labelled row every text is ``und``; one learned language is always
predicted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

DIM = 1 << 14
BITS = 31
#: Labelled documents per language that learning reads on average, at any size of the corpus.
SAMPLE = 2000
#: The least gap between the two smallest losses, relative to the code length, of a text that is not ambiguous.
MARGIN = 0.01
_BLOCK = 1 << 20


#: Random words among which each language's codeword is chosen.
_DRAWS = 512


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the byte n-grams of lengths 2 to 4, by bucket, of the whole lower-cased text with a space at either end.
    Blocks of starting places bound the memory; each block reads three bytes on, so that no n-gram is lost or made up."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    total = np.zeros(DIM)
    for at in range(0, len(b), _BLOCK):
        c = b[at : at + _BLOCK + 3].astype(np.uint32)
        two = c[:-1] * np.uint32(257) + c[1:]
        three = two[:-1] * np.uint32(65599) + c[2:]
        four = three[:-1] * np.uint32(65599) + c[3:]
        mixed = np.concatenate([two[:_BLOCK] * np.uint32(2654435761), three[:_BLOCK] * np.uint32(2246822519), four[:_BLOCK] * np.uint32(3266489917)])
        total += np.bincount(mixed >> np.uint32(18), minlength=DIM)
    return total


def codewords(languages: list[str], bits: int = BITS) -> np.ndarray:
    """One row of bits per language, fixed by the languages' number: each is, of ``_DRAWS`` random words, the one whose
    nearest earlier word is farthest. Every bit has both values if there are two languages or more."""
    rng = np.random.default_rng(20240)
    words = rng.integers(0, 2, (min(1, len(languages)), bits))
    for _ in languages[1:]:
        drawn = rng.integers(0, 2, (_DRAWS, bits))
        nearest = (drawn[:, None, :] != words[None, :, :]).sum(axis=2).min(axis=1)
        words = np.vstack([words, drawn[nearest.argmax()]])
    if len(languages) > 1:
        same = (words == words[0]).all(axis=0)
        words[-1, same] ^= 1  # takes the last word farther from all others
    return words.astype(np.int8)


class Model:
    """weights (DIM, bits), bias (bits), gain (bits), codes (languages, bits)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """The classifiers' weights, from n-gram counts of each language; ``tune`` completes the model."""
        self.languages, self.codes = languages, codewords(languages)
        p = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)  # smoothed, each language alike
        ones = self.codes.T.astype(np.float64)  # bits, languages
        share = lambda side: side @ p / np.maximum(side.sum(axis=1, keepdims=True), 1)
        w = np.log(share(ones) + 1e-9) - np.log(share(1 - ones) + 1e-9) if len(languages) > 1 else np.zeros((BITS, counts.shape[1]))
        self.weights = np.ascontiguousarray(w.T.astype(np.float32))
        self.bias, self.scale, self.weight = np.zeros(BITS), np.ones(BITS), np.full(BITS, 1 / BITS)

    def tune(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        """Threshold, scale and weight of every bit from the margins of documents: per language their number, and per
        language and bit their sum and sum of squares. A bit's error is that of its threshold between two normal curves."""
        means = sums / n[:, None]
        spread = np.sqrt(np.maximum((squares / n[:, None] - means**2).mean(axis=0), 1e-12))
        one = self.codes == 1
        low, high = np.where(one, means, np.inf).min(axis=0), np.where(one, -np.inf, means).max(axis=0)
        gap = np.maximum(low - high, 1e-3)
        self.bias, self.scale = (low + high) / 2, 6.0 / gap
        error = np.array([0.5 * math.erfc(x / 2 / math.sqrt(2)) for x in gap / spread])
        self.weight = (1 - 2 * error) / max((1 - 2 * error).sum(), 1e-12)

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return counts.astype(np.float32) @ self.weights / max(counts.sum(), 1)

    def losses(self, counts: np.ndarray) -> np.ndarray:
        margin = (self.margins(counts) - self.bias) * self.scale
        signed = np.where(self.codes == 1, margin, -margin)
        return np.logaddexp(0, -signed) @ self.weight

    def predict(self, text: str) -> tuple[str, float, bool]:
        loss = self.losses(ngram_counts(text))
        share = np.exp(-BITS * (loss - loss.min()))
        best = int(loss.argmin())
        second = np.partition(loss, 1)[1] if len(loss) > 1 else np.inf
        return self.languages[best], float(share[best] / share.sum()), bool(second - loss[best] < MARGIN)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from rows of ``docs`` (doc_id, text, lang) with a label; the caller leaves out what is held out."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull())
    sizes = known.groupBy("lang").count().withColumn("share", F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count")))
    chosen = known.join(F.broadcast(sizes.select("lang", "share")), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < F.col("share") * (1 << 20)).where(F.col("text").isNotNull())
    chosen = staged(chosen.select("lang", "text"), "labelled")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                sums[lang] = sums.get(lang, 0) + ngram_counts(text)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    # Spark sums the tasks' counts; what reaches the driver is one number per language and bucket, at any size of the corpus.
    summed = chosen.mapInPandas(count, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    parts: dict[str, np.ndarray] = {}
    for row in summed.collect():
        parts.setdefault(row["lang"], np.zeros(DIM))[row["bucket"]] = row["n"]
    languages = sorted(parts)
    model = Model(languages, np.array([parts[x] for x in languages]).reshape(len(languages), DIM))
    if len(languages) < 2:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, totals = _from(shared.value), {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                m = own.margins(ngram_counts(text)).astype(np.float64)
                totals[lang] = totals.get(lang, 0) + np.stack([np.ones(BITS), m, m * m])
        for lang, (n, one, two) in totals.items():
            yield pd.DataFrame({"lang": lang, "bit": np.arange(BITS), "n": n, "one": one, "two": two})

    totals = np.zeros((3, len(languages), BITS))
    seen = chosen.mapInPandas(margins, "lang string, bit int, n double, one double, two double").groupBy("lang", "bit").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))
    for row in seen.collect():  # one row per language and bit
        totals[:, languages.index(row["lang"]), row["bit"]] = row["n"], row["one"], row["two"]
    model.tune(totals[0, :, 0], totals[1], totals[2])
    return model


def _from(state: dict) -> Model:
    model = Model.__new__(Model)
    vars(model).update(state)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # its size depends on the languages alone

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        import regex

        letter, own = regex.compile(r"\p{L}"), _from(shared.value)
        rows = [own.predict(t) if t is not None and own.languages and letter.search(t) else ("und", 0.0, False) for t in texts]
        return pd.DataFrame(rows, columns=["lang_pred", "score", "ambiguous"])

    return docs.withColumn("__lang_p", predicted("text")).withColumns({c: F.col(f"__lang_p.{c}") for c in ("lang_pred", "score", "ambiguous")}).drop("__lang_p")


def query(documents: DataFrame) -> DataFrame:
    marked = documents.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(marked.where(~F.col("held_out")))
    return identify(marked.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
