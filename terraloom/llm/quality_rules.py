"""Quality rules whose cutoffs are chosen by exact binomial tests on labelled documents.

Every rule rejects documents whose value exceeds a cutoff. For a stratum (a language here) and a rule, the cutoffs of
a fixed grid are tested from the most lenient to the strictest on the labelled good documents: with ``n`` of them, of
which ``k`` would be rejected, the exact binomial tail ``P(Bin(n, alpha) <= k)`` must not exceed ``delta`` divided by
the number of (stratum, rule) families. A sequence that is tested in a fixed order and stops at its first failure
needs no correction within itself; the division corrects for the families. A rule that no cutoff passes never rejects.
With the ``rules`` rules of a stratum at ``alpha / rules`` each, the chance that in any stratum all of them together
reject more than ``alpha`` of the good documents that pass the base rules is at most ``delta``. The base rules are given,
not chosen, and what they reject is outside of this guarantee. ``log(delta / families) / log(1 - alpha / rules)`` good
labels are the least with which a cutoff that rejects none of them can be certified.

Only DataFrame functions are used. Texts are read once; what is shuffled is a few numbers a document.

Defined results: a null text has no words and fails the base rules; labels without a document, with a null doc_id or a
null quality are ignored; repeated labels of a document count as one good example if any calls it good; a null stratum
is a stratum of its own; extra columns of either table are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, staged, window_hashes, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ALPHA = 0.02
DELTA = 0.05
#: Rule name -> the grid of cutoffs from lenient to strict. All values are per cent of the document.
RULES: dict[str, list[float]] = {
    "repeat_pct": [28.0, 26.0, 24.0, 22.0, 20.0, 18.0, 16.0, 14.0, 12.0, 10.0, 8.0, 6.0, 4.0],
    "symbol_pct": [60.0, 50.0, 40.0, 35.0, 30.0, 25.0, 20.0, 15.0, 12.0, 10.0, 8.0, 6.0, 5.0, 4.0, 3.0, 2.0],
    "dup_line_pct": [80.0, 70.0, 60.0, 50.0, 45.0, 40.0, 35.0, 30.0, 25.0, 20.0, 15.0, 10.0],
    "long_word_pct": [60.0, 50.0, 40.0, 30.0, 25.0, 20.0, 15.0, 10.0, 5.0],
}
LONG_WORD = 30


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more. Windows are compared by a 64-bit hash; most
    documents have only distinct ones and end there, the others sort (hash, position): n log n at any length."""

    def covered(hashes: Column) -> Column:
        tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            twin = lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (s[F.least(i + 1, last)]["h"] == x["h"]))
            return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

        span = lambda p: F.aggregate(
            p,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")),
            lambda a, x: F.struct((a["n"] + x + window - F.greatest(x, a["end"])).cast("long").alias("n"), (x + window).alias("end")),
            lambda a: a["n"],
        )
        return let(let(tagged, starts), span)

    def by_hash(w: Column) -> Column:
        found = let(window_hashes(w, window), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
        return F.when(F.size(w) <= window, F.lit(0).cast("long")).otherwise(found)

    return let(words, by_hash)


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the base numbers of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spoken = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.char_length(x) > LONG_WORD)).cast("long").alias("n_long_words"),
    )
    of_lines = lambda s: F.struct(F.size(s).cast("long").alias("n_lines"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"))
    return docs.select(
        "doc_id",
        F.col(stratum).cast("string").alias("stratum"),
        let(words_of(F.col("text")), of_words).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(spoken, of_lines).alias("l"),
    ).select("doc_id", "stratum", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "w.n_long_words").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )


def rule_values() -> dict[str, Column]:
    pct = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"repeat_pct": pct("n_repeat_words", "n_words"), "symbol_pct": pct("n_symbols", "word_chars"), "dup_line_pct": pct("n_dup_lines", "n_lines"), "long_word_pct": pct("n_long_words", "n_words")}


def log_factorial(n: Column) -> Column:
    """ln n! for n >= 0: exact up to 20, by Stirling's series (error below 1e-15) above."""
    x = F.greatest(n.cast("double"), F.lit(20.0))
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float, terms: int = 512) -> Column:
    """P(Bin(n, p) <= k), summed from k downwards. Below the mean the terms fall geometrically, so that after ``terms``
    of them a geometric bound stands for the rest: never too small, hence the test stays valid. 1 at or above the mean."""
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)
    total = F.aggregate(
        F.sequence(F.lit(0), F.least(k, F.lit(terms)).cast("int")),
        F.struct(F.lit(0.0).alias("sum"), F.exp(top).alias("term")),
        lambda a, j: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * ratio(k - j)).alias("term")),
        lambda a: a["sum"] + F.when(k > terms, a["term"] / (1 - ratio(k - terms))).otherwise(F.lit(0.0)),
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def stratum_key(stratum: str) -> Column:
    """The stratum's name; null is a stratum of its own, apart from an empty name."""
    return F.when(F.col(stratum).isNull(), F.lit("none")).otherwise(F.concat(F.lit("is "), F.col(stratum)))


def select_cutoffs(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a struct of the certified cutoffs (null: the rule never rejects there)."""
    spark = feats.sparkSession
    good = labels.where(F.col("doc_id").isNotNull() & (F.col("quality") == 1)).select("doc_id").distinct()
    base = feats.where(~F.col("base_failed")).join(good, "doc_id", "left_semi").withColumn("stratum", stratum_key("stratum"))
    values = rule_values()
    #: bin: how many cutoffs of the grid a value exceeds; it is rejected by the cutoffs beyond that index.
    bins = [F.struct(F.lit(rule).alias("rule"), sum(((values[rule] <= cut).cast("int") for cut in grid), F.lit(0)).alias("passed")) for rule, grid in RULES.items()]
    counts = base.select("stratum", F.explode(F.array(*bins)).alias("b")).groupBy("stratum", "b.rule", "b.passed").agg(F.count("*").alias("n"))
    counted = staged(counts, "counts")  # a row per stratum, rule and bin
    families = max(1, counted.select("stratum").distinct().count() * len(RULES))
    grid = spark.createDataFrame([(rule, j, cut) for rule, cuts in RULES.items() for j, cut in enumerate(cuts)], "rule string, j int, cutoff double")
    # passed counts the cutoffs that hold the value, the most lenient first: cutoff j rejects it if j >= passed.
    tests = counted.join(F.broadcast(grid), "rule").groupBy("stratum", "rule", "j", "cutoff").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("j") >= F.col("passed"), F.col("n")).otherwise(0)).alias("k"))
    tested = tests.withColumn("ok", binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES)) <= F.lit(delta / families))
    order = Window.partitionBy("stratum", "rule").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = tested.withColumn("held", F.min(F.col("ok").cast("int")).over(order)).where("held = 1")
    best = passed.groupBy("stratum", "rule").agg(F.max_by("cutoff", "j").alias("cutoff"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"max_{rule}") for rule in RULES))


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Every document with its numbers, ``base_failed``, ``rule_failed`` (the first rule beyond its cutoff) and ``kept``."""
    feats = staged(features(docs, stratum), "quality")
    cuts = select_cutoffs(feats, labels, alpha, delta)
    joined = feats.withColumn("stratum_key", stratum_key("stratum")).join(cuts.withColumnRenamed("stratum", "stratum_key"), "stratum_key", "left")
    failed = F.coalesce(*(F.when(value > F.col(f"max_{rule}"), F.lit(rule)) for rule, value in rule_values().items()))
    return joined.withColumn("rule_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("rule_failed").isNull()).drop("stratum_key")


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_filter(documents, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_failed")
