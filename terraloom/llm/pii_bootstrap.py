"""Personal data by bootstrapped contextual extraction.

*Seeds.* Every whole text is searched for four base kinds (email, ip, card, phone); their spans are always reported. They
are the seed entities. *Sites.* Other words that look like identifiers (``MIN_DIGITS`` digits or more, or an ``@``) are
candidates. A seed's or candidate's site has two lexical patterns: the two words before it, and the word before with the
word after it (lower case, digits as 0, punctuation at the ends taken off; from the ``REACH`` characters on either side).

*Graph.* Patterns and values (by hash) make a bipartite graph of distinct edges, so that copies of a document count once.
Spark scores it in rounds. A pattern's support in a kind is the sum of its distinct values' scores in that kind; its
confidence is the support's share of support, seeds of other kinds, and ``DOUBT`` for what its candidates' scores leave
open. It speaks with a support of ``MIN_SUPPORT`` or more and from ``MIN_CONFIDENCE`` up. A seed's score is one in its own
kind; a candidate's, in a kind whose shape it has, is one minus the product of its patterns' doubts. Rounds go on until
no pattern begins or ceases to speak, ``ROUNDS`` at most: values found by a pattern support further patterns, which find
further values. *Finds.* A candidate whose score reaches ``MIN_SCORE`` in a kind is reported as ``ctx_<kind>``, at every
site where a speaking pattern holds it.

The texts are read once; only sites leave that pass, and all counting and scoring is done by Spark over the edges. A
pattern or value that a third of all sites share is summed before it is shuffled.

Defined results: null texts are empty; a null doc_id is kept; repeated rows are separate rows with equal results; values
that are a seed anywhere are never candidates; of equal scores the first kind is taken; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import removed
from .common import staged

#: The base kinds, then what their patterns find.
BASE = ("email", "ip", "card", "phone")
KINDS = BASE + tuple(f"ctx_{kind}" for kind in BASE)
MIN_DIGITS = 5
REACH = 96
MIN_SUPPORT = 3.0
MIN_CONFIDENCE = 0.8
MIN_SCORE = 0.8
ROUNDS = 6
#: What a candidate of unknown kind counts against its pattern; a seed of another kind counts 1.
DOUBT = 0.1

# The contract's patterns, written so that a scan takes time that grows with the text: emails are found from their "@",
# and number runs are entered at their beginning only.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_CLUE = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())

_SITES = "array<struct<v:long,kind:int,start:long,stop:long,p1:long,p2:long,fits:int>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    at = last = 0
    while found := _DOMAIN.search(text, at):
        low = max(last, at)
        start = low + len(text[low : found.start()].rstrip(_LOCAL))
        if start < found.start():
            yield start, found.end()
            last = at = found.end()
        else:
            at = found.start() + 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    small = lambda x: len(x := x.lstrip("0")) < 3 or len(x) == 3 and x <= "255"
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the words that look like identifiers and touch no base span."""
    busy = sorted((a, b) for _, a, b in taken)
    reach = [0]
    for _, b in busy:
        reach.append(max(reach[-1], b))
    at = 0
    while clue := _CLUE.search(text, at):
        # The word around the clue; what lies before ``at`` was looked at.
        begin = clue.start()
        while begin > at and not text[begin - 1].isspace():
            begin -= 1
        word = _WORD.match(text, begin)
        at = word.end()
        stripped = word[0].lstrip(_EDGE)
        start = at - len(stripped)
        end = start + len(stripped.rstrip(_EDGE))
        if "@" not in text[start:end] and len(_DIGIT.findall(text, start, end)) < MIN_DIGITS:
            continue
        k = bisect_right(busy, (end - 1, len(text)))  # base spans that begin before the word's end
        if reach[k] <= start:
            yield start, end


_NUMBER = re.compile(r"[0-9][0-9()/.-]*[0-9]")


def fits_of(word: str) -> int:
    """A bit for every kind whose shape a candidate has: an "@"; three dots or two colons; 12 to 19 or 6 to 15 digits."""
    digits = len(_DIGIT.findall(word)) if _NUMBER.fullmatch(word) else 0
    return ("@" in word) + 2 * (word.count(".") == 3 or word.count(":") >= 2) + 4 * (12 <= digits <= 19) + 8 * (6 <= digits <= 15)


def _plain(word: str) -> str:
    return _DIGIT.sub("0", word.strip(_EDGE).lower())


def patterns(text: str, start: int, end: int) -> tuple[str, str]:
    """The two words before, and the word before with the word after."""
    before = ["^", "^", *text[max(0, start - REACH) : start].split()]
    after = [*text[end : end + REACH].split(), "$"]
    near = _plain(before[-1])
    return f"{_plain(before[-2])} {near} _", f"{near} _ {_plain(after[0])}"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def sites_of(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """The base spans, and a site of each of them and of every candidate: value, kind or -1, start, end, two patterns, and
    the kinds that a candidate's shape fits."""
    text = text or ""
    if not _CLUE.search(text):
        return [], []
    spans = base_spans(text)
    every = [*spans, *((-1, a, b) for a, b in candidates(text, spans))]
    return spans, [(_hash(text[a:b].lower()), kind, a, b, *map(_hash, patterns(text, a, b)), 0 if kind >= 0 else fits_of(text[a:b])) for kind, a, b in every]


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, base (array of (kind, start, stop) by kind, then start) and sites. No text remains."""

    @F.pandas_udf(f"base array<struct<kind:int,start:long,stop:long>>, sites {_SITES}")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans, sites = sites_of(text)
            names = ("v", "kind", "start", "stop", "p1", "p2", "fits")
            rows.append(([dict(zip(names[1:4], x, strict=True)) for x in spans], [dict(zip(names, x, strict=True)) for x in sites]))
        return pd.DataFrame(rows, columns=["base", "sites"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", scan("text").alias("s")).select("row", "doc_id", "s.base", "s.sites")


def edges_of(sites: DataFrame) -> DataFrame:
    """p, v, kind (of a seed, else -1) and fits: the distinct edges of the graph."""
    each = sites.select("v", "kind", F.explode(F.array("p1", "p2")).alias("p"), "fits")
    seen = each.groupBy("p", "v", "kind").agg(F.max("fits").alias("fits"))
    seeds = seen.where("kind >= 0").select("v").distinct().withColumn("seed", F.lit(True))
    # A value that is a seed anywhere counts as that seed only.
    return seen.join(seeds, "v", "left").where("kind >= 0 or seed is null").select("p", "v", "kind", "fits")


def speaking_patterns(edges: DataFrame, scores: DataFrame | None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """p, kind and confidence of the patterns that speak. ``scores``: v, kind and score of candidates."""
    of = lambda test: F.count_distinct(F.when(test, F.col("v")))
    totals = edges.groupBy("p").agg(of(F.col("kind") >= 0).alias("n_seeds"), of(F.col("kind") < 0).alias("n_candidates"))
    lit_edges = edges.where("kind >= 0").select("p", "kind", F.lit(1e0).alias("score"), F.lit(1).alias("seed"))
    if scores is not None:
        lit_edges = lit_edges.unionByName(edges.where("kind < 0").drop("kind").join(scores, "v").select("p", "kind", "score", F.lit(0).alias("seed")))
    support = lit_edges.groupBy("p", "kind").agg(F.sum("score").alias("support"), F.sum("seed").alias("own")).where(F.col("support") > min_support - 1e-9)
    against = F.col("n_seeds") - F.col("own") + DOUBT * (F.col("n_candidates") - (F.col("support") - F.col("own")))
    confidence = F.col("support") / (F.col("support") + against)
    return support.join(totals, "p").select("p", "kind", confidence.alias("confidence")).where(F.col("confidence") > min_confidence - 1e-9)


def candidate_scores(edges: DataFrame, speaking: DataFrame) -> DataFrame:
    """v, kind and score of the candidates that a speaking pattern holds, in the kinds whose shape they have."""
    held = edges.where("kind < 0").drop("kind").join(speaking, "p").where(F.expr("(shiftright(fits, kind) & 1) = 1"))
    doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12)))))
    return held.groupBy("v", "kind").agg((1 - doubt).alias("score"))


def bootstrapped(edges: DataFrame, rounds: int = ROUNDS, **least: float) -> tuple[DataFrame, DataFrame]:
    """The speaking patterns and the candidates' scores when they have settled."""
    speaking = staged(speaking_patterns(edges, None, **least), "patterns")
    scores = staged(candidate_scores(edges, speaking), "scores")
    for _ in range(1, rounds):
        new_speaking = staged(speaking_patterns(edges, scores, **least), "patterns")
        had, has = speaking.select("p", "kind"), new_speaking.select("p", "kind")
        settled = had.exceptAll(has).isEmpty() and has.exceptAll(had).isEmpty()
        new_scores = staged(candidate_scores(edges, new_speaking), "scores")
        removed(speaking)
        removed(scores)
        speaking, scores = new_speaking, new_scores
        if settled:
            break
    return speaking, scores


def find(docs: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE, **least: float) -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, stop, score) by kind as in ``KINDS``, then start; base spans score 1."""
    rows = staged(scanned(docs.select("doc_id", "text")), "sites")
    sites = rows.select("row", F.explode("sites").alias("s")).select("row", "s.*")
    edges = staged(edges_of(sites), "edges")
    speaking, scores = bootstrapped(edges, rounds, **least)
    # Each value's best kind; of equal scores the first.
    best = scores.groupBy("v").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("kind")).alias("down"))).alias("b"))
    sure = best.where(F.col("b.score") >= min_score).select("v", (-F.col("b.down")).alias("found"), "b.score")
    held = edges.where("kind < 0").drop("kind").join(speaking.select("p", F.col("kind").alias("found")), "p").join(sure, ["v", "found"]).select("p", "v", "found", "score")
    near = sites.where("kind < 0").select("row", "v", "start", "stop", F.explode(F.array_distinct(F.array("p1", "p2"))).alias("p"))
    shape = F.struct((F.col("found") + len(BASE)).cast("int").alias("kind"), "start", "stop", "score")
    added = near.join(held, ["p", "v"]).groupBy("row").agg(F.array_sort(F.collect_set(shape)).alias("added"))
    base = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), F.lit(1e0).alias("score")))
    spans = F.concat(base, F.coalesce("added", F.array().cast(added.schema["added"].dataType)))
    return rows.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    names = F.array(*(F.lit(kind) for kind in KINDS))
    text_of = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: count(lambda x: x["kind"] == k)
    return found.select(
        "doc_id",
        *(of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)),
        F.sha2(text_of(F.filter("spans", lambda x: x["kind"] < len(BASE))), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
        count(lambda x: x["kind"] >= len(BASE)).alias("n_found"),
    )


def query(documents: DataFrame) -> DataFrame:
    return digest(find(documents))
