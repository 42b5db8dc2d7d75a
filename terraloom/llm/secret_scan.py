"""Secrets in texts, told apart by who holds them.

Every text is searched for the base kinds and for further candidate kinds. The candidates' values are hashed and counted
over the whole corpus by distinct repositories and owners, first per (hash, owner, repository), so that a value that a
third of the corpus repeats is summed before it is shuffled by hash. A value of many owners, or found in many repositories
whoever owns them, is a copied example; another whose characters look random is an owner's live-looking credential. Base spans are always reported; a span of a
further kind only if its value is live-looking and owner-specific.

Only DataFrame functions are used: matches come from ``regexp_extract_all``, their places from the lengths of what
``split`` leaves between them. Defined results: a null text is empty; a null owner or repository is an owner or
repository of its own; a null doc_id is kept; repeated rows are separate rows with equal results; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix_sums, staged

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind -> pattern, group of the value, and least characters of the value. The first three are the base kinds.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (_ASSIGN, 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "prefixed": (r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})", 0, 16),
    "bearer": (r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0, 27),
}
BASE = ("assign", "access", "hex")
#: A cheap test that holds for every text with a match of at least the stated length.
GATES = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: These take whole runs, so that asking for the least length in the pattern finds the same spans.
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
MAX_OWNERS = 2
MAX_REPOSITORIES = 20
_PLACEHOLDER = r"(?i)example|changeme|placeholder|x{6}|1234567|abcdefg"


def found(text: Column, kind: str) -> Column:
    """An array of struct(start, end, value) in code points, end exclusive."""
    pattern, group, least = KINDS[kind]
    pattern = LONG.get(kind, pattern)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def placed(m: Column, v: Column, gaps: Column) -> Column:
        ends = prefix_sums(F.transform(m, lambda x, i: F.char_length(x) + F.char_length(F.get(gaps, i))))
        return let(ends, lambda e: F.filter(F.transform(m, lambda x, i: F.struct((F.get(e, i) - F.char_length(x)).alias("start"), F.get(e, i).alias("end"), F.get(v, i).alias("value"))), lambda s: F.char_length(s["value"]) >= least))

    spans = let(whole, lambda m: let(value, lambda v: let(F.split(text, pattern, -1), lambda g: placed(m, v, g))))
    return F.when(text.rlike(GATES.get(kind, pattern)), spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """One row per document: row, doc_id, owner, repository, and c, its candidates by start and kind. No text remains."""
    text = F.coalesce(F.col("text"), F.lit(""))
    live = lambda v: (F.size(F.array_distinct(F.split(v, ""))) >= 8) & ~v.rlike(_PLACEHOLDER) & v.rlike("[0-9]")

    def of_kind(k: int, kind: str) -> Column:
        return F.transform(found(text, kind), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("v"), F.xxhash64(s["value"], F.lit(1)).alias("v2"), live(s["value"]).alias("live")))

    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.array_sort(F.concat(*(of_kind(k, kind) for k, kind in enumerate(KINDS)))).alias("c")
    )


def ownership(cands: DataFrame) -> DataFrame:
    """v, v2, n_owners, n_repositories of every candidate value of the corpus."""
    each = cands.select("owner", "repository", F.explode("c").alias("x")).select("x.v", "x.v2", "owner", "repository")
    by_repository = each.groupBy("v", "v2", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("v", "v2", "owner").agg(F.count("*").alias("n_repositories"))
    return by_owner.groupBy("v", "v2").agg(F.count("*").alias("n_owners"), F.sum("n_repositories").alias("n_repositories"))


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Every document with ``spans``, an array of (kind, start, end, n_owners, n_repositories, verdict)."""
    cands = staged(candidates(docs, owner, repository), "secrets")
    each = cands.select("row", F.explode("c").alias("x")).select("row", "x.*")
    verdict = F.when((F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories), F.lit("copied")).when(F.col("live"), F.lit("owner_specific")).otherwise(F.lit("plain"))
    judged = each.join(ownership(cands), ["v", "v2"]).withColumn("verdict", verdict).where((F.col("kind") < len(BASE)) | (F.col("verdict") == "owner_specific"))
    names = F.array(*(F.lit(k) for k in KINDS))
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repositories", "verdict"))).alias("s"))
    named = F.transform(F.coalesce("s", F.array().cast(spans.schema["s"].dataType)), lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["n_owners"].alias("n_owners"), x["n_repositories"].alias("n_repositories"), x["verdict"].alias("verdict")))
    return cands.select("row", "doc_id").join(spans, "row", "left").select("doc_id", named.alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    text_of = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda kind: count(lambda x: x["kind"] == kind)
    return scanned.select(
        "doc_id",
        *(of_kind(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(text_of(F.filter("spans", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
        count(lambda x: x["verdict"] == "owner_specific").alias("n_owner_specific"),
        count(lambda x: x["verdict"] == "copied").alias("n_copied"),
    )


def query(documents: DataFrame) -> DataFrame:
    return digest(scan_secrets(documents))
