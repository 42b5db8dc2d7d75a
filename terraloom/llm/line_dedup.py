"""Removal of lines that many documents share.

A line's key is the line without white space at its ends and with A-Z in lower case. The keys of at least
``min_chars`` code points go, as two 64-bit hashes with document and position, through one range partitioning by
(hash, document from the last one down), sorted within each partition by hash, document and position; a key that fills
many partitions is dealt out over them by its documents. A window runs along these sorted rows as they are (it asks for
no other exchange and no other sort) and marks the first occurrence of every key in every document; as the largest
document comes first, a key's very first occurrence is in the document that keeps it. A small second step joins what the
partitions saw of a key: the number of first occurrences, which is the number of its documents, and the leading one.

The result is, per document, a compressed keep bitmap (the runs of kept lines, as start and length), not text;
``apply_bitmaps`` cuts the texts by it.

Only DataFrame functions are used. Defined results: null and empty texts are one empty line; a document is a
doc_id (rows that repeat a doc_id count once, and each loses or keeps its lines by that id); a null doc_id is a document
that sorts before all others; a key in the kept document keeps all its lines there; extra columns pass through
``apply_bitmaps``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, let, shuffle_width, staged

MIN_CHARS = 40
MIN_DOCS = 5
_KEY = ("h1", "h2")
#: Documents from the largest doc_id down, a null one last: ascending in these two columns.
_DOWN = ("unnamed", "down")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def n_lines(text: Column) -> Column:
    filled = F.coalesce(text, F.lit(""))
    return (F.char_length(filled) - F.char_length(F.replace(filled, F.lit("\n"), F.lit(""))) + 1).cast("long")


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, doc_id, t, n_lines (of the text), pos of every line whose key is long enough."""
    # What belongs to the text is computed before its lines are dealt out, once a text.
    whole = docs.select("doc_id", text_key(F.col("text")).alias("t"), lines_of(F.col("text")).alias("lines")).withColumn("n_lines", F.size("lines"))
    lines = whole.select("doc_id", "t", "n_lines", F.posexplode("lines").alias("pos", "line"))
    keys = lines.where(F.octet_length("line") >= min_chars).withColumn("key", F.btrim("line", F.lit(WHITE))).where(F.char_length("key") >= min_chars)
    keys = keys.withColumn("key", ascii_lower(F.col("key")))
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"), "doc_id", "t", "n_lines", "pos")


def first_occurrences(lines: DataFrame) -> DataFrame:
    """``lines`` with ``first``: whether the row is the first of its key in its document, read off the sorted partitions."""
    down = lines.withColumns({"unnamed": F.col("doc_id").isNull(), "down": F.bitwise_not("doc_id")})
    ranged = down.repartitionByRange(shuffle_width(lines.sparkSession), *_KEY, *_DOWN)
    run = Window.partitionBy(*_KEY, *_DOWN).orderBy("pos", "t")
    return ranged.withColumn("first", F.lag("pos").over(run).isNull())


def shared_keys(marked: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, keeper of the keys of ``min_docs`` documents or more. Each partition brings one row per key."""
    lead = F.min(F.when(F.col("first"), F.struct(*_DOWN))).alias("lead")
    seen = marked.groupBy(*_KEY).agg(F.count_if("first").alias("n_docs"), lead).where(F.col("n_docs") >= min_docs)
    return seen.select(*_KEY, F.bitwise_not("lead.down").alias("keeper"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, t (the text's key), n_dropped and keep_runs (array of start and length). A document without a row keeps all."""
    marked = staged(first_occurrences(staged(line_hashes(docs, min_chars), "lines")), "sorted-lines")
    # Written out, it lies across no key's partitioning: both sides of the join are dealt anew, and hot keys can be split.
    shared = staged(shared_keys(marked, min_docs), "shared")
    lost = marked.join(shared, list(_KEY)).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    per_doc = lost.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set(F.col("pos").cast("long"))).alias("p"), F.max("n_lines").alias("n"))

    def kept_runs(p: Column, n: Column) -> Column:
        starts, ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(p, lambda x: x + 1)), F.concat(p, F.array(n.cast("long")))
        return F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length"))), lambda r: r["length"] > 0)

    return per_doc.select("doc_id", "t", F.size("p").cast("long").alias("n_dropped"), kept_runs(F.col("p"), F.col("n")).alias("keep_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the kept lines as text, and n_lines_before and n_dropped_lines."""
    marks = bitmaps.select(F.col("doc_id").alias("__line_id"), F.col("t").alias("__line_t"), F.col("n_dropped").alias("__line_n"), F.col("keep_runs").alias("__line_runs"))
    joined = docs.join(marks, F.col("doc_id").eqNullSafe(F.col("__line_id")) & (text_key(F.col("text")) == F.col("__line_t")), "left")
    kept = let(lines_of(F.col("text")), lambda ls: F.array_join(F.flatten(F.transform("__line_runs", lambda r: F.slice(ls, (r["start"] + 1).cast("int"), r["length"].cast("int")))), "\n"))
    return joined.withColumns(
        {
            "n_lines_before": n_lines(F.col("text")),
            "n_dropped_lines": F.coalesce("__line_n", F.lit(0)).cast("long"),
            "text": F.when(F.col("__line_n").isNull(), F.col("text")).otherwise(kept),
        }
    ).drop("__line_id", "__line_t", "__line_n", "__line_runs")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))


def query(documents: DataFrame) -> DataFrame:
    done = dedup_lines(documents.select("doc_id", "text"))
    return done.select("doc_id", F.col("n_lines_before").alias("n_lines"), F.col("n_dropped_lines").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
