"""Alignment of two tokenizers over a corpus, counted by spilled runs.

*Links.* A document's text, with a space before it, is cut by tokenizer A (byte-level BPE) and by tokenizer B (pieces with
byte fallback). Byte offsets where tokens of both end cut the tokens into groups, and every A-B pair of occurrences within
a group is a link. The documents of a block are tokenised one by one and laid end to end; groups and links are then worked out for
all of them at once. A group of very many tokens is counted by its distinct ids, not pair by pair.

*Runs.* A block of documents gives, for every radix bucket of the A ids, one run: the distinct (A, B, document) records
with their numbers of links, sorted by A, B and document, as a zstd frame. The runs of all blocks are written to the shared
folder. They are dealt by (bucket, deal): a bucket is dealt over so many tasks that each holds about ``TASK_BYTES`` of
frames, so that an A id in a third of all documents fills many tasks.

*Counting.* A task merges its runs by a heap of their A ids and counts, A by A, how many documents hold each B; Spark sums
these counts over the deals and takes each A id's highest. *Contributions.* In a second pass a task first reads its bucket's
counts, in A-major order with the marks of the highest, then streams its runs past them, one in memory at a time, and sends
each document's sums back to be added up.

Defined results: texts that are null or empty, or whose tokens of either side do not spell the text, have no tokens, and
zeros; a null doc_id is kept; repeated rows are separate documents; very long texts fill a block of their own; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Buckets by the low bits of the A id.
RADIX = 16
#: Bytes of zstd frames that a task merges, on average.
TASK_BYTES = 16 << 20
#: A block ends at 2 ** _DOC_BITS documents or so many A tokens.
BLOCK_TOKENS = 1 << 19
#: Groups with more links than this are counted by their distinct ids.
WIDE = 1024

#: Bits of a B id (and of an A id) in a pair, and of a document's place in its block.
_B_BITS, _DOC_BITS = 16, 12

_DOCS = "block long, idx int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_MAPPED = pa.schema([("block", pa.int64()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("bucket", pa.int32()), ("run", pa.binary())])


def byte_tables(ranks_path: str | None = None, model_path: str | None = None) -> tuple[Callable, Callable, list[bytes], list[bytes]]:
    """A's encoder of a text and B's of a list of texts, and the bytes of their tokens."""
    import public_tokenizers as files
    import sentencepiece
    import tiktoken

    with open(ranks_path or files.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(x): int(n) for x, n in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    a_bytes = [b""] * (max(ranks.values()) + 1)
    for x, n in ranks.items():
        a_bytes[n] = x
    pieces = sentencepiece.SentencePieceProcessor(model_file=model_path or files.path("piece_bpe_32k.model"))
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    b_bytes = [bytes([int(x[3:5], 16)]) if pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
    return own.encode_ordinary, lambda texts: pieces.encode(texts, num_threads=1), a_bytes, b_bytes


def _digit_table(n: int) -> np.ndarray:
    """The decimal digits of 0 to n - 1, a row each, with zero bytes for leading zeros."""
    powers = 10 ** np.arange(len(str(n - 1)) - 1, -1, -1)
    at = np.arange(n)[:, None]
    return np.where((at >= powers) | (powers == 1), at // powers % 10 + 48, 0).astype(np.uint8)


class Aligner:
    """Blocks of documents to their groups and links, for all documents of a block at once."""

    def __init__(self, ranks_path: str | None = None, model_path: str | None = None):
        self.encode_a, self.encode_b, self.a_bytes, self.b_bytes = byte_tables(ranks_path, model_path)
        self.a_size, self.b_size = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        self.digits = _digit_table(max(len(self.a_bytes), len(self.b_bytes)))

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both sides' ids of every text; none where a side's tokens do not spell the text."""
        out = []
        for text, b in zip(texts, self.encode_b([x or "" for x in texts]), strict=True):
            a = self.encode_a(" " + text) if text else []
            want = (" " + text).encode("utf-8", "surrogatepass") if text else b""
            good = b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if good else (np.empty(0, np.int64),) * 2)
        return out

    def block(self, tokens: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, groups_sha256) of every document; then the sorted keys (bucket, pair, document) of
        the block's links and how often each is linked. Documents end tokens of both sides, so that all of them can be
        laid end to end."""
        n_a, n_b = (np.array([len(x[side]) for x in tokens], np.int64) for side in (0, 1))
        a, b = (np.concatenate([x[side] for x in tokens]) for side in (0, 1))
        if not len(a):
            return [(0, 0, 0, 0, "")] * len(tokens), np.empty(0, np.int64), np.empty(0, np.int64)
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        cut_a, cut_b = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a, ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        doc_of_a = np.repeat(np.arange(len(tokens)), n_a)
        doc_of_group = doc_of_a[first_a]
        n_groups = np.bincount(doc_of_group, minlength=len(tokens))
        n_links = np.zeros(len(tokens), np.int64)
        np.add.at(n_links, doc_of_group, size_a * size_b)
        keys, times = self._links(a, b, doc_of_a, group_a, size_a, size_b, first_a, first_b)
        # The groups as text: every token is a separator and its digits, those of A before those of B in each group.
        text = np.zeros((len(a) + len(b), 1 + self.digits.shape[1]), np.uint8)
        at_a, at_b = np.arange(len(a)) + first_b[group_a], np.arange(len(b)) + (first_a + size_a)[group_b]
        text[:, 0] = ord(",")
        text[at_a[first_a], 0], text[at_b[first_b], 0] = ord(";"), ord("|")
        text[at_a, 1:], text[at_b, 1:] = self.digits[a], self.digits[b]
        stops = np.cumsum(n_a + n_b)
        rows = []
        for k, stop in enumerate(stops.tolist()):
            cells = text[stop - int(n_a[k] + n_b[k]) : stop].ravel()
            digest = hashlib.sha256(cells[cells != 0][1:].tobytes()).hexdigest() if len(cells) else ""
            rows.append((int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), digest))
        return rows, keys, times

    @staticmethod
    def _links(a, b, doc_of_a, group_a, size_a, size_b, first_a, first_b) -> tuple[np.ndarray, np.ndarray]:
        wide = size_a * size_b > WIDE
        mine = ~wide[group_a]
        reps = np.where(mine, size_b[group_a], 0)
        within = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        pair = np.repeat(a << _B_BITS, reps) | b[np.repeat(first_b[group_a], reps) + within]
        keys, times = np.unique(_keys(pair, np.repeat(doc_of_a, reps)), return_counts=True)
        if not wide.any():
            return keys, times
        every, often = [keys], [times]
        for g in np.flatnonzero(wide).tolist():  # distinct ids against distinct ids, with the products of their numbers
            ids_a, many_a = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
            ids_b, many_b = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
            every.append(_keys((ids_a[:, None] << _B_BITS | ids_b).ravel(), doc_of_a[first_a[g]]))
            often.append(np.outer(many_a, many_b).ravel())
        keys, at = np.unique(np.concatenate(every), return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, at, np.concatenate(often))
        return keys, times


def _keys(pair: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Numbers that sort by bucket, pair and document."""
    return (pair >> _B_BITS) % RADIX << (2 * _B_BITS + _DOC_BITS) | pair << _DOC_BITS | doc


def packed_run(pairs: np.ndarray, idx: np.ndarray, links: np.ndarray) -> bytes:
    """A run's records, sorted by pair and document: steps of the pair, documents, links."""
    import zstandard

    head = np.array([len(pairs)], "<i8").tobytes()
    body = np.diff(pairs, prepend=0).astype("<u4").tobytes() + idx.astype("<u2").tobytes() + links.astype("<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def unpacked_run(frame: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(frame)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    steps = np.frombuffer(raw, "<u4", n, 8)
    return np.cumsum(steps, dtype=np.int64), np.frombuffer(raw, "<u2", n, 8 + 4 * n).astype(np.int64), np.frombuffer(raw, "<i8", n, 8 + 6 * n)


def runs_of(keys: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, run) of a block, from its sorted keys."""
    bucket = keys >> (2 * _B_BITS + _DOC_BITS)
    pair, doc = keys >> _DOC_BITS & ((1 << 2 * _B_BITS) - 1), keys & ((1 << _DOC_BITS) - 1)
    cuts = np.searchsorted(bucket, np.arange(RADIX + 1)).tolist()
    for r, (a, b) in enumerate(itertools.pairwise(cuts)):
        if a < b:
            yield r, packed_run(pair[a:b], doc[a:b], times[a:b])


def mapped(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """Rows of two kinds: documents (bucket null) with their place (block, idx), and runs (block, bucket, run)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, block = Aligner(ranks_path, model_path), TaskContext.get().partitionId() << 32
        ids, tokens, size = [], [], 0

        def flush() -> pa.RecordBatch:
            rows, keys, times = aligner.block(tokens)
            out = [{"block": block, "idx": k, "doc_id": d, "n_a": n[0], "n_b": n[1], "n_groups": n[2], "n_links": n[3], "groups_sha256": n[4]} for k, (d, n) in enumerate(zip(ids, rows, strict=True))]
            out += [{"block": block, "bucket": r, "run": run} for r, run in runs_of(keys, times)]
            return pa.RecordBatch.from_pylist(out, _MAPPED)

        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.slice(at, 64)
                for doc, found in zip(some.column("doc_id").to_pylist(), aligner.tokens(some.column("text").to_pylist()), strict=True):
                    ids.append(doc)
                    tokens.append(found)
                    size += len(found[0])
                    if len(ids) >= 1 << _DOC_BITS or size >= BLOCK_TOKENS:
                        yield flush()
                        block, ids, tokens, size = block + 1, [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, f"{_DOCS}, bucket int, run binary")


def merged_counts(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, how many documents) of one A id after the other, by a k-way heap merge of the runs."""

    def by_a(run: bytes) -> Iterator[tuple[int, np.ndarray]]:
        pairs = unpacked_run(run)[0]
        heads = pairs >> _B_BITS
        cuts = np.flatnonzero(np.diff(heads, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pairs)], strict=True):
            yield int(heads[a]), pairs[a:b]

    for _, parts in itertools.groupby(heapq.merge(*map(by_a, runs), key=itemgetter(0)), key=itemgetter(0)):
        yield np.unique(np.concatenate([pairs for _, pairs in parts]), return_counts=True)


def dealt(runs: DataFrame, deals: int) -> DataFrame:
    return runs.select((F.col("bucket") * deals + F.pmod(F.xxhash64("block"), F.lit(deals))).cast("int").alias("part"), "block", "run")


def pair_counts(runs: DataFrame, deals: int) -> DataFrame:
    """pair, bucket, n (documents that hold it linked) and best (the highest of its A id, ties included)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [run for batch in batches for run in batch.column("run").to_pylist()]
        for several in itertools.batched(merged_counts(held), 512):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*several, strict=True)], names=["pair", "n"])

    seen = dealt(runs, deals).repartitionById(RADIX * deals, "part").select("run").mapInArrow(count, "pair long, n long")
    summed = seen.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", _B_BITS))
    # At most as many rows in a window as B has ids.
    best = F.col("n") == F.max("n").over(Window.partitionBy("a"))
    return summed.select("pair", F.pmod("a", F.lit(RADIX)).cast("int").alias("bucket"), "n", best.alias("best"))


def contributions(runs: DataFrame, counts: DataFrame, deals: int) -> DataFrame:
    """block, idx, n_best and count_sum of every document with links, added up over the buckets."""
    every = F.explode(F.sequence(F.col("bucket") * deals, F.col("bucket") * deals + (deals - 1)))
    first = counts.withColumn("part", every).select(F.col("part").cast("int"), F.lit(-1).cast("long").alias("block"), "pair", "n", "best")
    both = first.unionByName(dealt(runs, deals), allowMissingColumns=True)
    # A bucket's counts come first, sorted by pair; its runs follow.
    sent = both.repartitionById(RADIX * deals, "part").sortWithinPartitions("block", "pair")

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs, times, best = [], None, None, None
        for batch in batches:
            is_count = np.asarray(batch.column("block")) < 0
            if is_count.any():
                rows = batch.filter(pa.array(is_count))
                known.append((np.asarray(rows.column("pair")), np.asarray(rows.column("n")), rows.column("best").to_numpy(zero_copy_only=False)))
            if is_count.all():
                continue
            if pairs is None:
                pairs, times, best = map(np.concatenate, zip(*known, strict=True))
            rest = batch.filter(pa.array(~is_count))
            for block, frame in zip(rest.column("block").to_pylist(), rest.column("run"), strict=True):
                pair, idx, links = unpacked_run(frame.as_py())
                at = np.searchsorted(pairs, pair)
                sums, wins = np.zeros(idx.max() + 1, np.int64), np.zeros(idx.max() + 1, np.int64)
                np.add.at(sums, idx, links * times[at])
                np.add.at(wins, idx, links * best[at])
                docs = np.unique(idx)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), block)), pa.array(docs.astype(np.int32)), pa.array(wins[docs]), pa.array(sums[docs])], names=["block", "idx", "n_best", "count_sum"])

    sums = sent.drop("part").mapInArrow(contribute, "block long, idx int, n_best long, count_sum long")
    return sums.groupBy("block", "idx").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _deals(runs: DataFrame, task_bytes: int) -> int:
    size = runs.groupBy("bucket").agg(F.sum(F.octet_length("run")).alias("n")).agg(F.max("n")).first()[0] or 0
    return max(1, -(-size // task_bytes))


def align(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The documents' rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the corpus-wide
    table of pairs: a, b, n and best."""
    table = staged(mapped(docs, ranks_path, model_path), "aligned")
    runs, rows = table.where(F.col("bucket").isNotNull()).select("block", "bucket", "run"), table.where(F.col("bucket").isNull())
    deals = _deals(runs, task_bytes)
    counts = staged(pair_counts(runs, deals), "pair-counts")
    sums = contributions(runs, counts, deals)
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    numbers = rows.join(sums, ["block", "idx"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    pairs = counts.select(F.shiftright("pair", _B_BITS).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)).alias("b"), "n", "best")
    return numbers, pairs


def query(documents: DataFrame) -> DataFrame:
    return align(documents)[0]
