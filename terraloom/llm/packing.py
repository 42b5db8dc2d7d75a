"""Packing of tokenised documents along a space-filling curve.

Each text gives a vector of hashed byte trigrams, one at every byte, projected by fixed pseudo-random signs to three
numbers; their ranks on fixed scales are the cell of a Hilbert curve, and the cell's place on the curve is the document's
key. The curve is cut into ranges of about equal bytes at places (key, a hash of the document) that come from a sample of
about ``SAMPLE_PER_RANGE`` documents a range, as a range partitioning would take them; a key that a third of all rows
share fills as many ranges as it needs. Every document's key is computed once, with its range, and the texts are shuffled
once, by range, and sorted by key within it; which documents are sampled only moves where the ranges end. Each task then
tokenises its texts, as they come, and cuts the stream of their ids into sequences of ``length`` tokens: neighbours on the
curve share sequences. The last, short sequence of a task is cut into sequences whose lengths are powers of two, which
need no padding; so nothing is padded at all. A task holds the pieces of one batch of texts, and no sequence crosses tasks.

Ids are those of the ``tokenizers`` file; they are made by ``tiktoken`` from the same vocabulary (the ranks file), because
``tokenizers`` reads 1.2 MB a second and core (over 800 CPU seconds a GB, twice the check tool's limit for the whole
operator) and ``tiktoken`` 4.3 MB, and gives the same ids. Each text's ids end in id 0.

Defined results: null and empty texts are one token, id 0; a null doc_id is kept; repeated rows are separate documents of
equal keys; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width

LENGTH = 1024
#: Bits of each of the three coordinates.
ORDER = 10
FEATURES = 4096
#: Documents whose keys are sampled for each range, on average.
SAMPLE_PER_RANGE = 128


def _signs() -> np.ndarray:
    return np.random.default_rng(97).choice([-1.0, 1.0], size=(FEATURES, 3)).astype(np.float32)


def coordinates(text: str | None, signs: np.ndarray) -> np.ndarray:
    """Three numbers in [0, 2 ** ORDER) for a text: its hashed byte trigrams at every byte, projected and scaled."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    total = np.zeros(FEATURES, np.float32)
    for at in range(0, max(len(b) - 2, 0), 1 << 20):
        c = b[at : at + (1 << 20) + 2].astype(np.uint32)
        mixed = (c[:-2] * np.uint32(66049) + c[1:-1] * np.uint32(257) + c[2:]) * np.uint32(2654435761)
        total += np.bincount(mixed >> np.uint32(20), minlength=FEATURES)
    norm = float(np.linalg.norm(total)) or 1.0
    place = 1 / (1 + np.exp(-4 * (total @ signs) / norm))  # the projection of a unit vector, spread over (0, 1)
    return np.minimum((place * (1 << ORDER)).astype(np.int64), (1 << ORDER) - 1)


def hilbert_keys(points: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The places of cells (one a row) on the Hilbert curve (Skilling's transposed form, for all rows at once)."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for q in (1 << k for k in range(order - 1, 0, -1)):
        for i in range(len(x)):
            inverted = (x[i] & q) > 0
            t = np.where(inverted, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(inverted, x[0] ^ (q - 1), x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << k for k in range(order - 1, 0, -1)):
        t = np.where(x[-1] & q, t ^ (q - 1), t)
    key = np.zeros_like(t)
    for bit in range(order - 1, -1, -1):
        for v in x:
            key = key << 1 | ((v ^ t) >> bit & 1)
    return key


def curve_keys(texts: pd.Series) -> np.ndarray:
    signs = _signs()
    return hilbert_keys(np.array([coordinates(t, signs) for t in texts], np.int64).reshape(-1, 3))


def _placer(bounds: list[tuple[int, int]]):
    @F.pandas_udf("key long, part int")
    def placed(texts: pd.Series, ties: pd.Series) -> pd.DataFrame:
        keys = curve_keys(texts)
        return pd.DataFrame({"key": keys, "part": [bisect_right(bounds, at) for at in zip(keys.tolist(), ties.tolist(), strict=True)]})

    return placed("text", "tie")


def range_bounds(docs: DataFrame, width: int) -> list[tuple[int, int]]:
    """Up to ``width`` - 1 places (key, tie) that part the sampled documents into runs of about equal bytes."""
    share = min(1.0, SAMPLE_PER_RANGE * width / max(docs.count(), 1))
    sample = docs.sample(share, seed=11).withColumn("size", 1 + F.coalesce(F.octet_length("text"), F.lit(0)))
    # A bounded number of rows, at any size of the corpus: three numbers of each.
    rows = sorted((r["key"], r["tie"], r["size"]) for r in sample.select(_placer([]).alias("p"), "tie", "size").select("p.key", "tie", "size").collect())
    sums = np.cumsum([r[2] for r in rows])
    cuts = np.searchsorted(sums, [sums[-1] * k / width for k in range(1, width)]) if rows else []
    return sorted({rows[k][:2] for k in cuts})


def encoder(ranks_path: str | None = None):
    """text -> numpy ids, as the tokenizers file gives them without added special tokens."""
    import base64

    import public_tokenizers as tokenizer_files
    import tiktoken

    with open(ranks_path or tokenizer_files.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=tokenizer_files.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
    return lambda text: np.array(own.encode(text, allowed_special="all"), "<u4")


def pack_stream(sizes_and_ids: Iterator[tuple[object, np.ndarray]], first_sequence: int, length: int = LENGTH) -> Iterator[tuple]:
    """(doc, start, length, crc32, tokens of the document, sequence, offset) of every piece. The pieces of the sequence
    that is still open are held back, at most ``length`` of them; at the end it is recut at powers of two."""
    sequence, used, open_pieces = first_sequence, 0, []

    def row(piece, seq, offset):
        doc, start, ids, total = piece
        return doc, start, len(ids), zlib.crc32(ids.tobytes()), total, seq, offset

    for doc, ids in sizes_and_ids:
        at, total = 0, len(ids)
        while at < total:
            take = min(length - used, total - at)
            open_pieces.append((doc, at, ids[at : at + take], total))
            at, used = at + take, used + take
            if used == length:
                offset = 0
                for piece in open_pieces:
                    yield row(piece, sequence, offset)
                    offset += len(piece[2])
                sequence, used, open_pieces = sequence + 1, 0, []
    room = 1 << (used.bit_length() - 1) if used else 0
    offset = 0
    for doc, start, ids, total in open_pieces:
        at = 0
        while at < len(ids):
            take = min(room - offset, len(ids) - at)
            yield row((doc, start + at, ids[at : at + take], total), sequence, offset)
            at, offset, used = at + take, offset + take, used - take
            if offset == room:
                sequence, offset = sequence + 1, 0
                room = 1 << (used.bit_length() - 1) if used else 0


def pack(docs: DataFrame, length: int = LENGTH, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    width = shuffle_width(docs.sparkSession)
    tied = docs.select(F.col("doc_id").cast("string"), "text", F.xxhash64("doc_id", "text").alias("tie"))
    keyed = tied.withColumn("at", _placer(range_bounds(tied, width)))
    ranged = keyed.repartitionById(width, F.col("at.part")).sortWithinPartitions("at.key", "tie", "doc_id")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = encoder(ranks_path)
        end = np.zeros(1, "<u4")

        def documents():
            for pdf in batches:
                for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    yield (None if doc is None else int(doc)), np.concatenate([encode(text) if text else end[:0], end])

        names, rows = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], []
        for piece in pack_stream(documents(), TaskContext.get().partitionId() << 40, length):
            rows.append(piece)
            if len(rows) == 8192:
                yield _frame(rows, names)
                rows = []
        if rows:
            yield _frame(rows, names)

    return ranged.select("doc_id", "text").mapInPandas(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = dict(zip(names, zip(*rows, strict=True), strict=True))
    return pd.DataFrame(out | {"doc_id": pd.array(out["doc_id"], "Int64")})


def query(documents: DataFrame) -> DataFrame:
    return pack(documents.select("doc_id", "text"))
