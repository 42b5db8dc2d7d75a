"""Vectors of an index through an affine projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import TILE, same_dimension

#: The most that a projection may weigh. It belongs to a model and does not grow with the index.
MOST_BYTES = 512 << 20


def projected(index: DataFrame, weight: np.ndarray, bias: np.ndarray) -> DataFrame:
    """The index with ``embedding`` turned to ``weight @ embedding + bias``, made a unit vector (norms of 1e-12 at least); all
    other columns stay. The projection goes to each executor once, and a task multiplies ``TILE`` rows at a time. Vectors of
    another dimension, or values that are not finite, are errors."""
    weight, bias = np.asarray(weight, np.float64), np.asarray(bias, np.float64)
    if weight.ndim != 2 or bias.shape != (len(weight),) or not (np.isfinite(weight).all() and np.isfinite(bias).all()):
        raise ValueError("a projection is a finite matrix and a finite bias with an entry for each of its rows")
    if weight.nbytes > MOST_BYTES:
        raise ValueError(f"a projection of over {MOST_BYTES} bytes")
    if (found := same_dimension(index)) not in (None, weight.shape[1]):
        raise ValueError(f"vectors of {found} dimensions, a projection of {weight.shape[1]}")
    held = index.sparkSession.sparkContext.broadcast((weight, bias))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b = held.value
        for pdf in parts:
            for i in range(0, len(pdf), TILE):
                rows = pdf.iloc[i : i + TILE]
                out = np.array(rows["embedding"].tolist(), np.float64) @ w.T + b
                yield rows.assign(embedding=list(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)))

    whole = index.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    return whole.mapInPandas(work, whole.schema)
