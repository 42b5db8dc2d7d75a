"""Tracks of a sequence's positions. Frames are dealt by sequence and sorted by time within the partitions; a task walks
through them and holds only the open tracks' last positions, so that a sequence of any length streams through."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.greedy import _km


def tracks(frames: DataFrame, base_m: float = 5000.0) -> DataFrame:
    """frames (sequence, frame, ts, lat, lon, radius_m) with ``track``: the first of the sequence's tracks, in order of their
    creation, whose last position lies within max(100, base) plus half of both radii; a new one if there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence, last = None, []
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.sequence != sequence:
                    sequence, last = r.sequence, []
                gate = lambda t: max(100.0, base_m) + 0.5 * (max(0.0, t[2]) + max(0.0, r.radius_m))  # noqa: B023, E731
                k = next((k for k, t in enumerate(last) if 1000 * _km(t, (r.lat, r.lon)) <= gate(t)), len(last))
                last[k : k + 1] = [(r.lat, r.lon, r.radius_m)]
                out.append((r.sequence, r.frame, k))
            yield pd.DataFrame(out, columns=["sequence", "frame", "track"])

    dealt = frames.repartition("sequence").sortWithinPartitions("sequence", "ts", "frame")
    return dealt.select("sequence", "frame", "lat", "lon", "radius_m").mapInPandas(run, "sequence long, frame long, track int")
