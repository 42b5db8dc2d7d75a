"""Frames of videos: every so many seconds one is taken, and its candidates are fused; by a batch job or by a stream.

A frame is a row of video, frame (its number from 0), fps and candidates, an array of (item_id, lat, lon, score, match_id). A
frame depends on no other, so that frames may come in any order and late. A frame that comes twice is one in a batch job; in a stream, one of each micro-batch that
holds it, with equal rows. Decoding is not part of this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import fusion

#: Frames a second of a video that does not tell.
FPS = 30.0


def is_taken(interval_s: float, max_frames: int) -> Column:
    """Whether a frame is one of the first ``max_frames`` that are taken, one every ``interval_s`` seconds or every frame."""
    step = F.greatest(F.lit(1), F.floor(_fps() * interval_s))
    return F.coalesce((F.col("frame") >= 0) & (F.col("frame") % step == 0) & (F.col("frame") < max_frames * step), F.lit(False))


def _fps() -> Column:
    return F.when(F.col("fps") > 0, F.col("fps")).otherwise(F.lit(FPS))


def video_run(frames: DataFrame, interval_s: float, max_frames: int, knobs: fusion.Knobs = fusion.Knobs()) -> DataFrame:
    """One row per frame that is taken: its time in the video, and the fusion of its candidates, null without any."""
    taken = frames.where(is_taken(interval_s, max_frames) & F.col("video").isNotNull()).dropDuplicates(["video", "frame"])
    taken = taken.withColumn("timestamp_s", F.col("frame") / _fps())
    c = taken.select(F.struct("video", "frame").alias("query_id"), F.inline("candidates"))
    fused = fusion.fuse(c, knobs)
    out = [x for x in fused.columns if x != "query_id"]
    fused = fused.select(F.col("query_id.video").alias("video"), F.col("query_id.frame").alias("frame"), *out)
    return taken.select("video", "frame", "timestamp_s").join(fused, ["video", "frame"], "left")


def video_stream(frames: DataFrame, path: str, checkpoint: str, interval_s: float, max_frames: int, knobs: fusion.Knobs = fusion.Knobs()) -> StreamingQuery:
    """The same from a stream of frames, started: each micro-batch is fused as a table and overwrites its own folder
    ``batch=<n>`` below ``path``, so that a batch that is tried again leaves its rows once. It ends when the frames that are
    there are done, and goes on from ``checkpoint`` when it is started again."""

    def fuse(batch: DataFrame, n: int) -> None:
        video_run(batch, interval_s, max_frames, knobs).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={n}")

    return frames.writeStream.foreachBatch(fuse).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
