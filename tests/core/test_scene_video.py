"""Scene likeness against a plain loop; projections; frames of videos as batch and stream."""

import math

import numpy as np
import pytest

from terraloom.functions import scene
from terraloom.operators import vectors
from terraloom.streaming import video

FIELDS = ", ".join([*(f"{h} array<double>" for h in scene.HISTOGRAMS), *(f"{x} double" for x in (*scene.LEVELS, *scene.AXES))])


def signature(seed, **over):
    rng = np.random.default_rng(seed)
    row = {h: rng.dirichlet(np.full(n, 0.4)).tolist() for h, n in zip(scene.HISTOGRAMS, (8, 16, 16, 8, 8), strict=True)}
    row |= {x: float(rng.uniform()) for x in scene.LEVELS} | {x: float(rng.uniform(0, 360)) for x in scene.AXES}
    return row | over


def compared(spark, *pairs):
    rows = [(k, *s.values()) for k, pair in enumerate(pairs) for s in pair]
    c = spark.createDataFrame([(k, k) for k in range(len(pairs))], "query_id long, item_id long")
    sides = [spark.createDataFrame(rows[n::2], f"{key} long, {FIELDS}") for n, key in enumerate(("query_id", "item_id"))]
    return [r["structure"] for r in scene.with_structure(c, *sides).orderBy("query_id").collect()]


def test_scene_likeness(spark):
    a, b = signature(1), signature(2)
    flat = {x: 0.0 for x in scene.LEVELS}
    same, both, back, bare = compared(spark, (a, a), (a, b), (b, a), (a | flat, b | flat))
    assert same == pytest.approx(1.0) and both == pytest.approx(back) and 0 < both < 1
    assert bare == pytest.approx(1.0)  # nothing supports a cue of geometry; corners and edges are alike
    weak, none = compared(spark, (a | flat | {"corner_density": 1.0}, b | flat), (a | {x: None for x in scene.AXES}, a))
    assert weak == pytest.approx(0.13 / 0.35)
    assert none < 1.0  # an axis that is not known counts half


def test_opposite_shadows_count_by_their_support(spark):
    flat = {x: 0.0 for x in scene.LEVELS}
    a, b = signature(3, **flat, shadow_axis_deg=10.0), signature(3, **flat, shadow_axis_deg=190.0)
    strong = {"shadow_strength": 0.8}
    got = compared(spark, (a | strong, b | strong), (a | strong, b))
    assert got[0] == pytest.approx(0.35 / (0.35 + 0.15 * 0.8)) and got[1] == pytest.approx(1.0)


def test_scenes_without_a_signature_have_no_evidence(spark):
    c = spark.createDataFrame([(1, 1), (2, 1)], "query_id long, item_id long")
    s = signature(5)
    q = spark.createDataFrame([(1, *s.values())], f"query_id long, {FIELDS}")
    i = spark.createDataFrame([(1, *s.values())], f"item_id long, {FIELDS}")
    assert {r["query_id"]: r["structure"] for r in scene.with_structure(c, q, i).collect()} == {1: pytest.approx(1.0), 2: None}


def test_projection(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 7)
    x, w, b = np.random.default_rng(1).normal(size=(50, 6)), np.random.default_rng(2).normal(size=(3, 6)), np.array([0.1, 0.2, -0.3])
    index = spark.createDataFrame([(k, v.tolist(), "s") for k, v in enumerate(x)], "item_id long, embedding array<double>, source string")
    got = np.array([r["embedding"] for r in vectors.projected(index, w, b).orderBy("item_id").collect()])
    want = x @ w.T + b
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True))
    assert vectors.projected(index.limit(0), w, b).columns == index.columns
    with pytest.raises(ValueError, match="dimensions"):
        vectors.projected(index, w[:, :5], b)
    with pytest.raises(ValueError, match="finite"):
        vectors.projected(index, w * math.nan, b)
    zero = spark.createDataFrame([(1, [0.0] * 6)], "item_id long, embedding array<double>")
    assert vectors.projected(zero, w, b * 0).first()["embedding"] == [0.0] * 3


SCHEMA = "video string, frame long, fps double, candidates array<struct<item_id:long,lat:double,lon:double,score:double,match_id:string>>"


def test_a_stream_of_frames_is_the_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    frames = [(v, k, fps, [(i, 48.0 + rng.uniform(), 2.0 + rng.uniform(), rng.uniform(), f"retrieval:s{i % 2}:{i}") for i in range(k % 4)]) for v, fps in (("a", 25.0), ("b", None)) for k in range(0, 130, 5)]
    taken = {("a", k) for k in range(0, 125, 25)} | {("b", k) for k in range(0, 130, 30)}
    table = spark.createDataFrame(frames, SCHEMA)
    batch = {(r["video"], r["frame"]): r for r in video.video_run(table, 1.0, 5).collect()}
    assert set(batch) == taken and batch["a", 50]["timestamp_s"] == 2.0 and batch["b", 60]["timestamp_s"] == 2.0
    assert batch["a", 0]["mean_lat"] is None and batch["a", 25]["mean_lat"] is not None
    for n in range(3):  # out of order; a frame comes again
        spark.createDataFrame(frames[2 - n :: 3] + frames[:1] * (n == 0), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
    for _ in range(2):  # started again, it has nothing more to do
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b*")
        query = video.video_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", 1.0, 5)
        assert query.awaitTermination(120)
    got = [r for r in spark.read.parquet(f"{tmp_path}/out").drop("batch").dropDuplicates(["video", "frame"]).collect()]
    assert {(r["video"], r["frame"]) for r in got} == taken
    assert all(r["mean_lat"] == pytest.approx(batch[r["video"], r["frame"]]["mean_lat"]) for r in got)


def test_frames_at_the_edges(spark):
    rows = [("a", None, 25.0, []), (None, 0, 25.0, []), ("a", -25, 25.0, []), ("a", 1, 0.5, None)]
    got = video.video_run(spark.createDataFrame(rows, SCHEMA), 1.0, 5).collect()
    assert [(r["video"], r["frame"], r["timestamp_s"], r["mean_lat"]) for r in got] == [("a", 1, 2.0, None)]
    assert video.video_run(spark.createDataFrame([], SCHEMA), 1.0, 5).count() == 0
