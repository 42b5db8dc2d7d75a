"""Joins of places where many rows share one: they are paired by place, and give what all pairs give."""

import random
import time

from test_greedy import km


def _crowd(spark, n, names):
    return spark.range(n).selectExpr(f"id as {names}", "48.85 as lat", "2.35 as lon")


def test_nearest_pairs_places_not_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from terraloom.operators import spatial

    rng = random.Random(8)
    places = [(48.85 + rng.randrange(4) / 1e3, 2.35 + rng.randrange(4) / 1e3) for _ in range(40)]
    left = [(k, *rng.choice(places)) for k in range(300)] + [(900, None, 2.35), (901, 10.0, 10.0)]
    right = [(k, *rng.choice(places), rng.choice([None, 10.0, 200.0])) for k in range(400)]
    a = spark.createDataFrame(left, "id long, lat double, lon double")
    b = spark.createDataFrame(right, "ref long, lat double, lon double, h double")
    sizes, pairs = [], spatial.radius_pairs
    monkeypatch.setattr(spatial, "radius_pairs", lambda x, y, r: sizes.append((x.count(), y.count())) or pairs(x, y, r))
    for n in (1, 3):
        got = spatial.nearest(a, b.drop("h"), "id", [F.round("km", 9)], "ref", 0.2, n).select("id", "ref", "at").collect()
        want = []
        for i, la, lo in left:
            near = sorted((round(km((la, lo), p[1:3]), 9), p[0]) for p in right if la is not None and km((la, lo), p[1:3]) <= 0.2)
            want += [(i, ref, at + 1) for at, (_, ref) in enumerate(near[:n])]
        assert sorted(tuple(r) for r in got) == sorted(want)
        assert sizes.pop()[0] <= 18 and sizes == []
    by_heading = spatial.nearest(a, b, "id", [F.coalesce("h", F.lit(180.0)), F.round("km", 9)], "ref", 0.2).select("id", "ref").collect()
    want = []
    for i, la, lo in left:
        near = sorted((180.0 if p[3] is None else p[3], round(km((la, lo), p[1:3]), 9), p[0]) for p in right if la is not None and km((la, lo), p[1:3]) <= 0.2)
        want += [(i, near[0][2])] if near else []
    assert sorted(tuple(r) for r in by_heading) == sorted(want)
    assert sizes.pop()[1] <= 3 * 16


def test_a_crowd_below_equal_scenes(spark):
    from terraloom.operators.spatial import street_aerial_pairs

    scenes = spark.range(60_000).selectExpr("id as scene_id", "1.0 + id % 3 as resolution_m", "48.8 as south", "48.9 as north", "2.3 as west", "2.4 as east")
    streets = _crowd(spark, 60_000, "image_id").selectExpr("*", "1 as captured_at")
    began = time.monotonic()
    got = street_aerial_pairs(streets, scenes)
    assert {tuple(r) for r in got.groupBy("scene_id", "status").count().collect()} == {(0, "ok", 60_000)}
    assert time.monotonic() - began < 60


def test_a_crowd_of_notes_and_pins(spark):
    from terraloom.operators.spatial import matched_notes

    notes = _crowd(spark, 60_000, "note_id").selectExpr("note_id", "cast(null as long) as pin_id", "lat", "lon")
    began = time.monotonic()
    got = matched_notes(notes, _crowd(spark, 60_000, "pin_id"))
    assert [tuple(r) for r in got.groupBy("pin_id").count().collect()] == [(0, 60_000)]
    assert time.monotonic() - began < 60
