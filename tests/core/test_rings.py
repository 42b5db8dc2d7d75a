"""Nearest scenes in rings and least distances of splits against brute force."""

import math
import random

import pytest


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    t = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 12742 * math.atan2(math.sqrt(t), math.sqrt(max(0.0, 1 - t)))


ASKED, REFS = "query_path string, q_scene string, lat double, lon double", "path string, scene string, lat double, lon double"


def ring_brute(asked, refs, least, most, need, barred=()):
    out = {}
    for q, scene, lat, lon in asked:
        best = {}
        for p, s, *at in refs:
            d = km((lat, lon), at)
            if least <= d <= most and p != q and s != scene and (q, s) not in barred:
                best[s] = min(best.get(s, (math.inf, "")), (round(d, 9), p))
        out[q] = [(p, s) for s, (d, p) in sorted(best.items(), key=lambda x: x[1])][:need]
    return out


def nearest_of(rows, need):
    out = {}
    for r in rows:
        out.setdefault(r["query_path"], []).append((round(r["km"], 9), r["path"], r["scene"]))
    return {q: [(p, s) for _, p, s in sorted(v)][:need] for q, v in out.items()}


@pytest.mark.parametrize("least,most,need,start", [(0.0, 3.0, 4, 0.05), (2.0, 25.0, 10, None), (1.0, 400.0, 3, None)])
def test_rings(spark, least, most, need, start):
    from terraloom.operators.spatial import nearest_in_ring

    rng = random.Random(3)
    place = lambda: rng.choice([(48.8 + rng.random() / 5, 2.2 + rng.random() / 5), (48.85, 2.35), (-17.0, rng.choice([179.99, -179.99]))])
    asked = [(f"q{k}", f"s{k}", *place()) for k in range(20)]
    refs = [(f"r{k}", f"s{rng.randrange(60)}", *place()) for k in range(700)] + [("q1", "s50", *asked[1][2:])]
    barred = [(f"q{k}", f"s{rng.randrange(60)}") for k in range(20)]
    a, r = spark.createDataFrame(asked, ASKED), spark.createDataFrame(refs, REFS)
    want = {q: v for q, v in ring_brute(asked, refs, least, most, need, set(barred)).items() if v}
    got = nearest_in_ring(a, r, "query_path", least, most, need, spark.createDataFrame(barred, "query_path string, scene string"), 1, start_km=start)
    assert nearest_of(got.collect(), need) == want


def test_crowded_places_are_not_listed_whole(spark):
    from pyspark.sql import functions as F

    from terraloom.operators.spatial import nearest_in_ring

    crowd = spark.range(100_000).select(F.concat(F.lit("c"), "id").alias("path"), F.concat(F.lit("s"), "id").alias("scene"), F.lit(48.85).alias("lat"), F.lit(2.35).alias("lon"))
    asked = spark.createDataFrame([("q1", "s7", 48.85, 2.36), ("q2", "none", 48.95, 2.35)], ASKED)
    rows = nearest_in_ring(asked, crowd, "query_path", 0.5, 25.0, 5).collect()
    assert len(rows) <= 2 * 7 and {r["query_path"] for r in rows} == {"q1", "q2"} and all(r["scene"] != "s7" or r["query_path"] == "q2" for r in rows)


def test_split_distances_need_no_radius(spark):
    from terraloom.operators.spatial import least_split_distance

    rng = random.Random(5)
    centres = {"train": (48.0, 2.0), "val": (48.3, 2.0), "test": (-20.0, 179.9), "far": (-20.0, -179.9)}
    rows = [(s, lat + rng.random() / 20, lon + rng.random() / 20) for s, (lat, lon) in centres.items() for _ in range(40)]
    want = {(a, b): min(km(x[1:], y[1:]) for x in rows if x[0] == a for y in rows if y[0] == b) for a in centres for b in centres if a < b}
    got = {(r["a"], r["b"]): r["km"] for r in least_split_distance(spark.createDataFrame(rows, "split string, lat double, lon double"), 0.2).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_vectors_of_one_dimension_only(spark):
    from terraloom.operators.retrieval import same_dimension, similarity_topk

    schema = "item_id long, source string, embedding array<float>"
    index = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0])], schema)
    queries = lambda *rows: spark.createDataFrame(rows, "query_id long, embedding array<float>")
    assert same_dimension(index, queries((7, [1.0, 0.5]))) == 2 and same_dimension(index.limit(0)) is None
    with pytest.raises(ValueError, match="different dimensions"):
        similarity_topk(index, queries((7, [1.0])), 1)
    for wrong in (None, [1.0, None], [float("nan"), 1.0]):
        with pytest.raises(ValueError, match="1 rows have no vector"):
            similarity_topk(index, queries((7, wrong)), 1)
