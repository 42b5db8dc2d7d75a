"""Index merge, temporal posterior and ridge fit against plain loops."""

import math
import random

import numpy as np
import pytest

from test_greedy import km


def test_index_merge(spark, sf_dir):
    from terraloom.operators.merge import merge_without_copies
    from terraloom.plans import overlay

    index = overlay.geo_index(spark, sf_dir)
    rows = sorted(index.collect(), key=lambda r: r["item_id"])
    vectors = {r["item_id"]: np.array(r["embedding"], float) for r in rows}
    kept = []
    for r in rows:
        v = vectors[r["item_id"]]
        near = (k for k in kept if 1000 * km((r["lat"], r["lon"]), (k["lat"], k["lon"])) <= 3000)
        if not any(v @ vectors[k["item_id"]] / np.linalg.norm(v) / np.linalg.norm(vectors[k["item_id"]]) >= 0.1 for k in near):
            kept.append(r)
    got = {r["item_id"] for r in merge_without_copies(index, 3000.0, 0.1).collect()}
    assert got == {r["item_id"] for r in kept} and len(got) < len(rows)


def test_merge_keeps_both_ends_of_a_chain(spark):
    from terraloom.operators.merge import merge_without_copies

    rows = [(1, 48.0, 2.0, [1.0, 0.0]), (2, 48.0, 2.0, [0.9, 0.45]), (3, 48.0, 2.0, [0.6, 0.8]), (4, 49.0, 2.0, [1.0, 0.0])]
    got = merge_without_copies(spark.createDataFrame(rows, "item_id long, lat double, lon double, embedding array<double>"), 100.0, 0.85)
    assert {r["item_id"] for r in got.collect()} == {1, 3, 4}


def test_merge_of_long_chains_and_equal_items(spark):
    from terraloom.operators.merge import merge_without_copies

    schema = "item_id long, lat double, lon double, embedding array<double>"
    chain = [(k, 48.0 + 0.0008 * k, 2.0, [1.0, 0.0]) for k in range(1000)]  # 89 m apart: each conflicts with the one before
    same = [(5000 + k, 10.0, 2.0, [0.0, 1.0]) for k in range(4000)]  # 8 million pairs, were they not one item
    odd = [(9000, 10.0, 2.0, [0.0, 0.0]), (9001, 10.0, 2.0, [0.0, 0.0]), (9002, None, 2.0, [1.0, 0.0]), (9003, None, 2.0, [1.0, 0.0])]  # no conflicts
    got = sorted(r["item_id"] for r in merge_without_copies(spark.createDataFrame(chain + same + odd, schema), 100.0, 0.85).collect())
    assert got == [*range(0, 1000, 2), 5000, 9000, 9001, 9002, 9003]


def test_merge_waits_for_other_ranges():
    import pandas as pd

    from terraloom.operators.merge import decided

    rows = [(5, 1, 0), (6, 5, 0), (7, 2, 1), (7, 1, 0), (8, 7, 0), (9, 2, -1)]
    halves = (pd.DataFrame(part, columns=["item_id", "other", "known"]) for part in (rows[:3], rows[3:]))
    assert [tuple(r) for pdf in decided(halves) for r in pdf.values.tolist()] == [(7, -1), (8, 1), (9, 1)]


def test_temporal_posterior(spark):
    from terraloom.streaming.temporal import temporal_posterior

    rows = [(1, f, f, i, 48.0 + 0.01 * i + 0.002 * f, 2.0, 0.5 + 0.1 * i, 1000.0) for f in range(4) for i in range(3)] + [(2, 9, 0, 7, 10.0, 10.0, 0.4, 50.0)]
    got = {(r["frame"], r["item_id"]): r for r in temporal_posterior(spark.createDataFrame(rows, "sequence long, frame long, ts int, item_id long, lat double, lon double, w double, radius_m double")).collect()}
    prior, radius = None, None
    for f in range(4):
        here = [r for r in rows if r[0] == 1 and r[1] == f]
        w = [r[6] / sum(x[6] for x in here) for r in here]
        now = 1000.0
        if prior:
            sigma = max(500.0, 0.5 * (radius + now))
            support = [sum(pw * math.exp(-0.5 * (1000 * km(p, (r[4], r[5])) / sigma) ** 2) for p, pw in prior) for r in here]
            raw = [a * s for a, s in zip(w, support, strict=True)]
            w = [x / sum(raw) for x in raw]
            now *= max(0.55, 1 - 0.35 * max(support))
        for r, x in zip(here, w, strict=True):
            assert got[f, r[3]]["weight"] == pytest.approx(x, rel=1e-9) and got[f, r[3]]["radius_m"] == pytest.approx(now)
        prior, radius = [((r[4], r[5]), x) for r, x in zip(here, w, strict=True)], now
    assert got[9, 7]["weight"] == 1.0 and got[9, 7]["radius_m"] == 50.0


def test_ridge(spark):
    from terraloom.operators.fit import applied, ridge

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = 0.3 * x[:, 0] - 0.2 * x[:, 1] + 0.4
    frame = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y, strict=True)], "a double, b double, t double")
    model = ridge(frame, ["a", "b"], "t", 1e-9)
    w = {r["feature"]: r["weight"] for r in model.collect()}
    assert w == pytest.approx({"a": 0.3, "b": -0.2, "intercept": 0.4}, abs=1e-6)
    assert applied(frame, model, ["a", "b"]).where("rerank < 0 or rerank > 1").count() == 0


def test_temporal_posterior_of_shared_sets(spark):
    from terraloom.streaming.temporal import temporal_posterior, temporal_posterior_of_sets

    rng = random.Random(12)
    sets = spark.createDataFrame([(k, 10 * k + i, 48.0 + rng.random() / 20, 2.0 + rng.random() / 20, rng.choice([0.0, rng.random()])) for k in range(3) for i in range(5 + k)], "set long, item_id long, lat double, lon double, w double")
    frames = spark.createDataFrame([(f % 4, f, rng.randrange(9), rng.randrange(4), rng.uniform(0, 4000)) for f in range(60)], "sequence long, frame long, ts int, set long, radius_m double")
    key = lambda r: (r["sequence"], r["frame"], r["item_id"])
    got = {key(r): r for r in temporal_posterior_of_sets(frames, sets).collect()}
    want = {key(r): r for r in temporal_posterior(frames.join(sets, "set").drop("set")).collect()}
    assert set(got) == set(want) and len(want) > 200
    for k, r in want.items():
        assert (got[k]["weight"], got[k]["radius_m"]) == pytest.approx((r["weight"], r["radius_m"]), rel=1e-9)
    assert temporal_posterior_of_sets(frames, sets.limit(0)).count() == 0 == temporal_posterior_of_sets(frames.limit(0), sets).count()


def test_support_of_many_candidates_is_quick():
    import time

    from terraloom.streaming.temporal import updated

    rng = np.random.default_rng(3)
    rows = [(48 + a, 2 + b, w) for a, b, w in rng.random((2_000, 3)) / 10]
    began = time.process_time()
    weights, radius = updated(rows, rows, 900.0, 900.0)
    assert weights.sum() == pytest.approx(1.0) and radius < 900 and time.process_time() - began < 2


def test_merge_by_blocks_pairs_no_dropped_items(spark, monkeypatch):
    from terraloom.operators import merge

    rng = np.random.default_rng(5)
    rows = [(3 * k, 48.0 + rng.random() / 50, 2.0, rng.normal(size=3).tolist()) for k in range(400)]
    kept = []
    for r in rows:
        v = np.array(r[3])
        if not any(1000 * km(r[1:3], k[1:3]) <= 900 and v @ np.array(k[3]) >= 0.3 * np.linalg.norm(v) * np.linalg.norm(k[3]) for k in kept):
            kept.append(r)
    sizes, pairs = [], merge._conflicts
    monkeypatch.setattr(merge, "_conflicts", lambda a, b, *x: sizes.append((a.count(), b.count())) or pairs(a, b, *x))
    index = spark.createDataFrame(rows, "item_id long, lat double, lon double, embedding array<double>")
    got = merge.merge_without_copies(index, 900.0, 0.3, 50)
    assert sorted(r["item_id"] for r in got.collect()) == [r[0] for r in kept] and len(kept) < 100
    assert len(sizes) > 4 and sum(a * b for a, b in sizes) < 400 * 400 / 2


def test_sets_of_many_candidates_meet_once(spark, monkeypatch):
    from terraloom.streaming import temporal

    rng = random.Random(21)
    made, squared = spark.sparkContext.accumulator(0), temporal._squared_km
    monkeypatch.setattr(temporal, "_squared_km", lambda a, b: (made.add(len(a) * len(b)), squared(a, b))[1])
    monkeypatch.setattr(temporal, "LISTED", 250)  # a frame goes back in several rows
    n = {0: 560, 1: 530}
    sets = [(k, i, 48.0 + (i % 520) / 5000, 2.0 + rng.randrange(k + 1) * 1e-9, rng.random()) for k in n for i in range(n[k])]
    frames = spark.createDataFrame([(f % 2, f, f, f // 2 % 3 % 2, rng.uniform(0, 9000)) for f in range(60)], "sequence long, frame long, ts int, set long, radius_m double")
    sets = spark.createDataFrame(sets, "set long, item_id long, lat double, lon double, w double")
    key = lambda r: (r["sequence"], r["frame"], r["item_id"])
    got = {key(r): r for r in temporal.temporal_posterior_of_sets(frames, sets).collect()}
    assert 0 < made.value <= 2 * (560 + 530) ** 2  # once for each two sets that follow each other, in each sequence's part
    want = {key(r): r for r in temporal.temporal_posterior(frames.join(sets, "set").drop("set")).collect()}
    assert set(got) == set(want) and len(want) > 30_000
    for k, r in want.items():
        assert (got[k]["weight"], got[k]["radius_m"]) == pytest.approx((r["weight"], r["radius_m"]), rel=1e-9)


def test_sets_that_are_not_kept(monkeypatch):
    from terraloom.streaming import temporal

    rng = np.random.default_rng(8)
    a, b = (temporal._vectors(np.column_stack([48 + rng.random((n, 2)) / 10, rng.random(n)])) for n in (300, 200))
    want = temporal._squared_km(a, b)
    for most, keys in ((1 << 24, ["ab", "aa"]), (100_000, ["aa"]), (50_000, [])):  # one too large for all is made by blocks
        monkeypatch.setattr(temporal, "KEPT", most)
        kept: dict = {}
        for key, x, y in (("ab", a, b), ("aa", a, a)):
            squared = temporal._kept_km(kept, key, x, y)
            assert np.array_equal(squared(slice(7, 20)), temporal._squared_km(x, y)[7:20])
        assert list(kept) == keys
    assert want[3, 4] == pytest.approx(km(*(np.degrees((math.asin(v[2]), math.atan2(v[1], v[0]))) for v in (a[3], b[4]))) ** 2, rel=1e-9)
