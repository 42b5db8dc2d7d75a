"""Searches over blocks, order statistics, quotas, merges, fits and chains against plain loops."""

import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from test_greedy import km


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_search_over_many_blocks(spark, monkeypatch):
    from terraloom.operators import retrieval

    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 8 * 6 * 40)
    monkeypatch.setattr(retrieval, "TILE", 7)
    rng = np.random.default_rng(2)
    vectors = np.round(rng.normal(size=(240, 6)), 1)  # ties are common
    index = spark.createDataFrame([(k, f"s{k % 3}", v.tolist()) for k, v in enumerate(vectors)], "item_id long, source string, embedding array<double>")
    asked = [(k, vectors[k]) for k in range(0, 240, 3)]
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in asked], "query_id long, embedding array<double>")
    want = []
    for q, v in asked:
        for s in range(3):
            best = sorted((-round(float(v @ vectors[i]), 9), i) for i in range(240) if i % 3 == s and i != q)[:4]
            want += [(q, f"s{s}", i, n + 1) for n, (_, i) in enumerate(best)]
    assert retrieval._blocks(queries) > 1 and retrieval._blocks(index) > 1
    assert rows_of(retrieval.similarity_topk(index, queries, 4), "query_id", "source", "item_id", "rk") == sorted(want)
    views = retrieval.rotated_views(queries, 2, 3)
    for kind, f in (("max", max), ("median", lambda x: float(np.median(x)))):
        want = []
        for q, v in asked[:20]:
            for s in range(3):
                score = lambda i: round(f([float(np.roll(v, -2 * t) @ vectors[i]) for t in range(3)]), 9)  # noqa: B023, E731
                want += [(q, i) for _, i in sorted((-score(i), i) for i in range(240) if i % 3 == s and i != q)[:2]]
        got = retrieval.similarity_topk(index, views.where("query_id < 60"), 2, kind)
        assert rows_of(got, "query_id", "item_id") == sorted(want)
    assert retrieval.similarity_topk(index, queries.limit(0), 4).count() == 0 == retrieval.similarity_topk(index.limit(0), queries, 4).count()


def test_order_statistics(spark):
    from pyspark.sql import functions as F

    from terraloom.operators.evaluate import order_statistics

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.5, 0.5, rng.random() * 9, None])) for _ in range(900)] + [("one", 3.25)]
    places = {"low": F.lit(0), "third": F.floor(F.col("n") / 3), "high": F.col("n") - 1}
    for width in (0.01, 4.0):
        got = {r["k"]: (r["n"], r["low"], r["third"], r["high"]) for r in order_statistics(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", places, width).collect()}
        for k in ("a", "b", None, "one"):
            v = sorted(x for g, x in rows if g == k and x is not None)
            assert got[k] == (len(v), v[0], v[len(v) // 3], v[-1])


def test_scenes_of_all_sizes(spark):
    from terraloom.operators.spatial import covering_scene

    rng = random.Random(6)
    scenes = [(0, 90.0, -90.0, 90.0, -180.0, 180.0)]
    for k in range(1, 60):
        half, la, lo = 10 ** rng.uniform(-3, 1.5), rng.uniform(-50, 50), rng.uniform(-90, 90)
        scenes.append((k, half, la - half, la + half, lo - half, lo + half))
    points = [(k, rng.uniform(-60, 60), rng.uniform(-100, 100)) for k in range(200)] + [(900, scenes[7][2], scenes[7][4])]
    got = covering_scene(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(scenes, "scene_id long, resolution_m double, south double, north double, west double, east double"), "id")
    want = [(p, min((s[1], s[0]) for s in scenes if s[2] <= la <= s[3] and s[4] <= lo <= s[5])[1]) for p, la, lo in points]
    assert rows_of(got, "id", "scene_id") == sorted(want)


def test_source_balance_below_zero(spark):
    from terraloom.operators.retrieval import balanced_by_source

    rng = random.Random(9)
    rows = [(q, i, f"s{rng.randrange(3)}", round(rng.uniform(-1, 1), 3) + i * 1e-6) for q in range(12) for i in range(14)]
    want = []
    for q in range(12):
        left, taken = [r for r in rows if r[0] == q], defaultdict(int)
        for _ in range(9):
            best = max(left, key=lambda r: (round(r[3] / (1 + 0.3 * taken[r[2]]), 9), r[3], -r[1]))  # noqa: B023
            left.remove(best)
            taken[best[2]] += 1
            want.append((q, best[1]))
    assert rows_of(balanced_by_source(spark.createDataFrame(rows, "query_id long, item_id long, source string, score double"), 9, 0.3), "query_id", "item_id") == sorted(want)


def test_quota_sample_and_merge(spark):
    from pyspark.sql import functions as F

    from terraloom.operators.mining import merged_once, quota_sample

    rng = random.Random(3)
    rows = [(rng.randrange(12), k, rng.choice(["a", "b", "c", "d", "e", None]), rng.randrange(9)) for k in range(260)]
    taken, used, want = defaultdict(int), 0, []
    for cell in range(12):
        here, seen = 0, set()
        for c, i, s, q in sorted((r for r in rows if r[0] == cell), key=lambda r: (-r[3], -r[1])):
            if here == 4 or s is not None and (s in seen or taken[s] >= 3):
                continue
            here, used = here + 1, used + 1
            if s is not None:
                seen.add(s)
                taken[s] += 1
            if used <= 30:
                want.append((c, i))
    got = quota_sample(spark.createDataFrame(rows, "cell long, image_id long, sequence string, quality int"), 4, 3, [F.col("quality").desc(), F.col("image_id").desc()], 30)
    assert rows_of(got, "cell", "image_id") == sorted(want)
    pairs = [(k, rng.choice([None, *range(30)]), rng.randrange(30)) for k in range(150)]
    streets, aerials, want = set(), set(), []
    for k, a, b in pairs:
        if a is not None and a not in streets and b not in aerials:
            streets.add(a)
            aerials.add(b)
            want.append(k)
    frame = spark.createDataFrame(pairs, "at long, street_id long, aerial_id long")
    assert [x for (x,) in rows_of(merged_once(frame, ["street_id", "aerial_id"], ["at"]), "at")] == want
    assert merged_once(frame.limit(0), ["street_id", "aerial_id"], ["at"]).count() == 0


def test_fits_against_numpy(spark):
    from terraloom.operators import rerank as m

    rng = np.random.default_rng(8)
    names = ("a", "b", "c")
    x = rng.normal(size=(60, 3)) * (1, 5, 0) + (0, 2, 7)
    far = np.abs(x[:, 0] * 2 + rng.normal(size=60)) * 3
    target = np.exp(-0.5 * (far / 3) ** 2)
    rows = spark.createDataFrame([(k // 6, *map(float, r), float(d), float(t)) for k, (r, d, t) in enumerate(zip(x, far, target, strict=True))], "query_id long, a double, b double, c double, km double, target double")
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) < 1e-9, 1, x.std(axis=0))
    z = (x - mean) / scale
    design = np.hstack([z, np.ones((60, 1))])
    want = np.linalg.solve(design.T @ design + np.diag([1, 1, 1, 1e-12]), design.T @ target)
    got = m.ridge_model(rows, "target", 1.0, names)
    assert np.allclose([*got.weights, got.intercept], want, atol=1e-8)
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    w = np.zeros(3)
    for _ in range(4):
        grad = sum(z[i : i + 6].T @ (soft(z[i : i + 6] @ w) - soft(-0.5 * (far[i : i + 6] / 3) ** 2)) for i in range(0, 60, 6))
        w = w - 0.5 * (grad / 10 + 1e-3 * w)
    assert np.allclose(m.listwise_model(rows, "km", 3.0, epochs=4, names=names).weights, w, atol=1e-8)
    model = m.LinearModel(names, (1.0, 2.0, 3.0), 0.5, (0.0,) * 3, (1.0,) * 3, "exp", 0.1, 1.0)
    assert m.LinearModel.from_json(model.to_json()) == model
    short = m.LinearModel.from_json(json.dumps({"feature_names": ["a", "b"], "weights": [4], "bias": 2}))
    assert short.weights == (4.0, 0.0) and short.intercept == 2.0 and short.scales == (1.0, 1.0)


def test_every_knob_changes_the_chains(spark, sf_dir):
    from pyspark.sql import functions as F

    from terraloom.operators import fusion
    from terraloom.operators.rerank import FEATURES, LinearModel
    from terraloom.plans import chains
    from terraloom.plans import overlay as o
    from terraloom.sources.stage import written

    c = written(o.candidates(spark, sf_dir).withColumns({"structure": F.col("item_id") % 10 / 10.0, "local": F.col("item_id") % 7 / 7.0}), "knobs")
    views = c.selectExpr("query_id", "source", "item_id", "explode(array(0, 1)) as view", "score").withColumn("score", F.pmod(F.xxhash64("item_id", "view"), F.lit(97)) / 97.0)
    shape = lambda k: rows_of(chains.retrieval_chain(c, k, views), "query_id", "rank", "item_id", "lat")
    base = chains.RetrievalKnobs(top_k=8)
    plain = shape(base)
    from dataclasses import replace

    for change in ({"norm": "zscore"}, {"agreement_weight": 0.9}, {"weights": {"idx0": 3.0}}, {"reciprocal_rank": True}, {"structure_weight": 0.9}, {"local_weight": 0.9}, {"box": (48.8, 48.82, 2.25, 2.45)}, {"min_score": 0.5, "min_keep": 3}, {"locality_radius_km": 3.0, "locality_weight": 2.0}, {"balance_beta": 2.0}, {"graph_top_n": 12}, {"diverse_km": 5.0, "diverse_weight": 0.2}, {"consensus_top_n": 8}, {"density_top_n": 8}):
        assert shape(replace(base, **change)) != plain, change
    answer = lambda k: rows_of(fusion.fuse(c, k), "query_id", "mean_lat", "mean_lon", "tier")
    model = LinearModel(weights=tuple(3.0 if f == "support_3km" else 0.0 for f in FEATURES))
    plain = answer(fusion.Knobs())
    for change in ({"normalise": "minmax"}, {"normalise": "rank"}, {"normalise": "zscore"}, {"cross_weight": 4.0}, {"spatial_weight": 4.0}, {"plausibility_weight": 2.0, "plausibility_radius_km": 4.0}, {"outlier_strength": 3.0, "outlier_min_scale_km": 1.0}, {"reranker": model, "reranker_weight": 2.0}, {"cluster_radius_km": 3.0, "cluster_least_mass": 0.1}, {"credible_mass": 0.5}):
        assert answer(fusion.Knobs(**change)) != plain, change
    low = rows_of(fusion.fuse(c, fusion.Knobs(high_threshold=0.0, medium_threshold=0.0)), "query_id", "tier")
    assert low != rows_of(fusion.fuse(c, fusion.Knobs(high_threshold=0.0, medium_threshold=0.0, high_cap=(2.0, 1.0), medium_cap=(2.0, 1.0))), "query_id", "tier") or all(t == "low" for _, t in low)


def test_views_and_scopes():
    from terraloom.plans import providers as p

    assert p.chosen_angles([0, 370, 10, -90, 450, float("nan"), "x"]) == [0.0, 10.0, -90.0, 90.0]
    assert p.chosen_angles(None) == [0.0] and p.chosen_angles(range(0, 360, 10))[-1] in (-60.0, 60.0) and len(p.chosen_angles(range(0, 360, 10))) == 12
    assert p.chosen_scales([0.2, 0.8, 0.8004, 2]) == [1.0, 0.8, 0.45] and p.chosen_modes(["Edge", "blur"]) == ["edge"] and p.chosen_modes([]) == ["rgb"]


def test_results_and_sidecars_from_files(spark, tmp_path):
    from terraloom.sources import results as m

    (tmp_path / "r.jsonl").write_text('{"image": "a.jpg", "result": {"geo": {"latitude": 1, "longitude": 2, "confidence": 0.5}}}\n\nnot json\n{"path": "b.jpg", "candidates": [{"latitude": 3, "longitude": 4}, {"latitude": 5, "longitude": 6, "confidence": 0.1}]}\n')
    rows = m.read_results(spark, str(tmp_path / "r.jsonl")).cache()
    assert rows.where("_corrupt_record is not null").count() == 1
    got = {r["image"]: [tuple(x) for x in r["candidates"]] for r in m.assessed(rows.where("_corrupt_record is null")).collect()}
    assert got == {"a.jpg": [(1.0, 2.0, 0.5)], "b.jpg": [(5.0, 6.0, 0.1)]}
    folder = tmp_path / "side"
    folder.mkdir()
    for name, text in {"x.jpg.geoloc.json": '{"latitude": 9, "longitude": 9}', "x.geo.json": '{"candidates": [{"latitude": "7", "longitude": 8}, {"latitude": 7, "longitude": 8, "retrieval_score": "high", "landmark_id": 4}]}'}.items():
        (folder / name).write_text(text)
    files = m.read_sidecars(spark, str(folder), m.GEO_SUFFIXES)
    root = files.first()["path"].rpartition("/")[0]
    images = spark.createDataFrame([(f"{root}/x.jpg",), (f"{root}/y.jpg",)], "image string")
    assert [tuple(r)[2:] for r in m.geo_sidecars(m.sidecar_of(images, files, m.GEO_SUFFIXES)).collect()] == [(7.0, 8.0, 0.3, "4")]


def test_consensus_and_density_by_plain_loops(spark):
    from terraloom.operators.rerank import refined_by_density

    rng = random.Random(12)
    rows = [(q, i, 48.8 + rng.random() / 20, 2.3 + rng.random() / 20, 0.9 - i * 0.04, f"retrieval:s:{i}") for q in range(6) for i in range(9)]
    frame = spark.createDataFrame(rows, "query_id long, item_id long, lat double, lon double, score double, match_id string")
    got = {r["query_id"]: (r["lat"], r["lon"]) for r in refined_by_density(frame, 7, 0.8, 1.0, steps=30, mass=0.7).where("rank = 1").collect()}
    for q in range(6):
        head = [r for r in rows if r[0] == q][:7]
        w = [r[4] for r in head]
        keep = next(k for k in range(2, 8) if sum(w[:k]) >= 0.7 * sum(w) or k == 7)
        head, w = head[:keep], w[:keep]
        la0, lo0 = sum(r[2] * x for r, x in zip(head, w, strict=True)) / sum(w), sum(r[3] * x for r, x in zip(head, w, strict=True)) / sum(w)
        pts = [((r[3] - lo0) * 111.32 * math.cos(math.radians(la0)), (r[2] - la0) * 110.574) for r in head]
        best = None
        for x, y in pts[:8]:
            for _ in range(30):
                f = [k * math.exp(-0.5 * ((x - a) ** 2 + (y - b) ** 2) / 0.64) for (a, b), k in zip(pts, w, strict=True)]
                nx, ny = (sum(k * p[i] for p, k in zip(pts, f, strict=True)) / sum(f) for i in (0, 1))
                step = math.hypot(nx - x, ny - y)
                x, y = nx, ny
                if step <= 1e-3:
                    break
            d = sum(k * math.exp(-0.5 * ((x - a) ** 2 + (y - b) ** 2) / 0.64) for (a, b), k in zip(pts, w, strict=True))
            if best is None or d > best[0] + 1e-9:
                best = d, x, y
        assert km(got[q], (la0 + best[2] / 110.574, lo0 + best[1] / (111.32 * math.cos(math.radians(la0))))) < 1e-3
    assert pytest.approx(0.0) == km((1.0, 1.0), (1.0, 1.0))


def test_ingestion_stops_and_starts_again(spark, tmp_path):
    from terraloom.streaming.ingest import ingest

    drop, out = tmp_path / "in", str(tmp_path / "out")
    drop.mkdir()
    for run, ids in enumerate(([1, 2, 2, 3], [3, 4], [], [1, 5, None])):
        (drop / f"{run}.json").write_text("\n".join(json.dumps({"image_id": i, "n": run}) for i in ids))
        source = spark.readStream.schema("image_id long, n long").json(str(drop))
        ingest(source, out, str(tmp_path / "log")).awaitTermination(60)
    assert rows_of(spark.read.parquet(out), "image_id", "n") == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 3)]
    # a batch that is done again after a failure, with another log
    ingest(spark.readStream.schema("image_id long, n long").json(str(drop)), out, str(tmp_path / "other")).awaitTermination(60)
    assert spark.read.parquet(out).count() == 5


def test_crop_tiles_go_round(spark):
    from terraloom.functions.keys import crop_tiles

    row = spark.createDataFrame([(0.0, -179.9999), (85.0, 10.0)], "lat double, lon double").select(crop_tiles("lat", "lon", 3, 512).alias("t")).collect()
    assert {(t["x"], t["y"]) for t in row[0]["t"]} == {(x, y) for x in (7, 0) for y in (3, 4)} | {(x, y) for x in (7, 0) for y in (3, 4)}
    assert min(t["y"] for t in row[1]["t"]) == 0


def test_knobs_and_configs(spark, sf_dir):
    from terraloom.operators.fusion import Knobs, fuse
    from terraloom.plans import knobs as m
    from terraloom.plans import overlay as o
    from terraloom.queries_forms import _SETTINGS

    k = m.fusion_knobs({"temperature": -4, "top_k": 3.9, "normalise": "Other", "credible_mass": float("nan"), "spatial_weight": True, "unknown": 1, "cross_weight": "2"})
    assert (k.temperature, k.top_k, k.normalise, k.credible_mass, k.spatial_weight, k.cross_weight) == (1e-3, 3, "none", 0.9, Knobs().spatial_weight, Knobs().cross_weight)
    assert json.loads(m.with_best('{"fusion": {"a": 1, "b": 2}, "x": 3}', "fusion", {"b": 5})) == {"fusion": {"a": 1, "b": 5}, "x": 3}
    c, truth = o.candidates(spark, sf_dir), {r["query_id"]: (r["lat"], r["lon"]) for r in o.queries(spark, sf_dir).collect()}
    got = {r["setting"]: (r["mean_km"], r["place"]) for r in m.fusion_sweep(c, o.queries(spark, sf_dir), _SETTINGS).collect()}
    means = [np.mean([km((r["mean_lat"], r["mean_lon"]), truth[r["query_id"]]) for r in fuse(c, m.fusion_knobs(s)).collect()]) for s in _SETTINGS]
    assert np.allclose([got[n][0] for n in range(3)], means) and [got[n][1] for n in np.argsort(means)] == [1, 2, 3]
