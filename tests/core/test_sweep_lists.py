"""Sweeps over gathered lists against a plain loop, on odd lists, and the rows that Spark handles for them."""

import math
import random
from itertools import product

from test_greedy import km

from terraloom.plans import sweeps


def _unit(v):
    return 0.5 if v is None or not math.isfinite(v) else v if 0 <= v <= 1 else 0.5 * (v + 1) if -1 <= v < 0 else 1 / (1 + math.exp(-v))


def _best(rows):
    return sorted(rows, key=lambda r: (-round(r["s"], 9) if r["s"] is not None else math.inf, r["item"]))


def _far(a, b):
    return math.inf if None in (a["lat"], a["lon"], b["lat"], b["lon"]) else km((a["lat"], a["lon"]), (b["lat"], b["lon"]))


def _first(raw, k):
    rows = [dict(r) for r in raw if r["s"] is not None and r["s"] >= k["min_score"]]
    if k["locality_radius_km"] > 0 and k["locality_weight"] > 0 and rows:
        near = [max(1e-9, sum(_unit(b["s"]) * math.exp(-_far(a, b) / k["locality_radius_km"]) for b in rows if a["item"] != b["item"])) for a in rows]
        a = k["locality_weight"] / (1 + k["locality_weight"])
        new = [max(1e-6, min(1, _unit(r["s"]) * (1 - a + a * (1 if len(rows) < 3 else max(1e-3, min(1, x / max(near))))))) for r, x in zip(rows, near, strict=True)]
        rows = [r | {"s": x} for r, x in zip(rows, new, strict=True)]
    taken, least = {}, {}
    for r in _best(rows):
        n = taken[r["source"]] = taken.get(r["source"], -1) + 1
        r["least"] = least[r["source"]] = min(least.get(r["source"], math.inf), round(r["s"] / (1 + k["balance_beta"] * n), 9))
    rows = sorted(rows, key=lambda r: (-r["least"], -round(r["s"], 9), r["item"]))[: int(k["top_k"])]
    if k["graph_top_n"] > 1:
        head, rest = _best(rows)[: int(k["graph_top_n"])], _best(rows)[int(k["graph_top_n"]) :]
        u = lambda r: max(1e-9, _unit(r["s"]))
        worth = [u(r) ** k["graph_score_alpha"] * max(1e-9, sum(u(b) * math.exp(-_far(r, b) ** 2 * 0.5 / k["graph_sigma_km"] ** 2) for b in head)) ** k["graph_support_beta"] for r in head]
        rows = [r | {"s": max(1e-6, min(1, w / max(worth)))} for r, w in zip(head, worth, strict=True)] + rest
    place = lambda r: (r["lat"], r["lon"], r["match"])
    mine = {place(r) for r in rows if None not in place(r)}
    rows += [r for r in _best(raw) if place(r) not in mine][: max(0, math.floor(k["min_keep"] - len(rows)))]
    return _best(rows)[0]["item"] if rows else None


def test_odd_lists_equal_a_plain_loop(spark):
    r, lists = random.Random(4), {}
    for q in range(30):
        lists[q] = [
            {"item": q * 100 + i, "source": r.choice(["a", "b", None]), "s": r.choice([None, r.uniform(-3, 3), round(r.uniform(-1, 1), 1), r.random(), 0.5]), "match": r.choice([None, *[f"m{i}"] * 8]), "lat": r.choice([None, *[48 + r.random() / 10] * 9, 48.05]), "lon": r.choice([2.0, 179.99, -179.99]) if q % 5 == 0 else 2 + r.random() / 10}
            for i in range(r.choice([1, 2, 3, 9, 20]))
        ]
    rows = [(q, x["source"], x["item"], x["lat"], x["lon"], x["s"], x["match"]) for q, items in lists.items() for x in items]
    r.shuffle(rows)
    c = spark.createDataFrame(rows, "query_id long, source string, item_id long, lat double, lon double, score double, match_id string")
    grid = [
        {"min_score": low, "locality_radius_km": radius, "locality_weight": 0.7, "top_k": top_k, "balance_beta": beta, "graph_top_n": n, "min_keep": keep}
        for low, radius, (top_k, beta), n, keep in product((-1e9, 0.3, 0.9), (0, 4), ((10, 0), (3, 0.5)), (0, 5), (0, 2.5, 6))
    ]
    got = {(x["id"], x["setting"]): x["item_id"] for x in sweeps.first_candidates(c, grid).collect()}
    want = {(q, n): first for q, items in lists.items() for n, s in enumerate(map(sweeps.complete, grid)) if (first := _first(items, s)) is not None}
    assert got == want


def test_lists_are_gathered_once_whatever_the_settings(spark):
    rows = [(q, "s", q * 10 + i, 48.0 + i / 100, 2.0, 0.1 * i, f"m{i}") for q in range(20) for i in range(5)]
    c = spark.createDataFrame(rows, "query_id long, source string, item_id long, lat double, lon double, score double, match_id string")
    grid = [{"locality_radius_km": 1 + k, "locality_weight": 0.5, "graph_top_n": 4, "min_keep": k % 2} for k in range(30)]
    plan = sweeps.first_candidates(c, grid)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1 and "Window" not in plan
