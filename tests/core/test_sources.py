"""Ground truth in its four forms, and metadata from several tables by id, path or base name."""

import json

import pytest


def _dict_loop(records, tables, fields):
    """A dictionary of keys, the first table's entry kept."""

    def keys(row):
        from terraloom.sources.enrichment import IDS, PATHS

        paths = [str(row[c]).strip().replace("\\", "/").lower() for c in PATHS if row.get(c)]
        paths = [p.lstrip(".").lstrip("/") if p.startswith("./") else p for p in paths]
        ids = [f"id:{str(row[c]).strip()}" for c in IDS if str(row.get(c) or "").strip()]
        return ids + [f"path:{p}" for p in paths if p] + [f"name:{p.rsplit('/', 1)[-1]}" for p in paths if p]

    known, out = {}, []
    for table in tables:
        for row in table:
            for k in keys(row):
                known.setdefault(k, row)
    for row in map(dict, records):
        match = next((known[k] for k in keys(row) if k in known), {})
        row["changed"] = False
        for f in fields:
            row.setdefault(f, None)
            if row[f] in (None, "") and match.get(f) not in (None, ""):
                row[f], row["changed"] = match[f], True
        out.append(row)
    return sorted(out, key=repr)


def test_metadata_of_several_tables(spark):
    from terraloom.sources.enrichment import enriched

    names = ["id", "path", "source", "key", "changed"]
    records = [
        (1, "./A/x.JPG", None, "k", "old"), (2, "b\\y.jpg", "", "k", None), (3, "c/z.jpg", "mine", None, None), (4, None, None, None, None), (None, "q/x.jpg", None, "", "old"),
        (None, None, None, None, None), (2, "b\\y.jpg", "", "k", None), (7, "", "", None, None), *[(100 + k, f"d{k}/same.jpg", None, None, None) for k in range(50)],
    ]
    one = [{"id": "1", "source": "", "camera_type": None}, {"id": "7", "source": "seven", "camera_type": "c7"}]
    two = [{"image_path": "B/y.jpg", "source": "two", "sequence": "s2"}, {"image_path": "elsewhere/x.jpg", "source": "byname", "sequence": ""}, {"image_path": "r/same.jpg", "source": "same", "sequence": "t"}]
    three = [{"query_path": "b/Y.jpg", "source": "late", "sequence": "late"}, {"query_path": "c/z.jpg", "source": "three", "sequence": "s3"}]
    schema = "id long, path string, source string, key string, changed string"
    frame = spark.createDataFrame(records, schema)
    tables = [spark.createDataFrame([tuple(r.values()) for r in t], ", ".join(f"{c} string" for c in t[0])) for t in (one, two, three)]
    out = enriched(frame, tables)
    fields = ["camera_type", "source", "sequence"]
    got = sorted(({k: r[k] for k in ("id", "path", "source", "key", "changed", "camera_type", "sequence")} for r in out.collect()), key=lambda r: repr(sorted(r.items(), key=repr)))
    want = sorted(_dict_loop([dict(zip(names, r, strict=True)) for r in records], (one, two, three), fields), key=lambda r: repr(sorted(r.items(), key=repr)))
    assert got == want and sum(r["changed"] for r in got) == 55  # 50 + 2 + 1 + 1 + 1
    assert enriched(frame, []).where("changed").count() == 0
    assert enriched(frame.limit(0), tables).count() == 0 and enriched(frame, [t.limit(0) for t in tables]).where("changed").count() == 0
    bad = spark.createDataFrame([("1", "x"), ("2", "2.5")], "id string, value string")
    typed = enriched(spark.createDataFrame([(1, None), (2, None)], "id long, value double"), [bad], ["value"]).orderBy("id").collect()
    assert [(r["value"], r["changed"]) for r in typed] == [(None, False), (2.5, True)]


@pytest.mark.parametrize("form", ["csv", "jsonl", "json", "object"])
def test_truth_in_four_forms(spark, tmp_path, form):
    from terraloom.sources.scan import read_ground_truth

    rows = [("a.jpg", 1.0, 2.0, "g"), ("b.jpg", 0.0, 0.0, ""), ("a.jpg", 3.0, 4.0, None), ("c.jpg", None, 2.0, "g"), ("d.jpg", 5.0, 6.0, "h")]
    items = [{"image": i, "latitude": a, "longitude": b, "group": g} for i, a, b, g in rows]
    path = tmp_path / f"t.{'json' if form == 'object' else form}"
    if form == "csv":
        path.write_text("image,latitude,longitude,group\n" + "".join(f"{i},{'' if a is None else a},{b},{g or ''}\n" for i, a, b, g in rows))
    elif form == "jsonl":
        path.write_text("\n".join(map(json.dumps, items)))
    elif form == "json":
        path.write_text(json.dumps(items, indent=1))
    else:
        path.write_text("{" + ", ".join(f"{json.dumps(x['image'])}: {json.dumps(x)}" for x in items) + ', "e.jpg": 3, "f.jpg": null}')
    got = sorted(map(tuple, read_ground_truth(spark, str(path)).select("image", "lat", "lon", "grp").collect()))
    assert got == [("a.jpg", 3.0, 4.0, "ungrouped"), ("b.jpg", 0.0, 0.0, "ungrouped"), ("d.jpg", 5.0, 6.0, "h")]


def test_unreadable_objects_give_nothing(spark):
    from terraloom.sources.scan import keyed_truth

    texts = spark.createDataFrame([(0, None), (1, ""), (2, "not json"), (3, "[]"), (4, '{"a": {"lat": "x", "lon": 1}, "b": {"lat": 1, "lon": 2}}')], "n int, text string")
    assert [tuple(r) for r in keyed_truth(texts, "text", "n").select("image", "lat", "lon", "grp").collect()] == [("b", 1.0, 2.0, "ungrouped")]


@pytest.mark.parametrize("radius,most", [(0.0, 0), (0.0, 37), (1500.0, 0), (1500.0, 20), (1500.0, 10_000)])
def test_indices_merge_in_their_order(spark, radius, most):
    import math
    import random

    from terraloom.operators.merge import merge_indices

    rng, schema = random.Random(5), "n long, match_id string, path string, lat double, lon double, embedding array<double>"
    row = lambda n: (n, f"m{rng.randrange(60)}", rng.choice(["p", "q", None]), 48 + rng.random() / 20, 2 + rng.random() / 20, [rng.random() - 0.5 for _ in range(2)])
    tables = [[row(n) for n in range(90)] for _ in range(3)]
    tables[1] += [(-1, "first", "p", 48.0, 2.0, [3.0, 0.0]), (200, "m1", "far", 95.0, 2.0, [1.0, 0.0]), (201, "m1", "none", 48.0, 2.0, None)]

    def metres(a, b):
        p, q = math.radians(a[3]), math.radians(b[3])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
        return 12_742_000 * math.asin(math.sqrt(h))

    def cosine(a, b):
        return sum(x * y for x, y in zip(a[5], b[5], strict=True)) / math.hypot(*a[5]) / math.hypot(*b[5])

    seen, want = set(), []
    for origin, table in enumerate(tables):
        for r in sorted(table, key=lambda r: r[0]):
            if r[3] > 90 or r[5] is None or (r[1], r[2]) in seen:
                continue
            seen.add((r[1], r[2]))
            if not radius or not any(metres(r, k) <= radius and cosine(r, k) >= 0.8 for _, k in want):
                want.append((origin, r))
    want = [(origin, r[0], r[1], r[2]) for origin, r in want][: most or None]
    got = merge_indices([spark.createDataFrame(t, schema) for t in tables], "n", radius_m=radius, least_cosine=0.8, most=most)
    assert [tuple(r) for r in got.orderBy("item_id").select("origin", "n", "match_id", "path").collect()] == want
    assert got.where("abs(sqrt(aggregate(embedding, 0d, (s, x) -> s + x * x)) - 1) > 1e-9").count() == 0
    if not radius and not most:
        assert merge_indices([got.withColumn("n", got.n).limit(0)], "n").count() == 0
