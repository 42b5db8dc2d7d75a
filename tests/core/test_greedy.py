"""Greedy and stateful operators against plain loops, and edge cases of the scans."""

import math

import pytest


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    t = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 12742 * math.atan2(math.sqrt(t), math.sqrt(max(0.0, 1 - t)))


@pytest.fixture(scope="module")
def lists(spark, sf_dir):
    from terraloom.plans import overlay

    c = overlay.candidates(spark, sf_dir).cache()
    rows = {}
    for r in c.collect():
        rows.setdefault(r["query_id"], []).append(r)
    for v in rows.values():
        v.sort(key=lambda r: (-round(r["score"], 9), r["item_id"]))
    return c, rows


def test_diverse(lists):
    from terraloom.operators.greedy import diverse

    c, rows = lists
    want = set()
    for q, left in rows.items():
        left, taken = list(left), []
        taken.append(left.pop(0))
        while left and len(taken) < 8:
            values = [0.6 * r["score"] - 0.4 * math.exp(-min(km((r["lat"], r["lon"]), (t["lat"], t["lon"])) for t in taken) / 2) for r in left]
            taken.append(left.pop(values.index(max(values))))
        want |= {(q, t["item_id"]) for t in taken}
    assert {(r["query_id"], r["item_id"]) for r in diverse(c, 8, 2.0, 0.6).collect()} == want


def test_clusters_keep_every_row_and_merge_scores(lists):
    from terraloom.operators.greedy import clustered

    c, rows = lists
    got = clustered(c, 700.0).collect()
    assert {q: sum(r["n"] for r in got if r["query_id"] == q) for q in rows} == {q: len(v) for q, v in rows.items()}
    one = clustered(c, 1e9).collect()
    for r in one:
        prod = 1.0
        for x in rows[r["query_id"]]:
            prod *= 1 - min(0.999, max(0.0, x["score"]))
        assert r["n"] == len(rows[r["query_id"]]) and r["score"] == pytest.approx(1 - prod)


def test_suppression(spark):
    from terraloom.operators.greedy import suppressed

    rows = [(1, "a", 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, "a", 2, 0.8, 1.0, 1.0, 10.0, 10.0), (1, "b", 3, 0.7, 1.0, 1.0, 10.0, 10.0), (1, "a", 4, 0.6, 50.0, 50.0, 5.0, 5.0), (2, "a", 5, 0.1, 0.0, 0.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "image_id long, label string, det long, confidence double, x double, y double, w double, h double")
    assert {r["det"] for r in suppressed(d, 0.5).collect()} == {1, 3, 4, 5}
    assert suppressed(d.limit(0)).count() == 0


def test_tracks_take_the_first_within_the_gate(spark):
    from terraloom.streaming.tracks import tracks

    rows = [(1, 1, 1, 48.0, 2.0, 0.0), (1, 2, 2, 48.001, 2.0, 0.0), (1, 3, 3, 50.0, 2.0, 0.0), (1, 4, 4, 48.002, 2.0, 0.0), (2, 5, 1, 48.0, 2.0, 0.0), (2, 6, 0, 10.0, 2.0, 0.0)]
    f = spark.createDataFrame(rows, "sequence long, frame long, ts int, lat double, lon double, radius_m double")
    assert {r["frame"]: r["track"] for r in tracks(f, 1000.0).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 6: 0, 5: 1}


def test_windowed_counts_run_as_a_stream(spark, tmp_path):
    from terraloom.queries import _EVENTS
    from terraloom.streaming.events import windowed_counts

    batch = _EVENTS(spark, "/root/testdata/sf0.001")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counted").select("start", "kind", "n").collect())) == sorted(map(tuple, windowed_counts(batch).select("start", "kind", "n").collect()))


def test_scans(spark, tmp_path):
    from terraloom.sources import scan

    (tmp_path / "a.csv").write_text("Image,LATITUDE,lng,extra\nx.jpg,48.1,2.1,k\n,1,2,k\ny.jpg,abc,2,k\nz.jpg,95,2,k\nw.jpg,0.0,0.0,\n")
    ok, bad = scan.points(scan.read_metadata(spark, str(tmp_path / "a.csv")))
    assert {r["path"] for r in ok.collect()} == {"x.jpg", "w.jpg"} and {r["reason"] for r in bad.collect()} == {"no path", "no coordinates", "out of range"}
    (tmp_path / "t.jsonl").write_text('{"image": "a", "latitude": 0.0, "longitude": 0.0}\n{"image": "b", "latitude": 1.0, "longitude": 2.0, "group": "g"}\n')
    assert sorted(map(tuple, scan.read_ground_truth(spark, str(tmp_path / "t.jsonl")).collect())) == [("a", 0.0, 0.0, "ungrouped"), ("b", 1.0, 2.0, "g")]
    with pytest.raises(ValueError):
        scan.with_standard_names(spark.createDataFrame([(1,)], "x int"))


def test_boxes_across_the_date_line(spark):
    from pyspark.sql import functions as F

    from terraloom.functions import geo

    row = spark.range(1).select(
        geo.haversine_km(0.0, 179.9, 0.0, -179.9).alias("near"), geo.wrap_longitude(F.lit(180.0)).alias("same"), geo.wrap_longitude(F.lit(-190.0)).alias("wrapped"),
        geo.box_distance_km(F.lit(0.0), F.lit(-179.0), (-1, 1, 170, -170)).alias("inside"), geo.box_distance_km(F.lit(0.0), F.lit(160.0), (-1, 1, 170, -170)).alias("outside"),
    ).first()
    assert row.near == pytest.approx(22.239, abs=0.01) and row.same == 180 and row.wrapped == 170 and row.inside == 0 and row.outside == pytest.approx(1111.95, abs=0.1)
