"""Distance joins against all pairs, where cells are narrow or meet around the circle."""

import random

from test_greedy import km


def test_pairs_in_the_north_and_across_the_date_line(spark):
    from terraloom.operators.spatial import radius_pairs

    rng = random.Random(5)
    centres = [(0.0, 0.0), (48.9, 2.3), (65.0, 25.0), (70.0, 20.0), (-75.0, -60.0), (70.0, 180.0), (10.0, -180.0), (89.5, 0.0), (-89.9, 77.0)]
    places = [(70.0, 20.0), (70.0, 20.0259), (10.0, 179.999), (10.0, -179.995), (90.0, 0.0), (89.999, 180.0), (-90.0, 10.0)]
    for la, lo in centres:
        spread = 0.03 if abs(la) < 80 else 180.0
        places += [(max(-90.0, min(90.0, la + rng.uniform(-0.02, 0.02))), (lo + rng.uniform(-spread, spread) + 540) % 360 - 180) for _ in range(40)]
    rows = [(k, *p) for k, p in enumerate(places)]
    points = spark.createDataFrame(rows, "id long, lat double, lon double")
    for radius in (1.0, 30.0, 3000.0):
        got = [(r["id"], r["other"]) for r in radius_pairs(points, points.withColumnRenamed("id", "other"), radius).collect()]
        want = {(a[0], b[0]) for a in rows for b in rows if km(a[1:], b[1:]) <= radius}
        assert len(got) == len(set(got)) and set(got) == want
    assert km(places[0], places[1]) < 1 > km(places[2], places[3])


def test_notes_meet_pins_across_the_date_line(spark):
    from terraloom.operators.spatial import matched_notes

    notes = spark.createDataFrame([(1, None, 5.0, 179.99998), (2, None, 5.0, -180.0), (3, None, 5.0, 2.0)], "note_id long, pin_id long, lat double, lon double")
    pins = spark.createDataFrame([(7, 5.00005, -179.99998), (8, 5.0, 2.00005), (9, 5.0, 2.0003)], "pin_id long, lat double, lon double")
    assert {tuple(r) for r in matched_notes(notes, pins).select("note_id", "pin_id").collect()} == {(1, 7), (2, 7), (3, 8)}
