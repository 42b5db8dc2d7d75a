"""Sequence runs and session folds: stream, batch job and plain loop give the same rows."""

import json
import math
import random

import pytest


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    t = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 12742 * math.atan2(math.sqrt(t), math.sqrt(max(0.0, 1 - t)))


FRAMES = "sequence long, frame long, ts timestamp_ntz, lat double, lon double, radius_m double, tier string, candidates array<struct<item_id:long,lat:double,lon:double,w:double>>"


@pytest.fixture(scope="module")
def frames():
    import datetime

    rng, out = random.Random(3), []
    for k in range(240):
        s = rng.choice([1, 1, 1, 2, 3])
        c = [(i, 48 + rng.choice([0, 0.3]) + rng.random() / 20, 2 + rng.random() / 10, rng.random()) for i in range(rng.choice([0, 1, 4, 9]))]
        lat, lon = (c[0][1], c[0][2]) if c else (48.1, 2.05)
        out.append((s, k, datetime.datetime(2024, 5, 1) + datetime.timedelta(seconds=20 * k + rng.randrange(400) / 100), lat, lon, rng.choice([50.0, 900.0, 4000.0]), rng.choice(["low", "high"]), c))
    return out


def run_brute(rows, base=5000.0, expire=None):
    tracks, out = {}, {}
    for s, k, ts, lat, lon, radius, tier, c in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        mine = tracks.setdefault(s, [])
        total = sum(x[3] for x in c)
        w = [x[3] / total for x in c]
        found = None
        for n, t in enumerate(mine):
            if expire is not None and (ts - t["ts"]).total_seconds() > expire:
                continue
            if 1000 * km((lat, lon), t["at"]) <= base + 0.5 * (t["radius"] + radius):
                found = n
                break
        if found is not None and c and mine[found]["c"]:
            t = mine[found]
            sigma = min(25000.0, max(500.0, 0.5 * (t["radius"] + radius)))
            support = [sum(pw * math.exp(-0.5 * (1000 * km((x[1], x[2]), p) / sigma) ** 2) for p, pw in t["c"]) for x in c]
            logs = [math.log(max(1e-12, a)) + math.log(max(1e-12, b)) for a, b in zip(w, support, strict=True)]
            e = [math.exp(x - max(logs)) for x in logs]
            w = [x / sum(e) for x in e]
            lat, lon = sum(x[1] * a for x, a in zip(c, w, strict=True)), sum(x[2] * a for x, a in zip(c, w, strict=True))
            dx = [(x[2] - lon) * 111320 * math.cos(math.radians(lat)) for x in c]
            dy = [(x[1] - lat) * 111320 for x in c]
            xx, xy, yy = (sum(a * p * q for a, p, q in zip(w, u, v, strict=True)) for u, v in ((dx, dx), (dx, dy), (dy, dy)))
            spread = math.sqrt(max(0.0, (xx + yy) / 2 + math.sqrt(max(0.0, (xx - yy) ** 2 / 4 + xy * xy))))
            radius = max(spread, radius * max(0.55, 1 - 0.35 * min(1.0, max(support))))
            top = sorted([*w, 0.0], reverse=True)
            h = -sum(a * math.log(max(a, 1e-12)) for a in w) / math.log(max(2, len(w)))
            gap = top[0] - top[1]
            tier = "high" if top[0] >= 0.75 and gap >= 0.2 and h <= 0.55 else "medium" if top[0] >= 0.5 and gap >= 0.08 and h <= 0.8 else "low"
        state = {"at": (lat, lon), "radius": radius, "c": [((x[1], x[2]), a) for x, a in zip(c, w, strict=True)], "ts": ts}
        if found is None:
            mine.append(state)
            found = len(mine) - 1
        else:
            mine[found] = state
        out[s, k] = found, lat, lon, radius, tier, w
    return out


def check(rows, want):
    assert {(r["sequence"], r["frame"]) for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        track, lat, lon, radius, tier, w = want[r["sequence"], r["frame"]]
        assert (r["track"], r["tier"]) == (track, tier), r
        assert (r["mean_lat"], r["mean_lon"], r["radius_m"]) == pytest.approx((lat, lon, radius), rel=1e-7)
        assert sorted((x["w"] for x in r["weights"]), reverse=True) == pytest.approx(sorted(w, reverse=True), abs=1e-9)
        assert r["top1"] == pytest.approx(max(w, default=0.0))


@pytest.mark.parametrize("expire", [None, 300.0])
def test_a_sequence_run_is_the_loop(spark, frames, expire):
    from terraloom.streaming.sequences import sequence_run

    df = spark.createDataFrame(frames + frames[:5], FRAMES)
    want = run_brute(frames, expire=expire)
    if expire:
        assert want != run_brute(frames)
    check(sequence_run(df, expire_s=expire).collect(), want)
    assert sequence_run(df.limit(0)).count() == 0


def streamed(spark, tmp_path, rows, schema, build, name):
    """Writes the rows as files, one a micro-batch, in their given order."""
    import os

    folder = tmp_path / name
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"b{k:03d}"))
        for file in sorted((folder / f"b{k:03d}").glob("*.parquet")):
            os.utime(file, (1_700_000_000 + 60 * k,) * 2)
    stream = spark.readStream.schema(spark.read.parquet(str(folder / "b000")).schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "b*"))
    query = build(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_a_stream_of_shuffled_batches_is_the_batch(spark, frames, tmp_path):
    import datetime

    from terraloom.streaming.sequences import sequence_stream

    rng = random.Random(4)
    rows = sorted(frames, key=lambda r: r[1] + rng.randrange(12))  # late by twelve frames at most
    late_end = (9, 10_000, datetime.datetime(2024, 5, 2), 0.0, 0.0, 1.0, "low", [])
    parts = [rows[k : k + 40] for k in range(0, 240, 40)]
    parts[3] = parts[3] + parts[2][-3:]  # repeated
    got = streamed(spark, tmp_path, [*parts, [late_end]], FRAMES, lambda s: sequence_stream(s, late="10 minutes"), "frames_run")
    check([r for r in got if r["sequence"] != 9], run_brute(frames))


EVENTS = "session long, ts timestamp_ntz, event_id long, action string, target string, item long, rank int, n int, lat double, lon double, text string"


@pytest.fixture(scope="module")
def events():
    import datetime

    rng, out = random.Random(8), []
    for k in range(1, 500):
        action = rng.choice(["load", "pin", "pin", "note", "note", "note", "delete_note", "delete_pin", "confirm", "refuse", "refuse", "other"]) if k > 6 else "load"
        place = rng.choice([(48.1, 2.1), (48.2, 2.2), (48.10005, 2.1), (None, 2.0)])
        session = rng.randrange(3)
        known = [r[2] for r in out if r[0] == session and r[3] in ("pin", "note")]
        out.append((session, datetime.datetime(2024, 5, 1) + datetime.timedelta(seconds=10 * k), k, action, rng.choice(["note", "candidate", "pin", None]), rng.choice(known[-6:] or [0]) if rng.random() < 0.8 else None, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice([0, 4, 7]), *place, rng.choice(["a", "", None])))
    return out


def session_brute(rows):
    """Plain lists of tuples, replayed in order: (timeline line, counts) of every event that does something."""
    held, out = {}, []
    for s, _, eid, action, target, item, rank, n, lat, lon, text in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        h = held.setdefault(s, {"pins": {}, "notes": {}, "cands": [], "lines": 0})
        near = lambda a, b: None not in (*a, *b) and abs(a[0] - b[0]) < 1e-4 and abs(a[1] - b[1]) < 1e-4
        owns = lambda note, pid: note["t"] == "pin" and (note["pin"] == pid or near(note["at"], h["pins"][pid]))  # noqa: B023, E731
        did = True
        if action == "load":
            h["cands"] = [[k + 1, 0] for k in range(n)]
        elif action == "pin" and lat is not None:
            h["pins"][eid] = (lat, lon)
        elif action == "note":
            hit = None
            for i, note in h["notes"].items():
                if target == "note" and i == item or target == "candidate" and note["t"] == "candidate" and note["r"] == rank or target == "pin" and note["t"] == "pin" and near(note["at"], (lat, lon)):
                    hit = note
                    break
            if hit is None:
                h["notes"][eid] = {"t": target, "r": rank, "at": (lat, lon), "pin": item if target == "pin" else None}
            elif target == "pin" and item is not None:
                hit["pin"] = item
        elif action == "delete_note" and item in h["notes"]:
            note = h["notes"].pop(item)
            h["pins"] = {p: at for p, at in h["pins"].items() if not owns(note, p)}
        elif action == "delete_pin" and item in h["pins"]:
            h["notes"] = {i: note for i, note in h["notes"].items() if not owns(note, item)}
            del h["pins"][item]
        elif action in ("confirm", "refuse") and rank and rank <= len(h["cands"]):
            if action == "confirm":
                h["cands"][rank - 1][1] = 1
            else:
                h["cands"].pop(rank - 1)
        else:
            did = False
        if did:
            h["lines"] += 1
            out.append((s, eid, h["lines"], len(h["pins"]), len(h["notes"]), len(h["cands"]), sum(ok for _, ok in h["cands"]), h["cands"][0][0] if h["cands"] else None))
    return out


COUNTS = ("session", "event_id", "at", "n_pins", "n_notes", "n_candidates", "n_confirmed", "top")


def test_sessions_replay_as_the_loop(spark, events, tmp_path):
    import datetime

    from terraloom.streaming import sessions

    df = spark.createDataFrame(events + events[:9], EVENTS)  # repeated events are one
    want = session_brute(events)
    got = sessions.timeline(df).collect()
    assert sorted([tuple(r[c] for c in COUNTS) for r in got], key=repr) == sorted(want, key=repr)
    assert {r["message"] for r in got} >= {"rank 1 refused", "rank 2 confirmed", "note deleted", "pin deleted", "7 candidates"}
    rng = random.Random(2)
    rows = sorted(events, key=lambda r: r[2] + rng.randrange(20))
    end = (99, datetime.datetime(2024, 5, 3), 10_000, "other", *[None] * 7)
    stream = streamed(spark, tmp_path, [*(rows[k : k + 100] for k in range(0, 499, 100)), [end]], EVENTS, lambda s: sessions.timeline_stream(s, "5 minutes"), "lines")
    assert sorted([tuple(r[c] for c in COUNTS) for r in stream], key=repr) == sorted(want, key=repr)
    states = {r["session"]: r for r in sessions.session_states(sessions.timeline(df)).collect()}
    for s in (0, 1, 2):
        last = max((w for w in want if w[0] == s), key=lambda w: w[2])
        assert tuple(states[s][c] for c in COUNTS[3:]) == last[3:] and states[s]["lines"] == last[2]
    cases = spark.createDataFrame([(1, 0, 5), (1, 0, 7), (1, 1, 6), (2, 2, 1), (2, 77, 3)], "case_id int, session long, added int")
    listed = {r["case_id"]: r for r in sessions.case_listing(cases, sessions.session_states(sessions.timeline(df))).collect()}
    assert (listed[1]["n_sessions"], listed[1]["last_added"], listed[2]["n_sessions"]) == (2, 7, 2)
    assert listed[2]["n_pins"] == states[2]["n_pins"] and json.dumps(listed[1]["n_notes"]) == str(states[0]["n_notes"] + states[1]["n_notes"])
