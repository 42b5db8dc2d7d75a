"""Operator sessions folded from their events: pins, notes, and candidates that are confirmed or refused.

An event is a row of session, ts, event_id, action and the fields that the action needs (others null): ``load`` (n: as many
candidates, ranked from 1), ``pin`` (item, lat, lon, text), ``note`` (target note, candidate or pin; item, rank, lat, lon,
text), ``delete_note`` and ``delete_pin`` (item), ``confirm`` and ``refuse`` (rank). The order matters: refusing renumbers
what is left, so that a later rank means another candidate; a note on a candidate, on a pin's place or on a note's id
changes the one that is there. Every event that changes something is a line of the timeline, which is the output, with the
session's counts after it; the state of a session is what it holds now, so that it stays as small as the session itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import folded, folded_stream

#: Places that differ by less than this are one pin's place.
NEAR = 1e-4
SCHEMA = "session long, event_id long, at int, message string, n_pins int, n_notes int, n_candidates int, n_confirmed int, top long"


def _same_place(a: dict, b: dict) -> bool:
    return None not in (a["lat"], a["lon"], b["lat"], b["lon"]) and abs(a["lat"] - b["lat"]) < NEAR and abs(a["lon"] - b["lon"]) < NEAR


def _of_pin(note: dict, pin: dict) -> bool:
    return note["target"] == "pin" and (note["item"] == pin["item"] or _same_place(note, pin))


def _noted(s: dict, e: dict) -> None:
    match = {"note": lambda n: n["id"] == e["item"], "candidate": lambda n: n["target"] == "candidate" and n["rank"] == e["rank"], "pin": lambda n: n["target"] == "pin" and _same_place(n, e)}.get(e["target"], lambda n: False)
    note = next(filter(match, s["notes"]), None)
    if note is None:
        note = {"id": e["event_id"], "target": e["target"], "rank": e["rank"], "lat": e["lat"], "lon": e["lon"], "item": e["item"] if e["target"] == "pin" else None}
        s["notes"].append(note)
    note["text"] = e["text"]
    if e["target"] == "pin":
        note["item"] = e["item"] if e["item"] is not None else note["item"]
        pin = next((p for p in s["pins"] if _of_pin(note, p)), None)
        if pin:
            pin["text"], pin["note"] = e["text"] or pin["text"], note["id"]


def step(s: dict | None, e: dict) -> tuple[dict, list[tuple]]:
    s = s or {"pins": [], "notes": [], "candidates": [], "lines": 0}
    done, action = None, e["action"]
    if action == "load":
        s["candidates"], done = [{"id": k, "ok": False} for k in range(1, (e["n"] or 0) + 1)], f"{e['n'] or 0} candidates"
    elif action == "pin" and e["lat"] is not None and e["lon"] is not None:
        s["pins"].append({"item": e["event_id"], "lat": e["lat"], "lon": e["lon"], "text": e["text"] or "pin", "note": None})
        done = "pin added"
    elif action == "note":
        _noted(s, e)
        done = "note taken"
    elif action == "delete_note" and (note := next((n for n in s["notes"] if n["id"] == e["item"]), None)):
        s["notes"].remove(note)
        s["pins"] = [p for p in s["pins"] if not _of_pin(note, p)]
        done = "note deleted"
    elif action == "delete_pin" and (pin := next((p for p in s["pins"] if p["item"] == e["item"]), None)):
        s["pins"].remove(pin)
        s["notes"] = [n for n in s["notes"] if not _of_pin(n, pin)]
        done = "pin deleted"
    elif action in ("confirm", "refuse") and 1 <= (e["rank"] or 0) <= len(s["candidates"]):
        if action == "confirm":
            s["candidates"][e["rank"] - 1]["ok"] = True
        else:
            del s["candidates"][e["rank"] - 1]  # the ranks of those behind it fall by one
        done = f"rank {e['rank']} {action}ed" if action == "confirm" else f"rank {e['rank']} refused"
    if done is None:
        return s, []
    s["lines"] += 1
    top = s["candidates"][0]["id"] if s["candidates"] else None
    return s, [(e["session"], e["event_id"], s["lines"], done, len(s["pins"]), len(s["notes"]), len(s["candidates"]), sum(c["ok"] for c in s["candidates"]), top)]


def timeline(events: DataFrame) -> DataFrame:
    return folded(events, "session", "ts", "event_id", step, SCHEMA)


def timeline_stream(events: DataFrame, late: str = "10 minutes", expire_s: float | None = None) -> DataFrame:
    return folded_stream(events, "session", "ts", "event_id", step, SCHEMA, late, expire_s)


def session_states(lines: DataFrame) -> DataFrame:
    """Each session's counts after its last line."""
    return lines.groupBy("session").agg(F.max_by(F.struct("n_pins", "n_notes", "n_candidates", "n_confirmed", "top"), "at").alias("s"), F.max("at").cast("int").alias("lines")).select("session", "lines", "s.*")


def case_listing(cases: DataFrame, states: DataFrame) -> DataFrame:
    """Per case (case_id, session, added; a session may be in several cases, and counts once in each): its sessions, those
    with a confirmed candidate, pins and notes, and when the last was added."""
    once = cases.groupBy("case_id", "session").agg(F.max("added").alias("added"))
    joined = once.join(states, "session", "left")
    return joined.groupBy("case_id").agg(F.count("session").alias("n_sessions"), F.count_if(F.col("n_confirmed") > 0).alias("n_confirmed"), F.coalesce(F.sum("n_pins"), F.lit(0)).alias("n_pins"), F.coalesce(F.sum("n_notes"), F.lit(0)).alias("n_notes"), F.max("added").alias("last_added"))
