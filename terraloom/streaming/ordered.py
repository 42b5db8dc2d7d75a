"""Folds whose steps don't commute: each key's events are taken in the order of their times, by a batch job or by a stream.

The batch job deals events by key, sorts each partition by key, time and id, and walks through it with one key's state in
memory; a key of any length streams through. The stream holds back what is later than the watermark and takes the rest in
order when the watermark has passed it, so that micro-batches in any order, within the allowed delay, give what the batch
gives. State is the fold's own state and the events that are held back; a key that was idle for ``expire`` loses it.

Events of one key with equal time and id are one event; the first that comes is taken. In a stream, events that come after
the watermark are left out (Spark drops them), as are repeats of events that were already taken; a batch has no late events.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: state, event -> state, rows; the first state is None, and the event has the columns of its row.
Step = Callable[[object, dict], tuple[object, list[tuple]]]


def _events(rows: DataFrame, key: str, ts: str, event_id: str) -> DataFrame:
    payload = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(event_id).cast("long").alias("id"), payload.alias("payload"))


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names, dtype=object)


def folded(rows: DataFrame, key: str, ts: str, event_id: str, step: Step, schema: str) -> DataFrame:
    """What ``step`` gives for every event of a bounded table. Rows without a key, time or id are left out."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, state = object(), None, None
        for pdf in batches:
            out = []
            for k, us, i, payload in zip(pdf["key"], pdf["us"], pdf["id"], pdf["payload"], strict=True):
                if k != at:
                    at, last, state = k, None, None
                if (us, i) != last:
                    last = us, i
                    state, done = step(state, json.loads(payload))
                    out += done
            yield _frame(out, names)

    events = _events(rows, key, ts, event_id).where("key is not null and us is not null and id is not null")
    return events.repartition("key").sortWithinPartitions("key", "us", "id", "payload").select("key", "us", "id", "payload").mapInPandas(run, schema)


def folded_stream(rows: DataFrame, key: str, ts: str, event_id: str, step: Step, schema: str, late: str = "10 minutes", expire_s: float | None = None) -> DataFrame:
    """The same for a stream, in append mode; events may come ``late`` after others of later times."""
    names = StructType.fromDDL(schema).names

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        pending, last, state = pickle.loads(group.get[0]) if group.exists else ({}, None, None)
        for pdf in pdfs:
            for us, i, payload in zip(pdf["us"].tolist(), pdf["id"].tolist(), pdf["payload"], strict=True):
                if last is None or (us, i) > last:
                    pending.setdefault((us, i), payload)
        mark, out = group.getCurrentWatermarkMs(), []
        for at in sorted(x for x in pending if x[0] <= mark * 1000):
            last = at
            state, done = step(state, json.loads(pending.pop(at)))
            out += done
        if not pending and last is not None and expire_s is not None and mark * 1000 > last[0] + expire_s * 1e6:
            group.remove()
        else:
            group.update((pickle.dumps((pending, last, state)),))
            wake = min(pending)[0] // 1000 if pending else None if expire_s is None or last is None else int(last[0] / 1000 + expire_s * 1000)
            if wake is not None:
                group.setTimeoutTimestamp(max(wake, mark + 1))
        yield _frame(out, names)

    events = _events(rows, key, ts, event_id).where("key is not null and us is not null and id is not null").withWatermark("ts", late)
    return events.groupBy("key").applyInPandasWithState(run, schema, "state binary", "append", "EventTimeTimeout")
