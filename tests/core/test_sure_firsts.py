"""Rows that come first of all their keys are taken without a walk; what they leave gives what one walk gives."""

import random

from test_ordered_choices import merge_brute


def test_few_rows_are_walked(spark, monkeypatch):
    from terraloom.operators import mining, ranges

    rng = random.Random(12)
    rows = [(at, rng.randrange(900), rng.randrange(120)) for at in rng.sample(range(10**6), 4000)]
    frame = spark.createDataFrame(rows, "at long, a long, b long")
    walked, settled = [], ranges.settled
    monkeypatch.setattr(ranges, "settled", lambda r, *more: walked.append(r.count()) or settled(r, *more))
    assert sorted(r["at"] for r in mining.merged_once(frame, ["a", "b"], ["at"], 200).collect()) == merge_brute(rows)
    assert walked.pop() <= 200 and not walked


def test_rows_equal_in_all_are_taken_once(spark):
    from terraloom.operators import mining

    frame = spark.createDataFrame([(1, 5, 7)] * 40 + [(2, 5, 8)] * 40 + [(3, 6, 8)] * 40, "at long, a long, b long")
    assert sorted(r["at"] for r in mining.merged_once(frame, ["a", "b"], ["at"], 10).collect()) == [1, 3]
