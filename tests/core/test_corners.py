"""Oriented boxes are made once a row, whatever reads their corners, and odd ones give what they gave."""

import pytest
from pyspark.sql import functions as F

QUAD = "array<struct<x:double,y:double>>"


def _boxes(spark, n):
    from terraloom.functions import quads

    n = spark.range(n).select("id", *((F.col("id") % m).cast("double").alias(c) for c, m in (("x", 7), ("y", 5), ("w", 11), ("h", 13), ("turn", 180))))
    return n.select("id", F.lit(0.5).alias("confidence"), F.lit(None).cast("double").alias("heading_deg"), quads.box_quad(*map(F.col, ("x", "y", "w", "h", "turn"))).alias("quad"))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_makes_no_corner_twice(spark):
    from terraloom.functions import quads

    plan = _plan(quads.oriented_detections(_boxes(spark, 100), 0.35, 4.0))
    assert 0 < plan.count("COS(") <= 8 and "lambda" not in plan


def test_odd_quads_are_filtered(spark):
    from terraloom.functions import quads

    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    rows = [(0, 0.9, square, None), (1, 0.9, None, None), (2, 0.9, square[:3], None), (3, 0.9, [], 1.0), (4, 0.9, [*square[:3], None], None), (5, 0.9, [*square[:3], (None, 3.0)], None), (6, None, square, None), (7, 0.9, [(1.0, 1.0)] * 4, None), (8, 0.9, square[::-1], 7.0), (9, 0.9, [*square, (0.0, 1.0)], None)]
    frame = spark.createDataFrame(rows, f"k int, confidence double, quad {QUAD}, heading_deg double")
    got = {r["k"]: ([tuple(c) for c in r["quad"]], r["heading_deg"]) for r in quads.oriented_detections(frame, 0.5, 4.0).collect()}
    ring = [(0.0, 0.0), (0.0, 3.0), (4.0, 3.0), (4.0, 0.0)]
    assert got == {0: (ring, 0.0), 8: (ring, 7.0)}
    assert quads.oriented_detections(frame.limit(0), 0.5).count() == 0


def test_overlaps_make_no_corner_twice(spark, sf_dir):
    from terraloom.queries_assessed import _overlaps

    plan = _plan(_overlaps(spark, sf_dir))
    assert 0 < plan.count("COS(") <= 16 and "lambda" not in plan
    assert plan.index("COS(") < plan.index("Join")  # corners are made of pairs: the join shuffles a box's numbers


def test_overlap_of_odd_polygons(spark):
    from terraloom.functions import quads

    square, three, six = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)], [(-1.0, 1.0), (0.0, -1.0), (2.0, -1.0), (3.0, 1.0), (2.0, 3.0), (0.0, 3.0)]
    pairs = [(square, three, 0.5), (three, square, 0.5), (square, six, 4 / 12), (six, square[::-1], 4 / 12), (square, [], 0.0), ([], [], 0.0), (None, square, None), (square, [*square[:3], None], None), (square, square[:2], 0.0), (square, square, 1.0)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], f"k int, a {QUAD}, b {QUAD}")
    got = {r["k"]: r["iou"] for r in rows.select("k", quads.quad_iou(F.col("a"), F.col("b")).alias("iou")).collect()}
    for k, (_, _, want) in enumerate(pairs):
        assert got[k] is None if want is None else got[k] == pytest.approx(want)
