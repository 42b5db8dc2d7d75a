"""Oriented boxes: convex quads as arrays of four corners (x, y). Boxes are made in the JVM; corners are compared by numpy,
a batch at a time, as loops over corners within a column are costly and are written out anew wherever a filter takes them in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from . import polygons


def _corner(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_quad(x: Column, y: Column, w: Column, h: Column, degrees: Column) -> Column:
    """The corners of the box at (x, y) of the given size, turned around its centre."""
    c, s, cx, cy = F.cos(F.radians(degrees)), F.sin(F.radians(degrees)), x + w / 2, y + h / 2
    at = lambda u, v: _corner(cx + u * w / 2 * c - v * h / 2 * s, cy + u * w / 2 * s + v * h / 2 * c)
    return F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1))


def _overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    (p, p_void), (q, q_void) = polygons.corners(a), polygons.corners(b)
    return pa.array(polygons.overlap(p, q), pa.float64(), mask=p_void | q_void)


def quad_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two convex polygons; 0 where either has no area. Quads whose hulls are apart are not cut."""
    return F.arrow_udf(_overlap, DoubleType())(a, b)


def oriented_detections(detections: DataFrame, min_confidence: float, min_area: float = 16.0) -> DataFrame:
    """Detections (confidence, quad, heading_deg, others) that reach the confidence and the area, with their corners in
    canonical order and missing headings filled from the longer edge. Null confidences don't pass."""
    corner = "array<struct<x:double,y:double>>"
    sure = detections.where(F.col("confidence") >= min_confidence).withColumns({"quad": F.col("quad").cast(corner), "heading_deg": F.col("heading_deg").cast("double")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quad, void = polygons.corners(batch.column("quad"))
            area = np.abs(polygons.signed_area(quad))
            whole = (quad[2] == 4) & ~void & (area >= max(1e-3, min_area))
            x, y = polygons.around(*(z.reshape(-1, 4) for z in polygons.chosen(quad, whole)[:2]))
            ends = pa.array(np.arange(0, 4 * len(x) + 1, 4, dtype=np.int32))
            kept = batch.filter(pa.array(whole))
            given = kept.column("heading_deg")
            filled = given.fill_null(0.0).to_numpy(zero_copy_only=False)
            made = {
                "quad": pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x.ravel()), pa.array(y.ravel())], ["x", "y"])),
                "heading_deg": pa.array(np.where(given.is_null().to_numpy(zero_copy_only=False), polygons.headings(x, y), filled)),
            }
            yield pa.RecordBatch.from_arrays([made.get(name, kept.column(name)) for name in kept.schema.names], names=kept.schema.names)

    return sure.mapInArrow(run, StructType([f if f.name not in ("quad", "heading_deg") else type(f)(f.name, f.dataType) for f in sure.schema]))
