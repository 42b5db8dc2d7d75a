"""Convex polygons as flat numpy arrays, for the batches of a task: ``x`` and ``y`` hold corner after corner, ``n`` how many
corners each polygon has. Steps work on all polygons of a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Below this, two lines count as parallel.
PARALLEL = 1e-9

Polygons = tuple[np.ndarray, np.ndarray, np.ndarray]


def corners(column: pa.Array) -> tuple[Polygons, np.ndarray]:
    """The polygons of an array of lists of (x, y), and which of them are null or have a null coordinate."""
    n = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = column.flatten()
    x, y = (pc.struct_field(points, axis).cast(pa.float64()) for axis in ("x", "y"))
    gaps = pc.or_(x.is_null(), y.is_null()).to_numpy(zero_copy_only=False)
    void = column.is_null().to_numpy(zero_copy_only=False) | (np.bincount(owners(n)[gaps], minlength=len(n)) > 0)
    return (x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False), n), void


def owners(n: np.ndarray) -> np.ndarray:
    """The polygon of every corner."""
    return np.repeat(np.arange(len(n)), n)


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _neighbours(n: np.ndarray, step: int) -> np.ndarray:
    """The place of the corner after (1) or before (-1) every corner, around its polygon."""
    start, of = _starts(n), owners(n)
    return start[of] + (np.arange(len(of)) - start[of] + step) % n[of]


def chosen(p: Polygons, which: np.ndarray) -> Polygons:
    """The polygons that a mask marks."""
    x, y, n = p
    at = np.repeat(which, n)
    return x[at], y[at], n[which]


def signed_area(p: Polygons) -> np.ndarray:
    """By the shoelace formula: positive where the corners run counter-clockwise."""
    x, y, n = p
    after = _neighbours(n, 1)
    return np.bincount(owners(n), x * y[after] - x[after] * y, minlength=len(n)) / 2


def counter_clockwise(p: Polygons) -> Polygons:
    x, y, n = p
    start, of = _starts(n), owners(n)
    at = np.arange(len(of))
    at = np.where((signed_area(p) < 0)[of], 2 * start[of] + n[of] - 1 - at, at)
    return x[at], y[at], n


def hulls(p: Polygons) -> tuple[np.ndarray, ...]:
    """x0, y0, x1, y1 of polygons that have corners."""
    x, y, n = p
    start = _starts(n)
    return np.minimum.reduceat(x, start), np.minimum.reduceat(y, start), np.maximum.reduceat(x, start), np.maximum.reduceat(y, start)


def clipped(subject: Polygons, clipper: Polygons) -> Polygons:
    """The part of each polygon inside its clipper, whose corners run counter-clockwise: one half plane after another keeps
    the corners on its side and adds where the outline crosses its edge."""
    (x, y, n), (qx, qy, qn) = subject, clipper
    start = _starts(qn)
    for k in range(int(qn.max(initial=0))):
        has = k < qn
        first, second = np.where(has, start + k, 0), np.where(has, start + (k + 1) % np.maximum(qn, 1), 0)
        ax, ay, ex, ey = qx[first], qy[first], qx[second] - qx[first], qy[second] - qy[first]
        of, before = owners(n), _neighbours(n, -1)
        within = ~(ex[of] * (y - ay[of]) - ey[of] * (x - ax[of]) < 0) | ~has[of]
        at = np.flatnonzero(within != within[before])
        o, s = of[at], before[at]
        dx, dy = x[at] - x[s], y[at] - y[s]
        across = dx * ey[o] - dy * ex[o]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((ax[o] - x[s]) * ey[o] - (ay[o] - y[s]) * ex[o]) / across
            flat = np.abs(across) < PARALLEL
            cx, cy = np.where(flat, x[at], x[s] + t * dx), np.where(flat, y[at], y[s] + t * dy)
        # before every corner there is room for a crossing
        both_x, both_y, used = np.repeat(x, 2), np.repeat(y, 2), np.repeat(within, 2)
        used[::2] = False
        both_x[2 * at], both_y[2 * at], used[2 * at] = cx, cy, True
        x, y, n = both_x[used], both_y[used], np.bincount(np.repeat(of, 2)[used], minlength=len(n))
    return x, y, n


def overlap(p: Polygons, q: Polygons) -> np.ndarray:
    """Intersection over union of each polygon with its partner; 0 where either has no area. Only pairs whose hulls meet are cut."""
    p_area, q_area = signed_area(p), signed_area(q)
    out = np.zeros(len(p_area))
    solid = (p_area != 0) & (q_area != 0)
    p, q = chosen(p, solid), chosen(q, solid)
    h, g = hulls(p) if len(p[2]) else np.empty((4, 0)), hulls(q) if len(q[2]) else np.empty((4, 0))
    meet = ~((h[2] <= g[0]) | (g[2] <= h[0]) | (h[3] <= g[1]) | (g[3] <= h[1]))
    at = np.flatnonzero(solid)[meet]
    inside = clipped(counter_clockwise(chosen(p, meet)), counter_clockwise(chosen(q, meet)))
    shared = np.where(inside[2] < 3, 0.0, np.abs(signed_area(inside)))
    rest = np.abs(p_area[at]) + np.abs(q_area[at]) - shared
    real = ~(shared <= 0) & ~(rest <= 0)
    out[at[real]] = shared[real] / rest[real]
    return out


def around(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners, a polygon a row: around their mean by falling angle, from the one of the least y, then x."""
    rows = np.arange(len(x))[:, None]
    mean = lambda z: z.cumsum(axis=1)[:, -1:] / z.shape[1]
    turned = np.argsort(-np.arctan2(y - mean(y), x - mean(x)), axis=1, kind="stable")
    x, y = x[rows, turned], y[rows, turned]
    first = np.lexsort((x, y), axis=1)[:, :1]
    ring = (first + np.arange(x.shape[1])) % x.shape[1]
    return x[rows, ring], y[rows, ring]


def headings(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The direction of the longer of the first two edges, in degrees from 0 to 360."""
    ax, ay, bx, by = x[:, 1] - x[:, 0], y[:, 1] - y[:, 0], x[:, 2] - x[:, 1], y[:, 2] - y[:, 1]
    first = np.hypot(ax, ay) >= np.hypot(bx, by)
    return (np.degrees(np.arctan2(np.where(first, ay, by), np.where(first, ax, bx))) + 360) % 360
