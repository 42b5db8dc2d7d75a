"""Joins by distance and bounding box, spatial splits, de-duplication, sequences and detections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import angle_between, grid_cell, haversine_km
from ..sources.stage import written


#: No two places are farther apart.
HALF_ROUND_KM = 20_016.0


def _ring(lon, n: Column) -> Column:
    """The cell of a longitude among ``n`` equal ones around the circle."""
    return F.least(F.floor(F.pmod(F.col(lon) + 180, F.lit(360.0)) / 360 * n).cast("long"), n - 1)


def _around(cy: Column, lon: str, ring) -> Column:
    """The cells (cy, cx) of three bands and, in each, of three cells around the circle; no cell twice."""
    cells = lambda y, n: F.transform(F.array_distinct(F.array(*(F.pmod(_ring(lon, n) + k, n) for k in (-1, 0, 1)))), lambda x: F.struct(y.alias("cy"), x.alias("cx")))
    return F.explode(F.concat(*(cells(cy + k, ring(cy + k)) for k in (-1, 0, 1))))


def radius_pairs(left: DataFrame, right: DataFrame, radius_km: float) -> DataFrame:
    """All pairs within the radius, with ``km``; the right side's place is r_lat, r_lon. Both sides are dealt by grid cells:
    bands at least as high as the radius, each cut around the circle into cells at least as wide as the radius spans at the
    band's outer latitude (a single cell next to the poles). The right side goes to the cells around its own in three
    bands, at most nine, so that one equi-join by cell finds every pair, also across 180 degrees. Crowded cells can be
    split by the engine's skew join."""
    size = max(radius_km, 1e-6) / 110.574

    def ring(cy: Column) -> Column:
        outer = F.greatest(F.abs(cy * size), F.abs((cy + 1) * size))
        span = F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(min(size, 90.0))) / F.cos(F.radians(F.least(outer, F.lit(90.0)))))))
        return F.when(outer + size >= 90, F.lit(1).cast("long")).otherwise(F.floor(360 / span).cast("long"))

    band = lambda c: F.floor(F.col(c) / size).cast("long")
    r = right.withColumnsRenamed({"lat": "r_lat", "lon": "r_lon"}).withColumn("_d", _around(band("r_lat"), "r_lon", ring))
    r = r.withColumns({"cy": F.col("_d.cy"), "cx": F.col("_d.cx")}).drop("_d")
    return left.withColumns({"cy": band("lat"), "cx": _ring("lon", ring(band("lat")))}).join(r, ["cy", "cx"]).withColumn("km", haversine_km("lat", "lon", "r_lat", "r_lon")).where(F.col("km") <= radius_km).drop("cy", "cx")


def running_totals(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``order`` and ``name``: the total of ``value`` over all rows before, by ``order``. Two levels: the rows' ranges are
    written and summed, one number a range; a window then runs within each range."""
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.select(order, value).repartitionByRange(width, order).withColumn("_part", F.spark_partition_id()), "running")
    parts = ranged.groupBy("_part").agg(F.sum(value).alias("_all"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("_part", F.coalesce(F.sum("_all").over(before(Window.orderBy("_part"))), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(value).over(before(Window.partitionBy("_part").orderBy(order))), F.lit(0))
    return ranged.withColumn("_in", inside).join(F.broadcast(base), "_part").select(order, (F.col("_base") + F.col("_in")).alias(name))


def _back(rows: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with what was found for their values of ``by``; nulls are equal."""
    named = found.withColumnsRenamed({c: f"_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return rows.join(named, same).drop(*(f"_{c}" for c in by))


def nearest(left: DataFrame, right: DataFrame, key: str, order: list[Column], tie: str, radius_km: float, n: int = 1) -> DataFrame:
    """The first ``n`` of the right side within the radius for every ``key``, by ``order``, then the least ``tie``, the right
    side's id. ``order`` may use ``km`` and the other columns of both sides. Rows that agree in these are one: left ones are
    answered together, and of right ones the ``n`` of the least ids go on, so that crowded places are not paired row by row."""
    by, by_right = [c for c in left.columns if c != key], [c for c in right.columns if c != tie]
    if n == 1:
        few = right.where(F.col(tie).isNotNull()).groupBy(*by_right).agg(F.min(tie).alias(tie))
    else:
        few = right.withColumn("at", F.row_number().over(Window.partitionBy(*by_right).orderBy(tie))).where(F.col("at") <= n).drop("at")
    asked = left.select(*by).distinct()
    w = Window.partitionBy(*by).orderBy(*order, tie)
    best = radius_pairs(asked, few, radius_km).withColumn("at", F.row_number().over(w)).where(F.col("at") <= n)
    return _back(left, best, by)


def heading_order(a: str = "heading_deg", b: str = "r_heading_deg") -> Column:
    """Null headings count as opposite."""
    return F.coalesce(angle_between(a, b), F.lit(180.0))


#: Cell sizes for boxes: level 0 has cells of this many degrees, each level twice as wide ones as the level before.
BOX_CELL_DEG = 0.01
BOX_LEVELS = 17


def covering_scene(points: DataFrame, scenes: DataFrame, key: str) -> DataFrame:
    """For each point the scene of the finest resolution whose box holds it, then the smallest id. Of equal boxes only the
    first counts, and points of one place look once. A scene is dealt on the level whose cells are as wide as its box at
    least, so that it touches four cells at most, whatever its size; a place looks on every level that any scene is on."""
    cell = lambda level: F.lit(BOX_CELL_DEG) * F.pow(F.lit(2.0), level)
    wide = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    level = F.greatest(F.lit(0), F.least(F.lit(BOX_LEVELS - 1), F.ceil(F.log2(F.greatest(wide, F.lit(1e-12)) / BOX_CELL_DEG)))).cast("int")
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell(F.col("level"))).cast("long"), F.floor(F.col(b) / cell(F.col("level"))).cast("long")))
    boxes = scenes.groupBy("south", "north", "west", "east").agg(F.min(F.struct("resolution_m", "scene_id")).alias("s"))
    dealt = boxes.withColumn("level", level).withColumn("cy", span("south", "north")).withColumn("cx", span("west", "east"))
    used = [r["level"] for r in scenes.select(level.alias("level")).distinct().collect()]  # of BOX_LEVELS at most
    if not used:
        return points.select(key, F.lit(None).cast("double").alias("resolution_m"), F.lit(None).cast("long").alias("scene_id"), F.lit("no_open_aerial_found").alias("status"))
    looked = points.select("lat", "lon").distinct().withColumn("level", F.explode(F.array(*(F.lit(x) for x in used))))
    at = lambda c: F.floor(F.col(c) / cell(F.col("level"))).cast("long")
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    met = looked.withColumns({"cy": at("lat"), "cx": at("lon")}).join(dealt, ["level", "cy", "cx"]).where(inside)
    best = met.groupBy("lat", "lon").agg(F.min("s").alias("b")).select("lat", "lon", "b.resolution_m", "b.scene_id")
    found = points.select(key, "lat", "lon").join(best, ["lat", "lon"], "left").select(key, "resolution_m", "scene_id")
    return found.withColumn("status", F.when(F.col("scene_id").isNull(), "no_open_aerial_found").otherwise("ok"))


def spatial_split(points: DataFrame, cell_deg: float, train: float, val: float, reverse: bool = False) -> DataFrame:
    """``split`` by whole cells along the longer axis: train until its share is reached, then val, counted from what train
    really has, then test. Cells are summed first; only their counts are ordered."""
    cy, cx = grid_cell("lat", "lon", cell_deg)
    marked = points.withColumns({"cy": cy, "cx": cx})
    cells = marked.groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("n"))
    box = cells.agg((F.max("cy") - F.min("cy")).alias("h"), (F.max("cx") - F.min("cx")).alias("w"), F.sum("n").alias("total"))
    along = cells.crossJoin(F.broadcast(box)).withColumn("a", F.when(F.col("h") > F.col("w"), F.col("cy")).otherwise(F.col("cx"))).withColumn("b", F.when(F.col("h") > F.col("w"), F.col("cx")).otherwise(F.col("cy")))
    # The order is along one axis: sums by its coordinate meet in one small window, the cells of a coordinate in their own.
    lines = along.groupBy("a").agg(F.sum("n").alias("m"))
    way = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    before_line = lines.withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy(way("a")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("a").orderBy(way("b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = along.join(before_line.select("a", "before"), "a").withColumn("before", F.col("before") + within)
    first = placed.withColumn("is_train", F.col("before") < F.col("total") * train)
    size = first.agg(F.sum(F.when(F.col("is_train"), F.col("n")).otherwise(0)).alias("n_train"))
    split = F.when(F.col("is_train"), "train").when(F.col("before") < F.col("n_train") + F.col("total") * val, "val").otherwise("test")
    done = first.crossJoin(F.broadcast(size)).select("cy", "cx", split.alias("split"))
    return marked.join(done, ["cy", "cx"])


def split_buffer(split: DataFrame, cells: int = 1) -> DataFrame:
    """Drops the cells that have a cell of another split within ``cells`` cells."""
    own = split.select("cy", "cx", "split").distinct()
    shift = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-cells, cells + 1) for b in range(-cells, cells + 1))))
    near = own.withColumn("d", shift).select((F.col("cy") + F.col("d.a")).alias("cy"), (F.col("cx") + F.col("d.b")).alias("cx"), F.col("split").alias("other"))
    clash = own.join(near, ["cy", "cx"]).where("split <> other").select("cy", "cx").distinct()
    return split.join(clash, ["cy", "cx"], "left_anti")


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def sequence_neighbours(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("sequence").orderBy("captured_at", "image_id")
    return points.select("image_id", "sequence", F.lag("image_id").over(w).alias("previous_id"), F.lead("image_id").over(w).alias("next_id"), F.row_number().over(w).alias("position"), F.count(F.lit(1)).over(Window.partitionBy("sequence")).alias("total"))


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace area of corner arrays of one length."""
    n = F.size(xs)
    at = lambda a, i: F.get(a, F.pmod(i, n).cast("int"))
    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + at(xs, i) * at(ys, i + 1) - at(xs, i + 1) * at(ys, i))) / 2


def box_iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of two (x, y, w, h) boxes of columns."""
    (x, y, w, h), (p, q, r, s) = ([F.col(c) if isinstance(c, str) else c for c in t] for t in (a, b))
    over = lambda m, n, o, k: F.greatest(F.lit(0.0), F.least(m + n, o + k) - F.greatest(m, o))
    both = over(x, w, p, r) * over(y, h, q, s)
    whole = w * h + r * s - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def filter_detections(d: DataFrame, min_confidence: float = 0.25, min_area: float = 16.0) -> DataFrame:
    corners = d.withColumns({"xs": F.array("x", F.col("x") + F.col("w"), F.col("x") + F.col("w"), "x"), "ys": F.array("y", "y", F.col("y") + F.col("h"), F.col("y") + F.col("h"))})
    area = polygon_area(F.col("xs"), F.col("ys"))
    heading = F.when(F.col("w") >= F.col("h"), F.lit(90.0)).otherwise(F.lit(0.0))
    return corners.withColumn("area", area).where((F.col("confidence") >= min_confidence) & (F.col("area") >= min_area)).withColumn("heading_deg", heading).drop("xs", "ys")


def detection_summary(d: DataFrame, top_k: int = 3) -> DataFrame:
    """Per image: detections and the mean confidence of the best ``top_k``; tasks pass on an image's best few only."""
    best = d.withColumn("_at", F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("confidence").desc_nulls_last()))).where(F.col("_at") <= top_k)
    scores = best.groupBy("image_id").agg(F.avg("confidence").alias("score"))
    return d.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).join(scores, "image_id", "left")


def valid_candidates(c: DataFrame, min_score: float = 0.001) -> DataFrame:
    """Finite numbers, coordinates in range, score of at least the minimum."""
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & (F.col("score") >= min_score) & (F.abs("score") < float("inf"))
    return c.where(~F.isnan("lat") & ~F.isnan("lon") & ~F.isnan("score") & ok)


def least_split_distance(split: DataFrame, start_km: float = 0.1, most_km: float = HALF_ROUND_KM) -> DataFrame:
    """Per pair of different splits the least distance of their points. Radii double from ``start_km`` on until every pair
    has met, and a round only looks at splits that have not met all others; what meets within a radius holds the least
    distance. Points of one place and split count once."""
    points = written(split.select("split", "lat", "lon").where("split is not null and lat is not null and lon is not null").distinct(), "splits")
    names = points.select("split").distinct()
    open_pairs = names.select(F.col("split").alias("a")).join(names.select(F.col("split").alias("b")), F.expr("a < b"))
    open_pairs, out, radius = written(open_pairs, "open"), None, min(start_km, most_km)
    while True:
        left = points.select(F.col("split").alias("a"), "lat", "lon").join(F.broadcast(open_pairs.select("a").distinct()), "a", "left_semi")
        right = points.select(F.col("split").alias("b"), "lat", "lon").join(F.broadcast(open_pairs.select("b").distinct()), "b", "left_semi")
        met = written(radius_pairs(left, right, radius).where("a < b").groupBy("a", "b").agg(F.min("km").alias("km")), "met")
        found = met.join(F.broadcast(open_pairs), ["a", "b"], "left_semi")
        out = found if out is None else out.unionByName(found)
        open_pairs = written(open_pairs.join(F.broadcast(met), ["a", "b"], "left_anti"), "open")
        if radius >= most_km or open_pairs.isEmpty():
            return out
        radius = min(2 * radius, most_km)


def nearest_in_ring(asked: DataFrame, refs: DataFrame, key: str, least_km: float, most_km: float, need: int, barred: DataFrame | None = None, spare: int = 1, allowed: Column | None = None, start_km: float | None = None, paths: bool = True) -> DataFrame:
    """For every row of ``asked`` (key, q_scene, lat, lon; one row a key) the nearest of ``refs`` (path, scene, lat, lon) from
    ``least_km`` to ``most_km``, the first by (km, path) of each scene, at least the first ``need`` scenes by this order; none
    of the row's own scene or (with ``paths``, where keys are paths) its own path, or of its ``barred`` scenes (key, scene), ``spare`` of these at most; ``allowed`` may
    say more of a pair, by what depends on the two places only. Gives key, path, scene, km, r_lat, r_lon, and asked's columns.

    Radii double; a row that has its scenes within a radius is done, so that a crowded neighbourhood is never listed whole.
    At one place only the first path of each scene counts, and only as many scenes as a row could need."""
    by_place = Window.partitionBy("lat", "lon")
    once = refs.withColumn("_n", F.row_number().over(Window.partitionBy("lat", "lon", "scene").orderBy("path"))).where("_n = 1")
    once = written(once.withColumn("_n", F.row_number().over(by_place.orderBy("path"))).where(F.col("_n") <= need + spare + 1).select("path", "scene", "lat", "lon"), "places")
    radius = min(most_km, start_km or max(1.25 * least_km, most_km / 64))
    left, out, low = asked, None, None
    while True:
        met = radius_pairs(left, once, radius).where((F.col("km") >= least_km) & ~F.col("scene").eqNullSafe(F.col("q_scene")))
        met = met.where(F.col("path") != F.col(key)) if paths else met
        met = met.where(F.col("km") > low) if low is not None else met
        met = met.where(allowed) if allowed is not None else met
        if barred is not None:
            met = met.join(barred.select(key, "scene"), [key, "scene"], "left_anti")
        found = met if out is None else met.unionByName(out.join(left.select(key), key, "left_semi"))
        first = Window.partitionBy(key, "scene").orderBy(F.round("km", 9), "path")
        found = written(found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), "ring")
        done = out.join(left.select(key), key, "left_anti") if out is not None else None
        out = found if done is None else done.unionByName(found)
        if radius >= most_km:
            return out
        enough = found.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= need)
        left = written(left.join(enough, key, "left_anti"), "asking")
        if left.isEmpty():
            return out
        low, radius = radius, min(2 * radius, most_km)


def street_aerial_pairs(streets: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row per street id (the first by captured_at) with its covering scene, a pair id where there is one, and a status."""
    first = first_by_key(streets.select("image_id", "captured_at", "lat", "lon"), ["image_id"], [F.col("captured_at")])
    met = covering_scene(first, scenes, "image_id")
    return met.withColumn("pair_id", F.when(F.col("scene_id").isNotNull(), F.concat_ws("__", F.col("image_id").cast("string"), F.col("scene_id").cast("string"))))


def matched_notes(notes: DataFrame, pins: DataFrame, degrees: float = 1e-4) -> DataFrame:
    """Notes with pins: by pin_id if the note has one, else the first pin within ``degrees`` in both directions, also across
    180 degrees. The second way meets by cells of at least that size and their neighbours, each place once on either side."""
    by_id = notes.where("pin_id is not null").join(pins.select("pin_id"), "pin_id").select("note_id", "pin_id")
    n = F.lit(max(1, math.floor(360 / degrees) - 1)).cast("long")
    band = lambda c: F.floor(F.col(c) / degrees).cast("long")
    first = pins.groupBy(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).agg(F.min("pin_id").alias("pin_id"))
    p = first.withColumn("d", _around(band("p_lat"), "p_lon", lambda cy: n))
    p = p.withColumns({"cy": F.col("d.cy"), "cx": F.col("d.cx")})
    apart = F.abs(F.col("lon") - F.col("p_lon"))
    asked = notes.where("pin_id is null").select("note_id", "lat", "lon")
    places = asked.select("lat", "lon").distinct().withColumns({"cy": band("lat"), "cx": _ring("lon", n)})
    near = places.join(p, ["cy", "cx"]).where((F.abs(F.col("lat") - F.col("p_lat")) <= degrees) & ((apart <= degrees) | (apart >= 360 - degrees)))
    return by_id.unionByName(asked.join(near.groupBy("lat", "lon").agg(F.min("pin_id").alias("pin_id")), ["lat", "lon"]).select("note_id", "pin_id"))


def spatial_histogram(points: DataFrame, key: str, bins: int = 4) -> DataFrame:
    """key, by, bx, share: weights of points (u, v in [0, 1], weight) per cell of a bins x bins grid, 1 in all per key."""
    at = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int")
    cells = points.groupBy(key, at("v").alias("by"), at("u").alias("bx")).agg(F.sum("weight").alias("w"))
    total = F.sum("w").over(Window.partitionBy(key))
    return cells.select(key, "by", "bx", F.when(total > 0, F.col("w") / total).otherwise(F.lit(0.0)).alias("share"))
