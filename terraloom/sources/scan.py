"""Scans with header aliases, tolerant parsing and side tables of rejects; enrichment, resuming and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, number, posix_path

#: Field -> header names, the first that a file has is taken (fixed values).
ALIASES = {"path": ("path", "street_path", "image", "image_path", "query_path", "file", "filename"), "lat": ("lat", "latitude", "gps_lat"), "lon": ("lon", "lng", "longitude", "gps_lon")}


def resolve(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """Exact names first, then without regard to case."""
    folded = {c.lower(): c for c in reversed(columns)}
    return next((n for n in names if n in columns), None) or next((folded[n.lower()] for n in names if n.lower() in folded), None)


def with_standard_names(df: DataFrame, required: Sequence[str] = ("path", "lat", "lon")) -> DataFrame:
    """Renames aliased headers; other columns stay. Raises if a required field has none."""
    found = {field: resolve(df.columns, ALIASES[field]) for field in ALIASES}
    if missing := [f for f in required if not found[f]]:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    return df.withColumnsRenamed({c: f for f, c in found.items() if c and c != f})


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all text, under the standard names."""
    return with_standard_names(spark.read.csv(path, header=True))


def points(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a path and two parseable coordinates in range, the rejected rows with a reason)."""
    # Through a generator: a filter would take in the parsing, and parse anew wherever it reads a coordinate.
    read = df.withColumn("__read", F.explode(F.array(F.struct(*(number(F.col(c).cast("string")).alias(c) for c in ("lat", "lon"))))))
    lat, lon = F.col("__read.lat"), F.col("__read.lon")
    blank = F.coalesce(F.trim("path"), F.lit("")) == ""
    reason = F.when(blank, "no path").when(lat.isNull() | lon.isNull(), "no coordinates").when(~lat.between(-90, 90) | ~lon.between(-180, 180), "out of range")
    marked = read.withColumn("reason", reason)
    return marked.where("reason is null").withColumns({"lat": lat, "lon": lon}).drop("reason", "__read"), marked.where("reason is not null").drop("__read")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """image, lat, lon, grp from CSV, JSON lines, a JSON list or a JSON object keyed by image; a zero coordinate counts,
    blank groups are ``ungrouped``, and of several rows of an image the last one in the file stays."""
    name = path.lower()
    if name.endswith(".json"):
        texts = spark.read.text(path, wholetext=True)
        if texts.where(F.ltrim("value").startswith("{")).limit(1).count():
            return keyed_truth(texts.select("*", "_metadata.file_path"), "value", "file_path")
    files = spark.read.csv(path, header=True) if name.endswith(".csv") else spark.read.json(path, multiLine=not name.endswith(".jsonl"))
    # within a block of a file the numbers grow with the rows
    placed = files.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("__place"))
    raw = with_standard_names(placed)
    return last_by_key(_truth(raw, F.col("group") if "group" in raw.columns else F.lit(None), "__place"), "image", "place").drop("place")


def keyed_truth(texts: DataFrame, column: str, order: str) -> DataFrame:
    """image, lat, lon, grp of JSON objects (one per row of ``texts``) whose keys are images and whose values hold the
    coordinates; other values and unreadable texts give nothing. The last key counts, of several texts that of the last by ``order``."""
    each = texts.select(F.col(order).alias("__order"), F.posexplode(F.from_json(column, "map<string,string>")).alias("__at", "path", "__value"))
    value = F.from_json("__value", "latitude string, lat string, longitude string, lon string, `group` string")
    read = each.select("path", F.struct("__order", "__at").alias("__place"), F.explode(F.array(value)).alias("v"))
    raw = read.select("path", "__place", F.coalesce("v.latitude", "v.lat").alias("lat"), F.coalesce("v.longitude", "v.lon").alias("lon"), F.col("v.group").alias("group"))
    return last_by_key(_truth(raw, F.col("group"), "__place"), "image", "place").drop("place")


def _truth(raw: DataFrame, group: Column, place: str) -> DataFrame:
    ok, _ = points(raw.withColumn("grp", F.coalesce(F.nullif(F.trim(group.cast("string")), F.lit("")), F.lit("ungrouped"))))
    return ok.select(F.col("path").alias("image"), "lat", "lon", "grp", F.col(place).alias("place"))


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def resume(done: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """What is done, and of what comes the rows with new keys, once each."""
    fresh = incoming.join(done.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    return done.unionByName(fresh.select(*done.columns))


def enrich(df: DataFrame, extra: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fills blank fields of ``df`` from the row of ``extra`` with the same key; ``changed`` tells which rows gained."""
    side = extra.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    blank = lambda f: F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "")
    gains = [blank(f) & F.col(f"_{f}").isNotNull() for f in fields]
    changed = gains[0]
    for g in gains[1:]:
        changed = changed | g
    joined = df.join(side, key, "left").withColumn("changed", F.coalesce(changed, F.lit(False)))
    return joined.withColumns({f: F.when(blank(f), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).drop(*(f"_{f}" for f in fields))


def match_truth(df: DataFrame, truth: DataFrame) -> DataFrame:
    """Truth by the full image text, else by base name (the first in order of image)."""
    names = truth.groupBy(base_name(F.col("image")).alias("_name")).agg(F.min_by(F.struct("lat", "lon"), "image").alias("_b"))
    exact = truth.select(F.col("image").alias("_image"), F.struct("lat", "lon").alias("_a"))
    j = df.join(exact, F.col("image") == F.col("_image"), "left").join(names, base_name(F.col("image")) == F.col("_name"), "left")
    return j.withColumn("t", F.coalesce("_a", "_b")).drop("_image", "_a", "_name", "_b")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule with the number of rows that break it (a rule that is null counts as broken)."""
    broken = [F.sum((~F.coalesce(rule, F.lit(False))).cast("long")).alias(name) for name, rule in rules.items()]
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules)))
    return df.agg(*broken).select(pairs.alias("x")).select("x.*")


def check_index(index: DataFrame, dim: int) -> DataFrame:
    """Raises by name of the broken rule; returns the index with unit vectors (norms of at least 1e-12)."""
    rules = {"coordinates": F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), "dimension": F.size("embedding") == dim, "finite": F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))}
    if bad := [r["rule"] for r in violations(index, rules).where("broken > 0").collect()]:
        raise ValueError(f"index breaks: {', '.join(bad)}")
    return index.withColumn("embedding", unit_vector(F.col("embedding")))


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def chip_grid(scenes: DataFrame, chip: int, stride: int, most: int) -> DataFrame:
    """Every full chip window of a scene (width, height, west, north, pixel): row, col, centre; ``most`` at most, in order. A
    window's place follows from its number, so that a scene gives its first ones by itself and no windows are sorted. Only
    scenes that share their id are: they count together, windows of one place by their centres."""
    steps = lambda size: F.floor((F.col(size) - chip) / stride).cast("long") + 1
    fit = scenes.where((F.col("width") >= chip) & (F.col("height") >= chip)).withColumns({"_rows": steps("height"), "_cols": steps("width")})
    few = F.least(F.lit(most).cast("long"), F.col("_rows") * F.col("_cols"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("scene_id"))
    grid = fit.where(few > 0).withColumn("_n", shared).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), few - 1)))
    grid = grid.withColumns({"row": (F.floor(F.col("_k") / F.col("_cols")) * stride).cast("int"), "col": (F.col("_k") % F.col("_cols") * stride).cast("int")})
    half = chip / 2
    placed = grid.select("scene_id", "row", "col", (F.col("west") + (F.col("col") + half) * F.col("pixel")).alias("lon"), (F.col("north") - (F.col("row") + half) * F.col("pixel")).alias("lat"), "_n")
    at = F.row_number().over(Window.partitionBy("scene_id").orderBy("row", "col", "lon", "lat"))
    together = placed.where("_n > 1").withColumn("_at", at).where(F.col("_at") <= most).drop("_at")
    return placed.where("_n = 1").unionByName(together).drop("_n")


def csv_rows(df: DataFrame, text: Sequence[str], eight_decimals: Sequence[str]) -> DataFrame:
    """Columns in a fixed order as text, coordinates with 8 decimals."""
    return df.select(*(posix_path(F.col(c).cast("string")).alias(c) for c in text), *(F.format_string("%.8f", c).alias(c) for c in eight_decimals))


def by_source_text(df: DataFrame, needles: Sequence[str], columns: Sequence[str] = ("match_id", "path")) -> DataFrame:
    """Rows whose given columns, joined and in lower case, contain any of the needles; no needle keeps all."""
    words = [n.strip().lower() for n in needles if n.strip()]
    if not words:
        return df
    text = F.lower(F.concat_ws(" ", *columns))
    return df.where(F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w)))


def sampled_frames(df: DataFrame, key: str, order: str, step: int, most: int) -> DataFrame:
    """Every ``step``-th frame of each key in order, ``most`` at most; ``frame`` counts from 0."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return df.withColumn("frame", at).where((F.col("frame") % max(1, step) == 0) & (F.col("frame") < step * most))


def without_refused(df: DataFrame, refused: DataFrame, keys: Sequence[str], group: str, order: Sequence[Column]) -> DataFrame:
    """Drops the refused rows and numbers the rest of each group again."""
    left = df.join(refused.select(*keys).distinct(), list(keys), "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def fill_missing(df: DataFrame, estimates: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Estimates fill null fields and never overwrite."""
    side = estimates.select(key, *(F.col(f).alias(f"__est_{f}") for f in fields))
    return df.join(side, key, "left").withColumns({f: F.coalesce(f, f"__est_{f}") for f in fields}).drop(*(f"__est_{f}" for f in fields))


def resolved_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """key, path, found: the wanted path itself, below its parent, or without a ``chips/`` prefix, the first that exists."""
    p = posix_path(F.col("path"))
    tries = F.array(p, F.concat(F.lit("../"), p), F.regexp_replace(p, "^chips/", ""))
    each = wanted.select("key", "path", F.posexplode(tries).alias("at", "try"))
    met = each.join(files.select(F.col("file").alias("try")).distinct(), "try").groupBy("key").agg(F.min_by("try", "at").alias("found"))
    return wanted.join(met, "key", "left")


def first_unique(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Unique by each key in turn: the first row of every value of the first key, then of the second, and so on."""
    for k in keys:
        df = df.withColumn("__n", F.row_number().over(Window.partitionBy(k).orderBy(*order))).where("__n = 1").drop("__n")
    return df
