"""Result lines, sidecar files, index tables, triplets and reports: what runs leave behind and what is read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_name
from .scan import unit_vector

_CANDIDATE = "latitude: double, longitude: double, retrieval_score: double, confidence: double, match_id: string, image_path: string"
_FUSION = f"mean_latitude: double, mean_longitude: double, uncertainty_radius_m: double, confidence_tier: string, top1_cross_source_support: double, ambiguous: boolean, candidates: array<struct<candidate: struct<{_CANDIDATE}>, posterior_weight: double>>"
_GEO = "latitude: double, longitude: double, confidence: double, uncertainty_m: double, uncertainty_radius_m: double, confidence_tier: string"
_BODY = f"fusion: struct<{_FUSION}>, candidates: array<struct<{_CANDIDATE}>>"
RESULT = f"image string, path string, fusion struct<{_FUSION}>, candidates array<struct<{_CANDIDATE}>>, result struct<{_BODY}, geo: struct<{_GEO}>>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per line that is not blank; ``_corrupt_record`` holds a line that is no JSON."""
    return spark.read.schema(f"{RESULT}, _corrupt_record string").json(path)


def parsed_results(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(column, RESULT).alias("r")).select("r.*")


def assessed(results: DataFrame) -> DataFrame:
    """image, candidates (latitude, longitude, score; the best first), radius_m, tier, support of each result, whatever its
    shape: a fusion in ``result`` goes before one beside it and, if there is one, its candidates count alone; else the
    retrieval list in ``result``, or beside it; else the estimate. Entries without a place or score are left out."""
    fusion, geo = F.coalesce("result.fusion", "fusion"), F.col("result.geo")
    entry = lambda lat, lon, score: F.struct(lat.alias("latitude"), lon.alias("longitude"), score.alias("score"))
    fused = F.transform(fusion["candidates"], lambda x: entry(x["candidate"]["latitude"], x["candidate"]["longitude"], F.coalesce(x["posterior_weight"], x["candidate"]["retrieval_score"])))
    listed = F.transform(F.coalesce("result.candidates", "candidates"), lambda x: entry(x["latitude"], x["longitude"], F.coalesce(x["retrieval_score"], x["confidence"])))
    guess = F.when(geo.isNotNull(), F.array(entry(geo["latitude"], geo["longitude"], geo["confidence"])))
    none = F.array().cast("array<struct<latitude:double,longitude:double,score:double>>")
    chosen = F.when(fusion.isNotNull(), F.coalesce(fused, none)).otherwise(F.coalesce(listed, guess, none))
    whole = F.filter(chosen, lambda x: x["latitude"].isNotNull() & x["longitude"].isNotNull() & x["score"].isNotNull())
    keyed = F.array_sort(F.transform(whole, lambda x, i: F.struct((-x["score"]).alias("down"), i.alias("i"), x.alias("x"))))
    radius = F.coalesce(fusion["uncertainty_radius_m"], F.nullif(geo["uncertainty_radius_m"], F.lit(0.0)), geo["uncertainty_m"])
    support = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fusion["top1_cross_source_support"]))
    return results.select(
        F.coalesce(F.nullif("image", F.lit("")), F.nullif("path", F.lit(""))).alias("image"), F.transform(keyed, lambda k: k["x"]).alias("candidates"), radius.alias("radius_m"),
        F.trim(F.lower(fusion["confidence_tier"])).alias("tier"), F.when(fusion["top1_cross_source_support"].isNotNull(), support).alias("support"),
    )


def result_lines(fused: DataFrame, candidates: DataFrame) -> DataFrame:
    """image and ``value``, the JSON line of each query's assessment, from fusion's results (one row a query) and its
    candidates (w the posterior weight, the best first); to be written by ``write.text``."""
    item = F.struct(F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("score").alias("retrieval_score"), "match_id").alias("candidate"), F.col("w").alias("posterior_weight"))
    lists = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.round("w", 9)).alias("down"), "item_id", item.alias("x")))).alias("l"))
    j = fused.join(lists, "query_id", "left")
    ordered = F.transform("l", lambda x: x["x"])
    geo = F.struct(F.col("mean_lat").alias("latitude"), F.col("mean_lon").alias("longitude"), F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("top1"))).alias("confidence"), F.col("major_m").alias("uncertainty_m"), F.col("major_m").alias("uncertainty_radius_m"), F.col("tier").alias("confidence_tier"))
    fusion = F.struct(F.col("mean_lat").alias("mean_latitude"), F.col("mean_lon").alias("mean_longitude"), F.col("major_m").alias("uncertainty_radius_m"), F.col("tier").alias("confidence_tier"), "ambiguous", ordered.alias("candidates"))
    image = F.col("query_id").cast("string")
    return j.select(image.alias("image"), F.to_json(F.struct(image.alias("image"), F.struct(geo.alias("geo"), F.transform(ordered, lambda x: x["candidate"]).alias("candidates"), fusion.alias("fusion")).alias("result"))).alias("value"))


# Sidecars -----------------------------------------------------------------------------------------------------------

#: Suffixes of sidecar files, the first that an image has is read: after the whole name, or in place of its ending.
GEO_SUFFIXES, DETECTION_SUFFIXES = (".geo.json", ".geoloc.json"), (".detections.json",)


def read_sidecars(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """path and value (the whole text) of the sidecar files below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def sidecar_of(images: DataFrame, files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """image and value of the sidecar that comes first for it; images without one are left out."""
    bare = F.regexp_replace("image", r"\.[^./]+$", "")
    names = F.array(*(F.concat(stem, F.lit(x)) for x in suffixes for stem in (F.col("image"), bare)))
    met = images.select("image", F.posexplode(names).alias("at", "path")).join(files.select("path", "value"), "path")
    return met.groupBy("image").agg(F.min_by("value", "at").alias("value"))


def geo_sidecars(sidecars: DataFrame) -> DataFrame:
    """image, lat, lon, score, match_id: the candidates of each sidecar, one object or a list under ``candidates``. The score
    is retrieval_score, else confidence, else 0.3; places that are no numbers or out of range are left out."""
    fields = "latitude variant, longitude variant, retrieval_score variant, confidence variant, match_id string, landmark_id string, tile_id string"
    entry = f"struct<{fields.replace(' variant', ':variant').replace(' string', ':string')}>"
    raw = sidecars.select("image", F.from_json("value", f"{fields}, candidates array<{entry}>").alias("r"), F.get_json_object("value", "$.candidates").isNotNull().alias("listed"))
    names = ("latitude", "longitude", "retrieval_score", "confidence", "match_id", "landmark_id", "tile_id")
    one = F.array(F.struct(*(F.col(f"r.{n}").alias(n) for n in names)))
    items = raw.where("r is not null").select("image", F.posexplode(F.when(F.col("listed"), F.col("r.candidates")).otherwise(one)).alias("at", "x"))
    number = lambda n: F.when(F.schema_of_variant(F.col(f"x.{n}")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(F.col(f"x.{n}"), "$", "double"))
    score = F.when(F.col("x.retrieval_score").isNotNull(), number("retrieval_score")).otherwise(number("confidence"))
    found = items.select("image", "at", number("latitude").alias("lat"), number("longitude").alias("lon"), F.coalesce(score, F.lit(0.3)).alias("score"), F.coalesce(*(F.nullif(F.col(f"x.{n}"), F.lit("")) for n in names[4:])).alias("match_id"))
    return found.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def detection_sidecars(sidecars: DataFrame) -> DataFrame:
    """image, label, confidence, points: the detections of each sidecar, a list or a list under ``detections``; each needs a
    label, a numeric confidence and four points of two numbers."""
    fields = "label:string,confidence:double,obb:array<array<double>>,heading_deg:double"
    listed = F.coalesce(F.from_json("value", f"array<struct<{fields}>>"), F.from_json("value", f"detections array<struct<{fields}>>")["detections"])
    whole = F.col("value").rlike(r"^\s*\{")
    nested = F.when(whole, F.from_json("value", f"detections array<struct<{fields}>>")["detections"]).otherwise(listed)
    items = sidecars.select("image", F.posexplode(nested).alias("at", "x")).select("image", "at", "x.*")
    good = F.col("label").isNotNull() & F.col("confidence").isNotNull() & (F.size("obb") == 4) & F.forall("obb", lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())
    return items.where(good).select("image", "at", "label", "confidence", F.col("obb").alias("points"), "heading_deg")


# Index tables -------------------------------------------------------------------------------------------------------


def built_index(metadata: DataFrame, vectors: DataFrame, model_id: str) -> DataFrame:
    """The metadata (path, lat, lon, source) that have a vector (path, embedding), with unit vectors and the model's id;
    rows without a path or a place in range are left out, and of a repeated path the row of
    the least (lat, lon, source) stays, and the least vector."""
    placed = metadata.where(F.col("path").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    first = F.row_number().over(Window.partitionBy("path").orderBy("lat", "lon", "source"))
    ok = placed.withColumn("_n", first).where("_n = 1").drop("_n")
    return ok.join(vectors.groupBy("path").agg(F.min("embedding").alias("embedding")), "path").withColumn("embedding", unit_vector(F.col("embedding"))).withColumn("model_id", F.lit(model_id))


def write_index(index: DataFrame, path: str) -> DataFrame:
    """Writes an index by source and reads it back; a search of one source reads its part only."""
    index.write.partitionBy("source").mode("errorifexists").parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def with_embeddings(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (path) with the embedding of the same path, else of the first path (in order) of the same base name."""
    exact = index.groupBy(F.col("path").alias("_p")).agg(F.any_value("embedding").alias("_a"))
    named = index.groupBy(base_name(F.col("path")).alias("_n")).agg(F.min_by("embedding", "path").alias("_b"))
    j = rows.join(exact, F.col("path") == F.col("_p"), "left").join(named, base_name(F.col("path")) == F.col("_n"), "left")
    return j.withColumn("embedding", F.coalesce("_a", "_b")).drop("_p", "_a", "_n", "_b")


# Triplets and reports -----------------------------------------------------------------------------------------------

TRIPLET = "query_path string, triplet_weight double, positives array<struct<path: string, distance_to_gt_km: double>>, hard_negatives array<struct<path: string, distance_to_gt_km: double, distance_to_pred_km: double, source: string>>"


def triplet_lines(triplets: DataFrame) -> DataFrame:
    return triplets.select(F.to_json(F.struct(*(c for c in ("query_path", "triplet_weight", "positives", "hard_negatives") if c in triplets.columns))).alias("value"))


def parsed_triplets(lines: DataFrame) -> DataFrame:
    """The lines that hold a query path and both lists."""
    return lines.select(F.from_json("value", TRIPLET).alias("t")).select("t.*").where("query_path <> '' and positives is not null and hard_negatives is not null")


def parsed_reports(lines: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The named numbers of each report, a plain object or one under ``report``."""
    schema = ", ".join(f"{f}: double" for f in fields)
    raw = lines.withColumn("r", F.from_json("value", f"struct<{schema}, report: struct<{schema}>>"))
    return raw.select(*lines.columns, *(F.when(F.col("r.report").isNotNull(), F.col(f"r.report.{f}")).otherwise(F.col(f"r.{f}")).alias(f) for f in fields))


# Payloads, validation, history, feeds -------------------------------------------------------------------------------


def parsed_street_images(payloads: DataFrame) -> DataFrame:
    """image_id, lat, lon, heading_deg, captured_at, quality, sequence, thumb_url of provider payloads (``value``): computed
    values go before raw ones, the large thumbnail before the small one; an id, a point and a thumbnail are needed."""
    point = "struct<coordinates: array<double>>"
    fields = f"id string, computed_geometry {point}, geometry {point}, computed_compass_angle double, compass_angle double, thumb_2048_url string, thumb_1024_url string, captured_at string, quality_score double, sequence string"
    r = payloads.select(F.from_json("value", fields).alias("r")).select("r.*")
    whole = lambda g: F.when((F.size(f"{g}.coordinates") >= 2) & F.col(f"{g}.coordinates")[0].isNotNull() & F.col(f"{g}.coordinates")[1].isNotNull(), F.col(f"{g}.coordinates"))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    named = F.when(F.col("sequence").startswith("{"), F.get_json_object("sequence", "$.id")).otherwise(F.col("sequence"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    at = r.withColumns({"_p": F.coalesce(whole("computed_geometry"), whole("geometry")), "_t": F.coalesce(text("thumb_2048_url"), text("thumb_1024_url"))})
    return at.where(text("id").isNotNull() & F.col("_p").isNotNull() & F.col("_t").isNotNull()).select(
        F.trim("id").alias("image_id"), F.col("_p")[1].alias("lat"), F.col("_p")[0].alias("lon"), F.coalesce(finite("computed_compass_angle"), finite("compass_angle")).alias("heading_deg"),
        F.coalesce("captured_at", F.lit("")).alias("captured_at"), finite("quality_score").alias("quality"), F.coalesce(named, F.lit("")).alias("sequence"), F.col("_t").alias("thumb_url"),
    )


def result_violations(lines: DataFrame) -> DataFrame:
    """rule, n: how many lines (``value``) of results break each rule of their schema: what is required, ranges of arrays,
    values of tiers. A line that is no JSON object breaks the first rule and is not looked at further."""
    keys, inner = F.json_object_keys("value"), F.json_object_keys(F.get_json_object("value", "$.result"))
    r = lines.select(keys.alias("k"), inner.alias("i"), F.from_json("value", RESULT + ", x string").alias("r"), F.from_json("value", "result struct<detections: array<struct<label: string, confidence: double, obb: array<array<double>>>>, fusion: struct<confidence_tier: string, credible_set_size: long>>")["result"].alias("d"))
    has = lambda c, *names: F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains(c, n))
    tiers = lambda c: c.isNull() | c.isin("low", "medium", "high")
    boxes = F.forall("d.detections", lambda x: x["label"].isNotNull() & x["confidence"].isNotNull() & (F.size(x["obb"]) == 4) & F.forall(x["obb"], lambda p: F.size(p) == 2))
    listed = F.forall("r.result.candidates", lambda x: x["latitude"].isNotNull() & x["longitude"].isNotNull() & x["retrieval_score"].isNotNull())
    rules = {
        "object": F.col("k").isNotNull(), "required": has(F.col("k"), "image", "result"), "result_required": has(F.col("i"), "detections", "geo", "verification", "score"),
        "detections": boxes, "candidates": listed, "geo_tier": tiers(F.col("r.result.geo.confidence_tier")), "fusion_tier": tiers(F.col("d.fusion.confidence_tier")),
        "credible_set_size": F.coalesce(F.col("d.fusion.credible_set_size") >= 0, F.lit(True)),
    }
    soft = {name: rule if name == "object" else F.col("k").isNull() | F.coalesce(rule, F.lit(name not in ("required", "result_required"))) for name, rule in rules.items()}
    counts = r.agg(*(F.count_if(~rule).alias(name) for name, rule in soft.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules))).alias("x")).select("x.*")


def run_history(lines: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs first, 1 to 500 of them: run_id, finished_at and the summary's numbers, beside or under ``summary``."""
    r = lines.select(F.from_json("value", "run_id string, finished_at string, top1_mean_km double, within_5km_pct double, summary struct<top1_mean_km: double, within_5km_pct: double>").alias("r")).select("r.*")
    pick = lambda c: F.coalesce(F.col(f"summary.{c}"), F.col(c)).alias(c)
    return r.where("run_id is not null").select("run_id", "finished_at", pick("top1_mean_km"), pick("within_5km_pct")).orderBy(F.col("finished_at").desc(), "run_id").limit(max(1, min(500, limit)))


def summary_feed(assessments: DataFrame, rows: int = 200, candidates: int = 10) -> tuple[DataFrame, DataFrame]:
    """(one row: results, mean of the best scores, how many are of the high tier; the first ``rows`` results by image with
    their best ``candidates``): what a page of results shows."""
    best = F.get("candidates", F.lit(0))["score"]
    totals = assessments.agg(F.count(F.lit(1)).alias("n"), F.avg(best).alias("mean_score"), F.count_if(F.col("tier") == "high").alias("n_high"))
    return totals, assessments.orderBy("image").limit(rows).withColumn("candidates", F.slice("candidates", 1, candidates))
