"""Registered queries of keys, tiers, weights, tiles, payloads, validation, history and gates, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import geo, keys
from .operators import evaluate, fusion, mining
from .plans import knobs
from .plans import overlay as o
from .queries import _HITS, _errors, add, r_, with_
from .queries_data import _TRI_SQL, _TRIPLETS
from .queries_more import _ASSESSED, _SHAPES
from .sources import results

_IDS = lambda s, d: o.street_points(s, d).select("image_id", F.when(F.col("image_id") % 5 == 0, F.concat(F.lit("EXIF:"), "image_id")).when(F.col("image_id") % 5 == 1, F.lit("geoclip-v2")).when(F.col("image_id") % 5 == 2, F.concat(F.lit("retrieval: "), "source", F.lit(" :"), "image_id")).when(F.col("image_id") % 5 == 3, F.concat(F.lit("retrieval:"), "image_id")).alias("m"))
add("f15_source_keys", lambda s, d: _IDS(s, d).select("image_id", keys.provider_key(F.col("m")).alias("provider"), keys.retrieval_source(F.col("m")).alias("source")), with_("sp", "SELECT image_id, CASE image_id % 5 WHEN 0 THEN 'exif' WHEN 1 THEN 'geoclip' WHEN 2 THEN 'retrieval:' || lower(source) WHEN 3 THEN 'retrieval' ELSE 'unknown' END AS provider, CASE WHEN image_id % 5 = 2 THEN source END AS source FROM sp"))
_NAMES = lambda s, d: o.street_points(s, d).select("image_id", F.concat(F.when(F.col("image_id") % 2 == 0, "D:\\set\\Chips\\").otherwise("set/"), F.when(F.col("image_id") % 3 == 0, "RGB-PanSharpen_").when(F.col("image_id") % 3 == 1, "MUL_").otherwise("img_"), "image_id", F.lit(".tif")).alias("path"))
add("f16_scene_keys", lambda s, d: _NAMES(s, d).select("image_id", keys.scene_key(F.col("path")).alias("scene"), keys.reference_path(F.col("path")).alias("reference"), keys.reuse_key(F.col("path")).alias("reuse")), with_("sp", ", nm AS (SELECT image_id, CASE WHEN image_id % 2 = 0 THEN 'D:/set/Chips/' ELSE 'set/' END AS dir, CASE image_id % 3 WHEN 0 THEN 'RGB-PanSharpen_' WHEN 1 THEN 'MUL_' ELSE 'img_' END AS pre, image_id || '.tif' AS rest FROM sp) SELECT image_id, CASE WHEN pre = 'img_' THEN pre ELSE '' END || rest AS scene, CASE WHEN dir LIKE 'D:%' THEN 'Chips/' ELSE dir END || pre || rest AS reference, lower(dir || pre || rest) AS reuse FROM nm").replace(" , nm AS", ", nm AS"))
add("f21_estimate_tier", lambda s, d: o.street_points(s, d).select("image_id", keys.estimate_tier(F.col("quality") / 100 + 0.3, (F.col("image_id") * 7 % 1500).cast("double")).alias("tier")), with_("sp", ", e AS (SELECT image_id, greatest(0, least(1, quality/100+0.3e0)) * CASE WHEN image_id*7 % 1500 > 1000 THEN 0.4e0 WHEN image_id*7 % 1500 > 200 THEN 0.6e0 WHEN image_id*7 % 1500 > 50 THEN 0.85e0 ELSE 1 END AS s FROM sp) SELECT image_id, CASE WHEN s >= 0.75 THEN 'high' WHEN s >= 0.45 THEN 'medium' ELSE 'low' END AS tier FROM e").replace(" , e AS", ", e AS"))
add("f04_local_round_trip", lambda s, d: o.street_points(s, d).select("image_id", "lat", "lon", *(c.alias(n) for c, n in zip(geo.local_xy_km("lat", "lon", 48.9, 2.2), ("x", "y"), strict=True))).select("image_id", *(c.alias(n) for c, n in zip(geo.local_degrees("x", "y", 48.9, 2.2), ("back_lat", "back_lon"), strict=True))), with_("sp", f"SELECT image_id, {r_('lat', 'back_lat')}, {r_('lon', 'back_lon')} FROM sp"))
add("f24_zoom_and_cover", lambda s, d: o.street_points(s, d).select("image_id", keys.target_zoom(F.col("lat"), 120.0, 512).alias("zoom"), F.size(keys.crop_tiles("lat", "lon", 17, 512)).alias("tiles"), F.get(keys.crop_tiles("lat", "lon", 17, 512), F.lit(0))["x"].alias("x"), F.element_at(keys.crop_tiles("lat", "lon", 17, 512), -1)["y"].alias("y")), with_("sp", ", w AS (SELECT image_id, lat, (lon+180)/360*256*131072 AS x, (0.5e0-ln((1+sin(radians(lat)))/(1-sin(radians(lat))))/(4*pi()))*256*131072 AS y FROM sp) SELECT image_id, least(22, greatest(0, ceil(log2(greatest(156543.03392804097e0*cos(radians(lat))/(120e0/512), 1)))))::INT AS zoom, ((floor((x+255)/256)-floor((x-256)/256)+1)*(floor((y+255)/256)-floor((y-256)/256)+1))::INT AS tiles, floor((x-256)/256)::BIGINT AS x, floor((y+255)/256)::BIGINT AS y FROM w").replace(" , w AS", ", w AS"))
_NEG = lambda s, d: _TRIPLETS(s, d).where("role = 'negative'").groupBy("query_id").agg(F.min("km").alias("near"), F.max("km").alias("far"), F.max("score").alias("top"), F.count(F.lit(1)).alias("n"))
add("f26_triplet_weights", lambda s, d: _NEG(s, d).select("query_id", keys.spread_weight(F.col("near"), F.col("far"), F.col("top")).alias("by_spread"), keys.richness_weight(F.col("near"), F.col("n")).alias("by_richness")), with_("err", _TRI_SQL + f", ne AS (SELECT query_id, min(km) AS a, max(km) AS b, max(score) AS t, count(*) AS n FROM tri WHERE role = 'negative' GROUP BY query_id) SELECT query_id, {r_('least(4, greatest(1, 1+1.2e0/greatest(1,a)+0.8e0*greatest(0,least(1,t))+0.4e0*least(1,greatest(0,(b-a)/25))))', 'by_spread')}, {r_('least(3, 1+1.5e0*greatest(0,1-a/5)+0.5e0*least(1,n/20e0))', 'by_richness')} FROM ne").replace(" , mk AS", ", mk AS"))
add("f29_group_targets", lambda s, d: evaluate.utility_weights(_errors(s, d).withColumn("t", -0.5 * F.pow(F.col("km") / 3.0, F.lit(2))), ["query_id"], "t", 1.0).select("query_id", "item_id", "weight"), with_("err", f"SELECT query_id, item_id, {r_('exp(-0.5*pow(km/3e0,2))/sum(exp(-0.5*pow(km/3e0,2))) OVER (PARTITION BY query_id)', 'weight')} FROM err"))


def _per_cell(s, d):
    """Street points by the cell of a box; the box's cells are a small table of their own."""
    cells = s.createDataFrame([(k, *c) for k, c in enumerate(geo.box_cells(48.799995, 2.249995, 48.875, 2.425, 0.02))], "cell long, south double, west double, north double, east double")
    inside = (F.col("lat") >= F.col("south")) & (F.col("lat") < F.col("north")) & (F.col("lon") >= F.col("west")) & (F.col("lon") < F.col("east"))
    p = o.street_points(s, d).withColumn("cell", (F.floor((F.col("lat") - 48.799995) / 0.02) * 9 + F.floor((F.col("lon") - 2.249995) / 0.02)))
    return p.join(F.broadcast(cells), "cell").where(inside).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


add("f31_box_cells", _per_cell, with_("sp", "SELECT (floor((lat-48.799995e0)/0.02e0)*9+floor((lon-2.249995e0)/0.02e0))::BIGINT AS cell, count(*) AS n FROM sp WHERE lat < 48.875e0 AND lon < 2.425e0 GROUP BY 1"))

# Reports ------------------------------------------------------------------------------------------------------------
_SOME = lambda s, d: _errors(s, d).where("rank = 1 and query_id % 300 <> 0").withColumn("km", F.when(F.col("query_id") % 400 != 0, F.col("km")))
add("a18_score_report", lambda s, d: evaluate.score_report(_SOME(s, d), o.queries(s, d)), with_("top1 q", f"SELECT count(*) AS n, count(*) FILTER (query_id % 300 = 0) AS n_missing, count(*) FILTER (query_id % 300 <> 0 AND query_id % 400 = 0) AS n_null, {r_('avg(score) FILTER (query_id % 300 <> 0)', 'mean_score')}, {r_('min(score) FILTER (query_id % 300 <> 0)', 'min_score')}, {r_('max(score) FILTER (query_id % 300 <> 0)', 'max_score')} FROM top1"))
_NAMED = {0.1: "100m", 0.25: "250m", 0.5: "500m", 1.0: "1km", 2.0: "2km", 5.0: "5km"}
add("a20_crossview_report", lambda s, d: evaluate.crossview_report(_errors(s, d)), with_("err", "SELECT count(DISTINCT query_id) AS evaluated, " + ", ".join([*(r_(f"100*count(DISTINCT query_id) FILTER (rank=1 AND km<={r})/count(DISTINCT query_id)::DOUBLE", f"within_{n}_pct") for r, n in _NAMED.items()), *(r_(f"100*count(DISTINCT query_id) FILTER (rank<={k} AND km<={r})/count(DISTINCT query_id)::DOUBLE", f"top{k}_recall_{_NAMED[r]}_pct") for k in (1, 5, 10) for r in (0.1, 0.25, 0.5, 1.0))]) + " FROM err"))
_TOL = [("1-URGENT", "error", 0.01, 0.001), ("2-HIGH", "error", 0.01, 0.2), ("3-MEDIUM", "rate", 0.01, 0.0), ("4-NOT SPECIFIED", "rate", 5.0, 0.0), ("5-LOW", "count", 0.0, 0.0), ("none", "rate", 1.0, 0.0)]
_TWO = lambda s, d: o.run_metrics(s, d).where("run in ('F', 'O')").groupBy(F.col("scenario").alias("metric")).agg(F.max(F.when(F.col("run") == "F", F.col("value"))).alias("before"), F.max(F.when(F.col("run") == "O", F.col("value"))).alias("after"))
add("a30_metric_gate", lambda s, d: evaluate.metric_gate(_TWO(s, d), s.createDataFrame(_TOL, "metric string, kind string, absolute double, relative double")), with_("runs", f", t(metric, kind, a, r) AS (VALUES {', '.join(f'({chr(39)}{m}{chr(39)}, {chr(39)}{k}{chr(39)}, {x}e0, {y}e0)' for m, k, x, y in _TOL)}), c AS (SELECT scenario AS metric, max(value) FILTER (run='F') AS b, max(value) FILTER (run='O') AS v FROM runs GROUP BY 1) SELECT metric, kind, {r_('b', '\"before\"')}, {r_('v', '\"after\"')}, CASE kind WHEN 'rate' THEN coalesce(v >= b-a, false) WHEN 'error' THEN (b IS NULL AND v IS NULL) OR coalesce(v <= b+greatest(a, b*r), false) ELSE coalesce(b <= 0 OR v >= 0.95e0*b, true) END AS passed FROM t LEFT JOIN c USING (metric)").replace(" , t(", ", t("))
_LEAST = "(SELECT max(t) FROM (SELECT t, sum(n) OVER w AS n, sum(h) OVER w / sum(n) OVER w AS p FROM (SELECT round(w,2) AS t, count(*) AS n, sum(hit) AS h FROM hits GROUP BY 1) WINDOW w AS (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE n >= {0} AND p >= {1})"
add("a25_tier_thresholds", lambda s, d: evaluate.tier_thresholds(_HITS(s, d), (0.2, 5), (0.3, 3)), with_("hits", f"SELECT {r_('h', 'high')}, {r_('least(m, coalesce(h, m))', 'medium')} FROM (SELECT {_LEAST.format(5, 0.2)} AS h, {_LEAST.format(3, 0.3)} AS m)"))
_WEIGHTED = lambda s, d: _NEG(s, d).select("query_id", keys.richness_weight(F.col("near"), F.col("n")).alias("weight"))
add("a26_weight_summary", lambda s, d: mining.weight_summary(_WEIGHTED(s, d), _TRIPLETS(s, d)), with_("err", _TRI_SQL + f", ne AS (SELECT query_id, least(3, 1+1.5e0*greatest(0,1-min(km)/5)+0.5e0*least(1,count(*)/20e0)) AS w FROM tri WHERE role = 'negative' GROUP BY query_id), pq AS (SELECT query_id, count(*) FILTER (role='positive') AS p, count(*) FILTER (role='negative') AS m FROM tri GROUP BY query_id) SELECT count(*) AS triplets, {r_('avg(p)', 'mean_positives')}, {r_('avg(m)', 'mean_negatives')}, {r_('min(w)', 'min_weight')}, {r_('avg(w)', 'mean_weight')}, {r_('max(w)', 'max_weight')}, (SELECT count(DISTINCT item_id) FROM tri) AS items FROM pq LEFT JOIN ne USING (query_id)").replace(" , mk AS", ", mk AS"))
add("a26_most_reused", lambda s, d: mining.most_reused(_TRIPLETS(s, d)), with_("err", _TRI_SQL + " SELECT item_id, count(DISTINCT query_id) AS uses FROM tri WHERE role = 'negative' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10").replace(" , mk AS", ", mk AS"))

# Payloads, validation, history, feed --------------------------------------------------------------------------------


def _payloads(s, d):
    p, k = o.street_points(s, d), F.col("image_id")
    at = F.struct(F.array("lon", "lat").alias("coordinates"))
    sequence = F.when(k % 2 == 0, F.concat(F.lit('"s'), "sequence", F.lit('"'))).otherwise(F.concat(F.lit('{"id":"s'), "sequence", F.lit('"}')))
    body = F.to_json(F.struct(F.when(k % 13 != 0, k).alias("id"), F.when(k % 3 == 0, at).alias("computed_geometry"), F.when(k % 7 != 0, at).alias("geometry"), F.when(k % 4 == 0, F.col("heading_deg") + 1).alias("computed_compass_angle"), F.col("heading_deg").alias("compass_angle"), F.when(k % 5 == 0, F.lit("big")).when(k % 5 == 1, F.lit(" ")).alias("thumb_2048_url"), F.when(k % 5 < 4, F.lit("small")).alias("thumb_1024_url"), F.col("quality").alias("quality_score")))
    return p.select(F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.lit(',"sequence":'), sequence, F.lit("}")).alias("value"))


add("s12_street_payloads", lambda s, d: results.parsed_street_images(_payloads(s, d)).drop("captured_at"), with_("sp", f"SELECT image_id::VARCHAR AS image_id, {r_('lat', 'lat')}, {r_('lon', 'lon')}, {r_('CASE WHEN image_id % 4 = 0 AND heading_deg IS NOT NULL THEN heading_deg+1 ELSE heading_deg END', 'heading_deg')}, {r_('quality', 'quality')}, 's' || sequence AS sequence, CASE WHEN image_id % 5 = 0 THEN 'big' ELSE 'small' END AS thumb_url FROM sp WHERE image_id % 13 <> 0 AND (image_id % 3 = 0 OR image_id % 7 <> 0) AND image_id % 5 < 4"))


def _checked(s, d):
    p, k = o.street_points(s, d), F.col("image_id")
    corners = F.transform(F.sequence(F.lit(1), F.when(k % 17 == 0, 3).otherwise(4)), lambda i: F.array(i.cast("double"), F.lit(2.0)))
    detection = F.struct(F.lit("car").alias("label"), F.lit(0.5).alias("confidence"), corners.alias("obb"))
    candidate = F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.when(k % 19 != 0, F.col("quality")).alias("retrieval_score"))
    geo_ = F.struct(F.when(k % 23 == 0, "certain").otherwise("low").alias("confidence_tier"))
    fusion_ = F.struct(F.when(k % 29 == 0, "some").otherwise("high").alias("confidence_tier"), F.when(k % 31 == 0, -1).otherwise(4).alias("credible_set_size"))
    result = F.struct(F.array(detection).alias("detections"), geo_.alias("geo"), F.struct(F.lit(True).alias("shadow_ok")).alias("verification"), F.when(k % 37 != 0, F.lit(0.5)).alias("score"), F.array(candidate).alias("candidates"), fusion_.alias("fusion"))
    line = F.to_json(F.struct(F.when(k % 41 != 0, k.cast("string")).alias("image"), result.alias("result")))
    return p.select(F.when(k % 43 == 0, F.lit("[no object")).otherwise(line).alias("value"))


_BROKEN = {"object": "image_id % 43 = 0", "required": "image_id % 41 = 0 AND image_id % 43 <> 0", "result_required": "image_id % 37 = 0 AND image_id % 43 <> 0", "detections": "image_id % 17 = 0 AND image_id % 43 <> 0", "candidates": "image_id % 19 = 0 AND image_id % 43 <> 0", "geo_tier": "image_id % 23 = 0 AND image_id % 43 <> 0", "fusion_tier": "image_id % 29 = 0 AND image_id % 43 <> 0", "credible_set_size": "image_id % 31 = 0 AND image_id % 43 <> 0"}
add("s11_result_schema", lambda s, d: results.result_violations(_checked(s, d)), with_("sp", " UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) FILTER ({test}) AS n FROM sp" for rule, test in _BROKEN.items())))
_RUNS = lambda s, d: o.table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").cast("string").alias("finished_at"), (F.avg(F.col("o_totalprice").cast("double")) / 1e4).alias("km")).select(F.when(F.col("o_custkey") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("r"), "o_custkey").alias("run_id"), "finished_at", F.struct(F.col("km").alias("top1_mean_km")).alias("summary")))).otherwise(F.to_json(F.struct(F.concat(F.lit("r"), "o_custkey").alias("run_id"), "finished_at", F.col("km").alias("top1_mean_km"), F.lit(7.0).alias("within_5km_pct")))).alias("value"))
add("s16_run_lines", lambda s, d: results.run_history(_RUNS(s, d), 25), f"SELECT 'r' || o_custkey AS run_id, max(o_orderdate)::DATE::VARCHAR AS finished_at, {r_('avg(o_totalprice::DOUBLE)/1e4', 'top1_mean_km')}, CASE WHEN o_custkey % 2 <> 0 THEN 7e0 END AS within_5km_pct FROM orders GROUP BY o_custkey ORDER BY 2 DESC, 1 LIMIT 25")
add("s19_summary_feed", lambda s, d: results.summary_feed(_ASSESSED(s, d))[0], with_("cand", f"{_SHAPES} SELECT count(DISTINCT query_id) AS n, {r_('avg(s) FILTER (at_ = 1)', 'mean_score')}, count(DISTINCT query_id) FILTER (kind < 2) AS n_high FROM ks").replace(" , k AS", ", k AS"))
add("s19_feed_rows", lambda s, d: results.summary_feed(_ASSESSED(s, d), 200, 3)[1].select("image", F.size("candidates").alias("n"), F.element_at("candidates", -1)["score"].alias("last_score")), with_("cand", f"{_SHAPES} SELECT 'a/' || query_id || '.jpg' AS image, count(*)::INT AS n, {r_('first(s ORDER BY at_ DESC)', 'last_score')} FROM ks WHERE at_ <= 3 GROUP BY query_id ORDER BY 1 LIMIT 200").replace(" , k AS", ", k AS"))

# Fusion with everything on ------------------------------------------------------------------------------------------


def _fused_all(s, d):
    from .operators.rerank import FEATURES, LinearModel

    model = LinearModel(weights=tuple({"support_3km": 1.0, "retrieval_unit": 2.0}.get(f, 0.0) for f in FEATURES))
    knobs = fusion.Knobs(normalise="zscore", plausibility_weight=0.5, plausibility_radius_km=6.0, outlier_strength=0.5, outlier_min_scale_km=2.0, reranker=model, reranker_weight=1.0, cluster_radius_km=4.0, high_cap=(0.3, 2000.0), medium_cap=(0.1, 6000.0))
    return fusion.fuse(o.candidates(s, d), knobs).select("query_id", F.round("mean_lat", 5).alias("mean_lat"), F.round("mean_lon", 5).alias("mean_lon"), F.round("major_m", 2).alias("radius_m"), "tier", "set_size")


add("o2_full_fusion", _fused_all, None)

# Knobs --------------------------------------------------------------------------------------------------------------
_GRID = lambda s, d: o.table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 9 - 2).alias("spatial_weight"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 7) / 4.0).alias("credible_mass"), F.when(F.col("o_orderkey") % 3 == 0, " MinMax ").when(F.col("o_orderkey") % 3 == 1, "other").otherwise("rank").alias("normalise"))
add("o7_clamped_knobs", lambda s, d: knobs.clamped_grid(_GRID(s, d)), f"SELECT o_orderkey, {r_('greatest(0e0, least(10e0, o_orderkey % 9 - 2))', 'spatial_weight')}, {r_('CASE WHEN o_orderkey % 5 = 0 THEN 0.9e0 ELSE greatest(0.5e0, least(0.999e0, (o_orderkey % 7)/4e0)) END', 'credible_mass')}, CASE o_orderkey % 3 WHEN 0 THEN 'minmax' WHEN 1 THEN 'none' ELSE 'rank' END AS normalise FROM orders")
_SETTINGS = [{"spatial_sigma_km": 1.0, "cross_weight": 0.5}, {"temperature": 0.5, "normalise": "minmax"}, {"credible_mass": 0.6, "outlier_strength": 1.0, "outlier_min_scale_km": 2}]
add("g24_fusion_sweep", lambda s, d: knobs.fusion_sweep(o.candidates(s, d), o.queries(s, d), _SETTINGS), None)
