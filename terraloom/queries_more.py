"""Registered queries of refinements, gates, rerank models, result and sidecar scans, index tables, miners and providers,
with their SQL for DuckDB."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions.scores import histogram_similarity
from .operators import evaluate, fit, fusion, mining, rerank, retrieval, spatial
from .plans import chains, providers
from .plans import overlay as o
from .queries import SHIFT, UNIT, _errors, add, hav, r_, with_
from .sources import results, scan, stage

# Views --------------------------------------------------------------------------------------------------------------


def _views(s, d):
    """query_id, view, item_id, score: every candidate's score under three rotations of its query."""
    turn = lambda k: F.concat(F.slice("embedding", k * 16 + 1, F.size("embedding")), F.slice("embedding", 1, k * 16))
    turned = o.queries(s, d).select("query_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), turn)).alias("view", "qv"))
    j = o.candidates(s, d).select("query_id", "item_id").join(turned, "query_id").join(o.geo_index(s, d).select("item_id", "embedding"), "item_id")
    dot = F.aggregate(F.zip_with("qv", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return j.select("query_id", "view", "item_id", dot.alias("score"))


_VW = ", vw AS (SELECT c.query_id, v AS \"view\", c.item_id, list_dot_product(q.e[v*16+1:64] || q.e[1:v*16], gi.e) AS score FROM cand c JOIN q USING (query_id) JOIN gi USING (item_id), range(3) t(v))"
add("a01_view_rrf", lambda s, d: retrieval.views_by_rank(_views(s, d)).select("query_id", "item_id", "score"), with_("cand", f"{_VW}, rr AS (SELECT query_id, item_id, sum(1/(60e0+r)) AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id, \"view\" ORDER BY round(score,9) DESC, item_id) AS r FROM vw) GROUP BY query_id, item_id) SELECT query_id, item_id, {r_('CASE WHEN max(s) OVER g - min(s) OVER g < 1e-9 THEN 0.5e0 ELSE (s - min(s) OVER g)/(max(s) OVER g - min(s) OVER g) END', 'score')} FROM rr WINDOW g AS (PARTITION BY query_id)").replace(" , vw AS", ", vw AS"))


def _blended(s, d):
    ranks = _views(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "view").orderBy(F.round("score", 9).desc(), "item_id")))
    return rerank.with_agreement(o.candidates(s, d), ranks, 8, 3, 0.3).select("query_id", "item_id", "score")


_NORM8 = "(" + "+".join(f"1/{k}e0" for k in range(1, 9)) + ")"
add("w08_agreement_blend", _blended, with_("cand", f"{_VW}, ag AS (SELECT query_id, item_id, least(1, sum(1e0/r)/(3*{_NORM8})) AS a FROM (SELECT *, row_number() OVER (PARTITION BY query_id, \"view\" ORDER BY round(score,9) DESC, item_id) AS r FROM vw) WHERE r <= 8 GROUP BY query_id, item_id), bs AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM cand) SELECT query_id, item_id, {r_('CASE WHEN hi-lo <= 1e-12 THEN score ELSE lo + least(1, 0.7e0*(score-lo)/(hi-lo) + 0.3e0*coalesce(a,0))*(hi-lo) END', 'score')} FROM bs LEFT JOIN ag USING (query_id, item_id)").replace(" , vw AS", ", vw AS"))

# Refined positions --------------------------------------------------------------------------------------------------
_INIT = "{'x': %s, 'y': %s, 'd': false}"


def _fold(start: str, steps: int, x: str, y: str) -> str:
    none = "{'x': 0e0, 'y': 0e0, 'd': false}"
    return f"list_reduce(list_transform(range({steps}), lambda i: {none}), lambda s, i: CASE WHEN s.d THEN s ELSE {{'x': {x}, 'y': {y}, 'd': sqrt(pow(({x})-s.x,2)+pow(({y})-s.y,2)) <= 1e-3}} END, {start})"


def _sum(term: str) -> str:
    return f"list_sum(list_transform(p, lambda z: {term}))"


_PTS = "list({'x': (lon-lon0)*111.32e0*cos(radians(lat0)), 'y': (lat-lat0)*110.574e0, 'w': w, 'lat': lat, 'lon': lon} ORDER BY rank)"
_MEAN = "sum(lat*w)/sum(w) AS lat0, degrees(atan2(sum(sin(radians(lon))*w), sum(cos(radians(lon))*w))) AS lon0"
_FAR = "greatest(sqrt(pow(s.x-z.x,2)+pow(s.y-z.y,2)), 1e-9)"
_AT = lambda m: f"(lat0 + {m}.y/110.574e0)", lambda m: f"(lon0 + {m}.x/(111.32e0*cos(radians(lat0))))"


def _refined_sql(steps: str, name: str) -> str:
    return f"{steps} SELECT rnk.query_id, item_id, rank, {r_('CASE WHEN rank = 1 THEN coalesce(t_lat, lat) ELSE lat END', 'lat')}, {r_('CASE WHEN rank = 1 THEN coalesce(t_lon, lon) ELSE lon END', 'lon')}, CASE WHEN rank = 1 AND t_lat IS NOT NULL THEN '{name}' ELSE match_id END AS match_id FROM rnk LEFT JOIN tgt ON rnk.query_id = tgt.query_id"


_PULL = lambda axis: f"{_sum(f'z.w/{_FAR}*z.{axis}')}/{_sum(f'z.w/{_FAR}')}"
_MASS = lambda lat, lon: _sum(f"z.w*exp(-0.5*pow({hav(lat, lon, 'z.lat', 'z.lon')}/1.5e0,2))")
_CONSENSUS = (
    f", hd AS (SELECT *, greatest(1e-9, {SHIFT.format('score')}) AS u FROM rnk WHERE rank <= 12)"
    f", sup AS (SELECT a.query_id, a.item_id, a.rank, sum(b.u*exp(-0.5*pow({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}/3e0,2))) AS s FROM hd a JOIN hd b USING (query_id) GROUP BY ALL)"
    ", anc AS (SELECT query_id, first(item_id ORDER BY round(s,12) DESC, rank) AS item_id FROM sup GROUP BY query_id)"
    f", bal AS (SELECT b.query_id, b.rank, b.lat, b.lon, greatest(1e-9, pow({SHIFT.format('b.score')}, 1.5e0)) AS w FROM hd a JOIN anc USING (query_id, item_id) JOIN hd b ON a.query_id = b.query_id WHERE {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 3)"
    f", ctr AS (SELECT query_id, {_MEAN} FROM bal GROUP BY query_id HAVING count(*) >= 2), pts AS (SELECT bal.query_id, lat0, lon0, {_PTS} AS p FROM bal JOIN ctr USING (query_id) GROUP BY ALL)"
    f", med AS (SELECT *, {_fold(_INIT % (_sum('z.x*z.w') + '/' + _sum('z.w'), _sum('z.y*z.w') + '/' + _sum('z.w')), 24, _PULL('x'), _PULL('y'))} AS m FROM pts)"
    f", two AS (SELECT *, {_AT[0]('m')} AS mla, {_AT[1]('m')} AS mlo FROM med), chs AS (SELECT *, {_MASS('mla', 'mlo')} > 1.05*{_MASS('lat0', 'lon0')} AND {hav('lat0', 'lon0', 'mla', 'mlo')} >= 0.15 AS use FROM two)"
    ", tgt AS (SELECT query_id, CASE WHEN use THEN mla ELSE lat0 END AS t_lat, CASE WHEN use THEN mlo ELSE lon0 END AS t_lon FROM chs)"
)
_PLACE = ["query_id", "item_id", "rank", "lat", "lon", "match_id"]
add("g10_consensus", lambda s, d: rerank.refined_by_consensus(o.candidates(s, d), 12, 3.0, 1.5).select(*_PLACE), with_("rnk", _refined_sql(_CONSENSUS, "retrieval:consensus")).replace(" , hd AS", ", hd AS"))

_SHARE = "z.w*exp(-(pow(s.x-z.x,2)+pow(s.y-z.y,2))*0.125e0)"
_GO = lambda axis: f"CASE WHEN {_sum(_SHARE)} <= 1e-12 THEN s.{axis} ELSE {_sum(f'{_SHARE}*z.{axis}')}/{_sum(_SHARE)} END"
_DENSITY = (
    f", hd AS (SELECT *, greatest(1e-9, pow({SHIFT.format('score')}, 2e0)) AS w FROM rnk WHERE rank <= 12)"
    f", ctr AS (SELECT query_id, {_MEAN} FROM hd GROUP BY query_id), pts AS (SELECT hd.query_id, lat0, lon0, {_PTS} AS p FROM hd JOIN ctr USING (query_id) GROUP BY ALL HAVING count(*) >= 2)"
    f", mod AS (SELECT *, list_transform(p[1:8], lambda f: {_fold(_INIT % ('f.x', 'f.y'), 12, _GO('x'), _GO('y'))}) AS ms FROM pts)"
    f", den AS (SELECT query_id, lat0, lon0, p, i, ms[i] AS s FROM mod, range(1, 9) t(i) WHERE i <= len(ms))"
    f", one AS (SELECT query_id, lat0, lon0, first(s ORDER BY round({_sum(_SHARE)},9) DESC, i) AS m FROM den GROUP BY query_id, lat0, lon0)"
    f", tgt0 AS (SELECT query_id, {_AT[0]('m')} AS t_lat, {_AT[1]('m')} AS t_lon FROM one)"
    f", tgt AS (SELECT t.* FROM tgt0 t JOIN rnk a ON a.query_id = t.query_id AND a.rank = 1 JOIN rnk b ON b.query_id = t.query_id AND b.rank = 2 WHERE NOT (a.score - b.score >= 0.05e0 AND {hav('t_lat', 't_lon', 'a.lat', 'a.lon')} >= 2))"
)
add("g11_density_mode", lambda s, d: rerank.refined_by_density(o.candidates(s, d), 12, 2.0, 2.0, 0.05, 2.0, 12).select(*_PLACE), with_("rnk", _refined_sql(_DENSITY, "retrieval:kde_mode")).replace(" , hd AS", ", hd AS"))

# Evidence behind gates ----------------------------------------------------------------------------------------------


def _evidence(s, d, first: int):
    """Candidates with ``evidence`` in [0, 1]: the likeness of half of the two vectors; every seventh item has none."""
    half = lambda c: F.transform(F.slice(c, first, 32), lambda x: x.cast("double"))
    j = o.candidates(s, d).join(o.queries(s, d).select("query_id", half("embedding").alias("qv")), "query_id").join(o.geo_index(s, d).select("item_id", half("embedding").alias("iv")), "item_id")
    return j.withColumn("evidence", F.when(F.col("item_id") % 7 != 0, histogram_similarity(F.col("qv"), F.col("iv")))).drop("qv", "iv")


def _half_evidence_sql(first: int) -> str:
    part = f"[{first}:{first + 31}]"
    like = f"greatest(0, least(1, 0.5e0*(list_dot_product(q.e{part}, gi.e{part})/greatest(1e-12, sqrt(list_dot_product(q.e{part}, q.e{part})*list_dot_product(gi.e{part}, gi.e{part})))+1)))"
    return f"CASE WHEN rnk.item_id % 7 <> 0 THEN {like} END"


def _gate_sql(evidence: str, g: rerank.Gate, top_n: int, weight: float) -> str:
    """From the candidates' ``evidence``, an expression over the tables rnk, q and gi."""
    return (
        f", ev AS (SELECT rnk.*, CASE WHEN rank <= {top_n} THEN {evidence} END AS e_, {SHIFT.format('rnk.score')} AS u FROM rnk JOIN q USING (query_id) JOIN gi USING (item_id))"
        ", gt AS (SELECT query_id, max(e_) AS best, min(e_) AS least_, max(CASE WHEN rank = 1 THEN e_ END) AS one, coalesce(greatest(0, max(CASE WHEN rank = 1 THEN u END)-max(CASE WHEN rank = 2 THEN u END)), 1) AS gap FROM ev GROUP BY query_id)"
        f", op AS (SELECT query_id, coalesce(best >= {g.best}e0 AND best-least_ >= {g.spread}e0 AND NOT (gap >= 0.1e0 AND (one IS NULL OR best > one) AND best-coalesce(one,0) < {g.lead}e0), false) AS open FROM gt)"
        f" SELECT query_id, item_id, {r_(f'CASE WHEN open AND e_ IS NOT NULL THEN greatest(1e-6, least(1, (1-{weight}e0*greatest(0,least(1,(e_-{g.floor}e0)/{1 - g.floor}e0)))*u + {weight}e0*greatest(0,least(1,(e_-{g.floor}e0)/{1 - g.floor}e0))*e_)) ELSE score END', 'score')} FROM ev JOIN op USING (query_id)"
    )


for _name, _first, _gate, _n, _w in (("g16_structure_rerank", 1, rerank.STRUCTURE, 12, 0.4), ("g17_local_match_rerank", 33, rerank.LOCAL_MATCH, 10, 0.5)):
    add(_name, lambda s, d, f=_first, g=_gate, n=_n, w=_w: rerank.reranked_behind_gate(_evidence(s, d, f), "evidence", g, n, w).select("query_id", "item_id", "score"), with_("rnk q gi", _gate_sql(_half_evidence_sql(_first), _gate, _n, _w)).replace(" , ev AS", ", ev AS"))

# Features and models ------------------------------------------------------------------------------------------------
_FEAT_SQL = (
    f", fu AS (SELECT *, {UNIT.format('score')} AS u, greatest(1e-6, {UNIT.format('score')}) AS m FROM rnk)"
    ", fp AS (SELECT *, m/sum(m) OVER g AS p, sum(lat*m) OVER g / sum(m) OVER g AS cla, degrees(atan2(sum(m*sin(radians(lon))) OVER g, sum(m*cos(radians(lon))) OVER g)) AS clo, count(*) OVER g AS n, max(CASE WHEN rank=1 THEN lat END) OVER g AS tla, max(CASE WHEN rank=1 THEN lon END) OVER g AS tlo, max(CASE WHEN rank=1 THEN u END) OVER g AS top, lag(u) OVER (PARTITION BY query_id ORDER BY rank) AS prev FROM fu WINDOW g AS (PARTITION BY query_id))"
    f", fs AS (SELECT query_id, item_id, {', '.join(f'sum(op*own*exp(-0.5*pow(km/{x}e0,2))) AS s{x}' for x in (1, 3, 8, 20))} FROM (SELECT a.query_id, a.item_id, b.p AS op, CASE WHEN a.item_id = b.item_id THEN 0.35e0 ELSE 1 END AS own, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM fp a JOIN fp b USING (query_id)) GROUP BY query_id, item_id)"
    f", ft AS (SELECT query_id, item_id, rank, 1e0 AS bias, (rank-1)/greatest(n-1,1)::DOUBLE AS rank_frac, u AS retrieval_unit, greatest(0e0,top-u) AS retrieval_gap_top, greatest(0e0,coalesce(prev-u,0e0)) AS retrieval_gap_prev, {', '.join(f'greatest(1e-6, least(1, s{x}/max(s{x}) OVER (PARTITION BY query_id))) AS support_{x}km' for x in (1, 3, 8, 20))}, {hav('lat', 'lon', 'tla', 'tlo')} AS dist_top_km, {hav('lat', 'lon', 'cla', 'clo')} AS dist_centroid_km, 1e0 AS source_retrieval, 0e0 AS source_consensus, 0e0 AS source_geoclip FROM fp JOIN fs USING (query_id, item_id))"
)
add("g18_candidate_features", lambda s, d: rerank.candidate_features(o.candidates(s, d)), with_("rnk", _FEAT_SQL + " SELECT query_id, item_id, rank, " + ", ".join(r_(x, x) for x in rerank.FEATURES) + " FROM ft").replace(" , fu AS", ", fu AS"))
_WEIGHTS = {"rank_frac": -1.2, "retrieval_unit": 2.0, "retrieval_gap_top": -3.0, "support_3km": 0.8, "support_20km": 0.4, "dist_centroid_km": -0.3}
_MODEL = {"feature_names": list(rerank.FEATURES), "weights": [_WEIGHTS.get(x, 0.0) for x in rerank.FEATURES], "bias": 0.1, "means": [0.5] * len(rerank.FEATURES), "scales": [2.0] * len(rerank.FEATURES)}
_VALUE = "0.1e0 + " + " + ".join(f"({w}e0)*({x}-0.5e0)/2e0" for x, w in _WEIGHTS.items())
for _kind, _out in {"sigmoid": f"0.05e0 + 0.95e0/(1+exp(-({_VALUE})))", "exp": f"exp({_VALUE})", "linear_clamp": f"greatest(0.05e0, least(1, {_VALUE}))"}.items():
    add(f"g19_model_{_kind}", lambda s, d, k=_kind: rerank.scored_by_model(rerank.candidate_features(o.candidates(s, d)), rerank.LinearModel.from_json(json.dumps(_MODEL | {"activation": k}))).select("query_id", "item_id", "rerank"), with_("rnk", _FEAT_SQL + f", ro AS (SELECT query_id, item_id, {_out} AS r FROM ft) SELECT query_id, item_id, {r_('greatest(0.05e0, least(1, r/max(r) OVER (PARTITION BY query_id)))', 'rerank')} FROM ro").replace(" , fu AS", ", fu AS"))


def _labelled(s, d):
    rows = rerank.candidate_features(o.candidates(s, d)).join(_errors(s, d).select("query_id", "item_id", "km"), ["query_id", "item_id"])
    return stage.written(rows.withColumn("target", fit.distance_target("km", 3.0)), "labelled")


def _weights_of(s, model: rerank.LinearModel):
    return s.createDataFrame(list(zip(model.feature_names, model.weights, model.means, model.scales, strict=True)), "feature string, weight double, mean double, scale double")


add("g20_standardised_ridge", lambda s, d: _weights_of(s, rerank.ridge_model(_labelled(s, d), "target", 1.0)), None)
add("g21_listwise_fit", lambda s, d: _weights_of(s, rerank.listwise_model(_labelled(s, d), "km", 3.0)), None)

# Results, sidecars, index tables ------------------------------------------------------------------------------------


def _lines(s, d):
    """Result lines of four shapes, by the query's number: fusion in the result, fusion beside it, a list, an estimate."""
    c = o.candidates(s, d)
    place = [F.col("lat").alias("latitude"), F.col("lon").alias("longitude")]
    listed = F.struct(*place, F.when(F.col("rk") % 2 == 0, F.col("score")).alias("retrieval_score"), F.col("score").alias("confidence"))
    fused = F.struct(F.struct(*place, F.col("score").alias("retrieval_score")).alias("candidate"), F.when(F.col("rk") % 3 != 0, F.col("score") / 2).alias("posterior_weight"))
    packed = c.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("item_id", listed.alias("l"), fused.alias("f")))).alias("a"))
    get = lambda f: F.transform("a", lambda x: x[f])
    kind, first = F.floor(F.col("query_id") / 100) % 4, F.get("a", F.lit(0))["l"]
    fusion_ = F.struct(get("f").alias("candidates"), F.lit(" High").alias("confidence_tier"), F.lit(1.5).alias("top1_cross_source_support"), (F.col("query_id") + 1.0).alias("uncertainty_radius_m"))
    geo = F.struct(first["latitude"].alias("latitude"), first["longitude"].alias("longitude"), first["confidence"].alias("confidence"), F.lit(0.0).alias("uncertainty_radius_m"), F.lit(9.0).alias("uncertainty_m"))
    image = F.concat(F.lit("a/"), "query_id", F.lit(".jpg"))
    value = F.when(kind == 0, F.to_json(F.struct(image.alias("image"), F.struct(fusion_.alias("fusion"), get("l").alias("candidates")).alias("result")))).when(kind == 1, F.to_json(F.struct(image.alias("path"), fusion_.alias("fusion"), get("l").alias("candidates")))).when(kind == 2, F.to_json(F.struct(image.alias("image"), F.struct(get("l").alias("candidates"), geo.alias("geo")).alias("result")))).otherwise(F.to_json(F.struct(image.alias("image"), F.struct(geo.alias("geo")).alias("result"))))
    return packed.select(value.alias("value"))


_SHAPES = (
    ", k AS (SELECT *, (query_id//100) % 4 AS kind, CASE WHEN (query_id//100) % 4 < 2 AND rk % 3 <> 0 THEN score/2 ELSE score END AS s, row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS pos FROM cand)"
    ", ks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) AS at_ FROM k WHERE kind < 3 OR pos = 1)"
)
_ASSESSED = lambda s, d: results.assessed(results.parsed_results(_lines(s, d)))
add("s04_results", lambda s, d: _ASSESSED(s, d).select("image", F.size("candidates").alias("n"), F.get("candidates", F.lit(0))["latitude"].alias("lat"), F.get("candidates", F.lit(0))["score"].alias("score"), F.element_at("candidates", -1)["longitude"].alias("last_lon"), "radius_m", "tier", "support"), with_("cand", f"{_SHAPES} SELECT 'a/' || query_id || '.jpg' AS image, count(*)::INT AS n, {r_('first(lat ORDER BY at_)', 'lat')}, {r_('first(s ORDER BY at_)', 'score')}, {r_('first(lon ORDER BY at_ DESC)', 'last_lon')}, CASE WHEN any_value(kind) < 2 THEN query_id + 1e0 ELSE 9e0 END AS radius_m, CASE WHEN any_value(kind) < 2 THEN 'high' END AS tier, CASE WHEN any_value(kind) < 2 THEN 1e0 END AS support FROM ks GROUP BY query_id").replace(" , k AS", ", k AS"))
_TRUTH = lambda s, d: o.queries(s, d).where("query_id % 300 <> 0").select(F.concat(F.when(F.col("query_id") % 200 == 0, "a/").otherwise("b/"), "query_id", F.lit(".jpg")).alias("image"), "lat", "lon")
_KM = hav("lat", "lon", "tla", "tlo")
_METRIC_SQL = (
    f"{_SHAPES}, al AS (SELECT query_id, any_value(kind) AS kind FROM ks GROUP BY query_id), tr AS (SELECT query_id, lat AS tla, lon AS tlo FROM q WHERE query_id % 300 <> 0)"
    f", mt AS (SELECT ks.*, {_KM} AS km FROM ks JOIN tr USING (query_id))"
    ", pq AS (SELECT query_id, any_value(kind) AS kind, max(CASE WHEN at_=1 THEN km END) AS km, max(CASE WHEN at_=1 THEN greatest(0,least(1,s)) END) AS c, max((at_ <= 5 AND km <= 5)::INT) AS topk, max((at_ <= 5 AND km <= 25)::INT) AS top25 FROM mt GROUP BY query_id)"
    ", ph AS (SELECT *, (km <= 5)::INT AS hit FROM pq)"
    ", bn AS (SELECT least(floor(c*10),9) AS b, count(*) AS n, avg(hit) AS acc, avg(c) AS c, sum(pow(c-hit,2)) AS sq, sum(CASE WHEN hit=1 THEN -ln(greatest(1e-6,least(1-1e-6,c))) ELSE -ln(1-greatest(1e-6,least(1-1e-6,c))) END) AS nl FROM ph GROUP BY 1)"
    f" SELECT (SELECT count(*) FROM al) AS total, count(*) AS with_ground_truth, {r_('avg(hit)', 'top1')}, {r_('avg(topk)', 'topk')}, {r_('avg(km)', 'top1_mean_km')}, {r_('list_sort(list(km))[(count(*)//2)::INT+1]', 'top1_median_km')}, {r_('100*avg(top25)', 'top5_within_25km_pct')}, 1e0 AS avg_top1_cross_source_support, {r_('(SELECT avg(CASE WHEN kind < 2 THEN query_id+1e0 ELSE 9e0 END) FROM al)', 'avg_uncertainty_radius_m')}, {r_('100*avg((kind<2)::INT)', 'high_confidence_coverage_pct')}, {r_('avg(hit) FILTER (kind<2)', 'high_confidence_top1')}, {r_('100*avg((kind<2)::INT)', 'medium_or_higher_coverage_pct')}, {r_('avg(hit) FILTER (kind<2)', 'medium_or_higher_top1')}, count(*) FILTER (km<=1) AS n_0_1km, count(*) FILTER (km>1 AND km<=5) AS n_1_5km, count(*) FILTER (km>5 AND km<=25) AS n_5_25km, count(*) FILTER (km>25 AND km<=100) AS n_25_100km, count(*) FILTER (km>100) AS n_over_100km"
    f", {r_('(SELECT sum(abs(acc-c)*n)/sum(n) FROM bn)', 'ece')}, {r_('(SELECT sum(sq)/sum(n) FROM bn)', 'brier')}, {r_('(SELECT sum(nl)/sum(n) FROM bn)', 'nll')} FROM ph"
)
add("a17_metric_report", lambda s, d: evaluate.metric_report(_ASSESSED(s, d), _TRUTH(s, d), 5.0, 5), with_("cand q", _METRIC_SQL).replace(" , k AS", ", k AS"))


def _round_trip(s, d):
    c = o.candidates(s, d)
    weighed = stage.written(fusion.posterior(c), "posterior")
    back = results.assessed(results.parsed_results(results.result_lines(fusion.fused(weighed), weighed)))
    return back.select("image", "radius_m", "tier", F.posexplode("candidates").alias("at", "x")).select("image", "at", F.round("radius_m", 2).alias("radius_m"), "tier", F.col("x.latitude").alias("lat"), F.round("x.score", 5).alias("w"))


add("s09_assessment_round_trip", _round_trip, with_("post ell diag", f"SELECT post.query_id::VARCHAR AS image, (row_number() OVER (PARTITION BY post.query_id ORDER BY w DESC, item_id) - 1)::INT AS \"at\", round(major_m,2) AS radius_m, CASE WHEN hi THEN 'high' WHEN mid THEN 'medium' ELSE 'low' END AS tier, {r_('lat', 'lat')}, round(w,5) AS w FROM post JOIN ell USING (query_id) JOIN diag USING (query_id)"))


def _geo_files(s, d):
    """Sidecar texts of the street images, under four kinds of names; every fifth image has a second, later one."""
    p = o.street_points(s, d)
    k, name = F.col("image_id") % 4, F.concat(F.lit("img/"), "image_id", F.lit(".jpg"))
    stem = F.concat(F.lit("img/"), F.col("image_id"))
    path = F.when(k == 0, F.concat(name, F.lit(".geo.json"))).when(k == 1, F.concat(stem, F.lit(".geo.json"))).when(k == 2, F.concat(name, F.lit(".geoloc.json"))).otherwise(F.concat(stem, F.lit(".geoloc.json")))
    one = F.struct(F.col("lat").alias("latitude"), (F.col("lon") + F.when(F.col("image_id") % 9 == 0, 400).otherwise(0)).alias("longitude"), F.when(F.col("image_id") % 2 == 0, F.col("quality")).alias("confidence"), F.col("source").alias("tile_id"))
    text = F.when(F.col("image_id") % 3 == 0, F.to_json(F.struct(F.array(one, one).alias("candidates")))).when(F.col("image_id") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(one))
    later = p.where("image_id % 5 = 0").select(F.concat(F.lit("img/"), F.col("image_id"), F.lit(".geoloc.json")).alias("path"), F.lit('{"latitude": 1, "longitude": 2}').alias("value"))
    return p.select(name.alias("image")), p.select(path.alias("path"), text.alias("value")).unionByName(later.join(p.where("image_id % 4 = 3").select(F.concat(F.lit("img/"), "image_id", F.lit(".geoloc.json")).alias("path")), "path", "left_anti"))


add("s05_geo_sidecars", lambda s, d: results.geo_sidecars(results.sidecar_of(*_geo_files(s, d), results.GEO_SUFFIXES)).select("image", "at", "lat", "lon", "score", "match_id"), with_("sp", f"SELECT 'img/' || image_id || '.jpg' AS image, n::INT AS \"at\", {r_('lat', 'lat')}, {r_('lon', 'lon')}, {r_('CASE WHEN image_id % 2 = 0 THEN quality ELSE 0.3e0 END', 'score')}, source AS match_id FROM sp, range(2) t(n) WHERE (n = 0 OR image_id % 3 = 0) AND (image_id % 7 <> 0 OR image_id % 3 = 0) AND image_id % 9 <> 0"))


def _detection_files(s, d):
    li = o.detections(s, d)
    corner = lambda x, y: F.array(x, y)
    box = F.array(corner(F.col("x"), F.col("y")), corner(F.col("x") + F.col("w"), F.col("y")), corner(F.col("x") + F.col("w"), F.col("y") + F.col("h")), corner(F.col("x"), F.col("y") + F.col("h")))
    item = F.struct(F.when(F.col("label") != "N", F.col("label")).alias("label"), "confidence", F.when(F.col("w") > 5, box).otherwise(F.slice(box, 1, 3)).alias("obb"))
    lists = li.groupBy("image_id").agg(F.collect_list(item).alias("l"))
    return lists.select(F.col("image_id").cast("string").alias("image"), F.when(F.col("image_id") % 2 == 0, F.to_json("l")).otherwise(F.to_json(F.struct(F.col("l").alias("detections")))).alias("value"))


add("s06_detection_sidecars", lambda s, d: results.detection_sidecars(_detection_files(s, d)).groupBy("image", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence"), F.sum(F.get(F.get("points", F.lit(2)), F.lit(0))).alias("right")), with_("det", f"SELECT image_id::VARCHAR AS image, label, count(*) AS n, {r_('sum(confidence)', 'confidence')}, {r_('sum(x+w)', '\"right\"')} FROM det WHERE label <> 'N' AND w > 5 GROUP BY 1, 2"))


def _built(s, d):
    meta = o.geo_index(s, d).select(F.when(F.col("item_id") % 13 != 0, F.concat(F.lit("x/"), "item_id", F.lit(".jpg"))).alias("path"), (F.col("lat") * F.when(F.col("item_id") % 17 == 0, 2).otherwise(1)).alias("lat"), "lon", "source")
    vectors = o.geo_index(s, d).where("item_id % 3 <> 1").select(F.concat(F.lit("x/"), "item_id", F.lit(".jpg")).alias("path"), "embedding")
    return results.write_index(results.built_index(meta, vectors, "m1"), f"{stage.shared_dir(s)}/index-{uuid.uuid4().hex}")


add("s08_index_build", lambda s, d: _built(s, d).groupBy("source", "model_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total")).select("source", "model_id", "n", F.round("total", 3).alias("total")), with_("gi", "SELECT source, 'm1' AS model_id, count(*) AS n, round(sum(list_sum(e)/greatest(sqrt(list_dot_product(e,e)), 1e-12)), 3) AS total FROM gi WHERE item_id % 13 <> 0 AND item_id % 17 <> 0 AND item_id % 3 <> 1 GROUP BY source"))
_PATHS = lambda s, d: o.geo_index(s, d).select(F.concat(F.when(F.col("item_id") % 2 == 0, "a/").otherwise("b/"), F.col("item_id") % 500, F.lit(".jpg")).alias("path"), "embedding")
add("j09_embedding_lookup", lambda s, d: results.with_embeddings(o.street_points(s, d).select("image_id", F.concat(F.lit("a/"), F.col("image_id") % 900, F.lit(".jpg")).alias("path")), _PATHS(s, d).groupBy("path").agg(F.min("embedding").alias("embedding"))).select("image_id", F.get("embedding", F.lit(0)).cast("double").alias("first")), with_("sp gi", f", ix AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'a/' ELSE 'b/' END || (item_id % 500) || '.jpg' AS path, min(e) AS e FROM gi GROUP BY 1), nm AS (SELECT split_part(path, '/', 2) AS name, first(e ORDER BY path) AS e FROM ix GROUP BY 1) SELECT image_id, {r_('coalesce(ix.e[1], nm.e[1])', '\"first\"')} FROM sp LEFT JOIN ix ON ix.path = 'a/' || (image_id % 900) || '.jpg' LEFT JOIN nm ON nm.name = (image_id % 900) || '.jpg'").replace(" , ix AS", ", ix AS"))
_REPORTS = lambda s, d: o.run_metrics(s, d).select("run", "scenario", F.when(F.col("run") == "O", F.to_json(F.struct(F.struct(F.col("value").alias("mean_km")).alias("report"), F.lit(7.0).alias("mean_km")))).otherwise(F.to_json(F.struct(F.col("value").alias("mean_km")))).alias("value"))
add("s21_reports", lambda s, d: results.parsed_reports(_REPORTS(s, d), ("mean_km",)).select("run", "scenario", "mean_km"), with_("runs", f"SELECT run, scenario, {r_('value', 'mean_km')} FROM runs"))

# Mining -------------------------------------------------------------------------------------------------------------
_FAILED = lambda s, d: _errors(s, d).where("rank = 1").select(F.concat(F.lit("q/"), "query_id").alias("query_path"), (F.col("query_id") % 40).alias("scene"), F.col("t_lat").alias("lat"), F.col("t_lon").alias("lon"), F.when(F.col("query_id") % 300 != 0, F.col("lat")).alias("pred_lat"), F.when(F.col("query_id") % 300 != 0, F.col("lon")).alias("pred_lon"), "km")
_SCENED = lambda s, d: o.reference_points(s, d).select(F.concat(F.lit("r/"), F.lpad(F.col("ref_id").cast("string"), 9, "0")).alias("path"), (F.col("ref_id") % 40).alias("scene"), "lat", "lon")
_FAILED_SQL = (
    ", fl AS (SELECT query_id, query_id % 40 AS scene, t.lat AS lat, t.lon AS lon, CASE WHEN query_id % 300 <> 0 THEN e.lat END AS pla, CASE WHEN query_id % 300 <> 0 THEN e.lon END AS plo, km FROM top1 e JOIN (SELECT query_id, lat, lon FROM q) t USING (query_id) WHERE km >= 2)"
    ", rf AS (SELECT 'r/' || lpad(ref_id::VARCHAR, 9, '0') AS path, ref_id % 40 AS scene, lat, lon FROM ref)"
    f", ds AS (SELECT query_id, rf.path, rf.scene, {hav('fl.lat', 'fl.lon', 'rf.lat', 'rf.lon')} AS g, CASE WHEN pla IS NOT NULL THEN {hav('pla', 'plo', 'rf.lat', 'rf.lon')} END AS p FROM fl JOIN rf ON fl.scene <> rf.scene)"
    ", po AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(g,9), path) AS at_ FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scene ORDER BY round(g,9), path) AS n FROM ds WHERE g <= 1.5) WHERE n = 1) WHERE at_ <= 3)"
    ", ng AS (SELECT ds.*, 0 AS late, p AS o FROM ds WHERE p <= 2 AND g >= 2 UNION ALL SELECT ds.*, 1 AS late, g AS o FROM ds WHERE g >= 2 AND g <= 6)"
    ", n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scene ORDER BY late, round(o,9), path) AS n FROM ng WHERE query_id IN (SELECT query_id FROM po) AND (query_id, scene) NOT IN (SELECT (query_id, scene) FROM po)) WHERE n = 1)"
    ", n2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, round(o,9), path) AS at_ FROM n1) WHERE at_ <= 6)"
    f" SELECT 'q/' || query_id AS query_path, (SELECT string_agg(path, ',' ORDER BY at_) FROM po WHERE po.query_id = fl.query_id) AS positives, string_agg(n2.path, ',' ORDER BY at_) AS negatives, {r_('least(3, greatest(1, 1 + any_value(ln(1+fl.km))/ln(11e0) + 0.5e0*sum((late=0)::INT)/count(*)))', 'triplet_weight')} FROM fl JOIN n2 USING (query_id) GROUP BY query_id"
)


def _failure_triplets(s, d):
    return mining.failure_triplets(_FAILED(s, d), _SCENED(s, d), positive_km=1.5, most_km=6.0, max_negatives=6)


_JOINED = lambda c: F.array_join(F.transform(c, lambda x: x["path"]), ",")
add("g25_failure_triplets", lambda s, d: _failure_triplets(s, d).select("query_path", _JOINED("positives").alias("positives"), _JOINED("hard_negatives").alias("negatives"), "triplet_weight"), with_("top1 q ref", _FAILED_SQL).replace(" , fl AS", ", fl AS"))
_READ_BACK = lambda s, d: results.parsed_triplets(results.triplet_lines(_failure_triplets(s, d)))
add("s20_triplet_round_trip", lambda s, d: _READ_BACK(s, d).select("query_path", _JOINED("positives").alias("positives"), _JOINED("hard_negatives").alias("negatives"), "triplet_weight"), with_("top1 q ref", _FAILED_SQL).replace(" , fl AS", ", fl AS"))


def _crossview(s, d):
    streets = o.street_points(s, d).where("image_id % 100 = 0").select(F.col("image_id").alias("query_id"), "lat", "lon", (F.col("image_id") % 97).alias("aerial_id"))
    found = mining.crossview_triplets(streets, o.reference_points(s, d).withColumnRenamed("ref_id", "aerial_id"), 0.3, 0.5, 1.5, 3, 5)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["aerial_id"]), ",")
    return found.select("query_id", ids("positives").alias("positives"), ids("hard_negatives").alias("negatives"))


add("g27_crossview_triplets", _crossview, with_("sp ref", f", ds AS (SELECT image_id AS query_id, ref_id, {hav('sp.lat', 'sp.lon', 'ref.lat', 'ref.lon')} AS km, ref_id = image_id % 97 AS own FROM sp, ref WHERE image_id % 100 = 0), po AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT own, round(km,9), ref_id) AS at_ FROM ds WHERE own OR km <= 0.3) WHERE at_ <= 3), ng AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(km,9), ref_id) AS at_ FROM ds WHERE km BETWEEN 0.5 AND 1.5 AND (query_id, ref_id) NOT IN (SELECT (query_id, ref_id) FROM po)) WHERE at_ <= 5) SELECT query_id, positives, negatives FROM (SELECT query_id, string_agg(ref_id::VARCHAR, ',' ORDER BY at_) AS positives FROM po GROUP BY 1) JOIN (SELECT query_id, string_agg(ref_id::VARCHAR, ',' ORDER BY at_) AS negatives FROM ng GROUP BY 1) USING (query_id)").replace(" , ds AS", ", ds AS"))
_QUOTA = lambda s, d: o.street_points(s, d).select((F.floor(F.col("lat") / 0.02) * 10_000 + F.floor(F.col("lon") / 0.02)).alias("cell"), "image_id", F.when(F.col("image_id") % 10 != 0, F.col("sequence")).alias("sequence"), "quality")
add("g08_quota_sample", lambda s, d: mining.quota_sample(_QUOTA(s, d), 5, 2, [F.col("quality").desc(), F.col("image_id").desc()], 120).select("cell", "image_id"), None)
_CHUNKS = lambda s, d: o.table(s, d, "lineitem").select(F.col("l_orderkey").alias("street_id"), F.col("l_partkey").alias("aerial_id"), F.col("l_returnflag").alias("chunk"), F.xxhash64("l_orderkey", "l_linenumber").alias("row"))
add("g29_chunk_merge", lambda s, d: mining.merged_once(_CHUNKS(s, d), ["street_id", "aerial_id"], ["chunk", "row"]).select("street_id", "aerial_id"), None)

# Reports and baselines ----------------------------------------------------------------------------------------------
_PROVIDED = lambda s, d: o.candidates(s, d).select(F.col("source").alias("model"), F.when(F.col("item_id") % 11 == 0, "missing_file").when(F.col("item_id") % 13 == 0, "no_candidates").alias("error"), F.when((F.col("item_id") % 11 != 0) & (F.col("item_id") % 13 != 0), F.col("score")).alias("score"))
add("a28_provider_report", lambda s, d: evaluate.provider_report(_PROVIDED(s, d)), with_("cand", f"SELECT model, error, count(*) AS n, count(s) AS n_scored, {r_('avg(s)', 'mean_score')}, {r_('min(s)', 'min_score')}, {r_('max(s)', 'max_score')} FROM (SELECT source AS model, CASE WHEN item_id % 11 = 0 THEN 'missing_file' WHEN item_id % 13 = 0 THEN 'no_candidates' END AS error, CASE WHEN item_id % 11 <> 0 AND item_id % 13 <> 0 THEN score END AS s FROM cand) GROUP BY model, error"))
add("a35_baseline_promotion", lambda s, d: evaluate.promoted(o.run_metrics(s, d), "O", "paris", evaluate.promoted(o.run_metrics(s, d), "F", "us").unionByName(evaluate.promoted(o.run_metrics(s, d), "P", "paris"))), with_("runs", f"SELECT CASE WHEN run = 'O' THEN 'paris' ELSE 'us' END AS profile, scenario, {r_('value', 'value')}, run FROM runs WHERE run IN ('O', 'F')"))
_ROUNDS = lambda s, d: o.table(s, d, "orders").groupBy((F.col("o_custkey") % 50).alias("round")).agg(F.round(F.avg(F.col("o_totalprice").cast("double")) / 1e4, 1).alias("mean_km"), F.round(F.avg((F.col("o_totalprice") < 120000).cast("double")) * 100, 0).alias("within_2km_pct"))
add("g30_best_round", lambda s, d: evaluate.best_round(_ROUNDS(s, d), "within_2km_pct", True), f"SELECT round, {r_('m', 'mean_km')}, {r_('w', 'within_2km_pct')} FROM (SELECT o_custkey % 50 AS round, round(avg(o_totalprice::DOUBLE)/1e4, 1) AS m, round(avg((o_totalprice < 120000)::INT)*100, 0) AS w FROM orders GROUP BY 1) ORDER BY w DESC, m, round LIMIT 1")

# Before the providers run -------------------------------------------------------------------------------------------
_SCOPED = lambda s, d: o.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.lit("open-geo")).alias("named"), F.concat(F.lit("configs/"), F.when(F.col("c_custkey") % 2 == 0, "paris_v").otherwise("us_v"), "c_custkey", F.lit(".json")).alias("config"), F.concat(F.lit("D:\\data\\"), F.when(F.col("c_custkey") % 5 < 2, "paris_x").when(F.col("c_custkey") % 5 == 2, "open_geo").otherwise("other")).alias("folder"))


def _scopes(s, d):
    m = _SCOPED(s, d).withColumns({"profile": providers.scope_of_profile(F.col("named"), F.col("config")), "dataset": providers.scope_of_dataset(F.col("folder"))})
    return m.select("id", "profile", "dataset", providers.scope_mismatch(F.col("profile"), F.col("dataset")).alias("mismatch"))


add("p07_scope_check", _scopes, "SELECT id, profile, dataset, profile <> dataset AND dataset <> 'UNKNOWN' AS mismatch FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN replace(upper(trim(c_mktsegment)), '-', '_') WHEN c_custkey % 3 = 1 THEN 'US' WHEN c_custkey % 2 = 0 THEN 'PARIS' ELSE 'US' END AS profile, CASE WHEN c_custkey % 5 < 2 THEN 'PARIS' WHEN c_custkey % 5 = 2 THEN 'US' ELSE 'UNKNOWN' END AS dataset FROM customer)")
_NAMED = lambda s, d: o.queries(s, d).select("query_id", F.concat(F.lit("q/"), F.when(F.col("query_id") % 400 == 0, "PAN_").when(F.col("query_id") % 400 == 100, "rgb-").when(F.col("query_id") % 400 == 200, "mul").otherwise("img"), "query_id").alias("path"))
add("p12_views", lambda s, d: providers.with_views(_NAMED(s, d), "path", ["RGB", "gray", "gray", "blur", "edge"], [0, 370, 10, -90, 450, float("nan")], [0.2, 0.8, 0.8004, 2], True).select("query_id", "mode", "angle", "scale"), with_("q", "SELECT query_id, mode, angle, scale FROM (SELECT query_id, unnest(CASE query_id % 400 WHEN 0 THEN ['gray','edge'] WHEN 100 THEN ['rgb'] ELSE ['rgb','gray'] END) AS mode FROM q), (SELECT unnest([0e0, 10e0, -90e0, 90e0]) AS angle), (SELECT unnest([1e0, 0.8e0, 0.45e0]) AS scale)"))
_RAW = lambda s, d: o.run_metrics(s, d).select("run", "scenario", F.when(F.col("run") == "F", -F.col("value")).when(F.col("run") == "P", F.lit(float("nan"))).otherwise(F.col("value")).alias("weight"))
add("p14_index_weights", lambda s, d: providers.index_weights(_RAW(s, d)), with_("runs", f"SELECT run, scenario, {r_('CASE WHEN run = $$O$$ THEN value ELSE 1e0 END', 'weight')} FROM runs"))


def _provided_union(s, d):
    def broken(q):
        raise ValueError("no index")

    c = o.candidates(s, d)
    out, errors = providers.union_of_providers(o.queries(s, d), {"near": lambda q: c.where("rk <= 3"), "none": broken, "far": lambda q: c.where("rk > 8").withColumn("score", F.when(F.col("rk") == 9, F.lit(float("inf"))).otherwise(F.col("score")))})
    return out.select("query_id", "item_id", "provider", F.lit(len(errors)).alias("n_errors"))


add("u01_provider_union", _provided_union, with_("cand", "SELECT query_id, item_id, CASE WHEN rk <= 3 THEN 'near' ELSE 'far' END AS provider, 1 AS n_errors FROM cand WHERE (rk <= 3 OR rk = 10) AND score >= 0.001"))
add("u03_exact_copies", lambda s, d: spatial.first_by_key(o.street_points(s, d).select("sequence", F.concat("source", F.col("image_id") % 3).alias("path"), "image_id"), ["sequence", "path"], [F.col("image_id")]), with_("sp", "SELECT sequence, source || (image_id % 3) AS path, min(image_id) AS image_id FROM sp GROUP BY 1, 2"))


def _descriptors(s, d):
    """Eight descriptors an image: the parts of eight numbers of its vector."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, F.lit(8)))
    return o.geo_index(s, d).select("item_id", F.posexplode(cut).alias("part", "v"))


def _local_scores(s, d):
    q = _descriptors(s, d).where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("part").alias("q_part"), F.col("v").alias("qv"))
    pairs = o.candidates(s, d).where("rk <= 3").select("query_id", "item_id")
    return retrieval.local_matches(pairs, q, _descriptors(s, d), 0.95)


add("j14_local_matches", _local_scores, with_("cand q gi", ", pr_ AS (SELECT query_id, item_id, q.e AS qe, gi.e AS ie FROM cand JOIN q USING (query_id) JOIN gi USING (item_id) WHERE rk <= 3), dd AS (SELECT query_id, item_id, a, b, list_sum(list_transform(range(1, 9), lambda k: pow(qe[a*8+k]-ie[b*8+k], 2))) AS d2 FROM pr_, range(8) x(a), range(8) y(b)), nn AS (SELECT query_id, item_id, a, min(d2) AS d1, list_sort(list(d2))[2] AS d2 FROM dd GROUP BY query_id, item_id, a) SELECT query_id, item_id, count(*) AS n, count(*) FILTER (sqrt(d1) < 0.95e0*sqrt(d2)) AS n_good FROM nn GROUP BY query_id, item_id").replace(" , pr_ AS", ", pr_ AS"))

# Whole chains -------------------------------------------------------------------------------------------------------


def _pipeline(s, d):
    images = o.queries(s, d).select(F.col("query_id").alias("image_id"))
    given = images.where("image_id % 500 = 0").select("image_id", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(0.6).alias("confidence"), F.lit(50.0).alias("uncertainty_m"))
    found = providers.whole_pipeline(images, o.detections(s, d), given, lambda q: o.candidates(s, d), fusion.fuse)
    return found.select("image_id", "n_detections", "detection_score", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("confidence", 5).alias("confidence"), F.round("uncertainty_m", 2).alias("uncertainty_m"), "tier", "estimate")


add("o3_image_pipeline", _pipeline, with_("q ell diag det", ", ds AS (SELECT image_id, count(*) AS n, list_avg(list_sort(list(confidence), 'DESC')[1:3]) AS c FROM det GROUP BY image_id) SELECT query_id AS image_id, coalesce(ds.n, 0) AS n_detections, round(ds.c, 6) AS detection_score, round(CASE WHEN query_id % 500 = 0 THEN 1e0 ELSE mean_lat END, 4) AS lat, round(CASE WHEN query_id % 500 = 0 THEN 2e0 ELSE mean_lon END, 4) AS lon, round(CASE WHEN query_id % 500 = 0 THEN 0.6e0 ELSE greatest(0.05e0, least(0.95e0, top1)) END, 5) AS confidence, round(CASE WHEN query_id % 500 = 0 THEN 50e0 ELSE major_m END, 2) AS uncertainty_m, CASE WHEN hi THEN 'high' WHEN mid THEN 'medium' ELSE 'low' END AS tier, CASE WHEN query_id % 500 = 0 THEN 'given' ELSE 'fused' END AS estimate FROM q JOIN ell USING (query_id) JOIN diag USING (query_id) LEFT JOIN ds ON ds.image_id = query_id").replace(" , ds AS", ", ds AS"))


def _sourced_views(s, d):
    return _views(s, d).join(o.candidates(s, d).select("query_id", "item_id", "source"), ["query_id", "item_id"])


_FULL = chains.RetrievalKnobs(norm="minmax", agreement_weight=0.2, weights={"idx0": 1.2, "idx1": 0.9}, structure_weight=0.3, local_weight=0.3, box=(48.8, 48.95, 2.25, 2.45), min_score=0.1, min_keep=6, locality_radius_km=3.0, locality_weight=0.5, balance_beta=0.1, graph_top_n=12, diverse_km=1.0, consensus_top_n=8, consensus_radius_km=3.0, density_top_n=8, density_sigma_km=2.0, top_k=10)
add("o1_full_chain", lambda s, d: chains.retrieval_chain(_evidence(s, d, 1).withColumn("structure", F.col("evidence")).withColumn("local", F.col("evidence")).drop("evidence"), _FULL, _sourced_views(s, d)).select("query_id", "item_id", "rank", "match_id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon")), None)
