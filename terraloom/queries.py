"""The registered queries of the location operators, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, scores
from .operators import evaluate, fusion, retrieval, spatial
from .plans import overlay as o
from .streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BOX = (48.83, 48.87, 2.29, 2.41)


def hav(a: str, b: str, c: str, d: str) -> str:
    t = f"(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))"
    return f"(12742e0*atan2(sqrt({t}),sqrt(greatest(1-{t},0e0))))"


def _place_sql(key: str, fine: bool = False) -> str:
    a, b, s = (10000, 20000, "1e5") if fine else (1000, 2000, "1e4")
    return f"48.8e0 + (({key}*7919) % {a})::DOUBLE/{s} AS lat, 2.25e0 + (({key}*104729) % {b})::DOUBLE/{s} AS lon"


UNIT = "(CASE WHEN {0} IS NULL OR isnan({0}) OR isinf({0}) THEN 0.5e0 WHEN {0} BETWEEN 0 AND 1 THEN {0} ELSE 1/(1+exp(-{0})) END)"
SHIFT = "(CASE WHEN {0} IS NULL OR isnan({0}) OR isinf({0}) THEN 0.5e0 WHEN {0} BETWEEN 0 AND 1 THEN {0} WHEN {0} BETWEEN -1 AND 1 THEN 0.5e0*({0}+1) ELSE 1/(1+exp(-{0})) END)"
CTE = {
    "gi": f"SELECT vec_id AS item_id, 'idx' || (vec_id % 3) AS source, {_place_sql('vec_id')}, embedding::DOUBLE[] AS e FROM embeddings",
    "q": f"SELECT vec_id AS query_id, label AS grp, {_place_sql('vec_id')}, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0",
    "cand": "SELECT * FROM (SELECT query_id, source, item_id, gi.lat, gi.lon, list_dot_product(q.e, gi.e) AS score, 'retrieval:' || source || ':' || item_id AS match_id, row_number() OVER (PARTITION BY query_id, source ORDER BY round(list_dot_product(q.e, gi.e), 9) DESC, item_id) AS rk FROM q, gi WHERE item_id <> query_id) WHERE rk <= 10",
    "rnk": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM cand",
    "err": f"SELECT rnk.*, grp, {hav('rnk.lat', 'rnk.lon', 'q.lat', 'q.lon')} AS km FROM rnk JOIN q USING (query_id)",
    "top1": "SELECT * FROM err WHERE rank = 1",
    "pr": f"SELECT a.*, b.item_id AS o_item, b.score AS o_score, b.source AS o_source, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM cand a JOIN cand b USING (query_id)",
    "sp": f"SELECT event_id AS image_id, user_id AS sequence, ts AS captured_at, {_place_sql('event_id', True)}, CASE WHEN event_id % 11 <> 0 THEN (event_id*37 % 360)::DOUBLE END AS heading_deg, event_type AS source, value AS quality FROM events",
    "ref": f"SELECT c_custkey AS ref_id, {_place_sql('c_custkey')} FROM customer",
    "det": "SELECT l_orderkey AS image_id, l_returnflag AS label, l_discount::DOUBLE*10 AS confidence, (l_partkey % 50)::DOUBLE AS x, (l_suppkey % 50)::DOUBLE AS y, l_quantity::DOUBLE AS w, 5+l_tax::DOUBLE*100 AS h FROM lineitem",
    "runs": "SELECT o_orderstatus AS run, o_orderpriority AS scenario, avg(o_totalprice::DOUBLE)/1e4 AS value FROM orders GROUP BY ALL",
}
CTE |= {
    "prior": f"SELECT *, greatest(1e-3, {UNIT.format('score')}) / sum(greatest(1e-3, {UNIT.format('score')})) OVER (PARTITION BY query_id) AS p FROM cand",
    "kern": f"SELECT a.query_id, a.item_id, sum(b.p*exp(-0.5*pow({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}/2e0,2))) AS s, sum(CASE WHEN a.source<>b.source THEN b.p*exp(-0.5*pow({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}/15e0,2)) ELSE 0 END) / sum(CASE WHEN a.source<>b.source THEN b.p END) AS c FROM prior a JOIN prior b USING (query_id) GROUP BY ALL",
    "like_": "SELECT query_id, item_id, greatest(1e-3, least(1, s/max(s) OVER (PARTITION BY query_id))) AS spatial, greatest(1e-3, least(1, c/max(c) OVER (PARTITION BY query_id))) AS cross_ FROM kern",
    "lg": f"SELECT cand.*, spatial, cross_, ln(u/(1-u))/0.2e0 + 1.2e0*ln(greatest(spatial,1e-12)) + ln(greatest(cross_,1e-12)) AS logit FROM (SELECT *, greatest(1e-6, least(1-1e-6, {UNIT.format('score')})) AS u FROM cand) cand JOIN like_ USING (query_id, item_id)",
    "post": "SELECT *, e/sum(e) OVER (PARTITION BY query_id) AS w FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY query_id)) AS e FROM lg)",
    "cred": "SELECT * FROM (SELECT *, coalesce(sum(w) OVER (PARTITION BY query_id ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(w,9) DESC, item_id) AS at_ FROM post) WHERE at_ <= 5) WHERE before < 0.9e0 OR at_ <= 2",
    "mean_": "SELECT query_id, sum(lat*w)/sum(w) AS mean_lat, degrees(atan2(sum(w*sin(radians(lon))), sum(w*cos(radians(lon))))) AS mean_lon FROM cred GROUP BY query_id",
    "cov": "SELECT query_id, mean_lat, mean_lon, count(*) AS set_size, sum(w*x*x)/sum(w) AS xx, sum(w*x*y)/sum(w) AS xy, sum(w*y*y)/sum(w) AS yy FROM (SELECT cred.*, mean_lat, mean_lon, (lon-mean_lon)*greatest(1e-6, abs(111320e0*cos(radians(mean_lat)))) AS x, (lat-mean_lat)*111320e0 AS y FROM cred JOIN mean_ USING (query_id)) GROUP BY ALL",
    "ell": "SELECT query_id, mean_lat, mean_lon, set_size, sqrt(greatest((xx+yy)/2+root,0)) AS major_m, sqrt(greatest((xx+yy)/2-root,0)) AS minor_m, CASE WHEN xx+yy<=0 OR abs(xy)<1e-9 THEN 0e0 ELSE degrees(0.5*atan2(2*xy, xx-yy)) END AS orientation_deg FROM (SELECT *, sqrt(greatest(pow(xx+yy,2)/4-(xx*yy-xy*xy),0)) AS root FROM cov)",
    "diag": "SELECT *, calibrated_top1 >= 0.7 AND margin >= 0.2 AND entropy <= 0.55 AS hi, calibrated_top1 >= 0.45 AND margin >= 0.08 AND entropy <= 0.8 AS mid FROM (SELECT *, 1/(1+exp(-ln(greatest(1e-6,least(1-1e-6,top1))/(1-greatest(1e-6,least(1-1e-6,top1)))))) AS calibrated_top1 FROM (SELECT query_id, count(*) AS n, greatest(0, least(1, -sum(w*ln(greatest(w,1e-12)))/ln(greatest(count(*),2)))) AS entropy, 1/greatest(sum(w*w),1e-12) AS effective, max(w) AS top1, max(w) - coalesce(list_sort(list(w), 'DESC')[2], 0) AS margin FROM post GROUP BY query_id))",
    "hits": "SELECT post.*, grp, (CASE WHEN km <= 5 THEN 1 ELSE 0 END) AS hit FROM post JOIN (SELECT query_id, item_id, grp, km FROM err) USING (query_id, item_id)",
}
NEEDS = {
    "cand": ("gi", "q"), "rnk": ("cand",), "err": ("rnk",), "top1": ("err",), "pr": ("cand",), "prior": ("cand",), "kern": ("prior",), "like_": ("kern",), "lg": ("like_",), "post": ("lg",),
    "cred": ("post",), "mean_": ("cred",), "cov": ("mean_",), "ell": ("cov",), "diag": ("post",), "hits": ("post", "err"),
}


def with_(names: str, body: str) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for x in NEEDS.get(name, ()):
            need(x)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in order) + " " + body


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r_(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = lambda s, d: rounded(o.planned(query, s, d))
    if sql:
        SQL[name] = sql


def _errors(s, d):
    return evaluate.errors(o.candidates(s, d), o.queries(s, d))


def _top1(s, d):
    return _errors(s, d).where("rank = 1")


# Retrieval ----------------------------------------------------------------------------------------------------------
add("j01_similarity_topk", lambda s, d: o.candidates(s, d).select("query_id", "source", "item_id", "score", "rk"), with_("cand", f"SELECT query_id, source, item_id, {r_('score', 'score')}, rk FROM cand"))
add("w02_merged_ranking", lambda s, d: retrieval.ranked(retrieval.distinct_places(o.candidates(s, d))).select("query_id", "item_id", "rank"), with_("cand", "SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, item_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, round(lat,6), round(lon,6), match_id ORDER BY round(score,9) DESC, item_id) AS n FROM cand) WHERE n = 1"))
for mode, expr in {
    "minmax": "CASE WHEN max(score) OVER g - min(score) OVER g < 1e-9 THEN 0.5e0 ELSE (score - min(score) OVER g)/(max(score) OVER g - min(score) OVER g) END",
    "zscore": "CASE WHEN stddev_pop(score) OVER g < 1e-6 THEN 0.5e0 ELSE 1/(1+exp(-(score - avg(score) OVER g)/stddev_pop(score) OVER g)) END",
    "rank": "exp(-(row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, item_id) - 1)/greatest(1, count(*) OVER g/3e0))",
}.items():
    add(f"a02_normalise_{mode}", lambda s, d, mode=mode: retrieval.normalise_by_source(o.candidates(s, d), mode).select("query_id", "item_id", "norm"), with_("cand", f"SELECT query_id, item_id, {r_(expr, 'norm')} FROM cand WINDOW g AS (PARTITION BY query_id, source)"))
add("a03_weighted_fusion", lambda s, d: retrieval.fuse_by_weight(retrieval.normalise_by_source(o.candidates(s, d), "none"), {"idx0": 1.5, "idx1": 0.8}).select("query_id", "item_id", "fused"), with_("cand", f"SELECT query_id, item_id, {r_('greatest(-1, least(1, greatest(-1, least(1, score)) * CASE source WHEN $$idx0$$ THEN 1.5e0 WHEN $$idx1$$ THEN 0.8e0 ELSE 1e0 END))', 'fused')} FROM cand"))
add("a04_reciprocal_rank_fusion", lambda s, d: retrieval.fuse_by_reciprocal_rank(o.candidates(s, d)).select("query_id", "item_id", "rrf", "fused"), with_("cand", f"SELECT query_id, item_id, {r_('rrf', 'rrf')}, {r_('CASE WHEN max(rrf) OVER g - min(rrf) OVER g < 1e-9 THEN 0.5e0 ELSE (rrf - min(rrf) OVER g)/(max(rrf) OVER g - min(rrf) OVER g) END', 'fused')} FROM (SELECT query_id, sum(1/(60e0+rk)) AS rrf, first(item_id ORDER BY round(score,9) DESC, item_id) AS item_id FROM cand GROUP BY query_id, round(lat,5), round(lon,5)) WINDOW g AS (PARTITION BY query_id)"))
add("p02_backfill", lambda s, d: retrieval.with_backfill(o.candidates(s, d), 0.3, 5).select("query_id", "item_id"), with_("cand", "SELECT query_id, item_id FROM (SELECT *, sum((score >= 0.3)::INT) OVER (PARTITION BY query_id) AS kept, row_number() OVER (PARTITION BY query_id, score >= 0.3 ORDER BY round(score,9) DESC, item_id) AS at_ FROM cand) WHERE score >= 0.3 OR at_ <= 5 - kept"))
_BOXKM = f"(CASE WHEN lat BETWEEN {BOX[0]} AND {BOX[1]} AND lon BETWEEN {BOX[2]} AND {BOX[3]} THEN 0e0 ELSE {hav('lat', 'lon', f'least(greatest(lat,{BOX[0]}e0),{BOX[1]}e0)', f'least(greatest(lon,{BOX[2]}e0),{BOX[3]}e0)')} END)"
_ADJ = f"(SELECT *, greatest(1e-9, {SHIFT.format('score')} * CASE WHEN box_km <= 1e-6 THEN 1 ELSE exp(-box_km/250e0) END) AS adj FROM (SELECT *, {_BOXKM} AS box_km FROM cand))"
add("p03_geo_prior_soft", lambda s, d: retrieval.geo_prior(o.candidates(s, d), BOX, False).select("query_id", "item_id", "box_km", "adjusted"), with_("cand", f"SELECT query_id, item_id, {r_('box_km', 'box_km')}, {r_('greatest(1e-6, least(1, adj))', 'adjusted')} FROM {_ADJ}"))
add("p03_geo_prior_hard", lambda s, d: retrieval.geo_prior(o.candidates(s, d), BOX, True, min_keep=12).select("query_id", "item_id", "adjusted"), with_("cand", f"SELECT query_id, item_id, {r_('greatest(1e-6, least(1, adj))', 'adjusted')} FROM (SELECT *, sum((box_km <= 1e-6)::INT) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, box_km <= 1e-6 ORDER BY round(adj,9) DESC, item_id) AS at_ FROM {_ADJ}) WHERE box_km <= 1e-6 OR at_ <= 12 - n"))
add("g13_locality_rerank", lambda s, d: retrieval.rerank_by_locality(o.candidates(s, d), 3.0, 0.7), with_("pr", f"SELECT query_id, item_id, {r_('greatest(1e-6, least(1, u*((1-0.7e0/1.7e0)+0.7e0/1.7e0*greatest(1e-3, least(1, s/max(s) OVER (PARTITION BY query_id))))))', 'local_score')} FROM (SELECT query_id, item_id, any_value({SHIFT.format('score')}) AS u, greatest(1e-9, sum(CASE WHEN item_id <> o_item THEN {SHIFT.format('o_score')}*exp(-km/3e0) ELSE 0 END)) AS s FROM pr GROUP BY query_id, item_id)"))
add("g12_graph_rerank", lambda s, d: retrieval.rerank_by_graph(o.candidates(s, d), 15), with_("rnk", f"SELECT query_id, item_id, {r_('greatest(1e-6, least(1, raw/max(raw) OVER (PARTITION BY query_id)))', 'graph_score')} FROM (SELECT a.query_id, a.item_id, pow(greatest(1e-9, any_value({SHIFT.format('a.score')})), 0.4e0)*greatest(1e-9, sum(greatest(1e-9,{SHIFT.format('b.score')})*exp(-pow({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')},2)*0.5/9e0))) AS raw FROM rnk a JOIN rnk b USING (query_id) WHERE a.rank <= 15 AND b.rank <= 15 GROUP BY a.query_id, a.item_id) UNION ALL SELECT query_id, item_id, round(score,6) FROM rnk WHERE rank > 15"))
_LOW = lambda s, d: o.candidates(s, d).withColumn("score", F.col("score") - 0.5)  # scores on both sides of 0
add("g01_source_balance", lambda s, d: retrieval.balanced_by_source(_LOW(s, d), 10, 0.3).select("query_id", "item_id", "balanced"), with_("cand", f"SELECT query_id, item_id, {r_('b', 'balanced')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY low DESC, round(score,9) DESC, item_id) AS at_ FROM (SELECT *, min(round(b,9)) OVER (PARTITION BY query_id, source ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM (SELECT *, score/(1+0.3e0*(n-1)) AS b FROM (SELECT query_id, source, item_id, score-0.5e0 AS score, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score-0.5e0,9) DESC, item_id) AS n FROM cand)))) WHERE at_ <= 10"))
add("w07_rank_features", lambda s, d: retrieval.rank_features(o.candidates(s, d)), with_("rnk", f"SELECT query_id, item_id, rank, {r_('(rank-1)/greatest(count(*) OVER g - 1, 1)::DOUBLE', 'rank_fraction')}, {r_('max(score) OVER g - score', 'gap_top')}, {r_('coalesce(lag(score) OVER (PARTITION BY query_id ORDER BY rank) - score, 0)', 'gap_previous')} FROM rnk WINDOW g AS (PARTITION BY query_id)"))

# Fusion -------------------------------------------------------------------------------------------------------------
_POST = lambda s, d: fusion.posterior(o.candidates(s, d))
add("a08_a09_support", lambda s, d: fusion.spatial_and_cross_support(fusion.normalised_scores(o.candidates(s, d)), fusion.Knobs()).select("query_id", "item_id", "spatial", "cross"), with_("like_", f"SELECT query_id, item_id, {r_('spatial', 'spatial')}, {r_('cross_', '\"cross\"')} FROM like_"))
add("a05_posterior", lambda s, d: _POST(s, d).select("query_id", "item_id", "w"), with_("post", f"SELECT query_id, item_id, {r_('w', 'w')} FROM post"))
add("a10_plausibility", lambda s, d: fusion.plausibility(_POST(s, d), 6.0).select("query_id", "item_id", "plausible"), with_("post", f"SELECT query_id, item_id, {r_('CASE WHEN max(m) OVER g <= 1e-6 THEN 1 ELSE greatest(1e-3, least(1, m/max(m) OVER g)) END', 'plausible')} FROM (SELECT a.query_id, a.item_id, greatest(1e-6, sum(CASE WHEN a.item_id <> b.item_id AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 6 THEN b.w ELSE 0 END)) AS m FROM post a JOIN post b USING (query_id) GROUP BY ALL) WINDOW g AS (PARTITION BY query_id)"))
add("a11_outlier_guard", lambda s, d: fusion.outlier_guard(o.candidates(s, d), 1.0, 3.0).select("query_id", "item_id", "inlier"), with_("pr", f", tot AS (SELECT query_id, item_id, any_value(lat) AS lat, any_value(lon) AS lon, sum(km) AS t FROM pr GROUP BY query_id, item_id), mid AS (SELECT query_id, first(lat ORDER BY round(t,9), item_id) AS cl, first(lon ORDER BY round(t,9), item_id) AS co FROM tot GROUP BY query_id), dst AS (SELECT tot.query_id, item_id, {hav('lat', 'lon', 'cl', 'co')} AS d FROM tot JOIN mid USING (query_id)), med AS (SELECT query_id, list_sort(list(d))[ceil(count(*)/2.0)::INT] AS m FROM dst GROUP BY query_id), mad AS (SELECT query_id, any_value(m) AS m, list_sort(list(abs(d-m)))[ceil(count(*)/2.0)::INT] AS a FROM dst JOIN med USING (query_id) GROUP BY query_id) SELECT query_id, item_id, {r_('greatest(1e-3, least(1, r/max(r) OVER (PARTITION BY query_id)))', 'inlier')} FROM (SELECT dst.*, exp(-0.5*pow(d/greatest(1, m+3*greatest(a,1e-6)),2)) AS r FROM dst JOIN mad USING (query_id))".replace(", tot AS", ", tot AS", 1)).replace(" , tot AS", ", tot AS"))
add("a14_diagnostics", lambda s, d: fusion.diagnostics(_POST(s, d)), with_("diag", f"SELECT query_id, n, {r_('effective', 'effective')}, {r_('entropy', 'entropy')}, {r_('top1', 'top1')}, {r_('margin', 'margin')}, {r_('calibrated_top1', 'calibrated_top1')}, CASE WHEN hi THEN 'high' WHEN mid THEN 'medium' ELSE 'low' END AS tier, NOT (hi OR mid) OR effective >= greatest(3, 0.65*n) AS ambiguous FROM diag"))
add("w03_credible_set", lambda s, d: fusion.credible_set(_POST(s, d)).select("query_id", "item_id", "at"), with_("cred", "SELECT query_id, item_id, at_ AS \"at\" FROM cred"))
add("a13_f18_position", lambda s, d: rounded(fusion.weighted_position(fusion.credible_set(_POST(s, d))), 3), with_("ell", "SELECT query_id, round(mean_lat,3) AS mean_lat, round(mean_lon,3) AS mean_lon, set_size, round(major_m,3) AS major_m, round(minor_m,3) AS minor_m, round(orientation_deg,3) AS orientation_deg FROM ell"))
add("o2_fusion", lambda s, d: fusion.fuse(o.candidates(s, d)).select("query_id", F.round("mean_lat", 5).alias("mean_lat"), F.round("mean_lon", 5).alias("mean_lon"), F.round("major_m", 2).alias("radius_m"), "tier"), with_("ell diag", "SELECT query_id, round(mean_lat,5) AS mean_lat, round(mean_lon,5) AS mean_lon, round(major_m,2) AS radius_m, CASE WHEN hi THEN 'high' WHEN mid THEN 'medium' ELSE 'low' END AS tier FROM ell JOIN diag USING (query_id)"))

# Evaluation ---------------------------------------------------------------------------------------------------------
_V = "list_sort(list(km))"
add("a18_distance_report", lambda s, d: evaluate.distance_report(_top1(s, d)), with_("top1", "SELECT " + ", ".join([r_("avg(km)", "mean_km"), *(r_(f"avg((km <= {x})::INT)*100", f"within_{x}km_pct") for x in (1, 2, 5, 10, 50)), "count(*) AS evaluated", r_(f"{_V}[(count(*)//2)::INT+1]", "median_km"), r_(f"{_V}[CASE WHEN floor(count(*)*0.9)-1 < 0 THEN count(*) ELSE floor(count(*)*0.9) END::INT]", "p90_km"), *(r_(f"{_V}[round_even({p}/100.0*(count(*)-1), 0)::INT+1]", f"p{p}_km") for p in (10, 25, 75, 95))]) + " FROM top1"))
add("a19_candidate_oracle", lambda s, d: evaluate.candidate_oracle(_errors(s, d)), with_("err", f"SELECT query_id, {r_('min(km)', 'oracle_km')}, first(rank ORDER BY round(km,9), rank) AS oracle_rank, count(*) AS n_candidates FROM err GROUP BY query_id"))
add("f22_bucket_report", lambda s, d: evaluate.bucket_report(_errors(s, d)), with_("err", f"SELECT CASE WHEN km<=1 THEN '0-1km' WHEN km<=5 THEN '1-5km' WHEN km<=25 THEN '5-25km' WHEN km<=100 THEN '25-100km' ELSE '>100km' END AS bucket, count(*) AS n, {r_('avg(km)', 'mean_km')} FROM err GROUP BY 1"))
add("a21_group_report", lambda s, d: evaluate.group_report(_errors(s, d), 5.0, 5), with_("err", f"SELECT grp, count(*) AS n, {r_('avg(km)', 'mean_km')}, {r_('median(km)', 'median_km')}, {r_('avg(hit)', 'hit_rate')}, row_number() OVER (ORDER BY round(avg(km),9) DESC, grp) AS hardest FROM (SELECT query_id, grp, max(CASE WHEN rank=1 THEN km END) AS km, max((rank<=5 AND km<=5)::INT) AS hit FROM err GROUP BY ALL) GROUP BY grp"))
add("a20_recall_report", lambda s, d: evaluate.recall_report(_errors(s, d)), with_("err", f"SELECT k, radius_km, {r_('avg(hit)', 'recall')}, count(*) AS n FROM (SELECT k, radius_km, query_id, max((rank<=k AND km<=radius_km)::INT) AS hit FROM err, (SELECT unnest([1,5,10]) AS k) a, (SELECT unnest([0.5e0,1,2,5]) AS radius_km) b GROUP BY ALL) GROUP BY k, radius_km"))
add("a22_a23_source_priors", lambda s, d: evaluate.source_reliability(_errors(s, d), 5.0), with_("err", f"SELECT source, n, hits, {r_('rate', 'rate')}, {r_('greatest(0.25, least(4, rate/avg(rate) OVER ()))', 'prior')} FROM (SELECT source, count(*) AS n, sum((km<=5)::INT)::BIGINT AS hits, (sum((km<=5)::INT)+1)/(count(*)+2e0) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS at_ FROM err) WHERE at_ = 1 GROUP BY source)"))
_HITS = lambda s, d: _POST(s, d).join(_errors(s, d).select("query_id", "item_id", (F.col("km") <= 5).cast("int").alias("hit")), ["query_id", "item_id"]).withColumnRenamed("w", "conf")
add("a16_calibration_error", lambda s, d: evaluate.calibration_report(_HITS(s, d)), with_("hits", f"SELECT sum(n)::BIGINT AS n, {r_('sum(abs(acc-c)*n)/sum(n)', 'ece')}, {r_('sum(sq)/sum(n)', 'brier')}, {r_('sum(nl)/sum(n)', 'nll')} FROM (SELECT least(floor(w*10),9) AS b, count(*) AS n, avg(hit) AS acc, avg(w) AS c, sum(pow(w-hit,2)) AS sq, sum(CASE WHEN hit=1 THEN -ln(greatest(1e-6,least(1-1e-6,w))) ELSE -ln(1-greatest(1e-6,least(1-1e-6,w))) END) AS nl FROM hits GROUP BY 1)"))
add("a24_calibration_fit", lambda s, d: evaluate.calibration_fit(_HITS(s, d)).select("scale", "bias", F.round("loss", 5).alias("loss")), with_("hits", "SELECT round(scale,6) AS scale, round(bias,6) AS bias, round(loss,5) AS loss FROM (SELECT g, scale, bias, -sum(ones*ln(p)+(n-ones)*ln(1-p))/sum(n) AS loss FROM (SELECT g, scale, bias, n, ones, greatest(1e-6,least(1-1e-6,1/(1+exp(-(ln(u/(1-u))*scale+bias))))) AS p FROM (SELECT count(*) AS n, sum(hit) AS ones, greatest(1e-6,least(1-1e-6,round(w,6))) AS u FROM hits GROUP BY round(w,6)), (SELECT g, 0.5e0+(g//41)*0.1e0 AS scale, -2e0+(g%41)*0.1e0 AS bias FROM range(1271) t(g))) GROUP BY g, scale, bias) ORDER BY round(loss,9), g LIMIT 1"))
_CMP = lambda s, d: evaluate.compare_runs(o.run_metrics(s, d).where("run = 'F'"), o.run_metrics(s, d).where("run = 'O'"), ["scenario"])
_CMP_SQL = f"SELECT scenario, {r_('b.value', 'before')}, {r_('a.value', 'after')}, {r_('a.value-b.value', 'delta')}, {r_('100*(a.value-b.value)/abs(b.value)', 'delta_pct')}, CASE WHEN a.value IS NULL OR b.value IS NULL THEN 'missing' WHEN abs(a.value-b.value)<1e-9 THEN 'unchanged' WHEN a.value<b.value THEN 'improved' ELSE 'regressed' END AS verdict"
_CMP_FROM = " FROM (SELECT * FROM runs WHERE run='F') b FULL JOIN (SELECT * FROM runs WHERE run='O') a USING (scenario)"
add("j11_a29_impact_report", _CMP, with_("runs", _CMP_SQL + _CMP_FROM))
add("a31_policy_check", lambda s, d: evaluate.policy_check(_CMP(s, d), 0.01, 1.0).select("scenario", "delta", "allowed", "passed"), with_("runs", f"SELECT scenario, {r_('a.value-b.value', 'delta')}, {r_('greatest(0.01, abs(b.value)/100)', 'allowed')}, coalesce(a.value-b.value <= greatest(0.01, abs(b.value)/100), false) AS passed" + _CMP_FROM))
add("a32_standardise", lambda s, d: evaluate.standardised(o.street_points(s, d), ["quality"], ["sequence"]).select("image_id", "z_quality"), with_("sp", f"SELECT image_id, {r_('(quality - avg(quality) OVER g)/CASE WHEN stddev_pop(quality) OVER g < 1e-9 THEN 1 ELSE stddev_pop(quality) OVER g END', 'z_quality')} FROM sp WINDOW g AS (PARTITION BY sequence)"))

# Places, sequences, detections --------------------------------------------------------------------------------------
_NEAR = f"(SELECT image_id, ref_id, {hav('sp.lat', 'sp.lon', 'ref.lat', 'ref.lon')} AS km, ref.lat AS r_lat FROM sp JOIN ref ON abs(sp.lat-ref.lat) <= 0.003 AND abs(sp.lon-ref.lon) <= 0.005)"
add("j04_radius_join", lambda s, d: spatial.nearest(o.street_points(s, d).select("image_id", "lat", "lon"), o.reference_points(s, d), "image_id", [F.round("km", 9)], "ref_id", 0.2, 3).select("image_id", "ref_id", "km", "at"), with_("sp ref", f"SELECT image_id, ref_id, {r_('km', 'km')}, at_ AS \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(km,9), ref_id) AS at_ FROM {_NEAR} WHERE km <= 0.2) WHERE at_ <= 3"))
add("j05_nearest_point", lambda s, d: spatial.nearest(o.street_points(s, d).select("image_id", "lat", "lon"), o.reference_points(s, d), "image_id", [F.round("km", 9)], "ref_id", 0.15).select("image_id", "ref_id", "km"), with_("sp ref", f"SELECT image_id, ref_id, {r_('km', 'km')} FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(km,9), ref_id) AS at_ FROM {_NEAR} WHERE km <= 0.15) WHERE at_ = 1"))
_SCENES = lambda s, d: o.table(s, d, "part").select(F.col("p_partkey").alias("scene_id"), *o._place("p_partkey"), (F.col("p_size") / 1e4).alias("half"), (F.col("p_size") / 1e2).alias("resolution_m")).select("scene_id", "resolution_m", (F.col("lat") - F.col("half")).alias("south"), (F.col("lat") + F.col("half")).alias("north"), (F.col("lon") - F.col("half")).alias("west"), (F.col("lon") + F.col("half")).alias("east"))
add("j07_covering_scene", lambda s, d: spatial.covering_scene(o.street_points(s, d), _SCENES(s, d), "image_id"), with_("sp", f", sc AS (SELECT scene_id, resolution_m, lat-half AS south, lat+half AS north, lon-half AS west, lon+half AS east FROM (SELECT p_partkey AS scene_id, {_place_sql('p_partkey')}, p_size/1e4 AS half, p_size/1e2 AS resolution_m FROM part)) SELECT sp.image_id, {r_('b.r', 'resolution_m')}, b.scene_id, CASE WHEN b.scene_id IS NULL THEN 'no_open_aerial_found' ELSE 'ok' END AS status FROM sp LEFT JOIN (SELECT image_id, min(resolution_m) AS r, first(scene_id ORDER BY resolution_m, scene_id) AS scene_id FROM sp JOIN sc ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY image_id) b USING (image_id)").replace(" , sc AS", ", sc AS"))
_SPLIT = lambda s, d: spatial.spatial_split(o.street_points(s, d), 0.01, 0.7, 0.15)
_SPLIT_SQL = ", c AS (SELECT floor(lat/0.01e0)::BIGINT AS cy, floor(lon/0.01e0)::BIGINT AS cx, count(*) AS n FROM sp GROUP BY 1, 2), bx AS (SELECT max(cy)-min(cy) > max(cx)-min(cx) AS tall, sum(n) AS total FROM c), od AS (SELECT c.*, total, coalesce(sum(n) OVER (ORDER BY CASE WHEN tall THEN cy ELSE cx END, CASE WHEN tall THEN cx ELSE cy END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c, bx), tr AS (SELECT sum(n) AS n_train FROM od WHERE before < total*0.7e0), spl AS (SELECT cy, cx, n, CASE WHEN before < total*0.7e0 THEN 'train' WHEN before < n_train + total*0.15e0 THEN 'val' ELSE 'test' END AS split FROM od, tr)"
add("g06_spatial_split", lambda s, d: _SPLIT(s, d).groupBy("cy", "cx", "split").agg(F.count(F.lit(1)).alias("n")), with_("sp", _SPLIT_SQL + " SELECT cy, cx, split, n FROM spl").replace(" , c AS", ", c AS"))
add("g07_split_buffer", lambda s, d: spatial.split_buffer(_SPLIT(s, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n")), with_("sp", _SPLIT_SQL + " SELECT split, sum(n)::BIGINT AS n FROM spl a WHERE NOT EXISTS (SELECT 1 FROM spl b WHERE a.split <> b.split AND abs(a.cy-b.cy) <= 1 AND abs(a.cx-b.cx) <= 1) GROUP BY split").replace(" , c AS", ", c AS"))
add("w06_sequence_neighbours", lambda s, d: spatial.sequence_neighbours(o.street_points(s, d)), with_("sp", "SELECT image_id, sequence, lag(image_id) OVER w AS previous_id, lead(image_id) OVER w AS next_id, row_number() OVER w AS position, count(*) OVER (PARTITION BY sequence) AS total FROM sp WINDOW w AS (PARTITION BY sequence ORDER BY captured_at, image_id)"))
add("u02_first_by_key", lambda s, d: spatial.first_by_key(o.street_points(s, d), ["source", "sequence"], [F.col("captured_at"), F.col("image_id")]).select("source", "sequence", "image_id"), with_("sp", "SELECT source, sequence, first(image_id ORDER BY captured_at, image_id) AS image_id FROM sp GROUP BY source, sequence"))
add("a12_circular_mean", lambda s, d: o.street_points(s, d).groupBy("sequence").agg(geo.circular_mean_deg(F.col("heading_deg")).alias("heading")).select("sequence", F.pmod(F.round("heading", 4), F.lit(360.0)).alias("heading")), with_("sp", "SELECT sequence, CASE WHEN h >= 360 THEN h - 360 ELSE h END AS heading FROM (SELECT sequence, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 4) AS h FROM (SELECT sequence, degrees(atan2(sum(sin(radians(heading_deg))), sum(cos(radians(heading_deg))))) AS a FROM sp GROUP BY sequence))"))
add("f30_grid_cells", lambda s, d: o.street_points(s, d).groupBy(*(c.alias(n) for c, n in zip(geo.grid_cell("lat", "lon", 0.005), ("cy", "cx"), strict=True))).agg(F.count(F.lit(1)).alias("n")), with_("sp", "SELECT floor(lat/0.005e0)::BIGINT AS cy, floor(lon/0.005e0)::BIGINT AS cx, count(*) AS n FROM sp GROUP BY 1, 2"))
add("f24_tiles", lambda s, d: o.street_points(s, d).groupBy(*(F.floor(c / 256).cast("long").alias(n) for c, n in zip(geo.world_pixel("lat", "lon", 15), ("tx", "ty"), strict=True))).agg(F.count(F.lit(1)).alias("n")), with_("sp", "SELECT floor((lon+180)/360*32768)::BIGINT AS tx, floor((0.5-ln((1+sin(radians(lat)))/(1-sin(radians(lat))))/(4*pi()))*32768)::BIGINT AS ty, count(*) AS n FROM sp GROUP BY 1, 2"))
add("f01_f06_scalars", lambda s, d: o.street_points(s, d).select("image_id", geo.haversine_km("lat", "lon", 48.85, 2.35).alias("km"), geo.angle_between("heading_deg", 350.0).alias("turn"), geo.wrap_longitude(F.col("lon") + 358).alias("wrapped"), geo.box_distance_km("lat", "lon", BOX).alias("box_km")), with_("sp", f"SELECT image_id, {r_(hav('lat', 'lon', '48.85e0', '2.35e0'), 'km')}, {r_('least(abs((heading_deg-350+360) % 360), 360-abs((heading_deg-350+360) % 360))', 'turn')}, {r_('((lon+358+180) % 360)-180', 'wrapped')}, {r_(_BOXKM, 'box_km')} FROM sp"))
add("f07_f09_scores", lambda s, d: o.street_points(s, d).select("image_id", scores.unit_by_logistic(F.col("quality")).alias("a"), scores.unit_by_shift(F.col("quality") / 100 - 0.5).alias("b"), scores.scaled_log_odds(F.col("quality"), 0.2).alias("c"), scores.calibrated(scores.unit_by_logistic(F.col("quality")), 0.8, -0.1).alias("d")), with_("sp", f"SELECT image_id, {r_(UNIT.format('quality'), 'a')}, {r_(SHIFT.format('(quality/100-0.5e0)'), 'b')}, {r_(f'ln(u/(1-u))/0.2e0', 'c')}, {r_('1/(1+exp(-(ln(u/(1-u))*0.8e0-0.1e0)))', 'd')} FROM (SELECT *, greatest(1e-6, least(1-1e-6, {UNIT.format('quality')})) AS u FROM sp)"))
add("p05_detection_filter", lambda s, d: spatial.filter_detections(o.detections(s, d)).groupBy("label", "heading_deg").agg(F.count(F.lit(1)).alias("n"), F.avg("area").alias("area")), with_("det", f"SELECT label, CASE WHEN w >= h THEN 90e0 ELSE 0e0 END AS heading_deg, count(*) AS n, {r_('avg(w*h)', 'area')} FROM det WHERE confidence >= 0.25 AND w*h >= 16 GROUP BY 1, 2"))
add("f23_detection_score", lambda s, d: spatial.detection_summary(o.detections(s, d)), with_("det", f"SELECT image_id, n, {r_('list_sum(c)/len(c)', 'score')} FROM (SELECT image_id, count(*) AS n, list_sort(list(confidence), 'DESC')[1:3] AS c FROM det GROUP BY image_id)"))
add("p08_seeded_sample", lambda s, d: o.street_points(s, d).orderBy(F.md5(F.concat(F.col("image_id").cast("string"), F.lit("-7"))), "image_id").limit(50).select("image_id"), with_("sp", "SELECT image_id FROM sp ORDER BY md5(image_id || '-7'), image_id LIMIT 50"))
_EVENTS = lambda s, d: o.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 7).alias("key"), F.col("user_id").alias("session"), F.col("event_type").alias("kind"), "value")
add("t06_session_fold", lambda s, d: ev.latest_by_key(_EVENTS(s, d), ["session", "key"]), f"SELECT user_id AS session, user_id % 7 AS key, first(event_id ORDER BY ts DESC, event_id DESC) AS event_id, first(event_type ORDER BY ts DESC, event_id DESC) AS kind, {r_('first(value ORDER BY ts DESC, event_id DESC)', 'value')}, count(*) AS n FROM events GROUP BY 1, 2")
add("t08_windowed_counts", lambda s, d: ev.windowed_counts(_EVENTS(s, d)), f"SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n, {r_('sum(value)', 'total')} FROM events GROUP BY 1, 2")
add("s09_result_json", lambda s, d: retrieval.ranked(o.candidates(s, d)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("c")).select("query_id", F.to_json(F.struct(F.col("query_id").alias("image"), F.transform("c", lambda x: x["item_id"]).alias("candidates"))).alias("json")), with_("rnk", "SELECT query_id, '{\"image\":' || query_id || ',\"candidates\":[' || string_agg(item_id, ',' ORDER BY rank) || ']}' AS json FROM rnk GROUP BY query_id"))
