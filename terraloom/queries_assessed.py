"""Registered queries of oriented boxes, sequence runs, session folds, verification and score, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .functions import quads
from .operators import fusion, greedy, spatial
from .plans import chains, verification
from .plans import overlay as o
from .queries import _SPLIT, _SPLIT_SQL, CTE, add, hav, r_, with_
from .queries_more import _VW, _sourced_views
from .streaming import sequences, sessions

# Oriented boxes -----------------------------------------------------------------------------------------------------


_BOX = ("x", "y", "w", "h", "turn")


def _boxes(s: SparkSession, d: str) -> DataFrame:
    """The detections of lineitem, each to be turned around its centre."""
    li = o.table(s, d, "lineitem")
    x, y, w, h = (F.col(c) % 50 if c.endswith("key") else F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_tax"))
    turn = (F.col("l_linenumber") * 23 + F.col("l_partkey")) % 180 + 0.25
    values = (x.cast("double"), y.cast("double"), w.cast("double"), 5.5 + h.cast("double") * 100, turn.cast("double"))
    return li.select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_linenumber").cast("long").alias("det"),
        F.col("l_returnflag").alias("label"),
        (F.col("l_discount").cast("double") * 10).alias("confidence"),
        *(v.alias(name) for name, v in zip(_BOX, values, strict=True)),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey").cast("double")).alias("heading_deg"),
    )


def _quads(s: SparkSession, d: str) -> DataFrame:
    return _boxes(s, d).select("image_id", "det", "label", "confidence", quads.box_quad(*map(F.col, _BOX)).alias("quad"), "heading_deg")


def _corner_sql(u: int, v: int) -> str:
    return f"{{'x': cx+({u})*w/2*cos(t)-({v})*h/2*sin(t), 'y': cy+({u})*w/2*sin(t)+({v})*h/2*cos(t)}}"


_QUADS_SQL = f"""
dq AS (
  SELECT image_id, det, label, confidence, heading_deg, [{_corner_sql(-1, -1)}, {_corner_sql(1, -1)}, {_corner_sql(1, 1)}, {_corner_sql(-1, 1)}] AS quad
  FROM (SELECT *, x+w/2 AS cx, y+h/2 AS cy FROM (
    SELECT l_orderkey AS image_id, l_linenumber::BIGINT AS det, l_returnflag AS label, l_discount::DOUBLE*10 AS confidence,
           CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey::DOUBLE END AS heading_deg,
           (l_partkey % 50)::DOUBLE AS x, (l_suppkey % 50)::DOUBLE AS y, l_quantity::DOUBLE AS w, 5.5e0+l_tax::DOUBLE*100 AS h,
           radians(((l_linenumber*23+l_partkey) % 180)::DOUBLE+0.25e0) AS t
    FROM lineitem))
)"""


def _area_sql(p: str) -> str:
    term = f"{p}[i].x*{p}[i % len({p})+1].y-{p}[i % len({p})+1].x*{p}[i].y"
    return f"(coalesce(list_sum(list_transform(range(1, len({p})+1), lambda i: {term})), 0)/2)"


def _filtered(s: SparkSession, d: str) -> DataFrame:
    kept = quads.oriented_detections(_quads(s, d), 0.35, 150.3)
    at = lambda i, axis: F.get("quad", F.lit(i))[axis].alias(f"{axis}{i}")
    return kept.select("image_id", "det", at(0, "x"), at(0, "y"), at(1, "x"), at(1, "y"), at(2, "x"), at(2, "y"), "heading_deg")


_FILTERED_SQL = f"""
WITH {_QUADS_SQL},
big AS (SELECT *, (quad[1].x+quad[2].x+quad[3].x+quad[4].x)/4 AS mx, (quad[1].y+quad[2].y+quad[3].y+quad[4].y)/4 AS my FROM dq WHERE confidence >= 0.35e0 AND abs({_area_sql("quad")}) >= 150.3e0),
turned AS (SELECT *, list_transform(list_sort(list_transform(range(1, 5), lambda i: {{'a': -atan2(quad[i].y-my, quad[i].x-mx), 'p': quad[i]}})), lambda s: s.p) AS p FROM big),
firsts AS (SELECT *, list_sort(list_transform(range(1, 5), lambda i: {{'y': p[i].y, 'x': p[i].x, 'i': i}}))[1].i AS f FROM turned),
ordered AS (SELECT image_id, det, heading_deg, p[f:4] || p[1:f-1] AS p FROM firsts),
edged AS (SELECT *, p[2].x-p[1].x AS ax, p[2].y-p[1].y AS ay, p[3].x-p[2].x AS bx, p[3].y-p[2].y AS by_ FROM ordered),
long_ AS (SELECT *, sqrt(ax*ax+ay*ay) >= sqrt(bx*bx+by_*by_) AS one FROM edged)
SELECT image_id, det, {r_("p[1].x", "x0")}, {r_("p[1].y", "y0")}, {r_("p[2].x", "x1")}, {r_("p[2].y", "y1")}, {r_("p[3].x", "x2")}, {r_("p[3].y", "y2")},
       {r_("coalesce(heading_deg, (degrees(CASE WHEN one THEN atan2(ay, ax) ELSE atan2(by_, bx) END)+360) % 360)", "heading_deg")}
FROM long_
"""
add("p05_oriented_filter", _filtered, _FILTERED_SQL)


def _overlaps(s: SparkSession, d: str) -> DataFrame:
    """How much the detections of an image overlap, by label."""
    q = _boxes(s, d)
    other = q.select("image_id", *(F.col(c).alias(f"o_{c}") for c in ("det", *_BOX)))
    quad, o_quad = quads.box_quad(*map(F.col, _BOX)), quads.box_quad(*(F.col(f"o_{c}") for c in _BOX))
    # The numbers of a box are shuffled, not its corners.
    pairs = q.join(other, "image_id").where("det < o_det").withColumn("iou", quads.quad_iou(quad, o_quad))
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("iou").alias("mean_iou"), F.max("iou").alias("max_iou"))


def _clip_sql(k: int) -> str:
    """One step: what of the polygon p lies left of the k-th edge of q."""
    a, b, e, s = f"q[{k}]", f"q[{k % 4 + 1}]", "p[i]", "p[CASE WHEN i = 1 THEN len(p) ELSE i-1 END]"
    side = lambda z: f"(({b}.x-{a}.x)*({z}.y-{a}.y)-({b}.y-{a}.y)*({z}.x-{a}.x))"
    across = f"(({e}.x-{s}.x)*({b}.y-{a}.y)-({e}.y-{s}.y)*({b}.x-{a}.x))"
    t = f"((({a}.x-{s}.x)*({b}.y-{a}.y)-({a}.y-{s}.y)*({b}.x-{a}.x))/{across})"
    crossing = f"CASE WHEN abs({across}) < 1e-9 THEN {e} ELSE {{'x': {s}.x+{t}*({e}.x-{s}.x), 'y': {s}.y+{t}*({e}.y-{s}.y)}} END"
    cases = f"CASE WHEN {side(e)} >= 0 AND {side(s)} >= 0 THEN [{e}] WHEN {side(e)} >= 0 THEN [{crossing}, {e}] WHEN {side(s)} >= 0 THEN [{crossing}] ELSE [] END"
    return f"c{k} AS MATERIALIZED (SELECT label, areas, q, flatten(list_transform(range(1, len(p)+1), lambda i: {cases})) AS p FROM c{k - 1})"


_OVERLAPS_SQL = f"""
WITH {_QUADS_SQL},
ccw AS MATERIALIZED (SELECT image_id, det, label, CASE WHEN {_area_sql("quad")} < 0 THEN list_reverse(quad) ELSE quad END AS quad, abs({_area_sql("quad")}) AS area FROM dq),
c0 AS MATERIALIZED (SELECT a.label, a.area+b.area AS areas, b.quad AS q, a.quad AS p FROM ccw a JOIN ccw b ON a.image_id = b.image_id AND a.det < b.det),
{", ".join(_clip_sql(k) for k in range(1, 5))},
both_ AS MATERIALIZED (SELECT label, areas, CASE WHEN len(p) < 3 THEN 0 ELSE abs({_area_sql("p")}) END AS inside FROM c4),
io AS (SELECT label, CASE WHEN inside > 0 AND areas-inside > 0 THEN inside/(areas-inside) ELSE 0e0 END AS iou FROM both_)
SELECT label, count(*) AS n, {r_("avg(iou)", "mean_iou")}, {r_("max(iou)", "max_iou")} FROM io GROUP BY label
"""
add("f17_quad_overlap", _overlaps, _OVERLAPS_SQL)


def _suppressed(s: SparkSession, d: str) -> DataFrame:
    boxes = _quads(s, d).withColumn("det", F.xxhash64("det", "label", "confidence", "quad"))
    left = greedy.suppressed(boxes, 0.2, 0, per_label=False, mode="quad")
    return left.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


add("g03_quad_suppression", _suppressed, None)

# Sequences and sessions: tested against plain loops -----------------------------------------------------------------


def _frames(s: SparkSession, d: str) -> DataFrame:
    """Street images as frames: the posterior of one of the queries, moved to the image's place."""
    post = written_posterior(s, d)
    slots = post.groupBy("query_id").agg(F.collect_list(F.struct("item_id", "lat", "lon", "w")).alias("c"), F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    slots = slots.withColumn("slot", F.pmod(F.floor(F.col("query_id") / 100), F.lit(5))).groupBy("slot").agg(F.min_by(F.struct("c", "c_lat", "c_lon"), "query_id").alias("p"))
    j = o.street_points(s, d).withColumn("slot", F.pmod("image_id", F.lit(5))).join(slots, "slot")
    moved = F.transform("p.c", lambda x: F.struct(x["item_id"].alias("item_id"), (x["lat"] - F.col("p.c_lat") + F.col("lat")).alias("lat"), (x["lon"] - F.col("p.c_lon") + F.col("lon")).alias("lon"), x["w"].alias("w")))
    return j.select("sequence", F.col("image_id").alias("frame"), F.col("captured_at").alias("ts"), "lat", "lon", (F.col("quality") * 10).alias("radius_m"), F.lit("low").alias("tier"), moved.alias("candidates"))


def written_posterior(s: SparkSession, d: str) -> DataFrame:
    return fusion.posterior(o.candidates(s, d)).select("query_id", "item_id", "lat", "lon", "w")


def _sequence_run(s: SparkSession, d: str) -> DataFrame:
    run = sequences.sequence_run(_frames(s, d), 3000.0, expire_s=30 * 86400.0)
    return run.select("sequence", "frame", "track", "mean_lat", "mean_lon", F.round("radius_m", 3).alias("radius_m"), "tier", "ambiguous", "credible_size")


add("t03_sequence_run", _sequence_run, None)


def _session_events(s: SparkSession, d: str) -> DataFrame:
    """The event table as operators' events: a user is a session, and what an event does follows from its type and id."""
    e = o.table(s, d, "events")
    i = F.col("event_id")
    one_of = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64("event_type", "event_id"), F.lit(len(names))) + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("session"), "ts", "event_id",
        one_of("load", "pin", "pin", "note", "note", "note", "delete_note", "delete_pin", "confirm", "refuse").alias("action"),
        F.element_at(F.array(F.lit("candidate"), F.lit("pin"), F.lit("note")), (i % 3 + 1).cast("int")).alias("target"),
        F.lag("event_id", 2).over(_by_user()).alias("item"), (i % 4).cast("int").alias("rank"), (i % 9).cast("int").alias("n"),
        (48.8 + (i % 5) / 10).alias("lat"), (2.2 + (i % 7) / 10).alias("lon"), F.concat(F.lit("about "), "event_type").alias("text"),
    )


def _by_user() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


add("t06_session_timeline", lambda s, d: sessions.timeline(_session_events(s, d)), None)


def _cases(s: SparkSession, d: str) -> DataFrame:
    cases = _session_events(s, d).select(F.pmod("event_id", F.lit(12)).alias("case_id"), "session", F.col("event_id").alias("added")).where("added % 3 = 0")
    return sessions.case_listing(cases, sessions.session_states(sessions.timeline(_session_events(s, d))))


add("t07_case_counts", _cases, None)

# Verification and score ---------------------------------------------------------------------------------------------


def _assessed(s: SparkSession, d: str) -> DataFrame:
    images = o.street_points(s, d)
    i = F.col("image_id")
    uncertainty = F.element_at(F.array(F.lit(40e0), F.lit(150e0), F.lit(700e0), F.lit(5000e0)), (i % 4 + 1).cast("int"))
    estimates = images.where("image_id % 3 <> 0").select("image_id", "lat", "lon", ((i % 10) / 10e0).alias("confidence"), uncertainty.alias("uncertainty_m"))
    li = o.table(s, d, "lineitem")
    marks = li.select(
        F.col("l_orderkey").alias("image_id"),
        (F.col("l_discount").cast("double") * 10).alias("confidence"),
        F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_partkey") * 7 % 360).cast("double")).alias("shadow_azimuth_deg"),
        (F.col("l_suppkey") * 11 % 360).cast("double").alias("heading_deg"),
        F.when(F.col("l_linenumber") % 4 == 0, F.col("l_quantity").cast("double") / 10).alias("shadow_length_ratio"),
    )
    told = verification.verified(images, estimates, marks)
    seen = spatial.detection_summary(marks).withColumnRenamed("score", "detection_score")
    j = images.select("image_id").join(seen, "image_id", "left").join(estimates.drop("lat", "lon"), "image_id", "left").join(told, "image_id", "left")
    score = verification.overall_score(*(F.col(c) for c in ("detection_score", "confidence", "uncertainty_m", "shadow_ok", "ground_ok")))
    return j.select("image_id", "verdict", "shadow_ok", "ground_ok", F.round("mean_diff_deg", 3).alias("mean_diff_deg"), score.alias("score"))


_SUN_SQL = """
h AS (SELECT *, hour(captured_at)+minute(captured_at)/60e0+second(captured_at)/3600e0 AS hr FROM sp),
g AS (SELECT *, 2*pi()*(dayofyear(captured_at)-1+(hr-12)/24e0)/365e0 AS ga FROM h),
t AS (
  SELECT *, radians(lat) AS la,
    0.006918e0-0.399912e0*cos(ga)+0.070257e0*sin(ga)-0.006758e0*cos(2*ga)+0.000907e0*sin(2*ga)-0.002697e0*cos(3*ga)+0.00148e0*sin(3*ga) AS de,
    radians((hr*60+229.18e0*(0.000075e0+0.001868e0*cos(ga)-0.032077e0*sin(ga)-0.014615e0*cos(2*ga)-0.040849e0*sin(2*ga))+4*lon)/4-180) AS ha
  FROM g),
sun AS (
  SELECT image_id, (degrees(atan2(sin(ha), cos(ha)*sin(la)-tan(de)*cos(la)))+360) % 360 AS shadow,
    90-degrees(acos(greatest(-1, least(1, sin(la)*sin(de)+cos(la)*cos(de)*cos(ha))))) AS el
  FROM t)"""
_TURN = "least(abs(({0}-{1}) % 360), 360-abs(({0}-{1}) % 360))"
_ASSESSED_SQL = with_(
    "sp",
    f"""@{_SUN_SQL},
est AS (SELECT image_id, (image_id % 10)/10e0 AS confidence, [40e0, 150e0, 700e0, 5000e0][image_id % 4+1] AS uncertainty_m FROM sp WHERE image_id % 3 <> 0),
mk AS (
  SELECT l_orderkey AS image_id, l_discount::DOUBLE*10 AS c, CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey*7 % 360)::DOUBLE END AS az,
    (l_suppkey*11 % 360)::DOUBLE AS hd, CASE WHEN l_linenumber % 4 = 0 THEN l_quantity::DOUBLE/10 END AS ratio
  FROM lineitem),
ds AS (SELECT image_id, list_avg(list_sort(list(c), 'DESC')[1:3]) AS d FROM mk GROUP BY image_id),
sd AS (
  SELECT image_id, avg({_TURN.format("shadow", "az")}) AS diff, bool_or({_TURN.format("hd", "az")} < 12) AS conflict,
    bool_or(ratio IS NOT NULL AND NOT (el > 0 AND ratio > 0 AND ratio BETWEEN 1/greatest(0.01e0, tan(radians(el)))/3 AND 1/greatest(0.01e0, tan(radians(el)))*3)) AS misfit
  FROM mk JOIN est USING (image_id) JOIN sun USING (image_id) WHERE az IS NOT NULL GROUP BY image_id),
vd AS (
  SELECT image_id, diff, confidence >= 0.5 AS ground_ok,
    CASE WHEN el <= 0 THEN 'night' WHEN el < 5 THEN 'low_sun' WHEN diff IS NULL THEN 'time_only' WHEN misfit THEN 'length_mismatch' WHEN conflict THEN 'conflicts_heading' WHEN diff <= 25 THEN 'ok' ELSE 'diff' END AS verdict
  FROM est JOIN sun USING (image_id) LEFT JOIN sd USING (image_id)),
al AS (
  SELECT sp.image_id, verdict, verdict IN ('time_only', 'ok') AS shadow_ok, ground_ok, diff, d,
    confidence*CASE WHEN uncertainty_m <= 50 THEN 1e0 WHEN uncertainty_m <= 200 THEN 0.85e0 WHEN uncertainty_m <= 1000 THEN 0.6e0 ELSE 0.4e0 END AS geo
  FROM sp LEFT JOIN ds USING (image_id) LEFT JOIN est USING (image_id) LEFT JOIN vd USING (image_id)),
wt AS (SELECT *, CASE WHEN d IS NULL THEN 0e0 ELSE 0.4e0 END+CASE WHEN geo IS NULL THEN 0e0 ELSE 0.4e0 END+CASE WHEN verdict IS NULL THEN 0e0 ELSE 0.1e0 END+CASE WHEN verdict IS NULL THEN 0e0 ELSE 0.1e0 END AS total FROM al)
SELECT image_id, verdict, shadow_ok, ground_ok, round(diff, 3) AS mean_diff_deg,
  CASE WHEN total > 0 THEN round_even((CASE WHEN d IS NULL THEN 0 ELSE least(1, d)*0.4e0 END+CASE WHEN geo IS NULL THEN 0 ELSE least(1, geo)*0.4e0 END+coalesce(shadow_ok::INT*0.1e0, 0)+coalesce(ground_ok::INT*0.1e0, 0))/total, 3) ELSE 0e0 END AS score
FROM wt""",
).replace(" @", ", ")
add("f12_f23_assessment", _assessed, _ASSESSED_SQL)

# Gates of the composites ----------------------------------------------------------------------------------------------


def _clustered(s: SparkSession, d: str) -> DataFrame:
    """Fusion where the densest cluster stands for the credible set, but of ambiguous queries only."""
    out = fusion.fuse(o.candidates(s, d), fusion.Knobs(cluster_radius_km=4.0))
    return out.select("query_id", F.round("mean_lat", 5).alias("mean_lat"), F.round("mean_lon", 5).alias("mean_lon"), "set_size", F.round("major_m", 2).alias("major_m"), "tier", "ambiguous")


_near = hav("a.lat", "a.lon", "b.lat", "b.lon")
_CLUSTERED_SQL = with_(
    "cred diag",
    f"""@
amb AS (SELECT query_id FROM diag WHERE NOT (hi OR mid) OR effective >= greatest(3, 0.65e0*n)),
ca AS (SELECT * FROM cred WHERE query_id IN (SELECT query_id FROM amb)),
lst AS (SELECT query_id, least(count(*), 2) AS k FROM ca GROUP BY query_id),
pp AS (SELECT a.query_id, a.item_id, a.w, b.item_id AS o_item, b.w AS o_w FROM ca a JOIN ca b USING (query_id) WHERE {_near} <= 4),
bl AS (SELECT query_id, item_id, any_value(w) AS w, sum(o_w) AS mass, count(*) AS n FROM pp GROUP BY query_id, item_id),
ct AS (SELECT query_id, first(item_id ORDER BY round(mass, 9) DESC, n DESC, round(w, 9) DESC, item_id) AS item_id FROM bl JOIN lst USING (query_id) WHERE mass >= 0.35e0 AND n >= k GROUP BY query_id),
cl AS (
  SELECT * FROM cred WHERE query_id NOT IN (SELECT query_id FROM ct)
  UNION ALL SELECT * FROM cred WHERE (query_id, item_id) IN (SELECT (query_id, o_item) FROM pp JOIN ct USING (query_id, item_id))),
mean_ AS ({CTE["mean_"].replace("cred", "cl")}),
cov AS ({CTE["cov"].replace("cred", "cl")}),
ell AS ({CTE["ell"]})
SELECT query_id, round(mean_lat, 5) AS mean_lat, round(mean_lon, 5) AS mean_lon, set_size, round(major_m, 2) AS major_m,
  CASE WHEN hi THEN 'high' WHEN mid THEN 'medium' ELSE 'low' END AS tier, query_id IN (SELECT query_id FROM amb) AS ambiguous
FROM ell JOIN diag USING (query_id)""",
).replace(" @", ", ")
add("o2_cluster_fusion", _clustered, _CLUSTERED_SQL)


def _agreed(s: SparkSession, d: str) -> DataFrame:
    knobs = chains.RetrievalKnobs(agreement_weight=0.3, agreement_top_n=8, top_k=6)
    return chains.retrieval_chain(o.candidates(s, d), knobs, _sourced_views(s, d)).select("query_id", "item_id", "rank")


_NORM = "+".join(f"1/{k}e0" for k in range(1, 9))
_AGREED_SQL = with_(
    "cand",
    f"""@{_VW.removeprefix(", ")},
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, "view" ORDER BY round(score, 9) DESC, item_id) AS r FROM (SELECT vw.*, source FROM vw JOIN cand USING (query_id, item_id))),
ag AS (SELECT query_id, item_id, least(1, sum(1e0/r)/(3*({_NORM}))) AS a FROM rk WHERE r <= 8 GROUP BY query_id, item_id),
bs AS (SELECT *, min(score) OVER g AS lo, max(score) OVER g AS hi FROM cand WINDOW g AS (PARTITION BY query_id, source)),
mx AS (SELECT query_id, item_id, CASE WHEN hi-lo <= 1e-12 THEN score ELSE lo+least(1, 0.7e0*(score-lo)/(hi-lo)+0.3e0*coalesce(a, 0))*(hi-lo) END AS s FROM bs LEFT JOIN ag USING (query_id, item_id))
SELECT query_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, item_id) AS rank FROM mx) WHERE rank <= 6""",
).replace(" @", ", ")
add("o1_view_agreement", _agreed, _AGREED_SQL)

# Splits ---------------------------------------------------------------------------------------------------------------

_DISTANCE_SQL = with_(
    "sp",
    f"""{_SPLIT_SQL},
pt AS MATERIALIZED (SELECT DISTINCT split, lat, lon FROM sp JOIN spl ON floor(lat/0.01e0)::BIGINT = cy AND floor(lon/0.01e0)::BIGINT = cx)
SELECT a.split AS a, b.split AS b, {r_("min(" + _near + ")", "km")} FROM pt a JOIN pt b ON a.split < b.split GROUP BY ALL""",
).replace(" , c AS", ", c AS")
add("j12_least_distance", lambda s, d: spatial.least_split_distance(_SPLIT(s, d), 0.05), _DISTANCE_SQL)
