"""Registered queries of sweeps, models, the celled index and scene likeness, with their SQL for DuckDB."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scene
from .operators import celled, rerank, retrieval, vectors
from .plans import overlay as o
from .plans import sweeps
from .queries import CTE, SHIFT, add, hav, r_, with_
from .queries_more import _gate_sql
from .sources.stage import written
from .streaming import video

# Sweeps ---------------------------------------------------------------------------------------------------------------

#: 504 settings; a threshold of 0.45 leaves some queries without a candidate unless they are topped up.
GRID = [
    {"min_score": low, "locality_radius_km": radius, "locality_weight": weight, "top_k": top_k, "balance_beta": beta, "graph_top_n": n, "graph_sigma_km": sigma, "min_keep": keep}
    for low, (radius, weight), (top_k, beta), (n, sigma), keep in product(
        (-1.0, 0.3, 0.45), ((0, 0), (2, 0.5), (2, 1.5), (5, 0.5), (5, 1.5), (9, 0.5), (9, 1.5)), ((10, 0), (10, 0.3), (4, 0.3)), ((0, 3), (6, 2), (6, 3), (10, 3)), (0, 3)
    )
]


def _grid_sql(settings: list[dict]) -> str:
    rows = [(n, *sweeps.complete(s).values()) for n, s in enumerate(settings)]
    values = ", ".join("(" + ", ".join([str(r[0]), *(f"{x!r}::DOUBLE" for x in r[1:])]) + ")" for r in rows)
    return f"grid(setting, {', '.join(sweeps.complete({}))}) AS (VALUES {values})"


def _sweep_sql(settings: list[dict], by: tuple[str, ...]) -> str:
    """From the tables lists (model, query_id, source, item_id, lat, lon, score) and asked (model, query_id, lat, lon)."""
    key = "setting, model, query_id"
    keys = ", ".join(by)
    comma = "".join(f"{x}, " for x in by)
    return f"""{_grid_sql(settings)},
s0 AS (SELECT grid.*, lists.*, {SHIFT.format("score")} AS u FROM lists, grid WHERE score >= min_score),
s1s AS (SELECT a.setting, a.model, a.query_id, a.item_id, count(*) AS n,
          sum(CASE WHEN a.item_id <> b.item_id THEN b.u*exp(-{hav("a.lat", "a.lon", "b.lat", "b.lon")}/a.locality_radius_km) ELSE 0 END) AS s
        FROM s0 a JOIN s0 b USING ({key}) WHERE a.locality_radius_km > 0 AND a.locality_weight > 0 GROUP BY ALL),
s1l AS (SELECT *, CASE WHEN n < 3 OR max(greatest(1e-9, s)) OVER (PARTITION BY {key}) <= 0 THEN 1e0
          ELSE greatest(1e-3, least(1, greatest(1e-9, s)/max(greatest(1e-9, s)) OVER (PARTITION BY {key}))) END AS l FROM s1s),
s1 AS (SELECT s0.* REPLACE (CASE WHEN l IS NULL THEN score ELSE greatest(1e-6, least(1, u*(1-locality_weight/(1+locality_weight)+locality_weight/(1+locality_weight)*l))) END AS score)
       FROM s0 LEFT JOIN s1l USING ({key}, item_id)),
s2n AS (SELECT *, row_number() OVER (PARTITION BY {key}, source ORDER BY round(score, 9) DESC, item_id) AS nth FROM s1),
s2l AS (SELECT *, min(round(score/(1+balance_beta*(nth-1)), 9)) OVER (PARTITION BY {key}, source ORDER BY nth) AS least_ FROM s2n),
s2p AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY least_ DESC, round(score, 9) DESC, item_id) AS place_ FROM s2l),
s2 AS (SELECT * EXCLUDE (u), greatest(1e-9, {SHIFT.format("score")}) AS u, row_number() OVER (PARTITION BY {key} ORDER BY round(score, 9) DESC, item_id) AS rank
       FROM s2p WHERE place_ <= top_k),
s3h AS (SELECT * FROM s2 WHERE graph_top_n > 1 AND rank <= graph_top_n),
s3s AS (SELECT a.setting, a.model, a.query_id, a.item_id, pow(a.u, a.graph_score_alpha)*pow(greatest(1e-9,
          sum(b.u*exp(-0.5*pow({hav("a.lat", "a.lon", "b.lat", "b.lon")}/a.graph_sigma_km, 2)))), a.graph_support_beta) AS raw
        FROM s3h a JOIN s3h b USING ({key}) GROUP BY a.setting, a.model, a.query_id, a.item_id, a.u, a.graph_score_alpha, a.graph_sigma_km, a.graph_support_beta),
s3g AS (SELECT *, greatest(1e-6, least(1, raw/max(raw) OVER (PARTITION BY {key}))) AS g FROM s3s),
s3 AS (SELECT s2.* REPLACE (coalesce(g, score) AS score) FROM s2 LEFT JOIN s3g USING ({key}, item_id)),
have AS (SELECT {key}, count(*) AS n FROM s3 GROUP BY ALL),
fresh AS (SELECT setting, model, query_id, item_id, score, lists.lat, lists.lon, min_keep-coalesce(n, 0) AS lacks, row_number() OVER (PARTITION BY {key} ORDER BY round(score, 9) DESC, item_id) AS nth
          FROM lists CROSS JOIN grid LEFT JOIN have USING ({key}) ANTI JOIN s3 USING ({key}, item_id)),
both_ AS (SELECT {key}, item_id, score, lat, lon FROM s3 UNION ALL SELECT {key}, item_id, score, lat, lon FROM fresh WHERE nth <= lacks),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(score, 9) DESC, item_id) AS nth FROM both_) WHERE nth = 1),
rep AS (SELECT grid.setting, {comma}count(km) AS evaluated, count(*)-count(km) AS null_predictions, avg(km) AS mean_km, list_sort(list(km) FILTER (km IS NOT NULL)) AS l,
          {", ".join(f"100*avg(CASE WHEN km IS NOT NULL THEN (km <= {r})::INT::DOUBLE END) AS within_{r}km_pct" for r in (1, 2, 5, 10, 50))}
        FROM (SELECT grid.setting AS setting, asked.model, {hav("f.lat", "f.lon", "asked.lat", "asked.lon")} AS km
              FROM grid CROSS JOIN asked LEFT JOIN firsts f ON f.setting = grid.setting AND f.model = asked.model AND f.query_id = asked.query_id) grid GROUP BY ALL),
med AS (SELECT *, l[len(l)//2+1] AS median_km, l[CASE WHEN floor(0.9e0*len(l))-1 < 0 THEN len(l) ELSE floor(0.9e0*len(l))::BIGINT END] AS p90_km FROM rep)
SELECT setting, {comma}evaluated, null_predictions, {", ".join(r_(c, c) for c in sweeps.REPORT[2:])},
       row_number() OVER (ORDER BY round(median_km, 9) NULLS LAST, round(mean_km, 9) NULLS LAST, setting{", " + keys if keys else ""}) AS place
FROM med
"""


add(
    "g23_retrieval_sweep",
    lambda s, d: sweeps.retrieval_sweep(o.candidates(s, d), o.queries(s, d), GRID),
    with_("cand q", ", lists AS (SELECT 'all' AS model, query_id, source, item_id, lat, lon, score FROM cand), asked AS (SELECT 'all' AS model, query_id, lat, lon FROM q), " + _sweep_sql(GRID, ())).replace(" , lists AS", ", lists AS"),
)

#: Models derived from the given vectors: the whole vector, and its halves.
_PARTS = {"whole": (1, 64), "first": (1, 32), "second": (33, 32)}
SCENARIOS = [{}, {"locality_radius_km": 3, "locality_weight": 0.7}, {"graph_top_n": 12}, {"balance_beta": 0.5, "top_k": 5}]


def of_models(rows: DataFrame) -> DataFrame:
    """The rows once per model, with the model's part of the vector."""
    parts = F.array(*(F.struct(F.lit(name).alias("model"), F.slice("embedding", first, size).alias("v")) for name, (first, size) in _PARTS.items()))
    return rows.withColumn("_m", F.explode(parts)).withColumns({"model": F.col("_m.model"), "embedding": F.col("_m.v")}).drop("_m")


def _models(s: SparkSession, d: str) -> DataFrame:
    return sweeps.compare_models(of_models(o.geo_index(s, d)), of_models(o.queries(s, d)), SCENARIOS, 10)


def _models_sql() -> str:
    tables = ", ".join(f"{t} AS (SELECT '{name}' AS model, * REPLACE (e[{first}:{first + size - 1}] AS e) FROM {of})" for name, (first, size) in _PARTS.items() for t, of in ((f"gi_{name}", "gi"), (f"q_{name}", "q")))
    all_of = lambda t: " UNION ALL ".join(f"SELECT * FROM {t}_{name}" for name in _PARTS)
    place = "row_number() OVER (PARTITION BY a.model, query_id, source ORDER BY round(list_dot_product(a.e, b.e), 9) DESC, item_id)"
    return (
        f"WITH gi AS ({CTE['gi']}), q AS ({CTE['q']}), {tables}, asked AS ({all_of('q')}), items AS ({all_of('gi')}), "
        f"lists AS (SELECT * FROM (SELECT a.model, query_id, source, item_id, b.lat, b.lon, list_dot_product(a.e, b.e) AS score, {place} AS rk FROM asked a JOIN items b ON a.model = b.model AND item_id <> query_id) WHERE rk <= 10), "
        + _sweep_sql(SCENARIOS, ("model",))
    )


add("o5_models", _models, _models_sql())

# The celled index -----------------------------------------------------------------------------------------------------
#: Probes are chosen for the first share on a sample of rows; the second is asked of the stated queries.
CELLS, AIMED, TARGET = 32, 0.95, 0.9


def _celled(s: SparkSession, d: str):
    index = o.geo_index(s, d).select("item_id", "source", "embedding")
    centres = celled.fit_cells(index, CELLS)
    table = written(celled.celled_index(index, centres), "celled")
    return table, centres, celled.probes_for(table, centres, 10, AIMED)[0]


def _celled_search(s: SparkSession, d: str) -> DataFrame:
    """The candidates found, each with its exact score; recall depends on the cells and is measured by the query below."""
    table, centres, probes = _celled(s, d)
    return celled.celled_topk(table, o.queries(s, d), centres, 10, probes).select("query_id", "source", "item_id", "rk", "score")


def _celled_recall(s: SparkSession, d: str) -> DataFrame:
    """How much of the exact lists (lists, rows) the celled search finds, and whether that is the asked share."""
    table, centres, probes = _celled(s, d)
    q = o.queries(s, d)
    found = celled.celled_topk(table, q, centres, 10, probes)
    return celled.recall(found, o.candidates(s, d)).select("n", (F.col("recall") >= TARGET).alias("reached"))


add("j01_celled_search", _celled_search, None)
add("j01_celled_recall", _celled_recall, with_("cand", "SELECT count(*) AS n, true AS reached FROM cand"))

# Scenes ---------------------------------------------------------------------------------------------------------------


def _scenes(s: SparkSession, d: str) -> DataFrame:
    items = o.scene_signatures(s, d)
    return scene.with_structure(o.candidates(s, d), items.withColumnRenamed("item_id", "query_id"), items)


def _entropy_sql(h: str) -> str:
    return f"(CASE WHEN list_sum({h}) <= 1e-12 THEN 1e0 ELSE greatest(0, least(1, -list_sum(list_transform({h}, lambda x: CASE WHEN x/list_sum({h}) > 1e-12 THEN x/list_sum({h})*ln(x/list_sum({h})) ELSE 0 END))/ln(len({h})::DOUBLE))) END)"


def _scene_sql() -> str:
    """The tables sig (a row per signature) and scene (query_id, item_id, like_): signatures, cues, and their mixture."""
    runs = dict(zip(scene.HISTOGRAMS, ("1:8", "9:24", "25:40", "41:48", "49:56"), strict=True))
    level_at = {f: 57 + n if n < 8 else n - 7 for n, f in enumerate(scene.LEVELS)}
    columns = [f"list_transform(e[{r}], lambda x: abs(x)) AS {h}" for h, r in runs.items()]
    columns += [f"least(1, 4*abs(e[{i}])) AS {f}" for f, i in level_at.items()]
    columns += ["CASE WHEN e[3] > 0 THEN abs(e[4])*720 END AS shadow_axis_deg", "CASE WHEN e[5] > 0 THEN abs(e[6])*720 END AS sun_shadow_axis_deg"]
    gates = ", ".join(f"1-{_entropy_sql(h)} AS {h}_c" for h in scene.GATING)
    both = lambda f: f"least(a.{f}, b.{f})"
    level = lambda f: f"greatest(0, 1-abs(a.{f}-b.{f}))"
    shape = lambda f: f"least(1, 0.5e0*(list_dot_product(a.{f}, b.{f})/sqrt(list_dot_product(a.{f}, a.{f})*list_dot_product(b.{f}, b.{f}))+1))"
    axis = lambda f: f"coalesce(0.5e0*(1+cos(radians(a.{f}-b.{f}))), 0.5e0)"
    gated = lambda density, h, x: f"least(1, {both(density)}*({x}e0+{round(1 - x, 2)}e0*{both(h + '_c')}))"
    supports = {
        "line": both("line_strength"), "shadow": both("shadow_strength"), "corner": gated("corner_density", "corner_layout", 0.35), "edge": gated("edge_density", "edge_layout", 0.4),
        "foot": gated("footprint_density", "footprint_layout", 0.35), "direction": f"{both('line_strength')}*{both('line_anisotropy')}", "sun": both("sun_shadow_strength"),
        "ortho": f"{both('line_strength')}*{both('line_anisotropy')}*{both('line_orthogonality')}", "long_": f"{both('shadow_strength')}*{both('shadow_elongation')}",
        "turned": f"{gated('footprint_density', 'footprint_layout', 0.35)}*(0.35e0+0.65e0*{both('footprint_rectangularity')}*{both('footprint_orientation_c')})",
    }
    likes = {
        "l_line": shape("line_hist"), "l_cd": level("corner_density"), "l_ed": level("edge_density"), "l_axis": axis("shadow_axis_deg"), "l_corner": shape("corner_layout"), "l_edge": shape("edge_layout"),
        "l_ortho": level("line_orthogonality"), "l_dir": level("line_anisotropy"), "l_foot": shape("footprint_layout"), "l_turn": shape("footprint_orientation"),
        "l_rect": f"0.55e0*{level('footprint_rectangularity')}+0.45e0*{level('footprint_density')}", "l_long": level("shadow_elongation"), "l_sun": axis("sun_shadow_axis_deg"),
    }
    cues = ", ".join(f"{x} AS {n}" for n, x in (supports | likes).items())
    weights = "0.36e0*corner+0.24e0*edge+0.24e0*ortho+0.10e0*direction+0.12e0*foot+0.06e0*turned+0.04e0*foot+0.06e0*long_+0.04e0*sun"
    weighed = "0.36e0*corner*l_corner+0.24e0*edge*l_edge+0.24e0*ortho*l_ortho+0.10e0*direction*l_dir+0.12e0*foot*l_foot+0.06e0*turned*l_turn+0.04e0*foot*l_rect+0.06e0*long_*l_long+0.04e0*sun*l_sun"
    mix = "least(0.46e0, 0.24e0*corner+0.16e0*edge+0.18e0*ortho+0.10e0*direction+0.06e0*foot+0.04e0*turned+0.06e0*long_+0.03e0*sun)"
    base = "(0.5e0*line*l_line+0.22e0*l_cd+0.13e0*l_ed+0.15e0*shadow*l_axis)/(0.5e0*line+0.35e0+0.15e0*shadow)"
    return (
        f", sig0 AS (SELECT item_id, {', '.join(columns)} FROM gi WHERE item_id % 7 <> 0), sig AS (SELECT *, {gates} FROM sig0)"
        f", cue AS (SELECT rnk.query_id, rnk.item_id, {cues} FROM rnk JOIN sig a ON a.item_id = rnk.query_id JOIN sig b ON b.item_id = rnk.item_id)"
        f", scene AS (SELECT query_id, item_id, CASE WHEN {weights} <= 1e-9 THEN {base} ELSE (1-{mix})*({base})+{mix}*({weighed})/({weights}) END AS like_ FROM cue)"
    )


add(
    "f20_scene_similarity",
    lambda s, d: _scenes(s, d).select("query_id", "item_id", "structure"),
    with_("rnk", _scene_sql() + f" SELECT query_id, item_id, {r_('like_', 'structure')} FROM rnk LEFT JOIN scene USING (query_id, item_id)").replace(" , sig0", ", sig0"),
)
_LIKE = "(SELECT like_ FROM scene WHERE scene.query_id = rnk.query_id AND scene.item_id = rnk.item_id)"
add(
    "g16_scene_rerank",
    lambda s, d: rerank.reranked_behind_gate(_scenes(s, d), "structure", rerank.STRUCTURE, 12, 0.4).select("query_id", "item_id", "score"),
    with_("rnk q gi", _scene_sql() + _gate_sql(_LIKE, rerank.STRUCTURE, 12, 0.4)).replace(" , sig0", ", sig0"),
)

# Vectors and frames ---------------------------------------------------------------------------------------------------


def _projected(s: SparkSession, d: str) -> DataFrame:
    i, j = np.arange(1, 49), np.arange(1, 65)
    out = vectors.projected(o.geo_index(s, d), np.cos(0.37 * i[:, None] * j), np.sin(i) / 10)
    return out.select("item_id", F.size("embedding").cast("long").alias("n"), F.get("embedding", 0).alias("first"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"))


add(
    "f25_projection",
    _projected,
    with_("gi", f"""SELECT item_id, len(v) AS n, {r_("v[1]/greatest(1e-12, sqrt(list_dot_product(v, v)))", "first")}, {r_("list_sum(v)/greatest(1e-12, sqrt(list_dot_product(v, v)))", "total")}
FROM (SELECT item_id, list_transform(range(1, 49), lambda i: list_sum(list_transform(range(1, 65), lambda j: e[j]*cos(0.37e0*i*j)))+sin(i)/10) AS v FROM gi)"""),
)


def _augmented_near(s: SparkSession, d: str) -> DataFrame:
    out = retrieval.augmented_vectors(o.geo_index(s, d), o.queries(s, d), 12, 0.8, 0.1, 0.2, 6.0)
    return out.select("query_id", F.get("embedding", 0).alias("first"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"))


_AUGMENTED_NEAR_SQL = f"""
, un AS (SELECT item_id, lat, lon, list_transform(e, lambda x: x/sqrt(list_dot_product(e, e))) AS e FROM gi),
mine AS (SELECT un.* FROM un JOIN q ON query_id = item_id),
near AS (
  SELECT m.item_id AS query_id, n.e, list_dot_product(m.e, n.e) AS sc, {hav("m.lat", "m.lon", "n.lat", "n.lon")} AS km,
    row_number() OVER (PARTITION BY m.item_id ORDER BY round(list_dot_product(m.e, n.e), 9) DESC, n.item_id) AS p
  FROM mine m JOIN un n ON n.item_id <> m.item_id),
kept AS (SELECT *, exp((sc-max(sc) OVER (PARTITION BY query_id))/0.2e0) AS x FROM near WHERE p <= 12 AND sc >= 0.1e0 AND km <= 6),
sums AS (
  SELECT m.item_id AS query_id, i, 0.8e0*any_value(m.e[i])+coalesce(sum(x*kept.e[i])/sum(x), 0) AS v
  FROM mine m CROSS JOIN range(1, 65) t(i) LEFT JOIN kept ON kept.query_id = m.item_id GROUP BY 1, 2)
SELECT query_id, {r_("max(CASE WHEN i = 1 THEN v END)/sqrt(sum(v*v))", "first")}, {r_("sum(v)/sqrt(sum(v*v))", "total")} FROM sums GROUP BY query_id
"""
add("g15_augmentation_near", _augmented_near, with_("gi q", _AUGMENTED_NEAR_SQL).replace(" \n, un AS", ", un AS"))


def video_frames(s: SparkSession, d: str) -> DataFrame:
    """The queries as frames of one video at two frames a second, in the order of their ids."""
    c = o.candidates(s, d)
    lists = c.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "lat", "lon", "score", "match_id"))).alias("candidates"))
    return lists.select((F.col("query_id") % 2).alias("video"), F.floor(F.col("query_id") / 100).alias("frame"), F.lit(2.0).alias("fps"), "candidates")


def _video(s: SparkSession, d: str) -> DataFrame:
    run = video.video_run(video_frames(s, d), 1.0, 1_000_000)
    return run.select("video", "frame", "timestamp_s", "mean_lat", "mean_lon", "set_size", "major_m")


add(
    "t04_video_run",
    _video,
    with_("ell", f"SELECT query_id % 2 AS video, query_id // 100 AS frame, (query_id // 100)/2e0 AS timestamp_s, {r_('mean_lat', 'mean_lat')}, {r_('mean_lon', 'mean_lon')}, set_size, {r_('major_m', 'major_m')} FROM ell WHERE (query_id // 100) % 2 = 0"),
)
