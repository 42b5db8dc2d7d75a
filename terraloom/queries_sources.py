"""Registered queries of sources in several forms, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import merge
from .plans import overlay as o
from .queries import add, r_, with_
from .sources import enrichment, scan


def _query_records(s, d):
    """Records with blank sources and cameras, and paths written in another way than in the tables."""
    e = o.street_points(s, d)
    path = F.concat(F.lit("./Shots/"), "sequence", F.lit("/"), "image_id", F.lit(".JPG"))
    camera = F.when(F.col("image_id") % 4 == 0, "own")
    return e.select("image_id", path.alias("path"), F.when(F.col("image_id") % 3 == 0, "").otherwise(F.col("source")).alias("source"), camera.alias("camera_type"))


def _metadata_tables(s, d):
    """One by id that knows no camera, one by path, one by base name; all three know some of the same images."""
    e, n = o.street_points(s, d), F.col("image_id")
    one = e.where(n % 5 == 0).select("image_id", F.lit("one").alias("source"), F.lit("").alias("camera_type"))
    path = F.concat(F.lit("shots\\"), "sequence", F.lit("\\"), n, F.lit(".jpg"))
    two = e.where(n % 2 == 0).select(path.alias("image_path"), F.concat(F.lit("two-"), "source").alias("source"), F.lit("two").alias("camera_type"))
    named = F.when(n % 7 == 0, F.concat(F.lit("other/"), n, F.lit(".jpg")))
    three = e.where((n % 7 == 0) | (n % 10 == 0)).select(F.when(n % 10 == 0, n).alias("id"), named.alias("path"), F.lit("three").alias("camera_type"))
    return [one, two, three]


def _enriched(s, d):
    out = enrichment.enriched(_query_records(s, d), _metadata_tables(s, d))
    return out.select("image_id", "source", "camera_type", "changed")


add("s14_query_metadata", _enriched, with_("sp", """
SELECT image_id, CASE WHEN gains_source THEN found_source ELSE own_source END AS source,
  CASE WHEN gains_camera THEN found_camera ELSE own_camera END AS camera_type, gains_source OR gains_camera AS changed
FROM (
  SELECT *, own_source = '' AND found_source IS NOT NULL AS gains_source, own_camera IS NULL AND found_camera IS NOT NULL AS gains_camera
  FROM (
    SELECT image_id, CASE WHEN image_id % 3 = 0 THEN '' ELSE source END AS own_source, CASE WHEN image_id % 4 = 0 THEN 'own' END AS own_camera,
      CASE WHEN image_id % 5 = 0 THEN 'one' WHEN image_id % 2 = 0 THEN 'two-' || source END AS found_source,
      CASE WHEN image_id % 5 = 0 THEN NULL WHEN image_id % 2 = 0 THEN 'two' WHEN image_id % 7 = 0 THEN 'three' END AS found_camera
    FROM sp))"""))  # fmt: skip


def _keyed(s, d):
    """An object per image with a later one for every third; some hold no coordinates."""
    e = o.street_points(s, d)
    place = F.when(F.col("image_id") % 13 != 0, F.struct(F.col("lat").alias("latitude"), "lon", F.col("source").alias("group")))
    late = F.struct((F.col("lat") + 1).alias("lat"), F.col("lon").alias("longitude"))
    text = lambda value: F.to_json(F.create_map(F.concat(F.lit("img-"), "image_id"), value))
    texts = e.select(F.lit(0).alias("n"), text(place).alias("text")).unionAll(e.where("image_id % 3 = 0").select(F.lit(1).alias("n"), text(late).alias("text")))
    return scan.keyed_truth(texts, "text", "n")


add("s03_keyed_objects", _keyed, with_("sp", f"""
SELECT 'img-' || image_id AS image, {r_("CASE WHEN image_id % 3 = 0 THEN lat + 1 ELSE lat END", "lat")}, {r_("lon", "lon")},
  CASE WHEN image_id % 3 = 0 THEN 'ungrouped' ELSE source END AS grp
FROM sp WHERE image_id % 3 = 0 OR image_id % 13 <> 0"""))  # fmt: skip


def _merged(s, d):
    """A part of an index, then all of it in reverse order under longer ids for every fifth row."""
    one = o.geo_index(s, d).select("lat", "lon", "embedding", F.col("item_id").alias("n"), F.concat(F.lit("i"), "item_id").alias("match_id"), F.lit("chips").alias("path"))
    two = one.withColumns({"match_id": F.when(F.col("n") % 5 == 0, F.concat("match_id", F.lit("b"))).otherwise(F.col("match_id")), "n": -F.col("n")})
    return merge.merge_indices([one.where("n % 3 <> 0"), two], "n").select("match_id", "path", "origin", "lat", "lon")


add("g05_merged_indices", _merged, with_("gi", f"""
SELECT match_id, 'chips' AS path, min(origin) AS origin, {r_("min(lat)", "lat")}, {r_("min(lon)", "lon")} FROM (
  SELECT 'i' || item_id AS match_id, 0 AS origin, lat, lon FROM gi WHERE item_id % 3 <> 0
  UNION ALL SELECT 'i' || item_id || CASE WHEN item_id % 5 = 0 THEN 'b' ELSE '' END, 1, lat, lon FROM gi)
GROUP BY match_id"""))  # fmt: skip
