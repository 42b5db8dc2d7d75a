"""Metadata of queries filled from several tables, met by id, path or base name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, posix_path
from .stage import written

#: Fields that hold an id, fields that hold a path, and fields that are filled (fixed values).
IDS = ("image_id", "street_id", "query_id", "id")
PATHS = ("path", "street_path", "image_path", "query_path")
FIELDS = ("captured_at", "capture_time", "datetime", "datetimetz", "DateTimeOriginal", "DateTime", "camera_type", "source", "sequence")


def relative_path(path: Column) -> Column:
    """In lower case, with slashes, without leading ``./``."""
    return F.lower(F.regexp_replace(posix_path(path), r"^(\./)+", ""))


def lookup_keys(columns: Sequence[str]) -> Column:
    """The keys of a row, the surest first: its ids, then its whole paths, then their base names. Blank ones give none."""
    text = lambda names: [F.col(f"`{c}`").cast("string") for c in names if c in columns]
    key = lambda kind, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(kind), x))
    ids, paths = text(IDS), [relative_path(p) for p in text(PATHS)]
    keys = [key("id:", F.trim(i)) for i in ids] + [key("path:", p) for p in paths] + [key("name:", base_name(p)) for p in paths]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def lookup(tables: Sequence[DataFrame], types: dict[str, str], order: str | None = None) -> DataFrame:
    """key, found: for every key the fields of the first table's row that has it; of several rows of that table the
    least by ``order`` (a column), by default by the fields themselves. A value that does not fit the field's type is blank."""
    sides = []
    for n, table in enumerate(tables):
        fields = F.struct(*((F.col(f).cast("string").try_cast(t) if f in table.columns else F.lit(None).cast(t)).alias(f) for f, t in types.items()))
        first = F.col(order).cast("string") if order else F.lit(None).cast("string")
        sides.append(table.select(F.struct(F.lit(n).alias("table"), first.alias("first"), fields.alias("fields")).alias("row"), F.explode(lookup_keys(table.columns)).alias("key")))
    return reduce(DataFrame.unionByName, sides).groupBy("key").agg(F.min("row").alias("row")).select("key", F.col("row.fields").alias("found"))


def enriched(records: DataFrame, tables: Sequence[DataFrame], fields: Sequence[str] = FIELDS, order: str | None = None) -> DataFrame:
    """``records`` with blank ``fields`` (null or empty) filled from the row that the first of a record's keys finds among
    ``tables``, the first table winning; ``changed`` tells whether a field gained. A field that only the tables have is added, as text.

    Only records with a blank field are looked up, as row numbers and keys; a key has one row on the other side, so that a
    base name that many records share joins no pairs, and the engine can split its side of the join. Without tables, or
    where no field is in either, nothing changes. Repeated records stay, each enriched; a column named ``changed`` is replaced."""
    have = [f for f in fields if f in records.columns or any(f in t.columns for t in tables)]
    types = {f: dict(records.dtypes).get(f, "string") for f in have}
    if not tables or not have:
        return records.withColumn("changed", F.lit(False))
    rows = written(records.withColumns({f: F.lit(None).cast("string") for f in have if f not in records.columns} | {"__meta_row": F.monotonically_increasing_id()}), "records")
    blank = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) == "" for f in have}
    asks = rows.where(reduce(Column.__or__, blank.values())).select("__meta_row", F.posexplode(lookup_keys(records.columns)).alias("at", "key"))
    hits = asks.join(lookup(tables, types, order), "key").groupBy("__meta_row").agg(F.min_by("found", "at").alias("__meta_found"))
    gain = {f: blank[f] & (F.coalesce(F.col(f"__meta_found.{f}").cast("string"), F.lit("")) != "") for f in have}
    values = [F.when(gain[c], F.col(f"__meta_found.{c}")).otherwise(F.col(c)).alias(c) if c in gain else F.col(f"`{c}`") for c in rows.columns if c not in ("__meta_row", "changed")]
    return rows.join(hits, "__meta_row", "left").select(*values, reduce(Column.__or__, gain.values()).alias("changed"))
