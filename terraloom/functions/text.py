"""Parsing of fields as Spark columns: numbers, capture times, match ids and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import finite


def number(x: Column) -> Column:
    """The finite number that a text holds, else null."""
    return finite(x.try_cast("double"))


def capture_time(x: Column) -> Column:
    """A timestamp from epoch seconds or milliseconds (above 1e10), EXIF text, SQL text or ISO text with Z; else null."""
    epoch = number(x)
    seconds = F.when(F.abs(epoch) > 1e10, epoch / 1000).otherwise(epoch)
    exif = F.regexp_replace(x, r"^(\d{4}):(\d{2}):(\d{2}) ", "$1-$2-$3 ")
    return F.when(epoch.isNotNull(), F.timestamp_seconds(seconds)).otherwise(exif.try_cast("timestamp"))


def posix_path(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"\\", "/")


def base_name(x: Column) -> Column:
    return F.element_at(F.split(posix_path(x), "/"), -1)


def retrieval_id(source: Column, item: Column) -> Column:
    return F.concat_ws(":", F.lit("retrieval"), source, item.cast("string"))
