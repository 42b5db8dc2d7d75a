"""Ingestion that may stop and start again: every id is appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_new(batch: DataFrame, path: str, key: str) -> None:
    """Appends the rows of a batch whose key is not in the table yet, one of each key."""
    spark = batch.sparkSession
    fresh = batch.where(f"{key} is not null").dropDuplicates([key])
    if _exists(spark, path):
        fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti").select(*batch.columns)
    fresh.write.mode("append").parquet(path)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def ingest(source: DataFrame, path: str, checkpoint: str, key: str = "image_id") -> StreamingQuery:
    """A streaming job over what has arrived so far. A batch that is done again after a failure appends nothing twice,
    because its keys are in the table; without a time to wait for, no state grows with the stream."""
    return source.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
