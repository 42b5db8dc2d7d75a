"""Tables that cut lineage: between the rounds of an iterative operator, and after costly passes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir. Where that is unset, a local session takes a temporary one;
    on a cluster each executor would write such a folder on its own disk, so that it is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="terraloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/terraloom-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written once to the shared folder and read back: it survives the loss of executors, and a costly pass
    does not run once for each later use."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Deletes the files of a table that ``written`` gave, once nothing that is still to run reads it."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files and files[0].rsplit("/", 1)[0].find(f"/terraloom-{spark.sparkContext.applicationId}/") > 0:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
