"""Tables that end a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A session on one machine (tests) may do without: it gets a local folder. Any other must name one, as it can't be set once the session runs."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "/tmp/siltworks-checkpoints"


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: it is evaluated once, however often it is used, and a lost executor costs a reread."""
    path = f"{shared_dir(spark)}/siltworks-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
