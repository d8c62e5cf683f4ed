"""Tables cut from their lineage, in the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolderError(RuntimeError):
    """The session names no folder that all executors see."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A temporary one only where there is none and one machine runs all."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise NoSharedFolderError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/twinsift-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again, so that iterative plans stay short and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
