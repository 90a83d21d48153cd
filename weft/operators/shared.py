"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session's own checkpoint folder (a cluster would not see one, so there it is an error)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weft-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; the caller may delete it once the result is consumed."""
    return f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write df and read it back: what is written need not be computed again when executors are lost."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
