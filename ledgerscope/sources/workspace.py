"""Places for intermediate tables.

Tables stay until the folder is emptied: a lost executor, or a restarted stream, may read them again. Empty it when no
job runs.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that all runs share, under the shared folder of the cluster, which the session must name."""
    base = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError(f"{CHECKPOINT_SETTING} is not set")
    return f"{base.rstrip('/')}/{name}"


def workspace(spark: SparkSession, name: str) -> str:
    """A folder name that was not used before."""
    return f"{shared_folder(spark, name)}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the workspace and read it back: the plan before it is cut off."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table can be read there."""
    try:
        spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True
