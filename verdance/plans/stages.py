"""Tables between the steps of an iterative job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, spark.checkpoint.dir; in local mode in one of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='verdance-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a task that is given much work for each.
ROWS_A_TASK = 5000


def spread(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """df in tasks of about so many rows. Scans are cut by bytes, so a small file is one task however many rows it has and however much each costs."""
    return df.repartition(max(1, -(-df.count() // rows)))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet folder at a shared_path().

    Cuts lineage: an iterative job that loses an executor repeats no earlier round."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
