"""The folder that driver and executors share, for tables that one step writes and the next one reads."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="fieldloom-")
    return f"{base.rstrip('/')}/fieldloom-{uuid.uuid4().hex}/{name}"


def written(x: DataFrame, name: str) -> DataFrame:
    """``x`` as a table in the shared folder: read by several steps, made once."""
    path = folder(x.sparkSession, name)
    x.write.parquet(path)
    return x.sparkSession.read.schema(x.schema).parquet(path)
