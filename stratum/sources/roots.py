"""Where temporary roots go: the folder of ``spark.checkpoint.dir``, or a fresh local one where it is unset."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession, name: str) -> str:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{(shared or tempfile.mkdtemp(prefix='stratum-')).rstrip('/')}/roots/{name}-{uuid.uuid4().hex}"
