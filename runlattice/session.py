"""Session set-up that the engine needs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it isn't on their path already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
