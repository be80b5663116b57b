"""Python workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; on a cluster, install it on all nodes."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])
