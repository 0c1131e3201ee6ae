"""Python workers of this machine find the package. On a cluster it is installed, or given by ``--py-files``."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":")
    if root not in known:
        env["PYTHONPATH"] = ":".join([root, *filter(None, known)])
    return spark
