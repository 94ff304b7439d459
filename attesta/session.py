"""A Spark session with the settings that the engine expects."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str | None = None, name: str = "attesta", **conf: str) -> SparkSession:
    """ANSI types, UTC, and adaptive plans; anything in ``conf`` overrides."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def let_workers_import(spark: SparkSession) -> None:
    """Have Python workers look for this package where the driver found it, whatever folder either was started in."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
