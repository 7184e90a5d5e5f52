"""A session with the settings that the operators expect."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def build(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on (it coalesces, splits skewed joins and picks broadcasts by measured size), UTC, ANSI.

    On a cluster leave ``master`` to spark-submit.  ``shuffle_partitions`` should put about
    128 MB into a partition; adaptive execution merges what turns out smaller.
    """
    builder = SparkSession.builder.appName("routeloom")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # hash instead of sort joins wherever every measured partition of a side is small
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**settings, **conf}.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def let_workers_import(spark: SparkSession) -> None:
    """Puts this package's folder on the Python path of workers that start from now on.

    Enough where executors see the folder (local mode, a shared file system); elsewhere
    pass the package to spark-submit with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
