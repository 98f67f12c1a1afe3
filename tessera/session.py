"""Spark session defaults for the engine."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; ``conf`` wins. On a cluster, master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        defaults |= {"spark.sql.shuffle.partitions": str(os.cpu_count() or 8), "spark.driver.memory": "6g", "spark.ui.enabled": "false"}
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
