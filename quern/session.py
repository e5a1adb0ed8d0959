"""Session settings shared by tests, bench and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster the caller brings its own session instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quern")
    settings = dict(DEFAULTS)
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus if cpus != "*" else os.cpu_count() or 8)
    settings["spark.driver.memory"] = os.environ.get("QUERN_DRIVER_MEMORY", "8g")
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
