"""Sessions for tests, the bench and the tools (the library itself takes the
session it is given and sets no cluster configuration)."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # pair loops and kernels are CPU-bound per byte: let AQE keep more, smaller
    # partitions on small shuffles (large data is sized by the byte target)
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "vetta") -> SparkSession:
    master = master or os.environ.get("VETTA_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("VETTA_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Settings that only matter for comparisons with other engines.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
