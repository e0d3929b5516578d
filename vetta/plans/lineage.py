"""Cutting the lineage of tables that a loop writes again and again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Actions inside drop their shuffle files as they end."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that ``spark.checkpoint.dir`` names, without
    its lineage.  A scratch folder is used only by a local session where the
    setting is unset: on a cluster the executors could not read it."""
    _with_folder(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, what: str, file_rows: int) -> DataFrame:
    """``df`` written once as compressed Parquet to that folder and read again: cuts
    the lineage as ``checkpointed`` does, in less room, and leaves no shuffle files.
    A file has at most ``file_rows`` rows."""
    spark = df.sparkSession
    path = f"{_with_folder(spark)}/vetta-{what}-{uuid.uuid4().hex}"
    with releasing(spark):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _with_folder(spark: SparkSession) -> str:
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not spark.conf.get("spark.master", "").startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            path = tempfile.mkdtemp(prefix="vetta-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()
