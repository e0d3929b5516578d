"""Helpers shared by the operators: staged tables, table access, constants."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_RUN = r"[\x20\x09-\x0D]+"         # what separates words
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a scratch one
    only where that setting is unset (local runs and tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="vetta-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Actions inside drop their shuffle files as they end."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again:
    cuts the lineage, survives lost executors, computes the input once and
    leaves none of its shuffle files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vetta-{what}-{uuid.uuid4().hex}"
    with releasing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_folders.pop(df))
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character unchanged (a text of one byte
    per character is plain ASCII, where the quicker ``lower`` does the same)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)) \
            .otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; null: 0."""
    parts = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")
    return F.size(parts).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def label_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows where it is 1 are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3, F.lit(1))
