"""Reading segment tables: pruned scans, split names, test-set loading,
peeking, optional side tables and saved ensemble weights."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# The text columns the reference keeps (audio is never read).
SEGMENT_COLUMNS = ["audio_path", "doc_id", "src_text", "src_text_system", "src_lang", "tgt_lang",
                   "domain", "tgt_system", "tgt_text", "score"]
REQUIRED_TEST_COLUMNS = ["src_text", "tgt_text"]


def existing_paths(spark: SparkSession, paths) -> list[str]:
    """Keep paths that exist; report the others (listing only, no data)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    keep = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            keep.append(p)
        else:
            log.warning("missing part file skipped: %s", p)
    return keep


def read_segments(spark: SparkSession, paths, want=None, merge_schema: bool = False) -> DataFrame:
    """Union of the given part files, restricted to wanted columns that are
    present; the projection reaches the parquet scan (``ReadSchema``)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = existing_paths(spark, paths)
    if not found:
        raise FileNotFoundError(f"none of {paths} exists")
    df = spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(*found)
    want = SEGMENT_COLUMNS if want is None else want
    return df.select(*[c for c in want if c in df.columns])


def with_split(df: DataFrame) -> DataFrame:
    """``split`` from the file name: ``dev-00000-of-00003.parquet`` -> ``dev``."""
    return df.withColumn("split", F.regexp_extract(F.col("_metadata.file_name"), r"^([^-]+)-", 1))


def load_test_set(spark: SparkSession, paths_by_split: dict) -> DataFrame:
    """The ``test`` split, or the first one listed; requires text columns."""
    name = "test" if "test" in paths_by_split else next(iter(paths_by_split))
    df = spark.read.parquet(*([paths_by_split[name]] if isinstance(paths_by_split[name], str)
                              else paths_by_split[name]))
    missing = [c for c in REQUIRED_TEST_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"test set lacks required columns {missing}")
    return df


def peek(df: DataFrame):
    """First record and the column types, without scanning the table."""
    first = df.limit(1).collect()
    return (first[0].asDict() if first else None), [(f.name, f.dataType.simpleString())
                                                    for f in df.schema.fields]


def attach_side_features(df: DataFrame, side: DataFrame, key: str = "row_id",
                         prefix: str = "", how: str = "left") -> tuple[DataFrame, DataFrame]:
    """Join an optional feature table on the row key instead of by position.
    Returns ``(joined, coverage)`` where coverage holds the matched and
    unmatched row counts (lazy; the caller decides whether to warn)."""
    cols = [c for c in side.columns if c != key]
    s = side.select(key, *[F.col(c).alias(f"{prefix}{c}") for c in cols]).withColumn("_hit", F.lit(1))
    joined = df.join(s, key, how)
    coverage = joined.agg(F.count(F.lit(1)).alias("rows"),
                          F.count("_hit").alias("matched")) \
        .withColumn("unmatched", F.col("rows") - F.col("matched"))
    return joined.drop("_hit"), coverage


def weights_with_default(signals, saved: DataFrame) -> DataFrame:
    """``signal, weight``: the saved weight, or ``1/n`` for a signal without
    one (``n`` = number of signals in use)."""
    spark = saved.sparkSession
    n = len(signals)
    sig = spark.createDataFrame([(s, i) for i, s in enumerate(signals)], "signal string, signal_order int")
    return sig.join(F.broadcast(saved.select("signal", "weight")), "signal", "left").select(
        "signal", "signal_order",
        F.coalesce(F.col("weight").cast("double"), F.lit(1.0 / n)).alias("weight"))


def signal_columns(columns, fixed=None, suffix: str = "_score", gold: str = "score"):
    """Signals by fixed list (those present, in list order) or by suffix."""
    if fixed is not None:
        return [c for c in fixed if c in columns]
    return [c for c in columns if c.endswith(suffix) and c != gold]
