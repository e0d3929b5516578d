"""Writers: parquet, training CSV, ordered score file, run metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetta.functions.text import clean_text


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def training_rows(df: DataFrame, with_system: bool = False) -> DataFrame:
    """``src, mt, score[, system]`` with the score on a 0-1 scale, rows with
    missing or blank text dropped."""
    cols = [F.col("src_text").alias("src"), F.col("tgt_text").alias("mt"),
            (F.col("score").cast("double") / 100.0).alias("score")]
    if with_system:
        cols.append(F.col("tgt_system").alias("system"))
    out = df.select(*cols).na.drop(subset=["src", "mt", "score"])
    return clean_text(out, ("src", "mt"))


def write_training_csv(df: DataFrame, path: str, with_system: bool = False) -> None:
    training_rows(df, with_system).write.mode("overwrite").option("header", True) \
        .option("escape", '"').csv(path)


@F.pandas_udf(T.StringType())
def fixed6(v: pd.Series) -> pd.Series:
    """``%.6f`` of the exact binary value (C/Python rounding); the JVM
    formatter rounds the shortest decimal form instead, which differs on
    ties.  Arrow-batched, used only for the final text lines."""
    arr = v.to_numpy(dtype=np.float64, na_value=np.nan)
    out = pd.Series(np.char.mod("%.6f", arr), index=v.index, dtype=object)
    out[v.isna().to_numpy()] = None
    return out


def score_lines(df: DataFrame, value: str, order: str) -> DataFrame:
    """One ``%.6f`` line per row, in ``order``; the value must be a double."""
    return df.select(F.col(order).alias("seq"), fixed6(F.col(value).cast("double")).alias("line"))


def write_score_file(df: DataFrame, value: str, order: str, path: str) -> None:
    """Ordered score lines as range-sorted part files: part files in name
    order, concatenated, are the submission (no single writer task)."""
    score_lines(df, value, order).orderBy("seq").select("line") \
        .write.mode("overwrite").text(path)


def run_metadata(df: DataFrame, value: str, signals, method: str, timestamp: str,
                 team: str = "team", system: str = "ensemble-qe") -> DataFrame:
    """One-row summary of a submission (population std, as the reference)."""
    return df.agg(F.count(F.lit(1)).alias("n_test_samples"), F.avg(value).alias("mean"),
                  F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
                  F.max(value).alias("max")).select(
        F.lit(team).alias("team"), F.lit(system).alias("system"),
        F.array(*[F.lit(s) for s in signals]).alias("signals"), F.lit(method).alias("method"),
        F.lit(timestamp).alias("timestamp"), "n_test_samples",
        F.struct("mean", "std", "min", "max").alias("score_stats"))


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
