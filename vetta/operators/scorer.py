"""User-supplied batch scorers and merging a new signal by key.

A scorer is ``make_fn() -> fn`` where ``fn(pandas.DataFrame) -> array`` of
scores for a batch of rows.  ``make_fn`` runs once per task (a model loads
once per task, not per row or per batch), batches stream through Arrow, and
``row_id`` travels with every row so the result joins back by key.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BATCH = 64


def score_with(df: DataFrame, make_fn: Callable, inputs, output: str,
               batch_size: int = DEFAULT_BATCH, key: str = "row_id",
               group_by: str | None = None) -> DataFrame:
    """``key, output`` for every row of ``df``.  With ``group_by`` (e.g. a
    language-pair code) rows are clustered so each batch holds one value,
    for functions that need uniform batches."""
    cols = [key, *inputs] + ([group_by] if group_by and group_by not in inputs else [])
    src = df.select(*cols)
    if group_by:
        # ranges of (value, hash of the row): a frequent value is cut over many
        # tasks, and still lies together inside each
        src = src.repartitionByRange(group_by, F.xxhash64(key)).sortWithinPartitions(group_by)
    schema = T.StructType([src.schema[key], T.StructField(output, T.DoubleType())])

    def run(batches):
        fn = make_fn()
        for pdf in batches:
            groups = [pdf] if not group_by else [g for _, g in pdf.groupby(group_by, sort=False)]
            for g in groups:
                for start in range(0, len(g), batch_size):
                    chunk = g.iloc[start:start + batch_size]
                    vals = np.asarray(fn(chunk), dtype=np.float64)
                    yield pd.DataFrame({key: chunk[key].to_numpy(), output: vals})

    return src.mapInPandas(run, schema)


def length_ratio_scorer():
    """A lexical stand-in for a neural scorer: 100 * shorter / longer text
    length (characters)."""
    def fn(pdf: pd.DataFrame):
        s = pdf["src_text"].fillna("").str.len().to_numpy(dtype=np.float64)
        t = pdf["tgt_text"].fillna("").str.len().to_numpy(dtype=np.float64)
        hi = np.maximum(np.maximum(s, t), 1.0)
        return 100.0 * np.minimum(s, t) / hi
    return fn


def merge_signal(df: DataFrame, scores: DataFrame, key: str = "row_id"):
    """Attach a signal by key (left join) and report coverage lazily:
    ``(merged, checks)`` where checks holds rows, matched rows and whether
    the key is unique in the scores."""
    s = scores.withColumn("_hit", F.lit(1))
    merged = df.join(s, key, "left")
    unique = scores.agg(F.count(F.lit(1)) == F.countDistinct(key)).scalar()
    checks = merged.agg(F.count(F.lit(1)).alias("rows"), F.count("_hit").alias("matched")) \
        .select("rows", "matched", unique.alias("key_unique"))
    return merged.drop("_hit"), checks
