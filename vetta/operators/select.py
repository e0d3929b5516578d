"""Row selection and reshaping: score rescaling, split unions, language-pair
filters and training subset counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The target language pairs of the task.
TARGET_SRC = "en"
TARGET_TGTS = ("de", "zh")


def lp_predicate(src: str = TARGET_SRC, tgts=TARGET_TGTS) -> Column:
    return (F.col("src_lang") == F.lit(src)) & F.col("tgt_lang").isin(*tgts)


def lp_filter(df: DataFrame, src: str = TARGET_SRC, tgts=TARGET_TGTS) -> DataFrame:
    """Rows of the target pairs; a plain predicate, pushed into the scan."""
    return df.filter(lp_predicate(src, tgts))


def lp_complement(df: DataFrame, src: str = TARGET_SRC, tgts=TARGET_TGTS) -> DataFrame:
    """Everything else, rows with a null language included (``NOT pred``
    alone would drop them)."""
    return df.filter(~F.coalesce(lp_predicate(src, tgts), F.lit(False)))


def rescale(df: DataFrame, factor: float, col: str = "score") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("double") * F.lit(float(factor)))


def union_splits(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def subset_counts(train: DataFrame, synthetic: DataFrame, src: str = TARGET_SRC,
                  tgts=TARGET_TGTS, synth_tgts=TARGET_TGTS) -> DataFrame:
    """Rows of the target pairs, of other pairs, and of synthetic rows kept
    for training (synthetic target languages are a parameter)."""
    syn = synthetic.agg(F.count_if(F.coalesce(lp_predicate(src, synth_tgts), F.lit(False)))).scalar()
    return train.agg(F.count_if(F.coalesce(lp_predicate(src, tgts), F.lit(False))).alias("target"),
                     F.count_if(~F.coalesce(lp_predicate(src, tgts), F.lit(False))).alias("other")) \
        .select("target", "other", syn.alias("synthetic"))
