"""Training rows: labels of documents outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.llm import bloom
from vetta.llm.common import label_fold, staged


def train_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of labelled ids outside the held-out fold; null labels and ids
    are left out, and of several labels of one id the largest counts."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (label_fold(F.col(id_col)) != 1))
    return known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label)).cast("int").alias("y"))


def train_texts(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(id, text, y) of the labelled documents outside the held-out fold.  A
    Bloom filter of the labelled ids (bounded, broadcast) keeps the texts of
    other documents out of the join's shuffle."""
    known = staged(train_labels(labels, label, id_col), "labels")
    bits = bloom.filter_bits(known.count())
    bitmaps = bloom.pages(bloom.cell_rows(known, F.col("id"), bits))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(label_fold(F.col("id")) != 1)
    return bloom.with_hit(texts, "id", bitmaps, bits).where("hit").drop("hit").join(known, "id")
